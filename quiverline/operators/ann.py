"""Approximate nearest neighbours: inverted lists, hashing, and sharded proximity graphs.

All take ``search(query, k, ef, where)`` with the filter applied to candidates
exactly, before the cut to ``k``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from quiverline.functions import distance as D
from quiverline.operators.search import as_condition, knn, nearest_of_blocks
from quiverline.plans.filters import Filter
from quiverline.types import Metric

#: Cells that a search reads of the 16 by default: recall over 0.9 on vectors without clusters.
NPROBE = 11


class IvfIndex:
    """Rows dealt to the nearest of ``cells`` centroids; a search reads ``nprobe`` cells.

    ``save`` partitions by cell, so the probe list prunes directories.
    """

    def __init__(self, rows: DataFrame, centroids: np.ndarray, metric: Metric, id_col: str, vec_col: str):
        self.rows, self.centroids, self.metric, self.id_col, self.vec_col = rows, centroids, metric, id_col, vec_col

    @classmethod
    def build(cls, df: DataFrame, cells: int = 16, metric: Metric | str = Metric.EUCLIDEAN, seed: int = 1, id_col: str = "id", vec_col: str = "vector", train_rows: int = 100_000) -> IvfIndex:
        """Centroids come from at most about ``train_rows`` rows; every row is indexed."""
        metric = Metric.of(metric)
        unit = metric in (Metric.COSINE, Metric.DOT)
        n = df.count()
        some = df.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_rows / max(n, 1))) + 1)
        some = some.where(D.norm(F.col(vec_col)) > 0) if unit else some
        model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine" if unit else "euclidean").fit(some.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features")))
        centroids = np.array(model.clusterCenters())
        return cls(df.withColumn("cell", _nearest_cell(centroids, metric, F.col(vec_col))), centroids, metric, id_col, vec_col)

    def save(self, path: str) -> IvfIndex:
        self.rows.repartition("cell").write.partitionBy("cell").parquet(path)
        return IvfIndex(self.rows.sparkSession.read.parquet(path), self.centroids, self.metric, self.id_col, self.vec_col)

    def probes(self, query: Sequence[float], nprobe: int) -> list[int]:
        d = D.block_distances(_cell_metric(self.metric), self.centroids, np.array([query], dtype=float))[:, 0]
        return [int(i) for i in np.argsort(d, kind="stable")[:nprobe]]

    def search(self, query: Sequence[float], k: int, nprobe: int = NPROBE, where: Filter | Column | None = None, columns: Sequence[str] = ()) -> DataFrame:
        rows = self.rows.where(F.col("cell").isin(self.probes(query, nprobe)))
        return knn(rows, query, k, self.metric, where, self.id_col, self.vec_col, columns)

    def search_batch(self, queries: DataFrame, k: int, nprobe: int = NPROBE, where: Filter | Column | None = None, qid_col: str = "qid", qvec_col: str = "qv") -> DataFrame:
        """``qid``, ``id``, ``distance``, ``rank``: :meth:`search` for every query, the rows read once for a block of them."""
        rows = self.rows if (cond := as_condition(where)) is None else self.rows.where(cond)
        rows = rows.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.vec_col).alias("v"), F.col("cell").alias("key"))
        some = queries.select(qid_col, qvec_col).where(F.size(qvec_col) == self.centroids.shape[1])
        return nearest_of_blocks(rows, some, k, self.metric, self.id_col, qid_col, lambda vectors: _Probed(np.argsort(D.block_distances(_cell_metric(self.metric), self.centroids, vectors), axis=0, kind="stable")[:nprobe].T))


@dataclass
class _Probed:
    """Pairs of a row and a query that probes the row's cell."""

    probes: np.ndarray

    def __call__(self, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        for cell in np.unique(cells):
            yield (cells == cell).nonzero()[0], (self.probes == cell).any(axis=1).nonzero()[0], None


def _cell_metric(metric: Metric) -> Metric:
    return Metric.COSINE if metric in (Metric.COSINE, Metric.DOT) else Metric.EUCLIDEAN


def _nearest_cell(centroids: np.ndarray, metric: Metric, vec: Column) -> Column:
    @F.pandas_udf("int")
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        d = D.block_distances(_cell_metric(metric), np.stack(vectors.to_list()).astype(float), centroids)
        return pd.Series(d.argmin(axis=1).astype("int32"))

    return run(vec)


class LshIndex:
    """Random projections of Euclidean space (of unit vectors for cosine)."""

    def __init__(self, df: DataFrame, tables: int = 8, bucket: float = 0.5, metric: Metric | str = Metric.EUCLIDEAN, seed: int = 1, id_col: str = "id", vec_col: str = "vector"):
        self.metric, self.id_col, self.vec_col = Metric.of(metric), id_col, vec_col
        if self.metric not in (Metric.EUCLIDEAN, Metric.COSINE):
            raise ValueError("hashing is for euclidean and cosine")
        features = self._features(df, vec_col)
        self.model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=bucket, seed=seed).fit(features)
        self.rows = self.model.transform(features)

    def _features(self, df: DataFrame, vec_col: str) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        return df.withColumn("features", array_to_vector(F.coalesce(D.normalized(F.col(vec_col)), v) if self.metric is Metric.COSINE else v))

    def search(self, query: Sequence[float], k: int, where: Filter | Column | None = None, columns: Sequence[str] = ()) -> DataFrame:
        """The exact nearest among rows that share a bucket with the query in some table."""
        q = np.array(query, dtype=float)
        if self.metric is Metric.COSINE and np.linalg.norm(q):
            q = q / np.linalg.norm(q)
        spark = self.rows.sparkSession
        hashes = self.model.transform(spark.createDataFrame([(q.tolist(),)], "v array<double>").select(array_to_vector("v").alias("features"))).first()["hashes"]
        near = F.lit(False)
        for i, h in enumerate(hashes):
            near = near | (vector_to_array(F.col("hashes")[i])[0] == float(h[0]))
        return knn(self.rows.where(near), query, k, self.metric, where, self.id_col, self.vec_col, columns)

    def search_batch(self, queries: DataFrame, k: int, where: Filter | Column | None = None, qid_col: str = "qid", qvec_col: str = "qv") -> DataFrame:
        """``qid``, ``id``, ``distance``, ``rank``: :meth:`search` for every query, the rows read once for a block of them."""
        one = self.rows.select(F.size(self.vec_col)).first()
        hashed = self.model.transform(self._features(queries.where(F.size(qvec_col) == (one[0] if one else -1)), qvec_col))
        rows = self.rows if (cond := as_condition(where)) is None else self.rows.where(cond)
        rows = rows.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.vec_col).alias("v"), _buckets().alias("key"))
        return nearest_of_blocks(rows, hashed.select(qid_col, qvec_col, _buckets()), k, self.metric, self.id_col, qid_col, _ShareBucket)


def _buckets() -> Column:
    """The bucket in each table."""
    return F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)))


@dataclass
class _ShareBucket:
    """Pairs of a row and a query that share a bucket in some table."""

    of_queries: np.ndarray

    def __call__(self, of_rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        which = np.zeros((len(of_rows), len(self.of_queries)), dtype=bool)
        for table in range(self.of_queries.shape[1]):
            which |= of_rows[:, table, None] == self.of_queries[None, :, table]
        row, of = which.any(axis=1).nonzero()[0], which.any(axis=0).nonzero()[0]
        yield row, of, which[np.ix_(row, of)]


@dataclass(frozen=True)
class AnnConfig:
    """``m`` neighbours a node (twice that in the bottom layer), beams of ``ef_construction`` and ``ef_search``."""

    m: int = 16
    ef_construction: int = 100
    ef_search: int = 50
    seed: int = 1

    def __post_init__(self):
        if self.m < 2:
            raise ValueError("m must be 2 or more")


class _Graph:
    """A layered proximity graph in memory (Malkov and Yashunin 2018) over one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, metric: Metric, config: AnnConfig):
        self.ids, self.v, self.metric, self.config = ids, vectors, metric, config
        u = np.array([((int(i) * 0x9E3779B97F4A7C15 + config.seed * 0xBF58476D1CE4E5B9) >> 11) % (1 << 53) for i in ids], dtype=float) / float(1 << 53)
        self.levels = np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(config.m)).astype(int) if len(ids) else np.zeros(0, int)
        self.links: list[dict[int, list[int]]] = []
        self.entry = -1
        for i in range(len(ids)):
            self._insert(i)

    @classmethod
    def stored(cls, ids: np.ndarray, vectors: np.ndarray, links: list[list[list[int]]], entry: int, metric: Metric, config: AnnConfig) -> _Graph:
        """A graph that was built before: the links of each node by layer."""
        out = cls.__new__(cls)
        out.ids, out.v, out.metric, out.config, out.entry = ids, vectors, metric, config, entry
        out.links = [dict(enumerate(own)) for own in links]
        out.levels = np.array([len(own) - 1 for own in links])
        return out

    def _d(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        return D.block_distances(self.metric, self.v[at], q[None, :])[:, 0]

    def beam(self, q: np.ndarray, start: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        seen = set(start)
        near = list(zip(self._d(q, start).tolist(), start, strict=True))
        heap, best = list(near), [(-d, i) for d, i in near]
        heapq.heapify(heap)
        heapq.heapify(best)
        while heap:
            d, i = heapq.heappop(heap)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [j for j in self.links[i].get(layer, ()) if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for dj, j in zip(self._d(q, fresh).tolist(), fresh, strict=True):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(heap, (dj, j))
                    heapq.heappush(best, (-dj, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _insert(self, i: int) -> None:
        level = int(self.levels[i])
        self.links.append({layer: [] for layer in range(level + 1)})
        if self.entry < 0:
            self.entry = i
            return
        q, top = self.v[i], int(self.levels[self.entry])
        start = [self.entry]
        for layer in range(top, level, -1):
            start = [self.beam(q, start, 1, layer)[0][1]]
        for layer in range(min(level, top), -1, -1):
            found = self.beam(q, start, self.config.ef_construction, layer)
            most = self.config.m * (2 if layer == 0 else 1)
            self.links[i][layer] = [j for _, j in found[:most]]
            for j in self.links[i][layer]:
                own = self.links[j].setdefault(layer, [])
                own.append(i)
                if len(own) > most:
                    order = np.argsort(self._d(self.v[j], own), kind="stable")[:most]
                    self.links[j][layer] = [own[o] for o in order]
            start = [j for _, j in found]
        if level > top:
            self.entry = i

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = [self.entry]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            start = [self.beam(q, start, 1, layer)[0][1]]
        return self.beam(q, start, ef, 0)


class GraphIndex:
    """A graph for each shard of about ``shard_rows`` rows; a search asks every shard and merges.

    Graphs are made from a shard's rows when it is searched; ``tombstones`` (ids)
    leave the candidates.
    """

    def __init__(self, df: DataFrame, metric: Metric | str = Metric.EUCLIDEAN, config: AnnConfig | None = None, id_col: str = "id", vec_col: str = "vector", shard_rows: int = 20_000):
        self.metric, self.config, self.id_col, self.vec_col = Metric.of(metric), config or AnnConfig(), id_col, vec_col
        self.shards = max(1, -(-df.count() // shard_rows))
        self.rows = df.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(self.shards)).cast("int"))

    def search_batch(self, queries: Sequence[tuple[int, Sequence[float]]], k: int, ef: int | None = None, where: Filter | Column | None = None, tombstones: DataFrame | None = None) -> DataFrame:
        """``qid``, ``id``, ``distance``, ``rank``; the filter applies to the beam's rows, so fewer than ``k`` may be left."""
        from pyspark.sql import Window

        beam = max(ef or self.config.ef_search, k)
        metric, config, many = self.metric, self.config, [(int(i), np.array(q, dtype=float)) for i, q in queries]

        def shard(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            out = []
            if len(pdf):
                graph = _Graph(pdf["id"].to_numpy(), np.stack(pdf["v"].to_list()).astype(float), metric, config)
                ok = pdf["ok"].to_numpy()
                for qid, q in many:
                    if graph.v.shape[1] == len(q):
                        out += [(qid, int(graph.ids[i]), d) for d, i in graph.search(q, beam) if ok[i]]
            return pd.DataFrame(out, columns=["qid", "id", "distance"])

        condition = as_condition(where)
        rows = self.rows.select("shard", F.col(self.id_col).cast("long").alias("id"), F.col(self.vec_col).alias("v"), (condition if condition is not None else F.lit(True)).alias("ok"))
        found = rows.groupBy("shard").applyInPandas(shard, "qid long, id long, distance double")
        if tombstones is not None:
            found = found.join(tombstones.select("id"), "id", "left_anti")
        w = Window.partitionBy("qid").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def search_with_ids(self, queries, k: int, ids: DataFrame, ef: int | None = None) -> DataFrame:
        """Only rows whose id is in ``ids`` (of a bitmap query) may be found; they are chosen before the search, which keeps recall."""
        only = GraphIndex.__new__(GraphIndex)
        only.metric, only.config, only.id_col, only.vec_col, only.shards = self.metric, self.config, self.id_col, self.vec_col, self.shards
        only.rows = self.rows.join(ids.select(F.col("id").alias(self.id_col)), self.id_col, "left_semi")
        return only.search_batch(queries, k, ef)


def recall_at_k(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """``qid``, ``recall``: the share of a query's exact ids that were found."""
    hits = exact.select("qid", "id").join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hits.groupBy("qid").agg((F.coalesce(F.sum("hit"), F.lit(0)) / k).alias("recall"))


def selectivity(df: DataFrame, where: Filter | Column) -> DataFrame:
    """``selectivity``: the share of rows that match."""
    return df.agg(F.avg(as_condition(where).cast("int")).alias("selectivity"))
