"""Exact nearest neighbours: single queries by expressions, batches by matrix blocks."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quiverline.functions import distance as D
from quiverline.plans.filters import Filter
from quiverline.types import Metric

#: Queries that are sent to the tasks at once; more go in further blocks.
QUERY_BLOCK = 2048
#: Bytes of queries that :func:`knn_batch_expr` broadcasts at once.
QUERY_BYTES = 32 << 20
#: So many dimensions of queries, of at most so many values, are written out as columns.
WRITTEN, WRITTEN_SIZE = 4, 256
#: One row in so many is used for the bounds of queries.
BOUND_PART = 16


def as_condition(where: Filter | Column | None) -> Column | None:
    return where.column() if isinstance(where, Filter) else where


def knn(df: DataFrame, query: Sequence[float], k: int, metric: Metric | str = Metric.COSINE, where: Filter | Column | None = None, id_col: str = "id", vec_col: str = "vector", columns: Sequence[str] = ()) -> DataFrame:
    """``id``, ``columns``, ``distance`` of the ``k`` nearest rows; ties by id.

    The filter comes before the distance; a query of another dimension finds
    nothing. The plan is one TakeOrderedAndProject: each task keeps ``k`` rows.
    """
    if (cond := as_condition(where)) is not None:
        df = df.where(cond)
    rows = df.where(F.size(vec_col) == len(query)).select(id_col, *columns, D.rank_key(metric, F.col(vec_col), query).alias("_rank"))
    return rows.orderBy("_rank", id_col).limit(max(0, k)).select(id_col, *columns, D.from_rank_key(metric, F.col("_rank")).alias("distance"))


def knn_post_filter(df: DataFrame, query: Sequence[float], k: int, ef: int, where: Filter | Column, metric: Metric | str = Metric.COSINE, id_col: str = "id", vec_col: str = "vector", columns: Sequence[str] = ()) -> DataFrame:
    """The ``max(ef, k)`` nearest rows first, then the filter: may give fewer than ``k`` rows."""
    condition = as_condition(where)
    hits = knn(df.withColumn("_ok", condition), query, max(ef, k), metric, None, id_col, vec_col, [*columns, "_ok"])
    return hits.where("_ok").drop("_ok").orderBy("distance", id_col).limit(k)


def knn_batch(df: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, where: Filter | Column | None = None, id_col: str = "id", vec_col: str = "vector", qid_col: str = "qid", qvec_col: str = "qv") -> DataFrame:
    """``qid``, ``id``, ``distance``, ``rank`` of the ``k`` nearest rows of each query.

    Queries go out in blocks of at most ``QUERY_BLOCK``; a task keeps ``k`` rows of
    each query over all its batches (a matrix product each), and only those are
    shuffled, by the query.
    """
    if (cond := as_condition(where)) is not None:
        df = df.where(cond)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return nearest_of_blocks(rows, queries.select(qid_col, qvec_col), k, Metric.of(metric), id_col, qid_col)


#: For a block's queries: takes what a batch's rows have in ``key``; gives their candidates as numbers of rows, numbers of queries, and which pairs of these (``None``: all). No pair may come twice.
Candidates = Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]]


def nearest_of_blocks(rows: DataFrame, queries: DataFrame, k: int, metric: Metric, id_col: str = "id", qid_col: str = "qid", among: Callable[[np.ndarray], Candidates] | None = None) -> DataFrame:
    """The nearest ``rows`` (``id``, ``v``) of all ``queries`` (id, vector).

    With ``among``, rows have a third column and queries may have one; ``among`` gets
    the vectors of a block, or their third columns, and says which pairs are compared.
    """
    found = None
    for ids, vectors, keys in _blocks(queries):
        part = _nearest(rows, ids, vectors, k, metric, among(vectors if keys is None else keys) if among else None)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"{qid_col} long, {id_col} long, distance double, rank int")
    w = Window.partitionBy("qid").orderBy("distance", "id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("qid").alias(qid_col), F.col("id").alias(id_col), "distance", "rank")


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Blocks of queries of one dimension each."""

    def block(own: list) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        return np.array([x[0] for x in own]), np.array([x[1] for x in own], dtype=np.float64), np.array([x[2] for x in own]) if len(own[0]) > 2 else None

    held: dict[int, list] = {}
    for r in queries.toLocalIterator():
        own = held.setdefault(len(r[1]), [])
        own.append(r)
        if len(own) == QUERY_BLOCK:
            yield block(own)
            own.clear()
    for own in held.values():
        if own:
            yield block(own)


class _Best:
    """The ``k`` nearest rows so far of each of ``n`` queries; ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.q, self.i, self.d = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: No row farther than this belongs to a query; NaN: nothing is known.
        self.bound = np.full(n, np.nan)

    def add(self, ids: np.ndarray, of: np.ndarray, d: np.ndarray, which: np.ndarray | None) -> None:
        """Distances ``d`` of rows to the queries numbered ``of``; ``which`` of them count."""
        bound = self.bound[of]
        if (open_ := np.isnan(bound)).any() and len(d) >= self.k:
            some = d[:, open_] if which is None else np.where(which[:, open_], d[:, open_], np.nan)
            bound[open_] = np.partition(some, self.k - 1, axis=0)[self.k - 1]
        near = (d <= bound) | np.isnan(bound)
        row, query = np.nonzero(near if which is None else near & which)
        if not len(row):
            return
        q, i, d = np.concatenate([self.q, of[query]]), np.concatenate([self.i, ids[row]]), np.concatenate([self.d, d[row, query]])
        order = np.lexsort((i, d, q))
        q, i, d = q[order], i[order], d[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        kept = rank < self.k
        self.q, self.i, self.d = q[kept], i[kept], d[kept]
        last = rank[kept] == self.k - 1
        self.bound[self.q[last]] = self.d[last]


def _nearest(rows: DataFrame, qids: np.ndarray, queries: np.ndarray, k: int, metric: Metric, candidates: Candidates | None = None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((qids, queries, candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, pairs = sent.value
        best, all_q = _Best(len(q), k), np.arange(len(q))
        for batch in batches:
            lists = batch.column(1)
            fits = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), q.shape[1]), False))
            if not fits.any() or k <= 0:
                continue
            batch = batch.filter(pa.array(fits))
            own = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            keys = np.array(batch.column(2).to_pylist()) if pairs else None
            for low in range(0, len(v), 4096):
                at = np.arange(low, min(low + 4096, len(v)))
                for row, of, which in pairs(keys[at]) if pairs else [(np.arange(len(at)), all_q, None)]:
                    if len(row) and len(of):
                        best.add(own[at[row]], of, D.block_distances(metric, v[at[row]], q[of]), which)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.q].astype(np.int64)), pa.array(best.i.astype(np.int64)), pa.array(best.d)], names=["qid", "id", "distance"])

    return rows.mapInArrow(run, "qid long, id long, distance double")


def knn_batch_expr(df: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.COSINE, id_col: str = "id", vec_col: str = "vector", qid_col: str = "qid", qvec_col: str = "qv") -> DataFrame:
    """:func:`knn_batch` by expressions alone.

    The dimensions of most queries are written out as a column for each value, others
    go by functions of arrays. Queries stay off the driver; blocks of at most
    ``QUERY_BYTES`` are broadcast. Every pair is compared, but only those reach the
    sort that aren't beyond the query's bound (:func:`_with_bound`).
    """
    metric = Metric.of(metric)
    rows = df.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"))
    many = queries.select(F.col(qid_col).alias("_qid"), F.col(qvec_col).alias("_qv")).where(F.size("_qv") >= 0)
    counts = {r["n"]: r["count"] for r in many.groupBy(F.size("_qv").alias("n")).count().orderBy(F.desc("count"), "n").limit(WRITTEN).collect() if 0 < r["n"] <= WRITTEN_SIZE}
    parts = []
    for size, n in counts.items():
        blocks = -(-n * size * 8 // QUERY_BYTES)
        for block in range(blocks):
            some = many.where((F.size("_qv") == size) & (F.pmod(F.xxhash64("_qid"), F.lit(blocks)) == block))
            parts.append(_near_by_columns(rows.where(F.size("_v") == size), some, size, k, metric))
    rest = many.where(~F.size("_qv").isin(list(counts)))
    size, n = rest.agg(F.coalesce(F.sum(F.size("_qv")), F.lit(0)), F.count("*")).first()
    if n:
        blocks = max(1, -(-size * 8 // QUERY_BYTES))
        for block in range(blocks):
            some = rest.where(F.pmod(F.xxhash64("_qid"), F.lit(blocks)) == block)
            parts.append(rows.join(F.broadcast(some), F.size("_v") == F.size("_qv")).select("_qid", "_id", D.distance(metric, F.col("_v"), F.col("_qv")).alias("distance")))
    found = functools.reduce(DataFrame.unionByName, parts) if parts else rows.crossJoin(many).select("_qid", "_id", F.lit(0.0).alias("distance"))
    w = Window.partitionBy("_qid").orderBy("distance", "_id")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("_qid").alias(qid_col), F.col("_id").alias(id_col), "distance", "rank")


def _near_by_columns(rows: DataFrame, queries: DataFrame, size: int, k: int, metric: Metric) -> DataFrame:
    """Pairs of a row and a query of ``size`` values that aren't beyond the query's bound."""

    def value(vec: str, i: int) -> Column:
        x = F.get(vec, F.lit(i))
        return F.coalesce((x > 0.5).cast("int") if metric is Metric.HAMMING else x, F.lit(0 if metric is Metric.HAMMING else float("nan"))).cast("double")

    def flat(df: DataFrame, own: str, vec: str, to: str) -> DataFrame:
        norm = [F.coalesce(D.norm(F.col(vec)), F.lit(float("nan"))).alias(f"{to}norm")] if metric is Metric.COSINE else []
        return df.select(own, *norm, *(value(vec, i).alias(f"{to}{i}") for i in range(size)))

    def total(of: Callable[[Column, Column], Column]) -> Column:
        terms = [of(F.col(f"a{i}"), F.col(f"b{i}")) for i in range(size)]
        return functools.reduce(operator.add, [functools.reduce(operator.add, terms[low : low + 16]) for low in range(0, size, 16)])

    if metric in (Metric.COSINE, Metric.DOT):
        dot = total(lambda a, b: a * b)
        both = F.col("anorm") * F.col("bnorm")
        d = -dot if metric is Metric.DOT else F.when(both == 0, F.lit(1.0)).otherwise(1 - dot / both)
    else:
        square = total(lambda a, b: (a - b) * (a - b))
        d = F.sqrt(square) if metric is Metric.EUCLIDEAN else square
    context = rows.sparkSession
    tasks = max(4 * context.sparkContext.defaultParallelism, int(context.conf.get("spark.sql.shuffle.partitions")))
    # Dealt out after the columns are made: within one stage, they would be made again for each pair.
    rows, queries = flat(rows, "_id", "_v", "a").repartition(tasks), flat(queries, "_qid", "_qv", "b")
    pairs = rows.crossJoin(F.broadcast(_with_bound(rows, queries, d, max(1, k))))
    return pairs.where(F.col("bound").isNull() | ~(d > F.col("bound"))).select("_qid", "_id", d.alias("distance"))


def _with_bound(rows: DataFrame, queries: DataFrame, d: Column, k: int) -> DataFrame:
    """Queries with ``bound``: at least ``k`` rows are no farther; null if that isn't known.

    A part of the rows is dealt into ``k`` groups; the nearest rows of the groups are
    ``k`` rows, and the farthest of these gives the bound.
    """
    some = rows.where(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(BOUND_PART)) == 0).withColumn("part", F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(k)))
    least = some.crossJoin(F.broadcast(queries)).groupBy("_qid", "part").agg(F.min(d).alias("least"))
    bounds = least.groupBy("_qid").agg(F.when(F.count("*") == k, F.max("least")).alias("bound"))
    return queries.join(bounds, "_qid", "left")
