"""A graph index that is stored and can change.

Rows are dealt to shards, and each shard's graph is built once and written as rows
(id, vector, links of each layer). ``insert`` adds shards, so a change costs what it
adds; ``delete`` writes the ids. A search reads the stored links, walks each shard
on its own and merges. ``meta.json`` names the parts, so a write that didn't end
leaves no trace. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from quiverline.operators.ann import AnnConfig, _Graph
from quiverline.operators.search import as_condition
from quiverline.plans.filters import Filter
from quiverline.sources.collection import validated
from quiverline.sources.files import Store
from quiverline.types import CollectionError, DimensionMismatch, DuplicateId, Metric

NODES = "part int, shard int, entry boolean, place int, id long, v array<double>, links array<array<int>>, payload string"


class StoredGraph:
    """``open_or_create`` an index in a folder; ids are unique, and one that was deleted may come back."""

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta, self.store = spark, path.rstrip("/"), meta, Store(spark, path)
        self.metric, self.dimension, self.config = Metric.of(meta["metric"]), meta["dimension"], AnnConfig(**meta["config"])

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, dimension: int, metric: Metric | str = Metric.EUCLIDEAN, config: AnnConfig | None = None, shard_rows: int = 20_000) -> StoredGraph:
        store, config = Store(spark, path), config or AnnConfig()
        if store.exists("meta.json"):
            meta = json.loads(store.read("meta.json"))
            if meta["dimension"] != dimension:
                raise DimensionMismatch(meta["dimension"], dimension)
            if meta["metric"] != Metric.of(metric).value:
                raise CollectionError(f"the index's metric is {meta['metric']}, not {Metric.of(metric).value}")
            return cls(spark, path, meta)
        store.make()
        own = {"m": config.m, "ef_construction": config.ef_construction, "ef_search": config.ef_search, "seed": config.seed}
        out = cls(spark, path, {"dimension": dimension, "metric": Metric.of(metric).value, "config": own, "shard_rows": shard_rows, "next": 1, "parts": [], "deletes": []})
        out._save()
        return out

    def _save(self) -> None:
        self.store.write("meta.json", json.dumps(self.meta))

    def _tables(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}-{i}" for i in self.meta["parts" if kind == "part" else "deletes"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        """All stored nodes and ``live``: deletes count for parts that are older than they are."""
        gone = self._tables("delete", "part int, id long").groupBy("id").agg(F.max("part").alias("gone"))
        return self._tables("part", NODES).join(gone, "id", "left").withColumn("live", F.coalesce(F.col("part") > F.col("gone"), F.lit(True))).drop("gone")

    def rows(self) -> DataFrame:
        """``id``, ``vector``, ``payload`` of the vectors there are."""
        return self.nodes().where("live").select("id", F.col("v").alias("vector"), "payload")

    def insert(self, df: DataFrame, id_col: str = "id", vec_col: str = "vector", payload_col: str | None = None) -> None:
        """Add rows, all or none. Ids that are there, or that repeat, raise ``DuplicateId``; bad vectors fail before anything counts."""
        rows = validated(df, self.dimension, vec_col, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), (F.col(payload_col) if payload_col else F.lit(None)).cast("string").alias("payload"))
        twice = rows.select("id").unionByName(self.rows().select("id")).groupBy("id").count().where("count > 1").first()
        if twice:
            raise DuplicateId(f"id {twice['id']} is there already")
        number, metric, config = self.meta["next"], self.metric, self.config
        shards = max(1, -(-rows.count() // self.meta["shard_rows"]))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            g = _Graph(pdf["id"].to_numpy(), np.stack(pdf["v"].to_list()).astype(float), metric, config)
            links = [[own.get(layer, []) for layer in range(max(own, default=0) + 1)] for own in g.links]
            return pd.DataFrame({"part": number, "shard": pdf["shard"], "entry": [i == g.entry for i in range(len(g.ids))], "place": range(len(g.ids)), "id": g.ids, "v": pdf["v"].to_list(), "links": links, "payload": pdf["payload"].to_list()})

        placed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
        placed.groupBy("shard").applyInPandas(build, NODES).write.mode("overwrite").parquet(f"{self.path}/part-{number}")
        self.meta["parts"].append(number)
        self._next()

    def _next(self) -> None:
        self.meta["next"] += 1
        self._save()

    def delete(self, ids: DataFrame | Sequence[int]) -> int:
        """Delete the given ids; the number of those that were there. Their nodes still lead a search on, but aren't found."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        number = self.meta["next"]
        there = self.rows().select("id").join(ids.select(F.col("id").cast("long")).distinct(), "id", "left_semi")
        there.select(F.lit(number).alias("part"), "id").write.mode("overwrite").parquet(f"{self.path}/delete-{number}")
        n = self.spark.read.parquet(f"{self.path}/delete-{number}").count()
        self.meta["deletes"].append(number)
        self._next()
        return n

    def get(self, id_: int) -> Row | None:
        return self.rows().where(F.col("id") == id_).first()

    def __len__(self) -> int:
        return self.rows().count()

    def is_empty(self) -> bool:
        return self.rows().isEmpty()

    def max_level(self) -> int:
        """The highest layer that a vector of the index is in."""
        return self.nodes().where("live").agg(F.max(F.size("links"))).first()[0] or 1

    def clear(self) -> None:
        self.meta |= {"parts": [], "deletes": []}
        self._next()

    def compact(self) -> None:
        """Build the parts anew as one, without what was deleted."""
        rows = self.rows()
        number = self.meta["next"]
        kept = f"{self.path}/rows-{number}"
        rows.write.mode("overwrite").parquet(kept)
        before = dict(self.meta)
        try:
            self.meta |= {"parts": [], "deletes": []}
            self.insert(self.spark.read.parquet(kept), payload_col="payload")
        except Exception:
            self.meta = before
            raise
        for name in [*(f"part-{i}" for i in before["parts"]), *(f"delete-{i}" for i in before["deletes"]), f"rows-{number}"]:
            self.store.delete(name)

    def search_batch(self, queries: Sequence[tuple[int, Sequence[float]]], k: int, ef: int | None = None, where: Filter | Column | None = None, ids: DataFrame | None = None) -> DataFrame:
        """``qid``, ``id``, ``distance``, ``rank``. ``where`` sees ``id`` and ``payload``; ``ids`` limits what may be found."""
        beam, metric, config = max(ef or self.config.ef_search, k), self.metric, self.config
        many = [(int(i), np.array(q, dtype=float)) for i, q in queries]
        for _, q in many:
            if len(q) != self.dimension:
                raise DimensionMismatch(self.dimension, len(q))
        condition = as_condition(where)
        rows = self.nodes().withColumn("ok", F.col("live") & (condition if condition is not None else F.lit(True)))
        if ids is not None:
            rows = rows.join(ids.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left").withColumn("ok", F.col("ok") & F.col("_in").isNotNull())

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("place")
            g = _Graph.stored(pdf["id"].to_numpy(), np.stack(pdf["v"].to_list()), [[list(x) for x in own] for own in pdf["links"]], int(np.flatnonzero(pdf["entry"])[0]), metric, config)
            ok = pdf["ok"].to_numpy()
            out = [(qid, int(g.ids[i]), d) for qid, q in many for d, i in g.search(q, beam) if ok[i]]
            return pd.DataFrame(out, columns=["qid", "id", "distance"])

        found = rows.select("part", "shard", "entry", "place", "id", "v", "links", "ok").groupBy("part", "shard").applyInPandas(walk, "qid long, id long, distance double")
        w = Window.partitionBy("qid").orderBy("distance", "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def search(self, query: Sequence[float], k: int, ef: int | None = None, where: Filter | Column | None = None) -> DataFrame:
        return self.search_batch([(0, query)], k, ef, where).drop("qid")
