"""Durable collections: a Parquet snapshot and a log of changes, read as one view.

``meta.json`` names the snapshot; ``log/`` holds committed batches of changes. The
newest change of an id by ``seq`` wins. Nothing is changed in place, so a write that
didn't end leaves no trace. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quiverline.operators.search import knn, knn_batch
from quiverline.plans.filters import Filter
from quiverline.sources.files import Store
from quiverline.types import CollectionConfig, CollectionError, DimensionMismatch, DuplicateId, InvalidVector, Metric, NotFound, SyncMode, checked_id, checked_vector

ROWS = "seq long, op string, id long, vector array<float>, payload string"


def latest(log: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """The newest change (by ``seq``) of each id; ids whose newest is a delete go."""
    w = Window.partitionBy("id").orderBy(F.desc("seq"))
    rows = log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return rows if keep_deleted else rows.where("op != 'D'")


def validated(df: DataFrame, dimension: int, vec_col: str = "vector", id_col: str = "id") -> DataFrame:
    """The rows, failing the job at the first with a bad id or vector."""
    bad = F.col(vec_col).isNull() | (F.size(vec_col) != dimension) | F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.col(id_col).isNull() | (F.col(id_col) < 0)
    return df.where(F.when(bad, F.raise_error(F.concat(F.lit(f"bad vector or id, dimension {dimension} expected, id "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))).otherwise(F.lit(True)).cast("boolean"))


class FlatIndex:
    """Rows (``id``, ``vector``, and columns of the payload) without storage; each change gives a new index."""

    def __init__(self, df: DataFrame, dimension: int, metric: Metric | str = Metric.COSINE, next_id: int | None = None):
        self.df, self.dimension, self.metric = df, dimension, Metric.of(metric)
        self._next = next_id

    @classmethod
    def from_dataframe(cls, df: DataFrame, metric: Metric | str = Metric.COSINE) -> FlatIndex:
        """The first row's dimension; rows of another one raise."""
        first = df.select(F.size("vector")).first()
        n = first[0] if first else 0
        return cls(validated(df, n) if first else df, n, metric)

    def _with(self, df: DataFrame, next_id: int | None = None) -> FlatIndex:
        return FlatIndex(df, self.dimension, self.metric, next_id)

    def _one(self, id_: int, vector: Sequence[float], payload: dict) -> DataFrame:
        checked_vector(vector, self.dimension)
        row = {"id": checked_id(id_), "vector": [float(x) for x in vector]} | payload
        return self.df.sparkSession.createDataFrame([tuple(row.get(c) for c in self.df.columns)], self.df.schema)

    def insert(self, id_: int, vector: Sequence[float], **payload) -> FlatIndex:
        new = self._one(id_, vector, payload)
        if self.get(id_) is not None:
            raise DuplicateId(f"id {id_} exists")
        return self._with(self.df.unionByName(new), max(self.next_id, id_ + 1))

    def insert_auto(self, vector: Sequence[float], **payload) -> tuple[int, FlatIndex]:
        id_ = self.next_id
        return id_, self.insert(id_, vector, **payload)

    def insert_batch(self, rows: DataFrame) -> FlatIndex:
        """All rows or none."""
        rows = validated(rows, self.dimension)
        if rows.join(self.df.select("id"), "id", "left_semi").limit(1).count() or rows.groupBy("id").count().where("count > 1").limit(1).count():
            raise DuplicateId("some ids exist or repeat")
        return self._with(self.df.unionByName(rows))

    def update(self, id_: int, vector: Sequence[float], **payload) -> FlatIndex:
        new = self._one(id_, vector, payload)
        if self.get(id_) is None:
            raise NotFound(f"no id {id_}")
        return self._with(self.df.where(F.col("id") != id_).unionByName(new), self._next)

    def delete(self, id_: int) -> tuple[bool, FlatIndex]:
        return self.get(id_) is not None, self._with(self.df.where(F.col("id") != id_), self._next)

    def clear(self) -> FlatIndex:
        return self._with(self.df.limit(0), 1)

    def get(self, id_: int):
        return self.df.where(F.col("id") == id_).first()

    def ids(self) -> DataFrame:
        return self.df.select("id")

    @property
    def next_id(self) -> int:
        return self._next if self._next is not None else (self.df.agg(F.max("id")).first()[0] or 0) + 1

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def search(self, query: Sequence[float], k: int, where: Filter | Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        return knn(self.df, query, k, self.metric, where, columns=[c for c in self.df.columns if c not in ("id", "vector")] if columns is None else columns)

    def search_batch(self, queries: DataFrame, k: int, where: Filter | Column | None = None) -> DataFrame:
        return knn_batch(self.df, queries, k, self.metric, where)


class Collection:
    """A collection in a folder. Payloads are JSON objects, read as VARIANT."""

    def __init__(self, spark: SparkSession, path: str, config: CollectionConfig, meta: dict):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.store, self.meta = Store(spark, path), meta
        self._buffer: list[tuple] = []

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, config: CollectionConfig) -> Collection:
        store = Store(spark, path)
        if store.exists("meta.json"):
            meta = json.loads(store.read("meta.json"))
            if meta["dimension"] != config.dimension:
                raise DimensionMismatch(meta["dimension"], config.dimension)
            if meta["metric"] != config.metric.value:
                raise CollectionError(f"the collection's metric is {meta['metric']}, not {config.metric.value}")
            out = cls(spark, path, config, meta)
            last = out._log().agg(F.max("seq").alias("s"), F.max("id").alias("i")).first()
            out.meta["next_seq"] = max(meta["next_seq"], meta.get("folded", 0) + 1, (last["s"] or 0) + 1)
            out.meta["next_id"] = max(meta["next_id"], (last["i"] if last["i"] is not None else 0) + 1)
            return out
        store.make()
        out = cls(spark, path, config, {"dimension": config.dimension, "metric": config.metric.value, "next_id": 1, "next_seq": 1, "snapshot": None})
        if store.names("log") or any(x.startswith("snapshot-") for x in store.names()):
            raise CollectionError(f"{path} holds data but no meta.json")
        out._save()
        return out

    def _save(self) -> None:
        self.store.write("meta.json", json.dumps(self.meta, indent=2))

    def _log(self) -> DataFrame:
        """Committed batches; what the snapshot holds already is left out, should a flush have ended before it was removed."""
        paths = [f"{self.path}/log/{x}" for x in self.store.names("log") if "_SUCCESS" in self.store.names(f"log/{x}")]
        rows = self.spark.read.schema(ROWS).option("recursiveFileLookup", "true").parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)
        return rows.where(F.col("seq") > self.meta.get("folded", 0))

    def _all(self) -> DataFrame:
        rows = self._log()
        if self.meta["snapshot"]:
            rows = rows.unionByName(self.spark.read.schema(ROWS).parquet(f"{self.path}/{self.meta['snapshot']}"))
        if self._buffer:
            rows = rows.unionByName(self.spark.createDataFrame(self._buffer, ROWS))
        return rows

    def view(self) -> DataFrame:
        """``id``, ``vector``, ``payload`` (VARIANT) of the rows there are."""
        return latest(self._all()).select("id", "vector", F.parse_json("payload").alias("payload"))

    def _note(self, op: str, id_: int, vector: list[float] | None, payload: dict | None) -> None:
        self._buffer.append((self.meta["next_seq"], op, id_, vector, json.dumps(payload or {}) if op != "D" else None))
        self.meta["next_seq"] += 1
        most = self.config.sync_mode.rows
        if most and len(self._buffer) >= most:
            self.sync()

    def sync(self) -> None:
        """Write the buffered changes as a batch of the log."""
        if self._buffer:
            rows = self.spark.createDataFrame(self._buffer, ROWS).coalesce(1)
            rows.write.mode("error").parquet(f"{self.path}/log/seq={self._buffer[0][0]}")
            self._buffer = []

    def _checked(self, payload: dict | None) -> dict:
        if payload is not None and not isinstance(payload, dict):
            raise InvalidVector("Payload must be a JSON object")
        return payload or {}

    def insert(self, id_: int, vector: Sequence[float], payload: dict | None = None) -> None:
        """Insert or replace; what is wrong raises before anything is logged."""
        id_, vector, payload = checked_id(id_), checked_vector(vector, self.config.dimension), self._checked(payload)
        self._note("I", id_, vector, payload)
        self.meta["next_id"] = max(self.meta["next_id"], id_ + 1)

    def insert_auto(self, vector: Sequence[float], payload: dict | None = None) -> int:
        id_ = self.meta["next_id"]
        self.insert(id_, vector, payload)
        return id_

    def update(self, id_: int, vector: Sequence[float], payload: dict | None = None) -> None:
        id_, vector, payload = checked_id(id_), checked_vector(vector, self.config.dimension), self._checked(payload)
        self._note("U", id_, vector, payload)
        self.meta["next_id"] = max(self.meta["next_id"], id_ + 1)

    def delete(self, id_: int) -> bool:
        there = self.get(id_) is not None
        if there:
            self._note("D", id_, None, None)
        return there

    def insert_batch(self, rows: DataFrame | Iterable[tuple], name: str | None = None) -> None:
        """Append ``id``, ``vector`` and optionally ``payload`` (a JSON string): all rows or none. ``name`` makes a repeated call do nothing."""
        self.sync()
        seq = self.meta["next_seq"]
        target = f"log/{'batch=' + name if name else f'seq={seq}'}"
        if self.store.exists(f"{target}/_SUCCESS"):
            return
        if not isinstance(rows, DataFrame):  # of rows that repeat an id the last one counts, as in single inserts
            by = {checked_id(r[0]): (checked_vector(r[1], self.config.dimension), json.dumps(self._checked(r[2] if len(r) > 2 else None))) for r in rows}
            rows = self.spark.createDataFrame([(i, *x) for i, x in by.items()], "id long, vector array<float>, payload string")
        elif twice := rows.groupBy("id").count().where("count > 1").first():  # a table has no order that could tell
            raise DuplicateId(f"id {twice['id']} repeats in the batch")
        payload = F.col("payload") if "payload" in rows.columns else F.lit("{}")
        out = validated(rows, self.config.dimension).select(F.lit(seq).cast("long").alias("seq"), F.lit("I").alias("op"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), payload.alias("payload"))
        out.write.mode("overwrite").parquet(f"{self.path}/{target}")
        self.meta["next_seq"] = seq + 1
        last = self.spark.read.parquet(f"{self.path}/{target}").agg(F.max("id")).first()[0]
        self.meta["next_id"] = max(self.meta["next_id"], (last if last is not None else 0) + 1)

    def get(self, id_: int):
        return self.view().where(F.col("id") == id_).first()

    def __len__(self) -> int:
        return self.view().count()

    def is_empty(self) -> bool:
        return self.view().isEmpty()

    def search(self, query: Sequence[float], k: int, where: Filter | None = None) -> DataFrame:
        """``id``, ``payload``, ``distance``."""
        condition = where.column(payload=F.col("payload")) if isinstance(where, Filter) else where
        return knn(self.view(), query, k, self.config.metric, condition, columns=["payload"])

    def search_batch(self, queries: DataFrame, k: int, where: Filter | None = None) -> DataFrame:
        condition = where.column(payload=F.col("payload")) if isinstance(where, Filter) else where
        return knn_batch(self.view(), queries, k, self.config.metric, condition)

    def flush(self) -> None:
        """Fold the log into a new snapshot, point to it, then drop what it replaces."""
        self.sync()
        old = self.meta["snapshot"]
        new = f"snapshot-{int(old.split('-')[1]) + 1 if old else 1}"
        latest(self._all()).write.mode("overwrite").parquet(f"{self.path}/{new}")
        self.meta |= {"snapshot": new, "folded": self.meta["next_seq"] - 1}
        self._save()
        self.store.delete("log")
        if old:
            self.store.delete(old)


class AsyncCollection:
    """The same methods on a thread; each returns a Future, and errors come out of it."""

    def __init__(self, inner: Collection):
        self.inner, self._pool = inner, ThreadPoolExecutor(max_workers=1)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, config: CollectionConfig) -> AsyncCollection:
        return cls(Collection.open_or_create(spark, path, config))

    @classmethod
    def from_sync(cls, inner: Collection) -> AsyncCollection:
        return cls(inner)

    def __getattr__(self, name: str):
        if name not in ("insert", "insert_auto", "insert_batch", "update", "delete", "get", "flush", "sync", "is_empty"):
            raise AttributeError(name)
        f = getattr(self.inner, name)
        return lambda *a, **b: self._pool.submit(f, *a, **b)

    def search(self, *a, **b) -> Future:
        return self._pool.submit(lambda: self.inner.search(*a, **b).collect())

    def len(self) -> Future:
        return self._pool.submit(self.inner.__len__)

    size = len


__all__ = ["AsyncCollection", "Collection", "CollectionConfig", "FlatIndex", "SyncMode", "latest", "validated"]
