"""A text store: documents found by the vectors that an embedder makes of them."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiverline.functions import payload as P
from quiverline.sources.collection import Collection
from quiverline.types import CollectionConfig, Metric


class Embedder(Protocol):
    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Signed counts of hashed words, scaled to length one; the same for the same text everywhere."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_query(self, text: str) -> list[float]:
        v = [0.0] * self.dimension
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            v[h % self.dimension] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def embed_documents(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]


def embedded(df: DataFrame, embedder: Embedder, text_col: str = "text", to: str = "vector") -> DataFrame:
    """Add the vectors of a text column, by Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed_documents([t or "" for t in texts]))

    return df.withColumn(to, run(text_col))


class TextStore:
    """Texts and their metadata are kept with the vectors, so that they are there after reopening."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, metric: Metric = Metric.COSINE):
        self.embedder = embedder
        self.collection = Collection.open_or_create(spark, path, CollectionConfig(len(embedder.embed_query("test")), metric))

    def add_texts(self, texts: Sequence[str], metadatas: Sequence[dict] | None = None) -> list[str]:
        if metadatas is not None and len(metadatas) != len(texts):
            raise ValueError("a metadata for each text is needed")
        start = self.collection.meta["next_id"]
        vectors = self.embedder.embed_documents(list(texts))
        rows = [(start + i, v, {"text": t, "metadata": (metadatas[i] if metadatas else {})}) for i, (t, v) in enumerate(zip(texts, vectors, strict=True))]
        if rows:
            self.collection.insert_batch(rows)
        return [str(r[0]) for r in rows]

    def similarity_search_with_score(self, query: str, k: int = 4) -> list[tuple[str, dict, float]]:
        rows = self.collection.search(self.embedder.embed_query(query), k)
        out = rows.select(P.get_str(F.col("payload"), "text").alias("text"), F.to_json(P.value(F.col("payload"), "metadata")).alias("metadata"), "distance")
        return [(r["text"], json.loads(r["metadata"]), r["distance"]) for r in out.collect()]

    def similarity_search(self, query: str, k: int = 4) -> list[tuple[str, dict]]:
        return [(t, m) for t, m, _ in self.similarity_search_with_score(query, k)]

    def as_retriever(self, k: int = 4) -> Callable[[str], list[tuple[str, dict]]]:
        return lambda query: self.similarity_search(query, k)

    @classmethod
    def from_texts(cls, spark: SparkSession, path: str, texts: Sequence[str], embedder: Embedder, metadatas: Sequence[dict] | None = None) -> TextStore:
        out = cls(spark, path, embedder)
        out.add_texts(texts, metadatas)
        return out

    @classmethod
    def from_documents(cls, spark: SparkSession, path: str, documents: Sequence[tuple[str, dict]], embedder: Embedder) -> TextStore:
        return cls.from_texts(spark, path, [d[0] for d in documents], embedder, [d[1] for d in documents])
