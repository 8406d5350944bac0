"""Vector functions as Column expressions, computed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

from quiverline.types import Metric

Vector = Column | Sequence[float]


def as_column(v: Vector) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot_product(a: Vector, b: Vector) -> Column:
    return _sum(F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double")))


def euclidean_squared(a: Vector, b: Vector) -> Column:
    return _sum(F.zip_with(as_column(a), as_column(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def euclidean(a: Vector, b: Vector) -> Column:
    return F.sqrt(euclidean_squared(a, b))


def norm(v: Vector) -> Column:
    return F.sqrt(_sum(F.transform(as_column(v), lambda x: x.cast("double") * x.cast("double"))))


def normalized(v: Column) -> Column:
    """The vector scaled to length one; null for a zero vector."""
    return F.when(norm(v) != 0, F.transform(v, lambda x: x.cast("double") / norm(v)))


def cosine(a: Vector, b: Vector, norm_a: Column | None = None) -> Column:
    """``1 - cos``; 1 where either vector is zero. A literal's norm is computed once, here."""
    of_b = norm(b) if isinstance(b, Column) else F.lit(float(np.linalg.norm(np.asarray(b, dtype=float))))
    both = (norm_a if norm_a is not None else norm(a)) * of_b
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - dot_product(a, b) / both)


def hamming(a: Vector, b: Vector) -> Column:
    """Number of places where one value is above one half and the other isn't."""
    return F.size(F.filter(F.zip_with(as_column(a), as_column(b), lambda x, y: (x > 0.5) != (y > 0.5)), lambda d: d)).cast("double")


def distance(metric: Metric | str, a: Vector, b: Vector) -> Column:
    """Distance by a metric, null where the lengths differ."""
    f = {Metric.COSINE: cosine, Metric.EUCLIDEAN: euclidean, Metric.DOT: lambda x, y: -dot_product(x, y), Metric.HAMMING: hamming}[Metric.of(metric)]
    size = F.size(as_column(b)) if isinstance(b, Column) else F.lit(len(b))
    return F.when(F.size(as_column(a)) == size, f(a, b))


def rank_key(metric: Metric | str, a: Vector, b: Vector) -> Column:
    """What sorts like the distance and costs less."""
    return euclidean_squared(a, b) if Metric.of(metric) is Metric.EUCLIDEAN else distance(metric, a, b)


def from_rank_key(metric: Metric | str, key: Column) -> Column:
    return F.sqrt(key) if Metric.of(metric) is Metric.EUCLIDEAN else key


def similarity(d: Column) -> Column:
    return 1 - d


def block_distances(metric: Metric | str, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances of all vectors (rows) to all queries (columns)."""
    metric = Metric.of(metric)
    if metric is Metric.HAMMING:
        a, b = (vectors > 0.5).astype(np.float64), (queries > 0.5).astype(np.float64)
        return a @ (1 - b).T + (1 - a) @ b.T
    dots = vectors @ queries.T
    if metric is Metric.DOT:
        return -dots
    if metric is Metric.EUCLIDEAN:
        # Differences, not the expanded square: near neighbours would lose their digits.
        return np.sqrt(np.maximum(np.stack([((vectors - q) ** 2).sum(axis=1) for q in queries], axis=1), 0)) if len(queries) else dots
    both = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    return np.where(both == 0, 1.0, 1 - dots / np.where(both == 0, 1, both))
