"""Metrics, configuration and errors of the vector operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum


class VectorError(Exception):
    """Base of all errors of this package."""


class DimensionMismatch(VectorError, ValueError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"dimension mismatch: expected {expected}, got {got}")


class DuplicateId(VectorError, ValueError):
    pass


class NotFound(VectorError, KeyError):
    pass


class InvalidFilter(VectorError, ValueError):
    pass


class InvalidVector(VectorError, ValueError):
    pass


class CollectionError(VectorError, OSError):
    pass


class Metric(str, Enum):
    """Distances; lower is always nearer."""

    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT = "dot"
    HAMMING = "hamming"

    @classmethod
    def of(cls, name: str | Metric) -> Metric:
        try:
            return cls(name)
        except ValueError:
            raise ValueError("Invalid metric") from None

    @property
    def lower_is_better(self) -> bool:
        return True


class SyncMode(str, Enum):
    """When buffered single-row writes become a file of the log."""

    IMMEDIATE = "immediate"
    BATCHED = "batched"
    NONE = "none"

    @property
    def rows(self) -> int | None:
        return {"immediate": 1, "batched": 100, "none": None}[self.value]


@dataclass(frozen=True)
class CollectionConfig:
    dimension: int
    metric: Metric = Metric.COSINE
    sync_mode: SyncMode = SyncMode.BATCHED


def checked_id(value: int) -> int:
    """Ids are signed 64-bit numbers from 0; others are refused rather than wrapped."""
    if not 0 <= int(value) < 2**63:
        raise InvalidVector(f"id {value} is outside 0 to 2^63 - 1")
    return int(value)


def checked_vector(values: Sequence[float], dimension: int | None = None) -> list[float]:
    out = [float(x) for x in values]
    if dimension is not None and len(out) != dimension:
        raise DimensionMismatch(dimension, len(out))
    if not all(map(math.isfinite, out)):
        raise InvalidVector("vector has a value that is not finite")
    return out
