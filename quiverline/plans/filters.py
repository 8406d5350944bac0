"""Metadata filters: a predicate tree compiled to a Column.

Every leaf is two-valued (never null), so ``Not`` is plain negation. Over typed
columns the leaves keep forms that reach the Parquet scan; over a VARIANT payload
they compare types strictly.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F

from quiverline.functions import payload as P
from quiverline.types import InvalidFilter

_LEAVES = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains", "exists")


@dataclass(frozen=True)
class Filter:
    """``op`` is a leaf's name, or and, or, not. ``field`` and ``value`` are a leaf's, ``parts`` the others'."""

    op: str
    field: str | None = None
    value: Any = None
    parts: tuple[Filter, ...] = ()

    def __and__(self, other: Filter) -> Filter:
        return Filter("and", parts=(self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter("or", parts=(self, other))

    def __invert__(self) -> Filter:
        return Filter("not", parts=(self,))

    def negate(self) -> Filter:
        return ~self

    def to_json(self) -> str:
        return json.dumps(self._plain())

    def _plain(self) -> dict:
        if self.op in _LEAVES:
            return {"op": self.op, "field": self.field} | ({} if self.op == "exists" else {"value": list(self.value) if self.op == "in" else self.value})
        return {"op": self.op, "parts": [p._plain() for p in self.parts]}

    @classmethod
    def from_json(cls, text: str) -> Filter:
        return cls._from(json.loads(text))

    @classmethod
    def _from(cls, x: dict) -> Filter:
        op = x.get("op")
        if op in _LEAVES and isinstance(x.get("field"), str):
            value = x.get("value")
            return cls(op, x["field"], tuple(value) if op == "in" else value)
        parts = tuple(cls._from(p) for p in x.get("parts", ()))
        if op in ("and", "or") and len(parts) == 2 or op == "not" and len(parts) == 1:
            return cls(op, parts=parts)
        raise InvalidFilter(f"not a filter: {x}")

    def column(self, columns: dict[str, Column] | None = None, payload: Column | None = None) -> Column:
        """Compile against typed columns (``columns``, or columns of the fields' names) or a VARIANT ``payload``."""
        if self.op == "and":
            return self.parts[0].column(columns, payload) & self.parts[1].column(columns, payload)
        if self.op == "or":
            return self.parts[0].column(columns, payload) | self.parts[1].column(columns, payload)
        if self.op == "not":
            return ~self.parts[0].column(columns, payload)
        if payload is not None:
            return _variant(self, payload)
        return _typed(self, columns[self.field] if columns else F.col(self.field))

    def fields(self) -> set[str]:
        return {self.field} if self.op in _LEAVES else set().union(*(p.fields() for p in self.parts))


class field:  # noqa: N801
    """Builder: ``field("year").gte(2020) & field("lang").eq("en")``."""

    def __init__(self, name: str):
        self.name = name

    def eq(self, value: Any) -> Filter:
        return Filter("eq", self.name, value)

    def ne(self, value: Any) -> Filter:
        return Filter("ne", self.name, value)

    def gt(self, value: Any) -> Filter:
        return Filter("gt", self.name, value)

    def gte(self, value: Any) -> Filter:
        return Filter("gte", self.name, value)

    def lt(self, value: Any) -> Filter:
        return Filter("lt", self.name, value)

    def lte(self, value: Any) -> Filter:
        return Filter("lte", self.name, value)

    def contained_in(self, values: list) -> Filter:
        return Filter("in", self.name, tuple(values))

    def contains(self, text: str) -> Filter:
        return Filter("contains", self.name, text)

    def exists(self) -> Filter:
        return Filter("exists", self.name)


def _compare(op: str, c: Column, value: Any) -> Column:
    return {"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]


def _number(value: Any) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


#: Types that compare with a number; ``typeof`` is folded, so tests of it leave the plan.
_NUMERIC = "^(tinyint|smallint|int|bigint|float|double|decimal)"


def _typed(f: Filter, c: Column) -> Column:
    if f.op == "eq":
        return c.eqNullSafe(F.lit(f.value))
    if f.op == "ne":
        return ~c.eqNullSafe(F.lit(f.value))
    if f.op == "in":
        return c.isNotNull() & c.isin(*f.value) if f.value else F.lit(False)
    if f.op == "contains":
        return (F.typeof(c) == "string") & c.isNotNull() & F.contains(c, F.lit(str(f.value)))
    if f.op == "exists":
        return c.isNotNull()
    if not _number(f.value):
        return F.lit(False)
    hit = F.typeof(c).rlike(_NUMERIC) & c.isNotNull() & _compare(f.op, c, F.lit(f.value))
    return hit & (c <= F.lit(float("inf"))) if f.op in ("gt", "gte") else hit  # NaN sorts above all numbers


def _equal(p: Column, key: str, value: Any) -> Column:
    kind = P.kind(p, key)
    if value is None:
        hit = kind == "VOID"
    elif isinstance(value, bool):
        hit = P.get_bool(p, key) == value
    elif isinstance(value, int):
        hit = P.get_i64(p, key) == value
    elif isinstance(value, float):
        hit = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & (P.get_f64(p, key) == value)
    elif isinstance(value, str):
        hit = P.get_str(p, key) == value
    else:  # arrays and objects as a whole, by their canonical text
        same = F.to_json(F.try_variant_get(p, P.path(key), "variant")) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
        hit = kind.rlike("^(ARRAY|OBJECT)") & same
    return F.coalesce(hit, F.lit(False))


def _variant(f: Filter, p: Column) -> Column:
    if f.op == "eq":
        return _equal(p, f.field, f.value)
    if f.op == "ne":
        return ~_equal(p, f.field, f.value)
    if f.op == "in":
        out = F.lit(False)
        for v in f.value:
            out = out | _equal(p, f.field, v)
        return out
    if f.op == "contains":
        return F.coalesce(F.contains(P.get_str(p, f.field), F.lit(str(f.value))), F.lit(False))
    if f.op == "exists":
        return P.contains_key(p, f.field)
    if not _number(f.value):
        return F.lit(False)
    return F.coalesce(_compare(f.op, P.get_f64(p, f.field), F.lit(float(f.value))), F.lit(False))
