"""Payloads: flat objects held as VARIANT, with typed access that never converts.

Keys are read as they are, so ``a.b`` is one key. A key with a JSON null is present.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def path(key: str) -> str:
    if "'" in key or "\\" in key:
        raise ValueError(f"key {key!r} can't be quoted")
    return f"$['{key}']"


def parse(json: Column) -> Column:
    return F.parse_json(json)


def value(payload: Column, key: str) -> Column:
    """The value as VARIANT; null if the key is missing."""
    return F.try_variant_get(payload, path(key), "variant")


def kind(payload: Column, key: str) -> Column:
    """Type of the value, as in BIGINT, STRING, VOID for a JSON null; null if the key is missing."""
    return F.schema_of_variant(value(payload, key))


def contains_key(payload: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(payload.cast("map<string,variant>"), key), F.lit(False))


def keys(payload: Column) -> Column:
    return F.map_keys(payload.cast("map<string,variant>"))


def length(payload: Column) -> Column:
    return F.size(keys(payload))


def get_str(payload: Column, key: str) -> Column:
    return F.when(kind(payload, key) == "STRING", F.try_variant_get(payload, path(key), "string"))


def get_i64(payload: Column, key: str) -> Column:
    return F.when(kind(payload, key) == "BIGINT", F.try_variant_get(payload, path(key), "bigint"))


def get_f64(payload: Column, key: str) -> Column:
    return F.when(kind(payload, key).rlike(_NUMBER), F.try_variant_get(payload, path(key), "double"))


def get_bool(payload: Column, key: str) -> Column:
    return F.when(kind(payload, key) == "BOOLEAN", F.try_variant_get(payload, path(key), "boolean"))


def get_array(payload: Column, key: str) -> Column:
    return F.when(kind(payload, key).startswith("ARRAY"), F.try_variant_get(payload, path(key), "array<variant>"))


def from_columns(*names: str) -> Column:
    """A payload of columns; null columns are left out, as missing keys."""
    return F.parse_json(F.to_json(F.struct(*names)))


def set_value(payload: Column, key: str, json: Column) -> Column:
    """The payload with a key set to a JSON value."""
    old = F.map_filter(payload.cast("map<string,variant>"), lambda k, _: k != key)
    entries = F.transform(F.map_entries(old), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.to_json(e["value"])))
    name = F.to_json(F.array(F.lit(key)))
    added = F.concat(name.substr(F.lit(2), F.length(name) - 2), F.lit(":"), json)
    return F.parse_json(F.concat(F.lit("{"), F.array_join(F.concat(entries, F.array(added)), ","), F.lit("}")))


def remove(payload: Column, key: str) -> Column:
    left = F.map_filter(payload.cast("map<string,variant>"), lambda k, _: k != key)
    return F.parse_json(F.to_json(left))
