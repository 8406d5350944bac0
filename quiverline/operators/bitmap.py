"""Inverted bitmap index over metadata: postings as (field, kind, value, bucket, bitmap) rows.

A bucket covers 32768 ids, so 64-bit ids are safe. Values keep their type's name, so
that 1 and "1" differ, and a query gives the same ids as the row filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quiverline.plans.filters import Filter


def _bits(ids: DataFrame, *keys: str) -> DataFrame:
    return ids.groupBy(*keys, F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))


@dataclass(frozen=True)
class BitmapIndex:
    """``postings`` by value, ``everything`` the bitmap of all ids."""

    postings: DataFrame
    everything: DataFrame

    @classmethod
    def build(cls, df: DataFrame, id_col: str, fields: list[str]) -> BitmapIndex:
        kinds = dict(df.dtypes)
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(kinds[f]).alias("kind"), F.col(f).cast("string").alias("value")) for f in fields])
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.explode(pairs).alias("p")).select("id", "p.field", "p.kind", "p.value").where("value is not null")
        return cls(_bits(rows, "field", "kind", "value"), _bits(df.select(F.col(id_col).cast("long").alias("id"))))

    def insert(self, df: DataFrame, id_col: str) -> BitmapIndex:
        """The index with the rows of ``df`` as well, whose fields are all its other columns."""
        more = BitmapIndex.build(df, id_col, [c for c in df.columns if c != id_col])
        join = lambda a, b, *keys: a.unionByName(b).groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        return BitmapIndex(join(self.postings, more.postings, "field", "kind", "value"), join(self.everything, more.everything))

    def delete(self, ids: DataFrame) -> BitmapIndex:
        """The index without the ids of ``ids``; buckets that hold none of them stay as they are."""
        gone = _bits(ids.select(F.col("id").cast("long").alias("id")))

        def less(rows: DataFrame, *keys: str) -> DataFrame:
            hit = rows.join(gone.select("bucket"), "bucket", "left_semi").groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            left = self.ids(hit, *keys).join(ids.select(F.col("id").cast("long").alias("id")), "id", "left_anti")
            return rows.join(gone.select("bucket"), "bucket", "left_anti").select(*keys, "bucket", "bitmap").unionByName(_bits(left, *keys))

        return BitmapIndex(less(self.postings, "field", "kind", "value"), less(self.everything))

    def clear(self) -> BitmapIndex:
        return BitmapIndex(self.postings.where(F.lit(False)), self.everything.where(F.lit(False)))

    def __len__(self) -> int:
        return self.size()

    def is_empty(self) -> bool:
        return self.everything.isEmpty()

    def size(self) -> int:
        return self.everything.agg(F.sum(F.bitmap_count("bitmap"))).first()[0] or 0

    def posting(self, field: str, value) -> DataFrame:
        return self._union(self._of(field).where(_same(value)))

    def _of(self, field: str) -> DataFrame:
        return self.postings.where(F.col("field") == field)

    @staticmethod
    def _union(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def query(self, f: Filter) -> DataFrame:
        """Rows (``bucket``, ``bitmap``) of the ids that match."""
        if f.op == "and":
            both = self.query(f.parts[0]).unionByName(self.query(f.parts[1]))
            return both.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n")).where("n = 2").drop("n")
        if f.op == "or":
            return self._union(self.query(f.parts[0]).unionByName(self.query(f.parts[1])))
        if f.op == "not":
            return self._without(self.query(f.parts[0]))
        if f.op == "ne":
            return self._without(self.posting(f.field, f.value))
        own = self._of(f.field)
        if f.op == "eq":
            return self.posting(f.field, f.value)
        if f.op == "in":
            hit = F.lit(False)
            for v in f.value:
                hit = hit | _same(v)
            return self._union(own.where(hit))
        if f.op == "exists":
            return self._union(own)
        if f.op == "contains":
            return self._union(own.where((F.col("kind") == "string") & F.contains("value", F.lit(str(f.value)))))
        if isinstance(f.value, bool) or not isinstance(f.value, int | float):
            return self._union(own.where(F.lit(False)))
        x = F.when(~F.col("kind").isin("string", "boolean"), F.expr("try_cast(value as double)"))
        hit = {"gt": x > f.value, "gte": x >= f.value, "lt": x < f.value, "lte": x <= f.value}[f.op]
        return self._union(own.where(hit))

    def _without(self, some: DataFrame) -> DataFrame:
        left = self.ids(self.everything).join(self.ids(some), "id", "left_anti")
        return _bits(left)

    @staticmethod
    def ids(bitmaps: DataFrame, *keys: str) -> DataFrame:
        """The ids of bitmaps, read byte by byte, with the columns ``keys``."""
        at = F.sequence(F.lit(0), F.length("bitmap") - 1)
        byte = F.conv(F.hex(F.substring("bitmap", F.col("i") + 1, F.lit(1))), 16, 10).cast("int")
        rows = bitmaps.select(*keys, "bucket", "bitmap", F.explode(at).alias("i")).select(*keys, "bucket", "i", byte.alias("b")).where("b != 0")
        bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda x: F.expr("b").bitwiseAND(F.call_function("shiftleft", F.lit(1), x)) != 0)
        at = rows.select(*keys, "bucket", "i", F.explode(bits).alias("bit")).select(*keys, "bucket", (F.col("i") * 8 + F.col("bit")).alias("pos"))
        # Spark numbers buckets from 1 for ids from 1, and from 0 downwards for the others.
        return at.select(*keys, F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + F.col("pos") + 1).otherwise(F.col("bucket") * 32768 - F.col("pos")).cast("long").alias("id"))

    @staticmethod
    def count(bitmaps: DataFrame) -> int:
        return bitmaps.agg(F.sum(F.bitmap_count("bitmap"))).first()[0] or 0


def _same(value) -> Column:
    if isinstance(value, bool):
        return (F.col("kind") == "boolean") & (F.col("value") == str(value).lower())
    if isinstance(value, str):
        return (F.col("kind") == "string") & (F.col("value") == value)
    number = F.expr("try_cast(value as double)") == F.lit(float(value))
    return ~F.col("kind").isin("string", "boolean") & number
