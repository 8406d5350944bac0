"""Benchmark decontamination by a prefix-filtered set join.

A window is ``n`` consecutive words of a benchmark item (the whole item if it has
fewer). A window occurs in a document only if all its word shingles do, so its
prefix is a single shingle, the *rarest* in the corpus. The steps, each a
distributed table:

1. the windows of all items with their shingles (hashed to 64 bits);
2. how often each of these shingles occurs in all documents;
3. an index of the windows under their rarest shingle and its place in them;
4. the places of documents that hold an indexed shingle, with the words around;
5. a join of both on the shingle; length and position bounds (the window must fit
   around the shingle), then all words of the window are compared.

Nothing of the items goes through the driver but a bit table of fixed size: of
shingles that aren't in it, none leaves the task that reads a document. It never
drops a shingle of an item; when there are so many that most bits are set, the
joins still choose exactly, they only read more. The index is broadcast up to
``BROADCAST_ROWS`` windows and met by a shuffle join beyond, which Spark can split
where a shingle is hot.

Edge cases: null, empty and wordless texts have no words, wordless items no
windows; equal windows of several items count for each; ties in rarity go by hash
and place; an item with a null id hits words but can't be listed; document rows
with null ids and rows that repeat an id are judged by their own texts; very long
texts are read whole; other columns, whatever their names, play no part; empty
tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quiverline.llm.anchors import row_key, run_hashes
from quiverline.llm.common import drop, persist, raw_texts
from quiverline.llm.words import word_hashes

WINDOW = 10
SHINGLE = 3
#: Bits of the table that is broadcast (2 MB), whatever the number of items.
BITS = 1 << 24
#: Rows up to which a table of items is broadcast (about 20 MB).
BROADCAST_ROWS = 100_000

# Lower-cases A-Z; every other ASCII character than letters and digits becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Fixed value: the words of the contract; A-Z are letters of words too.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all shingles of ``size`` words of folded texts: hash, number of the text, place in it."""
    hashes, sizes = word_hashes(texts)
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = run_hashes(hashes, size, size)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = owner[: len(runs)] == owner[size - 1 :]
    return runs[own], owner[: len(runs)][own], place[: len(runs)][own]


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``item``, ``n``, ``g``, ``words`` (joined by blanks), ``s``: each window and the hashes of its shingles of ``g`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "n", "g", "words", "s"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())]
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                folded = text.translate(_FOLD)
                words = folded.decode("utf-8", "replace").split(" ")
                words = [w for w in words if w]
                if not words:
                    continue
                n = min(window, len(words))
                g = min(shingle, n)
                runs = _shingles([folded], g)[0].view(np.int64)
                at = range(len(words) - n + 1)
                rows = [[item] * len(at), [n] * len(at), [g] * len(at), [" ".join(words[i : i + n]) for i in at], [runs[i : i + n - g + 1] for i in at]]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)], names=names)

    return items.select(F.col(id_col).cast("string"), F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, "item string, n int, g int, words string, s array<long>")


def _bit_table(tokens: DataFrame) -> np.ndarray:
    """A bit for each value of the lower bits of ``token``; the driver gets at most ``BITS`` / 64 numbers."""
    at = F.col("token").bitwiseAND(F.lit(BITS - 1).cast("long"))
    rows = tokens.select(F.shiftright(at, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(BITS // 64, dtype=np.int64)
    for w, b in rows.collect():
        table[w] = b
    return table.view(np.uint64)


def _among(tokens: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = tokens & np.uint64(64 * len(table) - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Stored table ``id``, ``h`` (see ``anchors.row_key``), ``start``, ``n``, ``item``: each occurrence of a window in a row's text."""
    every = persist(windows(items, item_id, item_text, window).withColumn("w", F.md5("words")), "leaks-windows")
    distinct = every.dropDuplicates(["w"]).select("w", "n", "g", "words", "s")
    tokens = persist(distinct.select("g", F.explode("s").alias("token")).distinct(), "leaks-tokens")
    sizes = sorted(r["g"] for r in tokens.select("g").distinct().collect())  # 1 to SHINGLE
    first, second = row_key(id_col, text_col)
    rows = docs.where(F.col(text_col).isNotNull()).select(first.alias("id"), second.alias("h"), F.col(text_col).alias("text"))

    wanted = spark.sparkContext.broadcast(_bit_table(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [t.translate(_FOLD) for t in raw_texts(batch.column(0))]
            for g in sizes:
                runs = _shingles(folded, g)[0]
                found, n = np.unique(runs[_among(runs, wanted.value)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

    counted = rows.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("df"))
    counted = persist(counted.join(_few(tokens.select("token").distinct()), "token", "left_semi"), "leaks-counts")
    # The rarest shingle of each window; a window with one that no document has can't occur.
    placed = distinct.select("w", F.posexplode("s").alias("place", "token")).join(counted, "token", "left")
    rarest = placed.groupBy("w").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "place")).alias("r")).where("r.df > 0")
    index = persist(distinct.select("w", "n", "g", "words").join(rarest, "w").select(F.col("r.token").alias("token"), F.col("r.place").alias("place"), "w", "n", "g", "words"), "leaks-index")
    probes = spark.sparkContext.broadcast(_bit_table(index.select("token")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "h", "token", "at", "size", "low", "around"]
        for batch in batches:
            folded = [t.translate(_FOLD) for t in raw_texts(batch.column(2))]
            split: dict[int, list[bytes]] = {}
            for g in sizes:
                runs, owner, place = _shingles(folded, g)
                here = np.flatnonzero(_among(runs, probes.value))
                if not len(here):
                    continue
                size, low, around = [], [], []
                for i, at in zip(owner[here].tolist(), place[here].tolist(), strict=True):
                    words = split.get(i)
                    if words is None:
                        words = split[i] = folded[i].split()
                    size.append(len(words))
                    low.append(max(0, at - window + 1))
                    around.append(b" ".join(words[low[-1] : at + window]))
                columns = [batch.column(0).take(pa.array(owner[here])), batch.column(1).take(pa.array(owner[here])), pa.array(runs[here].view(np.int64)), pa.array(place[here], pa.int32()), pa.array(size, pa.int32()), pa.array(low, pa.int32()), pa.array(around, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    places = rows.mapInArrow(probe, "id long, h long, token long, at int, size int, low int, around string")
    met = places.join(_few(index), "token").withColumn("start", F.col("at") - F.col("place")).where("start >= 0 and start + n <= size")
    same = F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("low") + 1, F.col("n")), " ") == F.col("words")
    found = met.where(same).select("id", "h", "start", "n", "w")
    out = persist(found.join(_few(every.select("w", "item").distinct()), "w").select("id", "h", "start", "n", "item"), "leaks-hits")
    for stored in (every, tokens, counted, index):
        drop(stored)
    return out


def judged(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with ``_n_words``, ``_spans`` (hit words as ``struct<a, b>``, sorted, which may overlap) and ``_items`` (ids as strings, sorted)."""
    found = hits(spark, docs, items, id_col, text_col, **more)
    spans = found.select("id", "h", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")).alias("s")).distinct().groupBy("id", "h").agg(F.array_sort(F.collect_list("s")).alias("_spans"))
    listed = found.select("id", "h", "item").distinct().groupBy("id", "h").agg(F.array_sort(F.collect_list("item")).alias("_items"))
    each = spans.join(listed, ["id", "h"]).toDF("_id", "_h", "_spans", "_items")
    first, second = row_key(id_col, text_col)
    rows = docs.withColumns({"_id": first, "_h": second, "_n_words": F.coalesce(F.regexp_count(text_col, F.lit(_WORD)), F.lit(0)).cast("long")})
    rows = rows.join(each, ["_id", "_h"], "left").drop("_id", "_h")
    return rows.withColumns({"_spans": F.coalesce("_spans", F.array().cast("array<struct<a:int,b:int>>")), "_items": F.coalesce("_items", F.array().cast("array<string>"))})


def n_hit(spans: Column) -> Column:
    """Number of words in sorted spans that may overlap."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(s["b"] - F.greatest(acc["end"], s["a"]), F.lit(0))).alias("n")))["n"]
