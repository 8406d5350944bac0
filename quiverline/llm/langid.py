"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Every text becomes a vector of hashed byte trigrams of its lower-cased words,
weighted by TF-IDF and scaled to length one. A language is described by a few
spherical k-means centroids; a text gets the language of the centroid with the
largest cosine. A text further from every centroid than nearly all training
texts are from theirs is *rejected*.

Edge cases: null or letterless texts (numbers that look like letters are no letters)
get ``und``, score 0 and are rejected; an untrained model (empty table, no labels)
answers ``und`` for all; ties go to the language that sorts first; texts of any
length are read whole, in slices; rows with a null id are predicted like any other
and may be drawn for the fit; repeated rows are predicted each on its own and fill
one place of the sample; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quiverline.llm.common import drop, persist

BUCKETS = 1 << 13
#: Bound on the labelled rows of each language that a model is fitted on.
MAX_TRAIN_PER_LANG = 400
#: Languages (distinct labels) beyond which a model (100 KB for each) can't be held; :func:`fit` raises rather than leave any out.
MAX_LANGS = 2000
CENTROIDS = 3
#: Rejection: the cosine lies below this share of the lowest thousandth of the training texts' cosines.
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.001
#: Texts with fewer trigrams are further from any centroid by chance: the limit shrinks with the root of their number.
FULL_TRIGRAMS = 400
#: Bytes of text that are turned into trigrams at once.
SLICE = 1 << 20
#: Rows of the draw that a task takes up before it cuts them.
CUT_ROWS = 100_000

_DRAWN = pa.schema([("l", pa.string()), ("u", pa.int64()), ("v", pa.int64())])
_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each inner byte, and whether that byte belongs to a word."""
    wide = data.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(19), data[1:-1] != 32


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """A row of trigram counts for each text."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    small: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not small:
            return
        data = np.frombuffer(b"".join(x for _, x in small), dtype=np.uint8)
        owner = np.repeat(np.arange(len(small)), [len(x) for _, x in small])[1:-1]
        bucket, valid = _buckets(data)
        flat = np.bincount(owner[valid] * BUCKETS + bucket[valid], minlength=len(small) * BUCKETS)
        out[[i for i, _ in small]] += flat.reshape(len(small), BUCKETS)
        small.clear()
        held = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        data = b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b"  "
        for at in range(0, max(1, len(data) - 2), SLICE):  # slices overlap by two bytes
            part = data[at : at + SLICE + 2]
            if at + SLICE + 2 < len(data):  # an inner slice is counted alone
                bucket, valid = _buckets(np.frombuffer(part, dtype=np.uint8))
                out[i] += np.bincount(bucket[valid], minlength=BUCKETS)
            else:
                small.append((i, part))
                held += len(part)
        if held > SLICE or len(small) >= 64:
            flush()
    flush()
    return out


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # BUCKETS x centroids
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        if not self.langs:
            return lang, score, rejected
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            counts = trigram_counts(part)
            limit = self.threshold * np.sqrt(np.minimum(counts.sum(axis=1) / FULL_TRIGRAMS, 1))
            cosine = np.clip(_unit(counts * self.idf) @ self.centroids, 0, 1)
            best = cosine.argmax(axis=1)
            for j, text in enumerate(part):
                if has_letter(text):
                    lang[at + j], score[at + j] = self.langs[best[j]], float(cosine[j, best[j]])
                    rejected[at + j] = score[at + j] < limit[j]
        return lang, score, rejected


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def _cluster(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from farthest-first seeds, so that the result is the same each time."""
    seeds = [_unit(rows.mean(axis=0, keepdims=True))[0]]
    nearest = rows @ seeds[0]
    while len(seeds) < min(k, len(rows)):
        seeds.append(rows[int(nearest.argmin())])
        nearest = np.maximum(nearest, rows @ seeds[-1])
    centers = np.array(seeds)
    for _ in range(rounds):
        own = (rows @ centers.T).argmax(axis=1)
        centers = np.array([_unit(rows[own == c].mean(axis=0, keepdims=True))[0] if (own == c).any() else centers[c] for c in range(len(centers))])
    return centers


def _first(per_lang: int):
    """For ``mapInArrow``: the first ``per_lang`` different ``(u, v)`` of each language, in bounded memory."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.drop_duplicates().sort_values(["u", "v"]).groupby("l", sort=False).head(per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, size = pd.DataFrame({"l": pd.Series(dtype=str), "u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")}), [], 0
        for batch in batches:
            new.append(batch.to_pandas())
            size += batch.num_rows
            if size > max(len(held), CUT_ROWS):
                held, new, size = cut(pd.concat([held, *new])), [], 0
        held = cut(pd.concat([held, *new]))
        if len(held):
            yield pa.RecordBatch.from_pandas(held, schema=_DRAWN, preserve_index=False)

    return run


def draw(rows: DataFrame, per_lang: int) -> DataFrame:
    """``l, u, v, place`` of the at most ``per_lang`` first rows of each language ``l`` by ``(u, v)``; rows that agree in all three count once.

    Three rounds, none of which meets all rows of a language: each task of the scan
    cuts its own, a task for each root of their number cuts what hashes to it, and the
    last round sorts what those left, so its share grows with the root of the tasks.
    """
    tasks = rows.rdd.getNumPartitions()
    schema = "l string, u long, v long"
    cut = rows.mapInArrow(_first(per_lang), schema).repartition(math.isqrt(max(tasks - 1, 0)) + 1, "u", "v").mapInArrow(_first(per_lang), schema)
    place = F.row_number().over(Window.partitionBy("l").orderBy("u", "v"))
    return cut.withColumn("place", place).where(F.col("place") <= per_lang)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_lang: int = MAX_TRAIN_PER_LANG, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on at most ``per_lang`` rows of each language.

    The sample is drawn by hashes of key and text, spread over the whole table, and
    texts are read again for the drawn rows only. Rows whose text is null or
    letterless and rows without a language don't count. Trigrams are counted and
    languages clustered on the executors; the driver gets a count for each bucket, and
    of each language its centroids and at most ``per_lang`` numbers.
    """
    rows = labelled.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null").where(F.col("t").rlike(r"\p{L}"))
    hashed = rows.select("l", "t", F.xxhash64(F.col("k").cast("string")).alias("u"), F.xxhash64("t").alias("v"))
    places = persist(draw(hashed.select("l", "u", "v"), per_lang), "langid-places")
    langs = places.select("l").distinct().count()
    if langs > MAX_LANGS:
        drop(places)
        raise ValueError(f"{langs} languages, more than {MAX_LANGS}")
    drawn = hashed.join(F.broadcast(places), ["l", "u", "v"]).dropDuplicates(["l", "u", "v"])  # at most MAX_LANGS * per_lang places

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = trigram_counts(batch.column(1).to_pylist())
            at = [np.flatnonzero(row) for row in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([row[x] for row, x in zip(counts, at, strict=True)], pa.list_(pa.float32()))], names=["l", "place", "at", "n"])

    sparse = persist(drawn.select("l", "t", "place").mapInArrow(count, "l string, place int, at array<int>, n array<float>"), "langid-sample")
    drop(places)
    n = sparse.count()
    if not n:
        return LanguageModel((), np.ones(BUCKETS, dtype=np.float32), np.zeros((BUCKETS, 0)), 0.0)
    df = np.zeros(BUCKETS)
    for bucket, n in sparse.select(F.explode("at").alias("b")).groupBy("b").agg(F.count("*")).collect():  # at most BUCKETS rows
        df[bucket] = n
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def cluster(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        dense = np.zeros((len(own), BUCKETS), dtype=np.float32)
        for i, (at, n) in enumerate(zip(own["at"], own["n"], strict=True)):
            dense[i, at] = n
        dense = _unit(dense * idf)
        found = _cluster(dense, centroids).astype(np.float32)
        return pd.DataFrame({"l": [own["l"].iloc[0]], "centers": [found.tobytes()], "similar": [(dense @ found.T).max(axis=1).astype(float)]})

    fitted = sparse.groupBy("l").applyInPandas(cluster, "l string, centers binary, similar array<double>").toPandas().sort_values("l")
    drop(sparse)
    centers = [np.frombuffer(x, dtype=np.float32).reshape(-1, BUCKETS) for x in fitted["centers"]]
    langs = [lang for lang, x in zip(fitted["l"], centers, strict=True) for _ in x]
    threshold = REJECT_SHARE * float(np.quantile(np.concatenate(list(fitted["similar"])), REJECT_QUANTILE))
    return LanguageModel(tuple(langs), idf, np.concatenate(centers).T.astype(np.float32), threshold)


def identify(model: LanguageModel, text: Column) -> Column:
    """Column ``struct<lang, score, rejected>`` of a text column, by Arrow batches."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = model.predict(list(texts))
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return run(text)
