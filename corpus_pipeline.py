"""A pipeline that makes a training corpus of the documents: each stage is an operator whose decisions take effect.

``run`` writes what each stage keeps as Parquet in the shared folder and reads it
again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quiverline.deploy import ship
from quiverline.llm import decontaminate, jaccard, langid, pii, sentencepiece_codec
from quiverline.llm.common import persist, small_batches, table
from quiverline.llm.queries import SENTENCEPIECE_MODEL, language_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of an Arrow batch. Python workers serve one stage after the other and keep what each held most.
BATCH_ROWS = 250


def _begin(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ship(spark)
    small_batches(spark, BATCH_ROWS)
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those too far from every language, go."""
    docs = _begin(spark, docs)
    model = language_model(docs)
    return docs.withColumn("_l", langid.identify(model, F.col("text"))).where(~F.col("_l.rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked by five-word shingles the one with the smallest id stays; documents without an id stay.

    Rows that repeat an id with the same text come down to one; different texts under one id all stay if their id does.
    """
    docs = _begin(spark, docs)
    kept = jaccard.join(docs).where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    known = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("_key", pii.text_key(F.col("text"))).dropDuplicates(["doc_id", "_key"])
    return known.unionByName(docs.where("doc_id is null").withColumn("_key", F.lit(""))).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    docs = _begin(spark, docs)
    return decontaminate.judged(spark, docs, table(spark, sf_dir, "benchmark")).where(F.size("_spans") == 0).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, terms that disclose it are generalised or removed; ``n_chars`` follows the text."""
    docs = _begin(spark, docs)
    extra = pii.analyse(docs).extra.toDF("_key", "_terms")
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"_spans": pii.base_spans(text), "_key": pii.text_key(F.col("text"))}).join(extra, "_key", "left").withColumn("_terms", pii.known_terms(F.col("_terms")))
    rows = rows.withColumn("text", F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("_spans"), F.col("_terms"))))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding gives its text back."""
    docs = _begin(spark, docs)
    sent = sentencepiece_codec.send(spark, sentencepiece_codec.read_model(SENTENCEPIECE_MODEL))
    rows = docs.select("doc_id", "lang", "source", sentencepiece_codec.encode_checked(sent, F.col("text")).alias("r")).select("doc_id", "lang", "source", "r.*")
    return rows.select("doc_id", "lang", "source", "tokens", F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"), "exact")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: Components, models and segmentations are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
