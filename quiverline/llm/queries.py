"""The queries of the corpus operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quiverline.llm import anchors, decontaminate, htmltext, jaccard, langid, pii, quality, sentencepiece_codec, substring_dedup, suffix_array, warc
from quiverline.llm.common import persist, small_batches, table

#: Where the model file of a public SentencePiece tokenizer lies.
SENTENCEPIECE_MODEL = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.found(pii.analyse(table(spark, sf_dir, "documents")))
    n = [pii.number(F.col("spans"), k).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return rows.select(F.col("id").alias("doc_id"), *n, F.sha2(pii.listed(F.col("spans")), 256).alias("base_sha256"), pii.listed(pii.all_spans(F.col("spans"), F.col("terms"))).alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = anchors.with_spans(docs, substring_dedup.removed_spans(docs), "doc_id", "text")
    return rows.select("doc_id", substring_dedup.digest(F.col("text"), F.col("_spans")).alias("d")).select("doc_id", "d.*")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    sent = sentencepiece_codec.send(spark, sentencepiece_codec.read_model(SENTENCEPIECE_MODEL))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sentencepiece_codec.round_trip(sent, F.col("text")).alias("r")).select("doc_id", "r.*")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = anchors.with_spans(docs, suffix_array.removed_spans(docs), "doc_id", "text")
    return rows.select("doc_id", suffix_array.digest(F.col("text"), F.col("_spans")).alias("d")).select("doc_id", "d.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    rows = persist(docs.select("doc_id", quality.figures_of(F.col("text")).alias("f")).select("doc_id", "f.*"), "quality-figures")
    return quality.judge(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    rows = decontaminate.judged(spark, docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.n_hit(F.col("_spans")))
    return rows.select("doc_id", F.col("_n_words").alias("n_words"), "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs.where(~_held_out()))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = language_model(docs)
    rows = docs.select("doc_id", _held_out().alias("held_out"), langid.identify(model, F.col("text")).alias("l"))
    return rows.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score", "l.rejected")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = table(spark, sf_dir, "pages")
    rows = htmltext.extract(pages, persist(htmltext.wrappers(pages), "html-wrappers"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_substring_dedup, op3_warc, op4_jaccard, op5_sentencepiece, op6_suffix_array, op7_quality, op8_decontaminate, op9_langid, op10_html)}


#: DuckDB SQL of the operators that it can express on whole tables.
_ARCHIVED = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest, min(page_id) OVER (PARTITION BY sha256(h)) AS one FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 100 AND page_id > one THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > one THEN one END AS refers_to
FROM d
"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATED = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
places AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d JOIN (SELECT DISTINCT n FROM windows) ON len(w) >= n)),
hits AS (SELECT doc_id, k, n, item_id FROM places JOIN windows USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _ARCHIVED, "op8_decontaminate": _CONTAMINATED}
