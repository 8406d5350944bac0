import os

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quiverline.llm import sentencepiece_codec
from quiverline.llm.queries import SENTENCEPIECE_MODEL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.language_id(spark, docs, SF)
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    label = brute.jaccard(list(kept.items()))
    kept = {d: t for d, t in kept.items() if label[d][1] == d}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = brute.contamination(list(kept.items()), items)
    kept = {d: t for d, t in kept.items() if not hit[d][4]}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert out.keys() == kept.keys() and all(r["exact"] for r in out.values())
    codec = sentencepiece_codec.Codec.load(sentencepiece_codec.read_model(SENTENCEPIECE_MODEL))
    for d, t in kept.items():
        text = codec.decode(out[d]["tokens"])
        assert not brute.pii(text)[1]
        if not brute.pii(t)[1]:
            assert text == t


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "The quick brown fox", "en", "s", 1), (3, "The quick brown fox mail a@b.cd", "en", "s", 1), (3, "The quick brown fox mail a@b.cd", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("id", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert out.count() <= 5
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 5
