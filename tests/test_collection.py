import json
import urllib.request

import pytest
from pyspark.sql import functions as F

from quiverline.plans.filters import field
from quiverline.server import serve
from quiverline.sources.collection import AsyncCollection, Collection, FlatIndex
from quiverline.streaming.ingest import upserts
from quiverline.text import HashingEmbedder, TextStore
from quiverline.types import CollectionConfig, CollectionError, DimensionMismatch, DuplicateId, InvalidVector, Metric, NotFound, SyncMode

CONFIG = CollectionConfig(3, Metric.EUCLIDEAN, SyncMode.IMMEDIATE)


def test_flat_index(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "a"), (2, [0.0, 1.0, 0.0], "b")], "id long, vector array<float>, type string")
    index = FlatIndex.from_dataframe(df, "euclidean")
    with pytest.raises(DuplicateId):
        index.insert(1, [0, 0, 1], type="x")
    with pytest.raises(DimensionMismatch, match="dimension mismatch: expected 3, got 2"):
        index.insert(3, [0, 0])
    id_, index = index.insert_auto([0, 0, 1], type="a")
    assert id_ == 3 and len(index) == 3 and index.next_id == 4
    with pytest.raises(NotFound):
        index.update(9, [0, 0, 1])
    index = index.update(2, [0, 2, 0], type="c")
    assert index.get(2)["type"] == "c"
    there, index = index.delete(1)
    assert there and not index.delete(1)[0] and sorted(r[0] for r in index.ids().collect()) == [2, 3]
    assert [r["id"] for r in index.search([0, 0, 1], 5, field("type").eq("a")).collect()] == [3]
    assert index.clear().is_empty() and index.clear().next_id == 1


def test_reopen(spark, tmp_path):
    path = str(tmp_path / "c")
    c = Collection.open_or_create(spark, path, CONFIG)
    c.insert(1, [1, 2, 3], {"v": 1})
    c.insert(2, [0, 0, 1])
    with pytest.raises(DimensionMismatch):
        c.insert(1, [1, 2])
    with pytest.raises(InvalidVector):
        c.insert(3, [1, 2, float("nan")])
    c = Collection.open_or_create(spark, path, CONFIG)  # nothing was flushed
    assert len(c) == 2 and list(c.get(1)["vector"]) == [1, 2, 3]
    c.flush()
    c.update(1, [4, 5, 6], {"v": 2})
    c.flush()
    c = Collection.open_or_create(spark, path, CONFIG)
    assert list(c.get(1)["vector"]) == [4, 5, 6]
    assert c.delete(2) and not c.delete(2)
    c.flush()
    c = Collection.open_or_create(spark, path, CONFIG)
    assert len(c) == 1 and c.insert_auto([0, 0, 0]) == 3
    assert [r["id"] for r in c.search([4, 5, 6], 5, field("v").eq(2)).collect()] == [1]
    with pytest.raises(CollectionError):
        Collection.open_or_create(spark, path, CollectionConfig(3, Metric.DOT))
    with pytest.raises(DimensionMismatch):
        Collection.open_or_create(spark, path, CollectionConfig(4, Metric.EUCLIDEAN))


def test_buffer_and_batches(spark, tmp_path):
    c = Collection.open_or_create(spark, str(tmp_path / "b"), CollectionConfig(1, Metric.EUCLIDEAN, SyncMode.BATCHED))
    for i in range(101):
        c.insert(i, [float(i)])
    assert len(c._buffer) == 1 and len(c) == 101
    with pytest.raises(Exception, match="bad vector"):
        c.insert_batch(spark.createDataFrame([(500, [1.0]), (501, [1.0, 2.0])], "id long, vector array<float>"))
    assert len(c) == 101
    q = spark.createDataFrame([(1, [50.2])], "qid long, qv array<float>")
    assert [r["id"] for r in c.search_batch(q, 2).orderBy("rank").collect()] == [50, 51]
    a = AsyncCollection(c)
    a.insert(7, [1000.0]).result()
    assert a.search([1000.0], 1).result()[0]["id"] == 7
    with pytest.raises(DimensionMismatch):
        a.insert(8, [1.0, 2.0]).result()


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 0.0, 0.0], '{"a":1}'), (2, [0.0, 1.0, 0.0], "{}")], "id long, vector array<float>, payload string").write.parquet(str(tmp_path / "in"))
    c = Collection.open_or_create(spark, str(tmp_path / "c"), CONFIG)
    stream = spark.readStream.schema("id long, vector array<float>, payload string").parquet(str(tmp_path / "in"))
    upserts(stream, c, str(tmp_path / "check")).awaitTermination()
    upserts(stream, c, str(tmp_path / "check")).awaitTermination()
    assert len(c) == 2


def test_text_store(spark, tmp_path):
    store = TextStore.from_texts(spark, str(tmp_path / "t"), ["red apple", "blue sky"], HashingEmbedder(32), [{"n": 1}, {"n": 2}])
    assert store.similarity_search("blue sky", 1) == [("blue sky", {"n": 2})]
    again = TextStore(spark, str(tmp_path / "t"), HashingEmbedder(32))
    assert again.add_texts(["green tree"]) == ["3"] and again.as_retriever(1)("red apple")[0][0] == "red apple"
    with pytest.raises(ValueError):
        again.add_texts(["a", "b"], [{}])


def test_http(spark, tmp_path):
    server = serve(spark, str(tmp_path))

    def post(path, body):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", json.dumps(body).encode(), method="POST")
        try:
            with urllib.request.urlopen(r) as f:
                return f.status, json.loads(f.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())["error"]

    assert post("/collections/x", {"dimension": 3, "metric": "cosine"})[0] == 201
    assert post("/collections/x", {"dimension": 3, "metric": "y"}) == (400, "Invalid metric")
    assert post("/collections/x/insert", {"id": 1, "vector": [1, 0, 0], "payload": {"foo": "bar"}})[0] == 200
    assert post("/collections/x/insert", {"id": 1, "vector": [1, 0, 0], "payload": 3}) == (400, "Payload must be a JSON object")
    assert post("/collections/none/insert", {"id": 1, "vector": [1]}) == (404, "Collection not found")
    assert post("/collections/x/search", {"vector": [1, 0, 0], "k": 1})[1][0]["id"] == 1
    server.shutdown()


def test_entry_without_corpus(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert set(e.oracle_sql()) <= set(q) and "knn_cosine" in q
    assert e.entry(spark).agg(F.count("*")).first()[0] == 10
