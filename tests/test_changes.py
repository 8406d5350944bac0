"""What is stored and changes: the graph index, bitmaps, small files, and collections that a crash cuts short."""

import json

import pytest
from pyspark.sql import functions as F

from quiverline.operators.bitmap import BitmapIndex
from quiverline.operators.graph_store import StoredGraph
from quiverline.plans.filters import field
from quiverline.sources.collection import AsyncCollection, Collection
from quiverline.sources.files import Store
from quiverline.types import CollectionConfig, CollectionError, DimensionMismatch, DuplicateId, Metric


def vectors(spark, ids):
    return spark.createDataFrame([(i, [float(i % 7), float(i // 7), i / 3], json.dumps({"g": i % 2})) for i in ids], "id long, vector array<double>, payload string")


def test_stored_graph(spark, tmp_path):
    path = str(tmp_path / "graph")
    index = StoredGraph.open_or_create(spark, path, 3, "euclidean", shard_rows=30)
    assert index.is_empty() and len(index) == 0 and index.search([0, 0, 0], 3).count() == 0
    index.insert(vectors(spark, range(60)), payload_col="payload")
    index.insert(vectors(spark, range(60, 80)), payload_col="payload")
    with pytest.raises(DuplicateId):
        index.insert(vectors(spark, [5]))
    with pytest.raises(DuplicateId):
        index.insert(vectors(spark, [100, 100]))
    with pytest.raises(DimensionMismatch):
        index.search([0.0], 3)
    assert len(index) == 80 and index.get(7)["payload"] == '{"g": 1}' and index.get(99) is None and index.max_level() >= 1
    near = lambda i, q, **more: [r["id"] for r in i.search(q, 3, ef=100, **more).orderBy("rank").collect()]
    want = sorted(range(80), key=lambda i: ((i % 7 - 3) ** 2 + (i // 7 - 5) ** 2 + (i / 3 - 12) ** 2, i))
    assert near(index, [3, 5, 12]) == want[:3]
    assert index.delete([want[0], 999]) == 1 and index.delete([want[0]]) == 0
    again = StoredGraph.open_or_create(spark, path, 3)
    assert near(again, [3, 5, 12]) == want[1:4] and len(again) == 79
    assert near(again, [3, 5, 12], where=F.col("id") % 2 == 0) == [i for i in want[1:] if i % 2 == 0][:3]
    again.insert(vectors(spark, [want[0]]))  # a deleted id may come back
    assert near(again, [3, 5, 12]) == want[:3]
    again.compact()
    assert len(again.meta["parts"]) == 1 and near(StoredGraph.open_or_create(spark, path, 3), [3, 5, 12]) == want[:3]
    again.clear()
    assert StoredGraph.open_or_create(spark, path, 3).is_empty()
    with pytest.raises(DimensionMismatch):
        StoredGraph.open_or_create(spark, path, 4)
    with pytest.raises(CollectionError):
        StoredGraph.open_or_create(spark, path, 3, "dot")


def test_bitmap_changes(spark):
    rows = spark.createDataFrame([(i, f"c{i % 3}", float(i)) for i in range(200)] + [(100_000, "c1", 2.0)], "id long, c string, x double")
    index = BitmapIndex.build(rows.where("id < 100"), "id", ["c", "x"]).insert(rows.where("id >= 100"), "id").delete(rows.where("id % 4 = 0 and id < 90000").select("id"))
    whole = rows.where("id % 4 != 0 or id > 90000")
    assert index.size() == len(index) == whole.count() and not index.is_empty()
    for f, sql in ((field("c").eq("c1"), "c = 'c1'"), (field("x").gt(50), "x > 50"), (~field("c").eq("c2") if hasattr(field("c").eq("c2"), "__invert__") else field("c").ne("c2"), "c != 'c2'")):
        assert {r["id"] for r in index.ids(index.query(f)).collect()} == {r["id"] for r in whole.where(sql).collect()}
    assert index.clear().is_empty() and index.clear().size() == 0


def test_versions_of_small_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.make()
    assert not store.exists("meta.json")
    store.write("meta.json", "one")
    (tmp_path / "s" / "_meta.json.tmp").write_text("half")  # a write that didn't end
    assert store.read("meta.json") == "one"
    store.write("meta.json", "two")
    assert store.read("meta.json") == "two" and len(store._versions("meta.json")) == 1


def test_collection_after_crashes(spark, tmp_path):
    config, path = CollectionConfig(2, Metric.EUCLIDEAN), str(tmp_path / "c")
    c = Collection.open_or_create(spark, path, config)
    c.insert_batch([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (1, [9.0, 9.0])])
    assert list(c.get(1)["vector"]) == [9.0, 9.0]  # of rows that repeat an id the last one counts
    with pytest.raises(DuplicateId):
        c.insert_batch(spark.createDataFrame([(5, [0.0, 1.0]), (5, [1.0, 1.0])], "id long, vector array<float>"))
    c.delete(2)
    c.sync()
    first = sorted((tmp_path / "c" / "log").iterdir())
    assert len(first) == 2

    # Ended within flush, after the new meta and with the log removed in part: the insert is back without its delete.
    saved, remove = [], c.store.delete
    c.store.delete = lambda name: saved.append(name) if name == "log" else remove(name)
    c.flush()
    for x in first[1:] if "batch" in first[0].name or "seq=1" == first[0].name else first[:-1]:
        for f in x.iterdir():
            f.unlink()
        x.rmdir()
    again = Collection.open_or_create(spark, path, config)
    assert saved == ["log"] and again.get(2) is None and len(again) == 1
    again.insert(2, [5.0, 5.0])
    again.sync()
    assert len(Collection.open_or_create(spark, path, config)) == 2

    # A batch that wasn't committed isn't seen.
    again.insert_batch([(7, [1.0, 1.0])], name="b")
    (tmp_path / "c" / "log" / "batch=b" / "_SUCCESS").unlink()
    assert Collection.open_or_create(spark, path, config).get(7) is None

    # Data without its meta isn't taken for a new collection.
    for f in (tmp_path / "c").glob("meta.json*"):
        f.unlink()
    with pytest.raises(CollectionError):
        Collection.open_or_create(spark, path, config)


def test_async_from_sync(spark, tmp_path):
    c = AsyncCollection.from_sync(Collection.open_or_create(spark, str(tmp_path / "a"), CollectionConfig(2)))
    c.insert(1, [1.0, 0.0]).result()
    assert c.len().result() == c.size().result() == 1
