import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quiverline import queries
from quiverline.functions import distance as D, payload as P
from quiverline.operators import search
from quiverline.operators.ann import AnnConfig, GraphIndex, IvfIndex, LshIndex, recall_at_k
from quiverline.operators.bitmap import BitmapIndex
from quiverline.operators.search import knn, knn_batch, knn_batch_expr
from quiverline.plans.filters import Filter, field
from quiverline.types import InvalidFilter, Metric

CASES = [
    ("euclidean", (0, 0), (3, 4), 5),
    ("euclidean", (1, 2, 3), (1, 2, 3), 0),
    ("cosine", (1, 0), (2, 0), 0),
    ("cosine", (1, 0), (0, 1), 1),
    ("cosine", (1, 0), (-1, 0), 2),
    ("cosine", (0, 0), (1, 0), 1),
    ("dot", (1, 2, 3), (4, 5, 6), -32),
    ("hamming", (1, 0, 1, 0), (1, 1, 0, 0), 2),
]


def frame(spark, rows, cols="id long, vector array<float>"):
    return spark.createDataFrame(rows, cols)


def test_distances(spark):
    for metric, a, b, want in CASES:
        df = frame(spark, [(1, [float(x) for x in a])])
        assert df.select(D.distance(metric, F.col("vector"), [float(x) for x in b])).first()[0] == pytest.approx(want)
        assert D.block_distances(metric, np.array([a], float), np.array([b], float))[0, 0] == pytest.approx(want)


def test_norms(spark):
    df = frame(spark, [(1, [3.0, 4.0]), (2, [0.0, 0.0])])
    rows = df.select(D.norm(F.col("vector")), D.normalized(F.col("vector"))).collect()
    assert rows[0][0] == 5 and rows[0][1] == pytest.approx([0.6, 0.8]) and rows[1][1] is None


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40).flatmap(lambda n: st.tuples(*[st.lists(st.floats(-1, 1, width=32), min_size=n, max_size=n)] * 2)))
def test_block_kernels(pair):
    a, b = (np.array(x, float) for x in pair)
    assert D.block_distances("dot", a[None], b[None])[0, 0] == pytest.approx(-sum(x * y for x, y in zip(a, b, strict=True)), abs=1e-6)
    assert D.block_distances("euclidean", a[None], b[None])[0, 0] ** 2 == pytest.approx(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), abs=1e-6)


def test_metric_names():
    assert Metric.of("dot") is Metric.DOT
    with pytest.raises(ValueError, match="Invalid metric"):
        Metric.of("x")


def test_search_guards_and_ties(spark):
    df = frame(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [1.0])])
    assert [r["id"] for r in knn(df, [1.0, 0.0], 2).collect()] == [1, 3]
    assert knn(df, [1.0, 0.0, 0.0], 2).count() == 0
    assert knn(df, [1.0, 0.0], 0).count() == 0 and knn(df, [1.0, 0.0], 99).count() == 3


def test_pushdown(spark, tmp_path):
    frame(spark, [(i, [float(i), 1.0], i % 3) for i in range(9)], "id long, vector array<float>, label int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = knn(df, [1.0, 1.0], 2, where=field("label").eq(1))._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualNullSafe(label,1)" in plan


def test_batch_engines_agree(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, [(i, rng.normal(size=8).tolist()) for i in range(60)]).repartition(4)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(5)], "qid long, qv array<float>")
    for metric in ("cosine", "euclidean", "dot", "hamming"):
        a = [(r["qid"], r["rank"], r["id"]) for r in knn_batch(df, q, 4, metric).collect()]
        b = [(r["qid"], r["rank"], r["id"]) for r in knn_batch_expr(df, q, 4, metric).collect()]
        assert sorted(a) == sorted(b) and len(a) == 20


FIXTURE = '{"category":"documents","year":2024,"score":0.95,"active":true,"name":"test document","k":null,"n":1}'
FILTERS = [
    (field("category").eq("documents"), True), (field("category").eq("images"), False), (field("category").ne("images"), True),
    (field("year").gt(2020), True), (field("year").gte(2024), True), (field("year").lt(2025), True), (field("year").lte(2024), True),
    (field("category").contained_in(["documents", "images"]), True), (field("category").contained_in(["audio"]), False), (field("category").contained_in([]), False),
    (field("name").contains("document"), True), (field("name").contains(""), True), (field("year").contains("2"), False),
    (field("category").exists(), True), (field("none").exists(), False), (field("k").exists(), True),
    (field("category").eq("documents") & field("year").gt(2024), False), (field("category").eq("images") | field("year").eq(2024), True), (~field("category").eq("images"), True),
    (field("none").ne(1), True), (~field("none").gt(1), True), (field("none").eq(1), False), (field("none").gt(1), False),
    (field("n").eq(1.0), False), (field("n").eq("1"), False), (field("n").eq(True), False), (field("active").eq(True), True), (field("category").gt(1), False), (field("k").eq(None), True),
]


def test_payload_filters(spark):
    df = spark.createDataFrame([(FIXTURE,)], "j string").select(P.parse(F.col("j")).alias("p"))
    got = df.select(*[f.column(payload=F.col("p")).alias(f"c{i}") for i, (f, _) in enumerate(FILTERS)]).first()
    assert list(got) == [want for _, want in FILTERS]
    for f, _ in FILTERS:
        assert Filter.from_json(f.to_json()) == f
    with pytest.raises(InvalidFilter):
        Filter.from_json('{"op": "and", "parts": []}')


def test_payload_changes(spark):
    p = F.parse_json(F.lit('{"a":1,"b.c":"x"}'))
    row = spark.range(1).select(F.to_json(P.set_value(p, "z", F.lit("[1]"))), F.to_json(P.remove(p, "a")), P.get_str(p, "b.c"), P.get_i64(p, "b.c"), P.length(p)).first()
    assert row[0] == '{"a":1,"b.c":"x","z":[1]}' and row[1] == '{"b.c":"x"}' and row[2] == "x" and row[3] is None and row[4] == 2


def test_bitmap_equals_row_filter(spark):
    big = 4294967297
    df = spark.createDataFrame([(1, "red", 10), (2, "blue", 25), (3, None, 50), (big, "red", None), (32768, "green", 7), (32769, "red", 8), (0, "red", 1)], "id long, color string, price int")
    index = BitmapIndex.build(df, "id", ["color", "price"])
    assert index.size() == 7
    for f in (field("color").eq("red"), field("color").ne("red"), field("color").contained_in(["red", "blue"]), field("price").gt(8), ~field("price").gt(8), field("color").exists(), field("color").contains("re"), field("color").eq("red") & field("price").lt(20), field("color").eq("blue") | field("price").eq(7), field("price").eq("10")):
        assert sorted(r[0] for r in index.ids(index.query(f)).collect()) == sorted(r[0] for r in df.where(f.column() if f != field("price").eq("10") else F.lit(False)).select("id").collect()), f


def test_graph_recall(spark):
    rows = frame(spark, [(i, [float(np.sin(8 * i + j)) for j in range(8)]) for i in range(200)])
    queries = [(q, [float(np.cos(7 * q + j)) for j in range(8)]) for q in range(10)]
    exact = knn_batch(rows, spark.createDataFrame(queries, "qid long, qv array<double>"), 10, "euclidean")
    index = GraphIndex(rows, "euclidean", AnnConfig(), shard_rows=80)
    recall = recall_at_k(index.search_batch(queries, 10, ef=200), exact, 10).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    few = index.search_with_ids(queries, 5, spark.createDataFrame([(1,), (2,)], "id long"))
    assert {r["id"] for r in few.collect()} == {1, 2}
    with pytest.raises(ValueError):
        AnnConfig(m=1)


def test_ivf(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = frame(spark, [(i, (rng.normal(size=4) + 10 * (i % 4)).tolist()) for i in range(200)])
    index = IvfIndex.build(df, 4).save(str(tmp_path / "ivf"))
    q = [10.0, 10.0, 10.0, 10.0]
    want = [r["id"] for r in knn(df, q, 5, "euclidean").collect()]
    assert [r["id"] for r in index.search(q, 5, nprobe=1).collect()] == want
    assert "PartitionFilters: [isnotnull(cell" in index.search(q, 5, nprobe=1)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["ivf_recall", "lsh_recall"])
def test_recall_of_defaults(spark, tmp_path, name):
    """On vectors without clusters, the hard case of cells."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.uniform(-1, 1, size=64).tolist(), i % 5) for i in range(2000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    recall = [r["recall"] for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    assert len(recall) == 20 and sum(recall) / 20 >= 0.9


def scans_of(spark, folder, name, n):
    """Scans of the table in the plan of a query over ``n`` rows."""
    spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0], 0) for i in range(n)], "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return queries.queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def of_each(spark, index, many, k, **how):
    """What single searches find."""
    return sorted((qid, r["id"], round(r["distance"], 9)) for qid, q in many for r in index.search(q, k, **how).collect())


def test_lsh_batch(spark, tmp_path):
    """Equals single searches, also where rows share no bucket, and its plan doesn't grow with the queries."""
    rng = np.random.default_rng(5)
    df = frame(spark, [(i, [float(x) for x in rng.integers(-3, 4, size=3)]) for i in range(150)] + [(900, [0.0, 0.0, 0.0])]).repartition(3)
    many = [(i, [float(x) for x in rng.integers(-4, 5, size=3)]) for i in range(6)] + [(6, [0.0, 0.0, 0.0]), (7, [90.0, 90.0, 90.0])]
    q = spark.createDataFrame([*many, (8, [1.0])], "qid long, qv array<double>")
    for metric in ("euclidean", "cosine"):
        for where in (None, field("id").gte(70)):
            index = LshIndex(df, tables=2, bucket=0.7, metric=metric)
            got = index.search_batch(q, 20, where).collect()
            assert sorted((r["qid"], r["id"], round(r["distance"], 9)) for r in got) == of_each(spark, index, many, 20, where=where)
            assert metric == "cosine" or len([r for r in got if r["qid"] == 7]) == 0
    assert scans_of(spark, tmp_path / "a", "lsh_recall", 300) == scans_of(spark, tmp_path / "b", "lsh_recall", 1500)


def test_ivf_batch(spark, tmp_path):
    """Equals single searches of some cells, and its plan doesn't grow with the queries."""
    rng = np.random.default_rng(7)
    df = frame(spark, [(i, (rng.normal(size=4) + 3 * (i % 4)).tolist()) for i in range(200)]).repartition(3)
    many = [(i, (rng.normal(size=4) + 3 * (i % 4)).tolist()) for i in range(6)]
    q = spark.createDataFrame([*many, (8, [1.0])], "qid long, qv array<double>")
    for metric in ("euclidean", "cosine"):
        index = IvfIndex.build(df, 6, metric).save(str(tmp_path / metric))
        for nprobe, where in ((1, None), (2, field("id").gte(70))):
            got = index.search_batch(q, 60, nprobe, where).collect()
            assert sorted((r["qid"], r["id"], round(r["distance"], 9)) for r in got) == of_each(spark, index, many, 60, nprobe=nprobe, where=where)
            assert len(got) < 60 * len(many)
    assert scans_of(spark, tmp_path / "a", "ivf_recall", 300) == scans_of(spark, tmp_path / "b", "ivf_recall", 1500)


def test_batch_by_expressions_of_many_queries(spark, monkeypatch):
    """More queries than a block of the other engine, in several blocks, with ties, bounds and odd lengths."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, size=3)]) for i in range(700)] + [(1000 + i, [float(i), 1.0]) for i in range(9)] + [(2000, None), (2001, []), (2002, [float("nan"), 0.0, 1.0])]
    df = frame(spark, rows, "id long, vector array<double>").repartition(3)
    many = [(i, [float(x) for x in rng.integers(-2, 3, size=3)]) for i in range(search.QUERY_BLOCK + 60)] + [(9000, [3.0, 1.0]), (9001, [1.0] * 5), (9002, [0.0, 0.0, 0.0])]
    q = spark.createDataFrame(many, "qid long, qv array<double>")
    monkeypatch.setattr(search, "QUERY_BYTES", 20_000)
    monkeypatch.setattr(search, "WRITTEN", 1)
    for metric in ("cosine", "hamming"):
        a, b = (sorted((r["qid"], r["rank"], round(r["distance"], 9)) for r in f(df, q, 3, metric).collect()) for f in (knn_batch, knn_batch_expr))
        assert a == b and len(a) == 3 * (len(many) - 1)
    got = {(r["qid"], r["rank"]): r["id"] for r in knn_batch_expr(df, q, 3, "hamming").collect()}
    assert all(got[r["qid"], r["rank"]] == r["id"] for r in knn_batch(df, q, 3, "hamming").collect())
    assert knn_batch_expr(df, q.limit(0), 3).count() == 0 and knn_batch_expr(df, q.limit(2), 0).count() == 0


def test_batch_keeps_the_nearest_of_ties_and_nan(spark):
    """Many rows at one distance, rows with NaN, and fewer rows than ``k``."""
    rows = [(i, [float(i % 3), 0.0]) for i in range(9000)] + [(10_000 + i, [float("nan"), 0.0]) for i in range(50)]
    df = frame(spark, sorted(rows, key=lambda r: hash(r[0] * 7919 % 9973))).repartition(2)
    q = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0])], "qid long, qv array<float>")
    got = sorted((r["qid"], r["rank"], r["id"]) for r in knn_batch(df, q, 5, "euclidean").collect())
    assert got == [(0, i + 1, 3 * i) for i in range(5)] + [(1, i + 1, 3 * i + 2) for i in range(5)]
    few = df.where("id < 3 OR id >= 10040")
    assert [r["id"] for r in knn_batch(few, q.where("qid = 0"), 20, "euclidean").orderBy("rank").collect()] == [0, 1, 2, *range(10_040, 10_050)]


def test_filters_of_plain_columns_mind_the_type(spark):
    """Only strings contain; only numbers have an order, and NaN has none."""
    df = spark.createDataFrame([(1, "b12", 2.0, float("nan")), (12, None, float("inf"), 3.0)], "i long, s string, d double, n double")
    cases = {"i": (field("i").contains("1"), []), "s": (field("s").contains("12"), [1]), "d": (field("d").gt(1), [1, 12]), "n": (field("n").gt(1), [12]), "n2": (field("n").gte(3), [12]), "n3": (field("n").lt(9), [12]), "s2": (field("s").gt(1), []), "not": (~field("n").gt(1), [1])}
    for name, (f, want) in cases.items():
        assert sorted(r["i"] for r in df.where(f.column()).collect()) == want, name
    assert "typeof" not in df.where(field("d").gt(1).column())._jdf.queryExecution().optimizedPlan().toString()
