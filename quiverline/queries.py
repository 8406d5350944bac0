"""The queries of the vector operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quiverline.functions import distance as D, payload as P
from quiverline.operators.ann import GraphIndex, IvfIndex, LshIndex, recall_at_k, selectivity
from quiverline.operators.bitmap import BitmapIndex
from quiverline.operators.graph_store import StoredGraph
from quiverline.operators.search import knn, knn_batch, knn_batch_expr, knn_post_filter
from quiverline.plans.filters import Filter, field
from quiverline.sources.collection import latest
from quiverline.sources.files import shared_dir
from quiverline.text import HashingEmbedder, embedded
from quiverline.types import Metric

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

ID, VEC = "vec_id", "embedding"
OWN = {"id_col": ID, "vec_col": VEC}


def _add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return put


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols or ("distance",):
        df = df.withColumn(c, F.round(c, 6) + 0.0)
    return df


def _first(df: DataFrame, at: int = 0) -> list[float]:
    row = df.where(F.col(ID) == at).select(VEC).first()
    return list(row[0]) if row else []


# Vectors as they are, by sign (for Hamming), and of different lengths.
FORMS = {
    "": (lambda v, i: v, "embedding::DOUBLE[]"),
    "sign": (lambda v, i: F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(0.0)), "list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"),
    "scaled": (lambda v, i: F.transform(v, lambda x: x.cast("double") * (1 + i % 5)), "list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 5))"),
}
SQL_DISTANCE = {
    "cosine": "CASE WHEN sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(qv, qv)) = 0 THEN 1.0 ELSE 1 - list_inner_product(v, qv) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(qv, qv))) END",
    "euclidean": "list_distance(v, qv)",
    "dot": "-list_inner_product(v, qv)",
    "hamming": "len(list_filter(list_zip(v, qv), lambda p: (p[1] > 0.5) <> (p[2] > 0.5)))::DOUBLE",
}


def _formed(spark: SparkSession, d: str, form: str) -> DataFrame:
    return _table(spark, d, "embeddings").withColumn(VEC, FORMS[form][0](F.col(VEC), F.col(ID)))


def _rows_sql(form: str = "", where: str = "true") -> str:
    return f"SELECT vec_id, label, {FORMS[form][1]} AS v FROM embeddings WHERE {where}"


def _knn_sql(metric: str, form: str = "", k: int = 10, where: str = "true", at: int = 0) -> str:
    return f"""WITH s AS ({_rows_sql(form, where)}), q AS (SELECT v AS qv FROM ({_rows_sql(form)}) WHERE vec_id = {at}),
    d AS (SELECT vec_id, label, {SQL_DISTANCE[metric]} AS x FROM s, q)
    SELECT vec_id, label, round(x, 6) + 0.0 AS distance FROM d ORDER BY x, vec_id LIMIT {k}"""


def _knn(name: str, metric: str, form: str = "", k: int = 10, where: Filter | None = None, sql_where: str = "true", at: int = 0) -> None:
    @_add(name, _knn_sql(metric, form, k, sql_where, at))
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _formed(spark, d, form)
        return _rounded(knn(df, _first(df, at), k, metric, where, columns=["label"], **OWN))


for _m in ("cosine", "euclidean", "dot"):
    _knn(f"knn_{_m}", _m)
    _knn(f"knn_scaled_{_m}", _m, "scaled", at=3)
_knn("knn_hamming", "hamming", "sign")
_knn("knn_k_gt_n", "cosine", k=1_000_000)
_knn("knn_k_zero", "cosine", k=0)
_knn("knn_filtered_label", "cosine", where=field("label").eq(3), sql_where="label = 3")
_knn("knn_filtered_in", "euclidean", "scaled", where=field("label").contained_in([1, 4]) & field("vec_id").gte(10), sql_where="label IN (1, 4) AND vec_id >= 10")


@_add("knn_zero_vector", f"WITH s AS ({_rows_sql()}), q AS (SELECT list_transform(v, lambda x: 0.0::DOUBLE) AS qv FROM s WHERE vec_id = 0), d AS (SELECT vec_id, {SQL_DISTANCE['cosine']} AS x FROM s, q) SELECT vec_id, round(x, 6) + 0.0 AS distance FROM d ORDER BY x, vec_id LIMIT 10")
def _zero(spark, d):
    df = _table(spark, d, "embeddings")
    return _rounded(knn(df, [0.0] * len(_first(df)), 10, "cosine", **OWN))


@_add("knn_dim_mismatch", "SELECT vec_id, 0.0::DOUBLE AS distance FROM embeddings WHERE false")
def _mismatch(spark, d):
    return knn(_table(spark, d, "embeddings"), [1.0, 2.0], 10, **OWN)


@_add("knn_post_filter", f"WITH t AS ({_knn_sql('cosine', k=50)}) SELECT * FROM t WHERE label = 3 ORDER BY distance, vec_id LIMIT 10")
def _post(spark, d):
    df = _table(spark, d, "embeddings")
    return _rounded(knn_post_filter(df, _first(df), 10, 50, field("label").eq(3), "cosine", columns=["label"], **OWN))


_BATCH = f"""WITH s AS ({{rows}}), q AS (SELECT vec_id AS qid, v AS qv FROM ({_rows_sql()}) WHERE vec_id % 10 = 0),
    d AS (SELECT qid, vec_id, {{distance}} AS x FROM s, q), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x, vec_id) AS rank FROM d)
    SELECT qid, vec_id, round(x, 6) + 0.0 AS distance, rank::INT AS rank FROM r WHERE rank <= 10"""


def _queries_of(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col(ID).alias("qid"), F.col(VEC).alias("qv"))


def _batch(name: str, metric: str, f: Callable, where: Filter | None = None, sql_where: str = "true") -> None:
    @_add(name, _BATCH.format(rows=_rows_sql(where=sql_where), distance=SQL_DISTANCE[metric]))
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _table(spark, d, "embeddings")
        found = f(rows.where(where.column()) if where else rows, _queries_of(spark, d), 10, metric, **OWN)
        return _rounded(found.select("qid", ID, "distance", F.col("rank").cast("int").alias("rank")))


_batch("knn_batch", "cosine", knn_batch)
_batch("knn_batch_l2", "euclidean", knn_batch)
_batch("knn_batch_dot", "dot", knn_batch)
_batch("knn_batch_expr", "cosine", knn_batch_expr)
_batch("knn_batch_filtered", "euclidean", knn_batch, field("label").lt(5), "label < 5")


@_add("vector_norm", f"SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) + 0.0 AS norm, len(v)::INT AS dimension FROM ({_rows_sql('scaled')})")
def _norm(spark, d):
    return _rounded(_formed(spark, d, "scaled").select(ID, D.norm(F.col(VEC)).alias("norm"), F.size(VEC).alias("dimension")), "norm")


@_add("vector_normalized", f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) + 0.0 AS total, round(v[1] / sqrt(list_inner_product(v, v)), 6) + 0.0 AS first FROM ({_rows_sql('scaled')})")
def _normalized(spark, d):
    rows = _formed(spark, d, "scaled").select(ID, D.normalized(F.col(VEC)).alias("u"))
    return _rounded(rows.select(ID, F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("u")[0].alias("first")), "total", "first")


def _pairwise(name: str, column: Callable, sql: str) -> None:
    @_add(name, f"WITH s AS ({_rows_sql('scaled')}), q AS (SELECT v AS qv FROM s WHERE vec_id = 1) SELECT vec_id, round({sql}, 5) + 0.0 AS value FROM s, q")
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _formed(spark, d, "scaled")
        return df.select(ID, (F.round(column(F.col(VEC), _first(df, 1)), 5) + 0.0).alias("value"))


_pairwise("l2_squared", D.euclidean_squared, "list_distance(v, qv) * list_distance(v, qv)")
_pairwise("dot_product", D.dot_product, "list_inner_product(v, qv)")
_pairwise("similarity", lambda v, q: D.similarity(D.cosine(v, q)), f"1 - ({SQL_DISTANCE['cosine']})")

_E = "SELECT event_id FROM events WHERE "
FILTERS: dict[str, tuple[Filter, str]] = {
    "eq": (field("event_type").eq("click"), "coalesce(event_type = 'click', false)"),
    "ne": (field("event_type").ne("click"), "NOT coalesce(event_type = 'click', false)"),
    "gt": (field("value").gt(50), "coalesce(value > 50, false)"),
    "gte": (field("value").gte(50.5), "coalesce(value >= 50.5, false)"),
    "lt": (field("value").lt(10), "coalesce(value < 10, false)"),
    "lte": (field("value").lte(10), "coalesce(value <= 10, false)"),
    "in": (field("event_type").contained_in(["view", "error"]), "coalesce(event_type IN ('view', 'error'), false)"),
    "in_empty": (field("event_type").contained_in([]), "false"),
    "contains": (field("event_type").contains("ur"), "coalesce(contains(event_type, 'ur'), false)"),
    "exists": (field("value").exists(), "value IS NOT NULL"),
    "and": (field("event_type").eq("click") & field("value").gt(50), "coalesce(event_type = 'click', false) AND coalesce(value > 50, false)"),
    "or": (field("event_type").eq("click") | field("value").gt(90), "coalesce(event_type = 'click', false) OR coalesce(value > 90, false)"),
    "not": (~field("value").gt(50), "NOT coalesce(value > 50, false)"),
}
for _n, (_f, _s) in FILTERS.items():
    _add(f"filter_{_n}", _E + _s)(lambda spark, d, f=_f: _table(spark, d, "events").where(Filter.from_json(f.to_json()).column()).select("event_id"))

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
JSON_FILTERS: dict[str, tuple[Filter, str]] = {
    "eq": (field("k").eq(7), f"coalesce({_K} = 7, false)"),
    "type_strict": (field("k").eq("7") | field("k").eq(7.0), "false"),
    "range": (field("k").gte(20) & field("k").lt(30.5), f"coalesce({_K} >= 20 AND {_K} < 30.5, false)"),
    "in": (field("k").contained_in([1, 2, 3]), f"coalesce({_K} IN (1, 2, 3), false)"),
    "exists": (field("k").exists(), "json_exists(props, '$.k')"),
    "not_missing_key": (~field("other").gt(1) & field("other").ne(1), "true"),
}
for _n, (_f, _s) in JSON_FILTERS.items():
    _add(f"filter_json_{_n}", _E + _s)(lambda spark, d, f=_f: _table(spark, d, "events").withColumn("p", P.parse(F.col("props"))).where(f.column(payload=F.col("p"))).select("event_id"))

_CASES = """SELECT * FROM VALUES (1, '{"a":1}'), (2, '{"a":1.0}'), (3, '{"a":"1"}'), (4, '{"a":null}'), (5, '{}'), (6, '{"a":2.5}'), (7, '{"a":true}') AS t(id, j)"""
CASE_FILTERS: dict[str, tuple[Filter, tuple[int, ...]]] = {
    "int": (field("a").eq(1), (1,)),
    "float": (field("a").eq(1.0), (2,)),
    "string": (field("a").eq("1"), (3,)),
    "null": (field("a").eq(None), (4,)),
    "exists": (field("a").exists(), (1, 2, 3, 4, 6, 7)),
    "range": (field("a").gt(0), (1, 2, 6)),
    "not_range": (~field("a").gt(0), (3, 4, 5, 7)),
    "ne": (field("a").ne(1), (2, 3, 4, 5, 6, 7)),
}
for _n, (_f, _ids) in CASE_FILTERS.items():
    _add(f"payload_{_n}", f"SELECT unnest([{', '.join(map(str, _ids))}])::INT AS id")(lambda spark, d, f=_f: spark.sql(_CASES).withColumn("p", P.parse(F.col("j"))).where(f.column(payload=F.col("p"))).select("id"))


@_add("payload_accessors", "SELECT event_id, " + _K + " AS k, CAST(" + _K + " AS DOUBLE) AS f, NULL::VARCHAR AS s, 1::INT AS n FROM events")
def _accessors(spark, d):
    p = F.col("p")
    rows = _table(spark, d, "events").withColumn("p", P.parse(F.col("props")))
    return rows.select("event_id", P.get_i64(p, "k").alias("k"), P.get_f64(p, "k").alias("f"), P.get_str(p, "k").alias("s"), P.length(p).alias("n"))


FIELDS = ["o_orderstatus", "o_orderpriority"]
_O = "SELECT o_orderkey AS id FROM orders WHERE "
BITMAPS: dict[str, tuple[Filter, str]] = {
    "eq": (field("o_orderstatus").eq("F"), "o_orderstatus = 'F'"),
    "ne": (field("o_orderstatus").ne("F"), "o_orderstatus <> 'F'"),
    "in": (field("o_orderpriority").contained_in(["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "exists": (field("o_orderstatus").exists(), "o_orderstatus IS NOT NULL"),
    "contains": (field("o_orderpriority").contains("HIGH"), "contains(o_orderpriority, 'HIGH')"),
    "and": (field("o_orderstatus").eq("F") & field("o_orderpriority").eq("1-URGENT"), "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "or": (field("o_orderstatus").eq("F") | field("o_orderpriority").eq("1-URGENT"), "o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"),
    "not": (~(field("o_orderstatus").eq("F") & field("o_orderpriority").eq("1-URGENT")), "NOT (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')"),
}
for _n, (_f, _s) in BITMAPS.items():
    _add(f"bitmap_{_n}", _O + _s)(lambda spark, d, f=_f: (i := BitmapIndex.build(_table(spark, d, "orders"), "o_orderkey", FIELDS)).ids(i.query(f)))


@_add("bitmap_range", "SELECT p_partkey AS id FROM part WHERE p_size > 20 AND p_size <= 30")
def _bitmap_range(spark, d):
    i = BitmapIndex.build(_table(spark, d, "part"), "p_partkey", ["p_size"])
    return i.ids(i.query(field("p_size").gt(20) & field("p_size").lte(30)))


@_add("bitmap_postings", "SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def _postings(spark, d):
    i = BitmapIndex.build(_table(spark, d, "orders"), "o_orderkey", FIELDS)
    return i.postings.groupBy("field", "value").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Inserts of all rows, updates of every third, deletes of every fifth."""
    e = _table(spark, d, "embeddings").select(F.col(ID).alias("id"), "label")
    one = e.select((F.col("id") + 1).alias("seq"), F.lit("I").alias("op"), "id", "label")
    two = e.where("id % 3 = 0").select((F.col("id") + 1_000_000).alias("seq"), F.lit("U").alias("op"), "id", (F.col("label") + 100).alias("label"))
    three = e.where("id % 5 = 0").select((F.col("id") + 2_000_000).alias("seq"), F.lit("D").alias("op"), "id", F.lit(None).cast("int").alias("label"))
    return one.unionByName(two).unionByName(three)


_add("crud_latest_wins", "SELECT vec_id AS id, (CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END)::INT AS label FROM embeddings WHERE vec_id % 5 <> 0")(lambda spark, d: latest(_log(spark, d)).select("id", "label"))
_add("crud_upsert", "SELECT vec_id AS id, (CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END)::INT AS label FROM embeddings")(lambda spark, d: latest(_log(spark, d).where("op != 'D'")).select("id", "label"))
_add("crud_delete", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 5 = 0")(lambda spark, d: latest(_log(spark, d), keep_deleted=True).where("op = 'D'").select("id"))
_add("insert_auto_ids", "SELECT coalesce(max(vec_id), 0) + 1 AS next_id, count(*) AS n FROM embeddings")(lambda spark, d: _table(spark, d, "embeddings").agg((F.coalesce(F.max(ID), F.lit(0)) + 1).alias("next_id"), F.count("*").alias("n")))
_add("selectivity", "SELECT round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 9) AS selectivity FROM events")(lambda spark, d: selectivity(_table(spark, d, "events"), field("value").gt(50)).select(F.round("selectivity", 9).alias("selectivity")))


@_add("ivf_exhaustive", _knn_sql("euclidean", "scaled"))
def _ivf(spark, d):
    df = _formed(spark, d, "scaled")
    return _rounded(IvfIndex.build(df, 16, "euclidean", **OWN).search(_first(df), 10, nprobe=16, columns=["label"]))


def _recall(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    exact = knn_batch(_table(spark, d, "embeddings"), _few(spark, d), 10, "euclidean", **OWN).withColumnRenamed(ID, "id")
    return recall_at_k(found, exact, 10).select("qid", F.round("recall", 6).alias("recall"))


def _few(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col(ID).alias("qid"), F.col(VEC).alias("qv"))


@_add("graph_recall")
def _graph(spark, d):
    many = [(r["qid"], list(r["qv"])) for r in _few(spark, d).toLocalIterator()]
    return _recall(spark, d, GraphIndex(_table(spark, d, "embeddings"), "euclidean", **OWN).search_batch(many, 10, ef=200))


def _stored_graph(spark: SparkSession, d: str) -> StoredGraph:
    """All vectors but every seventh, these added afterwards, and every fifth deleted."""
    e = _table(spark, d, "embeddings").select(F.col(ID).alias("id"), F.col(VEC).alias("vector"), F.col("label").cast("string").alias("payload"))
    index = StoredGraph.open_or_create(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", len(e.first()["vector"]))
    index.insert(e.where("id % 7 != 0"), payload_col="payload")
    index.insert(e.where("id % 7 = 0"), payload_col="payload")
    index.delete(e.where("id % 5 = 0").select("id"))
    return index


@_add("graph_stored", "SELECT vec_id AS id, label::VARCHAR AS payload FROM embeddings WHERE vec_id % 5 <> 0")
def _graph_stored(spark, d):
    return _stored_graph(spark, d).rows().select("id", "payload")


@_add("graph_stored_search", "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 1), e AS (SELECT vec_id AS id, list_distance(embedding::DOUBLE[], q.qv::DOUBLE[]) AS x FROM embeddings, q WHERE vec_id % 5 <> 0) SELECT id, round(x, 6) AS distance, rank FROM (SELECT id, x, row_number() OVER (ORDER BY x, id)::INT AS rank FROM e) WHERE rank <= 10")
def _graph_stored_search(spark, d):
    q = _table(spark, d, "embeddings").where("vec_id = 1").first()[VEC]
    return _stored_graph(spark, d).search(list(q), 10, ef=4000).select("id", F.round("distance", 6).alias("distance"), "rank")


_add("bitmap_changes", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0")(
    lambda spark, d: (i := BitmapIndex.build((o := _table(spark, d, "orders").select("o_orderkey", *FIELDS)).where("o_orderkey % 2 = 0"), "o_orderkey", FIELDS).insert(o.where("o_orderkey % 2 = 1"), "o_orderkey").delete(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id")))).ids(i.query(field("o_orderstatus").eq("F")))
)


@_add("lsh_recall")
def _lsh(spark, d):
    found = LshIndex(_table(spark, d, "embeddings"), metric="euclidean", **OWN).search_batch(_few(spark, d), 10)
    return _recall(spark, d, found.withColumnRenamed(ID, "id"))


@_add("ivf_recall")
def _ivf_recall(spark, d):
    found = IvfIndex.build(_table(spark, d, "embeddings"), metric="euclidean", **OWN).search_batch(_few(spark, d), 10)
    return _recall(spark, d, found.withColumnRenamed(ID, "id"))


@_add("recall_at_k", "SELECT vec_id AS qid, 1.0::DOUBLE AS recall FROM embeddings WHERE vec_id % 100 = 0")
def _self_recall(spark, d):
    found = knn_batch_expr(_table(spark, d, "embeddings"), _few(spark, d), 10, "euclidean", **OWN).withColumnRenamed(ID, "id")
    return _recall(spark, d, found)


@_add("text_search_topk")
def _text(spark, d):
    docs = embedded(_table(spark, d, "documents").select("doc_id", "text", "lang"), HashingEmbedder(64))
    query = HashingEmbedder(64).embed_query(_table(spark, d, "benchmark").where("item_id = 0").first()["text"])
    return _rounded(knn(docs, query, 4, Metric.COSINE, id_col="doc_id", columns=["lang"]))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
