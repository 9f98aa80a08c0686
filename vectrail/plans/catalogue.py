"""Registered queries over the driver's tables, each with the SQL that gives the same rows where SQL can.

Trained state that the SQL shares is fixed: centroids and codebooks are the rows with vec_id < 16.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions import filters, metadata
from vectrail.functions.distance import compute_distance, cosine_similarity, dot_product, l2_squared, norm_squared, register_sql
from vectrail.functions.text import hash_vectors
from vectrail.functions.validate import is_valid
from vectrail.operators import graph, ivfpq, kmeans, pq, search, sq8
from vectrail.operators.postings import intersect, lookup, postings
from vectrail.sources import oplog
from vectrail.streaming import ingest
from vectrail.types import Metric

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
FIXED, M, KSUB, DSUB = 16, 8, 16, 8
#: The queries where no SQL names others: their number grows with the table.
EVERY = "vec_id % 20 = 0"


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return _queries


def oracle_sql() -> dict[str, str]:
    return _oracles


# -- SQL pieces --------------------------------------------------------------------------------------------------------
def _sum(a: str, b: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {term}))"


X, Y = "CAST(z[1] AS DOUBLE)", "CAST(z[2] AS DOUBLE)"


def sql_l2(a: str, b: str) -> str:
    return _sum(a, b, f"({X} - {Y}) * ({X} - {Y})")


def sql_dot(a: str, b: str) -> str:
    return _sum(a, b, f"{X} * {Y}")


def sql_cos(a: str, b: str) -> str:
    return f"(CASE WHEN {sql_dot(a, a)} * {sql_dot(b, b)} > 0 THEN {sql_dot(a, b)} / sqrt({sql_dot(a, a)} * {sql_dot(b, b)}) ELSE 0 END)"


SQL_METRIC = {"l2": sql_l2, "dot": lambda a, b: f"-{sql_dot(a, b)}", "cosine": lambda a, b: f"-{sql_cos(a, b)}"}


def sql_knn(metric: str, k: int, where: str = "true", q: int = 7) -> str:
    d = SQL_METRIC[metric]("e.embedding", "q.embedding")
    return f"SELECT e.vec_id AS vector_id, {d} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {q}) q WHERE {where} ORDER BY distance, vector_id LIMIT {k}"


def sql_batch(metric: str, k: str, which: str, where: str = "true") -> str:
    d = SQL_METRIC[metric]("e.embedding", "q.embedding")
    return f"""SELECT q_id, CAST(r AS INTEGER) AS rank, vector_id, distance FROM (
      SELECT q.vec_id AS q_id, e.vec_id AS vector_id, {d} AS distance, {k} AS k, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d}, e.vec_id) AS r
      FROM embeddings e, (SELECT * FROM embeddings WHERE {which}) q WHERE {where}) t WHERE r <= k"""


# -- tables ------------------------------------------------------------------------------------------------------------
def vectors(spark: SparkSession, sf_dir: str, meta: bool = False, only_even: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    columns = [F.col("vec_id").cast("long").alias("vector_id"), F.col("embedding").alias("vector")]
    if meta:
        values = metadata.column_map(label=(F.col("label"), "int"), even=(F.col("vec_id") % 2 == 0, "bool"), share=(F.col("vec_id") / 4.0, "float"), name=(F.concat(F.lit("n"), F.col("label").cast("string")), "str"))
        columns.append((F.when(F.col("vec_id") % 2 == 0, values) if only_even else values).alias("metadata"))
    return rows.select(*columns)


def one_query(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def query_rows(spark: SparkSession, sf_dir: str, condition: str = "vec_id % 20 = 0") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(condition).select(F.col("vec_id").cast("long").alias("q_id"), F.col("embedding").alias("q"), F.col("label"))


def fixed(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("vec_id") < FIXED).orderBy("vec_id").select("embedding").collect()
    return np.array([r[0] for r in rows], np.float32)


def fixed_books(spark: SparkSession, sf_dir: str) -> pq.Codebooks:
    x = fixed(spark, sf_dir)
    return pq.Codebooks(x.reshape(FIXED, M, DSUB).transpose(1, 0, 2))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an operation log: users are vectors, each event an operation on its user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "signup", oplog.INSERT).when(F.col("event_type") == "view", oplog.INSERT_META).when(F.col("event_type") == "click", oplog.UPDATE_META)
    op = op.when(F.col("event_type") == "error", F.when(F.col("event_id") % 50 == 0, oplog.DELETE).otherwise(oplog.CLEAR_META)).otherwise(oplog.UPDATE_META)
    values = metadata.column_map(value=(F.col("value"), "float"))
    rows = e.select(
        F.col("event_id").cast("long").alias("seq"),
        op.alias("op"),
        F.col("user_id").cast("long").alias("vector_id"),
        F.when(op.isin(oplog.INSERT, oplog.INSERT_META), F.array(F.col("value").cast("float"), (F.col("event_id") % 7).cast("float"))).alias("vector"),
        F.when(op.isin(oplog.INSERT_META, oplog.UPDATE_META), values).alias("metadata"),
    )
    return oplog.with_checksum(rows)


SQL_LOG = """log AS (SELECT event_id AS seq, user_id AS vector_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'insert_meta' WHEN 'click' THEN 'update_meta'
    WHEN 'error' THEN CASE WHEN event_id % 50 = 0 THEN 'delete' ELSE 'clear_meta' END ELSE 'update_meta' END AS op, value, CAST(value AS FLOAT) AS v0, CAST(event_id % 7 AS FLOAT) AS v1 FROM events),
  born AS (SELECT vector_id, min(seq) AS born FROM log WHERE op IN ('insert', 'insert_meta') GROUP BY 1),
  died AS (SELECT l.vector_id, min(l.seq) AS died FROM log l JOIN born b USING (vector_id) WHERE l.op = 'delete' AND l.seq > b.born GROUP BY 1),
  meta AS (SELECT l.vector_id, arg_max(struct_pack(m := CASE WHEN l.op IN ('insert_meta', 'update_meta') THEN l.value END), l.seq).m AS value FROM log l JOIN born b USING (vector_id) LEFT JOIN died d USING (vector_id)
    WHERE l.seq >= b.born AND (l.seq = b.born OR l.op IN ('update_meta', 'clear_meta')) AND (d.died IS NULL OR l.seq < d.died) GROUP BY 1),
  folded AS (SELECT b.vector_id, CAST(l.v0 AS DOUBLE) AS v0, CAST(l.v1 AS DOUBLE) AS v1, m.value AS meta_value, d.died IS NOT NULL AS deleted
    FROM born b JOIN log l ON l.seq = b.born LEFT JOIN died d ON d.vector_id = b.vector_id LEFT JOIN meta m ON m.vector_id = b.vector_id)"""


def _flat(folded: DataFrame) -> DataFrame:
    value = F.try_element_at(F.col("metadata"), F.lit("value"))["f"]
    rest = ["deleted"] if "deleted" in folded.columns else []
    return folded.select("vector_id", F.col("vector")[0].cast("double").alias("v0"), F.col("vector")[1].cast("double").alias("v1"), value.alias("meta_value"), *rest)


# -- exact search ------------------------------------------------------------------------------------------------------
@query(sql_knn("l2", 10))
def knn_l2(spark, sf_dir):
    return search.knn(vectors(spark, sf_dir), one_query(spark, sf_dir), 10, "l2")


@query(sql_knn("dot", 10))
def knn_dot(spark, sf_dir):
    return search.knn(vectors(spark, sf_dir), one_query(spark, sf_dir), 10, "dot")


@query(sql_knn("cosine", 10))
def knn_cosine(spark, sf_dir):
    return search.knn(vectors(spark, sf_dir), one_query(spark, sf_dir), 10, "cosine")


@query(sql_batch("l2", "10", "vec_id % 20 = 0"))
def knn_batch_l2(spark, sf_dir):
    return search.knn_batch(vectors(spark, sf_dir), query_rows(spark, sf_dir), 10, "l2")


@query(sql_batch("dot", "10", "vec_id % 20 = 0"))
def knn_batch_dot(spark, sf_dir):
    return search.knn_batch(vectors(spark, sf_dir), query_rows(spark, sf_dir), 10, "dot")


@query(sql_batch("cosine", "10", "vec_id % 20 = 0"))
def knn_batch_cosine(spark, sf_dir):
    return search.knn_batch(vectors(spark, sf_dir), query_rows(spark, sf_dir), 10, "cosine")


@query(sql_batch("l2", "1 + q.vec_id % 4", "vec_id % 20 = 0"))
def knn_batch_mixed_k(spark, sf_dir):
    asked = query_rows(spark, sf_dir).withColumn("k", (1 + F.col("q_id") % 4).cast("int"))
    return search.knn_batch(vectors(spark, sf_dir), asked, metric="l2")


@query(sql_batch("l2", "5", "vec_id % 20 = 0", "(q.vec_id % 3 = 0 OR (q.vec_id % 3 = 1 AND e.label = 3) OR (q.vec_id % 3 = 2 AND e.label BETWEEN 2 AND 5))"))
def knn_batch_filtered(spark, sf_dir):
    texts = F.when(F.col("q_id") % 3 == 1, '{"Eq": {"key": "label", "value": 3}}').when(F.col("q_id") % 3 == 2, '{"Range": {"key": "label", "min": 2, "max": 5}}')
    return search.knn_batch(vectors(spark, sf_dir, True), query_rows(spark, sf_dir, "vec_id % 20 = 0").withColumn("filter_json", texts), 5, "l2")


@query(f"SELECT q.vec_id AS q_id, t.vector_id, t.distance FROM embeddings q, LATERAL (SELECT e.vec_id AS vector_id, {sql_l2('e.embedding', 'q.embedding')} AS distance FROM embeddings e ORDER BY distance, vector_id LIMIT 3) t WHERE q.vec_id % 20 = 0")
def knn_lateral(spark, sf_dir):
    """LATERAL takes its three of what each task has found nearest, not of all rows. Rows and queries whose vectors
    do not have as many numbers as most, all finite, meet every query and row."""
    register_sql(spark)
    rows, asked = vectors(spark, sf_dir), query_rows(spark, sf_dir, "vec_id % 20 = 0").withColumn("key", F.xxhash64("q_id", "q"))
    once = asked.select(F.col("key").alias("q_id"), "q").dropDuplicates(["q_id"])
    most = once.filter(F.size("q") > 0).groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = most[0] if most else 1
    plain, plain_query = is_valid(F.col("vector"), dimension) & F.col("vector_id").isNotNull(), is_valid(F.col("q"), dimension)
    near = search.near_by_task(rows.filter(plain), once.filter(plain_query), 3, "l2", dimension)
    distance = F.call_function("vec_l2", "vector", "q").alias("distance")
    odd = rows.filter(~plain).crossJoin(once).unionByName(rows.filter(plain).crossJoin(F.broadcast(once.filter(~plain_query))))
    near.unionByName(odd.select("q_id", "vector_id", distance)).createOrReplaceTempView("vr_near")
    asked.createOrReplaceTempView("vr_queries")
    return spark.sql("SELECT q_id, t.vector_id, t.distance FROM vr_queries, LATERAL (SELECT vector_id, distance FROM vr_near WHERE vr_near.q_id = vr_queries.key ORDER BY distance NULLS LAST, vector_id NULLS LAST LIMIT 3) t")


@query(f"SELECT e.vec_id AS vector_id, {sql_dot('e.embedding', 'e.embedding')} AS norm2, {sql_l2('e.embedding', 'q.embedding')} AS l2, {sql_dot('e.embedding', 'q.embedding')} AS dot, {sql_cos('e.embedding', 'q.embedding')} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q")
def distance_functions(spark, sf_dir):
    from vectrail.functions.distance import vector_literal

    q = vector_literal(one_query(spark, sf_dir))
    v = F.col("vector")
    return vectors(spark, sf_dir).select("vector_id", norm_squared(v).alias("norm2"), l2_squared(v, q).alias("l2"), dot_product(v, q).alias("dot"), cosine_similarity(v, q).alias("cosine"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {sql_l2('a.embedding', 'b.embedding')} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id")
def pairwise_distances(spark, sf_dir):
    found = search.all_distances(vectors(spark, sf_dir), query_rows(spark, sf_dir, EVERY), "l2")
    return found.filter("q_id <> vector_id").select(F.col("q_id").alias("a"), F.col("vector_id").alias("b"), "distance")


@query("SELECT vec_id AS vector_id, vec_id % 5 <> 1 AND vec_id % 5 <> 2 AND vec_id % 5 <> 3 AS valid FROM embeddings")
def validate_vectors(spark, sf_dir):
    bad = F.when(F.col("vector_id") % 5 == 1, F.slice("vector", 1, 10)).when(F.col("vector_id") % 5 == 2, F.transform("vector", lambda x: F.lit(float("nan")).cast("float")))
    bad = bad.when(F.col("vector_id") % 5 == 3, F.lit(None)).otherwise(F.col("vector"))
    return vectors(spark, sf_dir).select("vector_id", is_valid(bad, 64).alias("valid"))


@query("SELECT count(*) AS live, CAST(0 AS BIGINT) AS deleted, max(vec_id) AS max_vector_id, CAST(min(len(embedding)) AS INTEGER) AS dimension FROM embeddings")
def collection_metrics(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.count("*").alias("live"), F.lit(0).cast("long").alias("deleted"), F.max("vector_id").alias("max_vector_id"), F.min(F.size("vector")).alias("dimension"))


# -- filters -----------------------------------------------------------------------------------------------------------
def _filtered(name: str, found: dict, where: str) -> None:
    def run(spark, sf_dir):
        return search.knn(vectors(spark, sf_dir, True), one_query(spark, sf_dir), 10, "l2", found)

    run.__name__ = name
    query(sql_knn("l2", 10, where))(run)


_filtered("knn_filter_eq", {"Eq": {"key": "label", "value": 3}}, "e.label = 3")
_filtered("knn_filter_and", {"And": [{"Eq": {"key": "label", "value": 3}}, {"Eq": {"key": "even", "value": True}}]}, "e.label = 3 AND e.vec_id % 2 = 0")
_filtered("knn_filter_or", {"Or": [{"Eq": {"key": "name", "value": "n1"}}, {"Range": {"key": "share", "min": 10.0, "max": 20.0}}]}, "e.label = 1 OR e.vec_id / 4.0 BETWEEN 10 AND 20")
_filtered("knn_filter_in", {"In": {"key": "label", "values": [1, 2, "n5", 7.0]}}, "e.label IN (1, 2)")
_filtered("knn_filter_range", {"Range": {"key": "label", "min": 4, "max": 6}}, "e.label BETWEEN 4 AND 6")
_filtered("knn_filter_exists", {"Range": {"key": "name"}}, "true")
_filtered("knn_filter_empty_and", {"And": []}, "true")
_filtered("knn_filter_none", {"Or": []}, "false")
_filtered("knn_filter_other_type", {"Eq": {"key": "label", "value": 3.0}}, "false")


@query(sql_knn("l2", 10, "e.vec_id % 2 = 0 AND e.label >= 2"))
def knn_filter_missing_metadata(spark, sf_dir):
    return search.knn(vectors(spark, sf_dir, True, True), one_query(spark, sf_dir), 10, "l2", {"Range": {"key": "label", "min": 2}})


@query(sql_knn("l2", 10, "e.label = 3 AND e.vec_id % 2 = 0"))
def selective_scan(spark, sf_dir):
    found = {"And": [{"Eq": {"key": "label", "value": 3}}, {"Eq": {"key": "even", "value": True}}]}
    return search.search_filtered(vectors(spark, sf_dir, True), one_query(spark, sf_dir), 10, found, "l2")


EVENT_FILTERS = {
    "type_eq": ({"Eq": {"key": "event_type", "value": "click"}}, "event_type = 'click'"),
    "user_range": ({"Range": {"key": "user_id", "min": 10, "max": 20}}, "user_id BETWEEN 10 AND 20"),
    "value_range": ({"Range": {"key": "value", "min": 100.0}}, "value >= 100"),
    "in_mixed": ({"In": {"key": "event_type", "values": ["error", "view", 3]}}, "event_type IN ('error', 'view')"),
    "props_k": ({"Range": {"key": "k", "min": 5}}, "CAST(props->>'k' AS BIGINT) >= 5"),
    "nested": ({"And": [{"Or": [{"Eq": {"key": "event_type", "value": "view"}}, {"Eq": {"key": "event_type", "value": "error"}}]}, {"Range": {"key": "value", "max": 50.0}}]}, "event_type IN ('view', 'error') AND value <= 50"),
    "wrong_type": ({"Range": {"key": "user_id", "min": 1.0, "max": 5.0}}, "false"),
}


def event_metadata(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    values = metadata.column_map(event_type=(F.col("event_type"), "str"), user_id=(F.col("user_id"), "int"), value=(F.col("value"), "float"), k=(F.get_json_object("props", "$.k").try_cast("bigint"), "int"))
    return e.select(F.col("event_id").cast("long").alias("vector_id"), values.alias("metadata"))


@query("SELECT event_id AS vector_id, " + ", ".join(f"coalesce({sql}, false) AS {name}" for name, (_, sql) in EVENT_FILTERS.items()) + " FROM events")
def filter_eval_events(spark, sf_dir):
    rows = event_metadata(spark, sf_dir)
    return rows.select("vector_id", *(filters.compile_filter(f, F.col("metadata")).alias(name) for name, (f, _) in EVENT_FILTERS.items()))


@query("""SELECT key, value, count(*) AS n, min(vector_id) AS first_id FROM (
  SELECT 'event_type' AS key, '3:' || event_type AS value, event_id AS vector_id FROM events
  UNION ALL SELECT 'user_id', '1:' || CAST(user_id AS VARCHAR), event_id FROM events) GROUP BY 1, 2""")
def postings_build(spark, sf_dir):
    index = postings(event_metadata(spark, sf_dir)).filter(F.col("key").isin("event_type", "user_id"))
    return index.groupBy("key", "value").agg(F.count("*").alias("n"), F.min("vector_id").alias("first_id"))


@query("SELECT event_id AS vector_id FROM events WHERE event_type = 'click' AND user_id = 17")
def postings_intersect(spark, sf_dir):
    return intersect(postings(event_metadata(spark, sf_dir)), [("event_type", "click"), ("user_id", 17)])


@query("SELECT event_id AS vector_id FROM events WHERE event_type = 'purchase'")
def postings_lookup(spark, sf_dir):
    return lookup(postings(event_metadata(spark, sf_dir)), "event_type", "purchase")


@query("SELECT event_id AS vector_id, event_type AS kind, true AS has_type, false AS has_other, CAST(4 AS INTEGER) AS n FROM events")
def metadata_accessors(spark, sf_dir):
    rows = event_metadata(spark, sf_dir)
    a = metadata.accessors(F.col("metadata"), "event_type")
    return rows.select("vector_id", a["get"]["s"].alias("kind"), a["contains_key"].alias("has_type"), metadata.accessors(F.col("metadata"), "other")["contains_key"].alias("has_other"), a["len"].cast("int").alias("n"))


# -- scalar quantisation -----------------------------------------------------------------------------------------------
SQL_CALIB = "c AS (SELECT pos, min(x) AS mn, (CAST(max(x) AS DOUBLE) - CAST(min(x) AS DOUBLE)) / 255.0 AS scale FROM (SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY 1), l AS (SELECT list(mn ORDER BY pos) AS mns, list(scale ORDER BY pos) AS scales FROM c)"
SQL_CODE = "CAST(CASE WHEN scales[i] > 0 THEN least(greatest(round((CAST(embedding[i] AS DOUBLE) - CAST(mns[i] AS DOUBLE)) / scales[i]), 0), 255) ELSE 0 END AS SMALLINT)"
SQL_CODES = f"list_transform(range(1, 65), lambda i: {SQL_CODE})"
SQL_DECODED = f"codes AS (SELECT vec_id, embedding, label, {SQL_CODES} AS codes, mns, scales FROM embeddings, l), d AS (SELECT vec_id, embedding, codes, list_transform(range(1, 65), lambda i: CAST(mns[i] AS DOUBLE) + CAST(codes[i] AS DOUBLE) * scales[i]) AS decoded FROM codes)"


@query(f"WITH {SQL_CALIB} SELECT CAST(pos - 1 AS INTEGER) AS dim, mn, scale FROM c")
def sq8_train(spark, sf_dir):
    return sq8.train(vectors(spark, sf_dir))


@query(f"WITH {SQL_CALIB}, {SQL_DECODED} SELECT vec_id AS vector_id, array_to_string(codes, ',') AS codes FROM d")
def sq8_encode(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("vector_id", F.array_join(sq8.encode_column(F.col("vector"), sq8.train(v).collect()).cast("array<string>"), ",").alias("codes"))


@query(f"WITH {SQL_CALIB}, {SQL_DECODED} SELECT vec_id AS vector_id, list_max(list_transform(range(1, 65), lambda i: abs(CAST(embedding[i] AS DOUBLE) - decoded[i]))) AS error FROM d")
def sq8_decode_error(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return sq8.encode_error(v, sq8.train(v).collect())


def _sq8(metric: str) -> None:
    d = SQL_METRIC[metric]("d.decoded", "q.embedding")
    sql = f"WITH {SQL_CALIB}, {SQL_DECODED} SELECT q_id, CAST(r AS INTEGER) AS rank, vector_id, distance FROM (SELECT q.vec_id AS q_id, d.vec_id AS vector_id, {d} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d}, d.vec_id) AS r FROM d, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE r <= 10"

    def run(spark, sf_dir):
        return sq8.Sq8Index.build(vectors(spark, sf_dir), metric).search_batch(query_rows(spark, sf_dir, "vec_id % 20 = 0"), 10)

    run.__name__ = f"sq8_knn_{metric}"
    query(sql)(run)


for _metric in ("l2", "dot", "cosine"):
    _sq8(_metric)


# -- k-means and product quantisation ----------------------------------------------------------------------------------
SQL_CELL = f"cells AS (SELECT vec_id, embedding, s.cell AS cell, s.d AS distance FROM (SELECT e.vec_id, e.embedding, min(struct_pack(d := {sql_l2('e.embedding', 'c.embedding')}, cell := c.vec_id)) AS s FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < {FIXED}) c GROUP BY 1, 2))"
SQL_PART = "list_slice({v}, s * 8 + 1, s * 8 + 8)"
SQL_BOOKS = f"books AS (SELECT s, vec_id AS code, {SQL_PART.format(v='embedding')} AS centroid FROM embeddings, range(0, {M}) t(s) WHERE vec_id < {KSUB})"
SQL_PQ = f"{SQL_BOOKS}, one AS (SELECT e.vec_id, b.s, min(struct_pack(d := {sql_l2(SQL_PART.format(v='e.embedding'), 'b.centroid')}, code := b.code)).code AS code FROM embeddings e, books b GROUP BY 1, 2), pqc AS (SELECT vec_id, list(code ORDER BY s) AS codes FROM one GROUP BY 1)"
SQL_TAB = f"tab AS (SELECT q.vec_id AS q_id, list({sql_l2(SQL_PART.format(v='q.embedding'), 'b.centroid')} ORDER BY b.s, b.code) AS tab FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, books b GROUP BY 1)"
SQL_ADC = f"list_sum(list_transform(range(0, {M}), lambda s: tab[s * {KSUB} + codes[s + 1] + 1]))"


@query(f"WITH {SQL_CELL} SELECT vec_id AS vector_id, CAST(cell AS INTEGER) AS cell, distance FROM cells")
def kmeans_assign(spark, sf_dir):
    return kmeans.assign_rows(vectors(spark, sf_dir), fixed(spark, sf_dir))


@query(f"WITH {SQL_CELL} SELECT CAST(cell AS INTEGER) AS cell, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 9) AS value FROM (SELECT cell, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM cells) GROUP BY 1, 2")
def kmeans_update(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return kmeans.update_step(v, kmeans.assign_rows(v, fixed(spark, sf_dir)))


@query(f"WITH {SQL_CELL} SELECT CAST(cell AS INTEGER) AS cell, count(*) AS n, round(sum(distance), 9) AS inertia FROM cells GROUP BY 1")
def kmeans_inertia(spark, sf_dir):
    return kmeans.inertia(kmeans.assign_rows(vectors(spark, sf_dir), fixed(spark, sf_dir)))


@query(f"WITH {SQL_CELL} SELECT vec_id AS vector_id, distance FROM cells ORDER BY distance DESC, vec_id LIMIT 1")
def kmeans_reseed(spark, sf_dir):
    return kmeans.farthest(kmeans.assign_rows(vectors(spark, sf_dir), fixed(spark, sf_dir)))


@query(f"WITH {SQL_PQ} SELECT vec_id AS vector_id, array_to_string(codes, ',') AS codes FROM pqc")
def pq_encode(spark, sf_dir):
    codes = pq.encode(vectors(spark, sf_dir), fixed_books(spark, sf_dir))
    return codes.select("vector_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query(f"WITH {SQL_BOOKS}, {SQL_TAB} SELECT q_id, CAST(generate_subscripts(tab, 1) - 1 AS INTEGER) AS place, unnest(tab) AS d FROM tab")
def pq_adc_table(spark, sf_dir):
    asked = query_rows(spark, sf_dir, "vec_id % 20 = 0").select("q_id", "q")
    return pq.adc_tables(asked, fixed_books(spark, sf_dir).frame(spark)).select("q_id", F.posexplode("tab").alias("place", "d"))


@query(f"WITH {SQL_PQ}, {SQL_TAB} SELECT q_id, CAST(r AS INTEGER) AS rank, vector_id, distance FROM (SELECT q_id, vec_id AS vector_id, {SQL_ADC} AS distance, row_number() OVER (PARTITION BY q_id ORDER BY {SQL_ADC}, vec_id) AS r FROM pqc, tab) WHERE r <= 10")
def pq_adc_knn(spark, sf_dir):
    index = ivfpq.IvfPqIndex.from_trained(vectors(spark, sf_dir), fixed(spark, sf_dir), fixed_books(spark, sf_dir))
    return index.search_batch(query_rows(spark, sf_dir, "vec_id % 20 = 0"), 10, nprobe=FIXED)


@query(f"WITH {SQL_PQ} SELECT p.vec_id AS vector_id, round(sum(list_sum(list_transform(b.centroid, lambda x: CAST(x AS DOUBLE)))), 9) AS total FROM pqc p, books b WHERE p.codes[b.s + 1] = b.code GROUP BY 1")
def pq_reconstruct(spark, sf_dir):
    books = fixed_books(spark, sf_dir)
    back = pq.reconstruct(pq.encode(vectors(spark, sf_dir), books), books)
    return back.select("vector_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 9).alias("total"))


@query(f"WITH {SQL_CELL} SELECT CAST(cell AS INTEGER) AS cell, count(*) AS n FROM cells GROUP BY 1")
def ivf_list_sizes(spark, sf_dir):
    return ivfpq.IvfPqIndex.from_trained(vectors(spark, sf_dir), fixed(spark, sf_dir), fixed_books(spark, sf_dir)).cell_sizes()


SQL_PROBE = f"probe AS (SELECT q_id, cell FROM (SELECT q.vec_id AS q_id, c.vec_id AS cell, row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_l2('q.embedding', 'c.embedding')}, c.vec_id) AS r FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT * FROM embeddings WHERE vec_id < {FIXED}) c) WHERE r <= 4)"
SQL_NEAR = f"near AS (SELECT q_id, vec_id, {SQL_ADC} AS distance FROM cells JOIN probe USING (cell) JOIN tab USING (q_id) JOIN pqc USING (vec_id))"


def _ranked(source: str, k: int) -> str:
    return f"SELECT q_id, CAST(r AS INTEGER) AS rank, vec_id AS vector_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, vec_id) AS r FROM {source}) WHERE r <= {k}"


@query(f"WITH {SQL_PQ}, {SQL_CELL}, {SQL_TAB}, {SQL_PROBE}, {SQL_NEAR} {_ranked('near', 5)}")
def ivfpq_adc(spark, sf_dir):
    index = ivfpq.IvfPqIndex.from_trained(vectors(spark, sf_dir), fixed(spark, sf_dir), fixed_books(spark, sf_dir))
    return index.search_batch(query_rows(spark, sf_dir, "vec_id % 20 = 0"), 5, nprobe=4)


@query(f"WITH {SQL_PQ}, {SQL_CELL}, {SQL_TAB}, {SQL_PROBE}, {SQL_NEAR}, few AS ({_ranked('near', 20)}), again AS (SELECT q_id, f.vector_id AS vec_id, {sql_l2('e.embedding', 'q.embedding')} AS distance FROM few f JOIN embeddings e ON e.vec_id = f.vector_id JOIN embeddings q ON q.vec_id = f.q_id) {_ranked('again', 5)}")
def ivfpq_rerank(spark, sf_dir):
    index = ivfpq.IvfPqIndex.from_trained(vectors(spark, sf_dir), fixed(spark, sf_dir), fixed_books(spark, sf_dir))
    return index.search_batch(query_rows(spark, sf_dir, "vec_id % 20 = 0"), 5, nprobe=4, rerank=4)


# -- trained indexes: rows and recall ----------------------------------------------------------------------------------
@query()
def ivfpq_trained(spark, sf_dir):
    v = vectors(spark, sf_dir)
    index = ivfpq.IvfPqIndex.build(v, ivfpq.IvfPqConfig(nlist=16, m=8, ksub=32, iterations=4))
    return index.search_batch(query_rows(spark, sf_dir, EVERY), 10, nprobe=8, rerank=4)


@query()
def recall_ivf_by_nprobe(spark, sf_dir):
    v, asked = vectors(spark, sf_dir), query_rows(spark, sf_dir, EVERY)
    truth = search.knn_batch(v, asked, 10, "l2")
    index = ivfpq.IvfPqIndex.from_trained(v, fixed(spark, sf_dir), fixed_books(spark, sf_dir))
    return ivfpq.tune(index, asked, truth, 10, [1, 4, FIXED], [0, 8])


@query()
def hnsw_knn(spark, sf_dir):
    index = graph.GraphIndex.build(vectors(spark, sf_dir), "l2", graph.GraphConfig(ef_construction=64, shard_rows=250))
    return index.search_batch(query_rows(spark, sf_dir, EVERY), 10, ef=64)


@query()
def hnsw_filtered(spark, sf_dir):
    v = vectors(spark, sf_dir, True)
    index = graph.GraphIndex.build(v, "l2", graph.GraphConfig(ef_construction=64, shard_rows=250))
    return index.search_batch(query_rows(spark, sf_dir, EVERY), 10, 64, {"Eq": {"key": "even", "value": True}}, v)


@query()
def recall_hnsw(spark, sf_dir):
    v, asked = vectors(spark, sf_dir), query_rows(spark, sf_dir, EVERY)
    return search.recall(hnsw_knn(spark, sf_dir), search.knn_batch(v, asked, 10, "l2"), 10)


@query(sql_batch("l2", "10", EVERY))
def hnsw_exhaustive(spark, sf_dir):
    """A beam as wide as a shard finds what an exact search finds."""
    index = graph.GraphIndex.build(vectors(spark, sf_dir), "l2", graph.GraphConfig(ef_construction=64, shard_rows=250))
    return index.search_batch(query_rows(spark, sf_dir, EVERY), 10, ef=1_000)


@query(sql_batch("l2", "10", EVERY, "e.vec_id % 2 = 0"))
def hnsw_filtered_exhaustive(spark, sf_dir):
    v = vectors(spark, sf_dir, True)
    index = graph.GraphIndex.build(v, "l2", graph.GraphConfig(ef_construction=64, shard_rows=250))
    return index.search_batch(query_rows(spark, sf_dir, EVERY), 10, 1_000, {"Eq": {"key": "even", "value": True}}, v)


@query(sql_batch("l2", "10", EVERY))
def ivfpq_exhaustive(spark, sf_dir):
    """All cells of a trained index, with all candidates scored again by their vectors."""
    v = vectors(spark, sf_dir)
    index = ivfpq.IvfPqIndex.build(v, ivfpq.IvfPqConfig(nlist=16, m=8, ksub=32, iterations=4))
    return index.search_batch(query_rows(spark, sf_dir, EVERY), 10, nprobe=16, rerank=1_000)


@query(f"WITH {SQL_CALIB}, {SQL_DECODED}, found AS ({sql_batch('l2', '10', 'vec_id % 20 = 0')}), quant AS (SELECT q_id, vector_id FROM (SELECT q.vec_id AS q_id, d.vec_id AS vector_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_l2('d.decoded', 'q.embedding')}, d.vec_id) AS r FROM d, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE r <= 10) SELECT avg(n / 10.0) AS recall FROM (SELECT f.q_id, CAST(count(x.vector_id) AS DOUBLE) AS n FROM found f LEFT JOIN quant x ON x.q_id = f.q_id AND x.vector_id = f.vector_id GROUP BY 1)")
def recall_sq8(spark, sf_dir):
    v, asked = vectors(spark, sf_dir), query_rows(spark, sf_dir, "vec_id % 20 = 0")
    return search.recall(sq8.Sq8Index.build(v, "l2").search_batch(asked, 10), search.knn_batch(v, asked, 10, "l2"), 10)


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_percentiles(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.agg(*(search.nearest_rank("value", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)))


@query("SELECT a.event_type, a.n AS n_a, b.n AS n_b, CAST(b.n AS DOUBLE) / a.n AS n_ratio FROM (SELECT event_type, count(*) AS n FROM events WHERE user_id < 75 GROUP BY 1) a JOIN (SELECT event_type, count(*) AS n FROM events WHERE user_id >= 75 GROUP BY 1) b USING (event_type)")
def run_comparison(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = lambda c: e.filter(c).groupBy("event_type").agg(F.count("*").alias("n"))
    return search.compare_runs(half("user_id < 75"), half("user_id >= 75"), ["event_type"], ["n"])


# -- operation log -----------------------------------------------------------------------------------------------------
@query(f"WITH {SQL_LOG} SELECT vector_id, v0, v1, meta_value, deleted FROM folded")
def log_fold(spark, sf_dir):
    return _flat(oplog.fold(event_log(spark, sf_dir)))


@query(f"WITH {SQL_LOG} SELECT vector_id, v0, v1, meta_value FROM folded WHERE NOT deleted")
def live_vectors(spark, sf_dir):
    return _flat(oplog.live(oplog.fold(event_log(spark, sf_dir))))


@query("SELECT event_id AS seq, user_id AS vector_id FROM events WHERE event_id < (SELECT coalesce(min(event_id), 1e18) FROM events WHERE event_id % 701 = 700)")
def log_prefix_valid(spark, sf_dir):
    log = event_log(spark, sf_dir)
    torn = log.withColumn("crc", F.when(F.col("seq") % 701 == 700, F.col("crc") + 1).otherwise(F.col("crc")))
    return oplog.valid_prefix(torn).select("seq", "vector_id")


@query(f"WITH {SQL_LOG} SELECT seq, CASE op WHEN 'insert_meta' THEN 'update_meta' ELSE op END AS op, vector_id FROM log WHERE op <> 'insert'")
def log_checkpoint(spark, sf_dir):
    return oplog.checkpoint_log(event_log(spark, sf_dir)).select("seq", "op", "vector_id")


@query(f"WITH {SQL_LOG} SELECT max(vector_id) AS max_vector_id FROM log WHERE op IN ('insert', 'insert_meta')")
def log_max_id(spark, sf_dir):
    return oplog.max_vector_id(event_log(spark, sf_dir))


@query(f"WITH {SQL_LOG} SELECT vector_id FROM log WHERE op = 'delete'")
def log_deletes(spark, sf_dir):
    return oplog.deletes(event_log(spark, sf_dir))


@query(f"WITH {SQL_LOG} SELECT count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS deleted, CAST(count(*) FILTER (deleted) AS DOUBLE) / count(*) AS ratio, CAST(count(*) FILTER (deleted) AS DOUBLE) / count(*) > 0.2 AS compact FROM folded")
def compact_stats(spark, sf_dir):
    f = oplog.fold(event_log(spark, sf_dir))
    ratio = F.count_if("deleted") / F.count("*")
    return f.agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("deleted"), ratio.alias("ratio"), (ratio > 0.2).alias("compact"))


@query("SELECT event_id, 1000 + row_number() OVER (ORDER BY event_id) AS vector_id FROM events")
def assign_ids(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("long").alias("event_id"))
    return oplog.assign_ids(e, "event_id", 1000)


@query("SELECT vector_id, last.op AS last_op, n FROM (SELECT user_id AS vector_id, arg_max(struct_pack(op := event_type), event_id) AS last, count(*) AS n FROM events GROUP BY 1)")
def log_last_operation(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("user_id").cast("long").alias("vector_id")).agg(F.max_by("event_type", "event_id").alias("last_op"), F.count("*").alias("n"))


@query(f"WITH {SQL_LOG} SELECT vector_id, v0, v1, meta_value, deleted FROM folded")
def streaming_fold(spark, sf_dir):
    from vectrail.sources.paths import scratch

    base = scratch(spark, "stream")
    ingest.stage_log(event_log(spark, sf_dir), f"{base}/log")
    run = ingest.fold_stream(ingest.read_log_stream(spark, f"{base}/log"), f"{base}/state", f"{base}/checkpoint")
    run.awaitTermination()
    return _flat(ingest.folded_state(spark, f"{base}/state"))


# -- demonstrations ----------------------------------------------------------------------------------------------------
@query()
def semantic_search_docs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("vector_id"), "text")
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("long").alias("q_id"), "text")
    return search.knn_batch(hash_vectors(docs), hash_vectors(asked, out="q"), 5, Metric.COSINE, 384)

