"""Exact nearest neighbours: one query, a batch, with filters, and the measures of a search.

Vectors are DataFrames (vector_id, vector[, metadata]). One query is a top-k over a column expression, which Spark runs
as TakeOrderedAndProject. A batch is scanned once for each block of queries (at most `BLOCK_FLOATS` numbers, the bound of
what is broadcast): every task keeps its k nearest for each query, and only those are shuffled, by query.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions.distance import compute_distance, vector_literal
from vectrail.functions.filters import conjunction, parse, search_filter
from vectrail.functions.validate import check_search, check_vector
from vectrail.operators.kernels import TopK, exact, matrix
from vectrail.operators.postings import intersect, postings
from vectrail.types import EmptyIndex, InvalidInput, Metric

BLOCK_FLOATS = 4_000_000
SELECTIVE = 32_768
PARTIAL = "q_id long, vector_id long, distance double"


def knn(vectors: DataFrame, query, k: int, metric: Metric | str = Metric.L2, found: dict | str | None = None) -> DataFrame:
    """(vector_id, distance) of the k nearest to one query among rows that pass the filter, nearest first."""
    check_search(k)
    rows = vectors.filter(search_filter(found, F.col("metadata"))) if found is not None else vectors
    near = rows.select("vector_id", compute_distance(F.col("vector"), vector_literal(query), metric).alias("distance"))
    return near.orderBy("distance", "vector_id").limit(k)


def query_blocks(queries: DataFrame, dimension: int):
    """Query rows in blocks whose vectors fill at most BLOCK_FLOATS numbers."""
    size, block = max(1, BLOCK_FLOATS // max(1, dimension)), []
    for row in queries.toLocalIterator(prefetchPartitions=True):
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _partial(shared, metric: Metric, filtered: bool):
    def run(batches):
        q_ids, q, ks, group, which = shared.value
        tops = [TopK(q[group == g], k, metric) for g, k in enumerate(ks)]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            allowed = matrix(batch.column(2), bool) if filtered else None
            for g, top in enumerate(tops):
                top.see(ids, x, None if allowed is None else allowed[:, which[group == g]].T)
        for g, top in enumerate(tops):
            yield top.rows(q_ids[group == g])

    return run


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int | None = None, metric: Metric | str = Metric.L2, dimension: int | None = None) -> DataFrame:
    """(q_id, rank, vector_id, distance) for queries (q_id, q[, k][, filter_json]).

    Each query may have its own k and filter; queries that share a filter share its column, so the scan evaluates each
    filter once a row."""
    metric = Metric.parse(metric)
    has_k, has_filter = "k" in queries.columns, "filter_json" in queries.columns
    if k is None and not has_k:
        raise InvalidInput("give k, or a column k with the queries")
    columns = ["q_id", F.col("q").cast("array<double>").alias("q"), (F.col("k") if has_k else F.lit(k)).cast("int").alias("k"), (F.col("filter_json") if has_filter else F.lit(None)).cast("string").alias("f")]
    spark, parts = vectors.sparkSession, []
    if dimension is None:
        first = queries.select(F.size("q")).first()
        dimension = first[0] if first else 1
    most = 0
    for block in query_blocks(queries.select(*columns), dimension):
        ks = sorted({r["k"] for r in block})
        filters = sorted({r["f"] for r in block if r["f"] is not None})
        most = max([most, *ks])
        group = np.array([ks.index(r["k"]) for r in block])
        which = np.array([filters.index(r["f"]) + 1 if r["f"] is not None else 0 for r in block])
        shared = spark.sparkContext.broadcast((np.array([r["q_id"] for r in block], np.int64), np.array([r["q"] for r in block], float), ks, group, which))
        rows = vectors.select("vector_id", "vector")
        if filters:
            conditions = [F.lit(True), *(search_filter(f, F.col("metadata")) for f in filters)]
            rows = vectors.select("vector_id", "vector", F.array(*conditions).alias("allowed"))
        parts.append(rows.mapInArrow(_partial(shared, metric, bool(filters)), PARTIAL))
    if not parts:
        return spark.createDataFrame([], "q_id long, rank int, vector_id long, distance double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("q_id").orderBy("distance", "vector_id")
    hits = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    if has_k:
        hits = hits.join(queries.select("q_id", F.col("k").alias("__k")), "q_id").filter(F.col("rank") <= F.col("__k"))
    return hits.select("q_id", "rank", "vector_id", "distance")


def near_by_task(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric | str, dimension: int) -> DataFrame:
    """(q_id, vector_id, distance) of the k nearest that each task has read to each query (q_id, q): the k nearest of all
    rows are among them. Every vector has `dimension` finite numbers."""
    metric, spark = Metric.parse(metric), vectors.sparkSession

    def near(block) -> DataFrame:
        alike = np.zeros(len(block), np.int64)
        shared = spark.sparkContext.broadcast((np.array([r["q_id"] for r in block], np.int64), np.array([r["q"] for r in block], float), [k], alike, alike))
        return vectors.select("vector_id", "vector").mapInArrow(_partial(shared, metric, False), PARTIAL)

    parts = [near(block) for block in query_blocks(queries.select("q_id", F.col("q").cast("array<double>").alias("q")), dimension)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PARTIAL)


def all_distances(vectors: DataFrame, queries: DataFrame, metric: Metric | str = Metric.L2) -> DataFrame:
    """(q_id, vector_id, distance) of every query (q_id, q) with every row, by blocks of queries."""
    metric, spark = Metric.parse(metric), vectors.sparkSession
    first = queries.select(F.size("q")).first()

    def near(block) -> DataFrame:
        shared = spark.sparkContext.broadcast([(r["q_id"], np.array(r["q"], float)) for r in block])

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(1))
                    for q_id, q in shared.value:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), q_id)), batch.column(0), pa.array(exact(q, x, metric))], names=["q_id", "vector_id", "distance"])

        return vectors.select("vector_id", "vector").mapInArrow(run, PARTIAL)

    parts = [near(block) for block in query_blocks(queries.select("q_id", F.col("q").cast("array<double>").alias("q")), first[0] if first else 1)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], PARTIAL)


def selective_ids(vectors: DataFrame, found: dict | str, index: DataFrame | None = None) -> DataFrame | None:
    """The ids that an Eq or an And of Eq names by its postings; None if the filter is another or names over SELECTIVE rows."""
    clauses = conjunction(parse(found))
    if not clauses:
        return None
    ids = intersect(postings(vectors) if index is None else index, clauses)
    return ids if ids.limit(SELECTIVE + 1).count() <= SELECTIVE else None


def search_filtered(vectors: DataFrame, query, k: int, found: dict | str, metric: Metric | str = Metric.L2, index: DataFrame | None = None) -> DataFrame:
    """Exact top-k under any filter: through postings where `selective_scan` applies, else by a scan of all rows."""
    near = selective_scan(vectors, query, k, found, metric, index)
    return knn(vectors, query, k, metric, found) if near is None else near


def selective_scan(vectors: DataFrame, query, k: int, found: dict | str, metric: Metric | str = Metric.L2, index: DataFrame | None = None) -> DataFrame | None:
    """Exact top-k over the rows that an Eq or an And of Eq names by its postings; None if the filter is another or
    names more than SELECTIVE rows."""
    ids = selective_ids(vectors, found, index)
    return None if ids is None else knn(vectors.join(F.broadcast(ids), "vector_id", "left_semi"), query, k, metric)


def search(vectors: DataFrame, query, k: int, metric: Metric | str = Metric.L2, found: dict | str | None = None, dimension: int | None = None) -> DataFrame:
    """`knn` with the checks of a collection: dimension and finiteness first, then that there is a row at all."""
    check_search(k)
    query = check_vector(query, dimension if dimension is not None else len(query))
    if not vectors.limit(1).count():
        raise EmptyIndex("the collection has no vectors")
    return knn(vectors, query, k, metric, found)


def merge_hits(parts: list[DataFrame], k: int) -> DataFrame:
    """The k nearest of several results (q_id, rank, vector_id, distance); a vector counts once, at its least distance."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    once = both.groupBy("q_id", "vector_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("q_id").orderBy("distance", "vector_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q_id", "rank", "vector_id", "distance")


def recall(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall) averaged over the truth's queries: |found and true| / k."""
    both = truth.select("q_id", "vector_id").join(hits.select("q_id", "vector_id"), ["q_id", "vector_id"]).groupBy("q_id").agg(F.count("*").alias("n"))
    every = truth.select("q_id").distinct().join(both, "q_id", "left")
    return every.agg(F.avg(F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("recall"))


def nearest_rank(column: str | Column, p: float) -> Column:
    """The value of rank ceil(n * p)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.percentile_cont(c, p) if p in (0.0, 1.0) else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def compare_runs(a: DataFrame, b: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Equal configurations of two result sets side by side, with the ratio b / a of every value."""
    left = a.select(*on, *(F.col(v).alias(f"{v}_a") for v in values))
    right = b.select(*on, *(F.col(v).alias(f"{v}_b") for v in values))
    return left.join(right, on).withColumns({f"{v}_ratio": F.try_divide(F.col(f"{v}_b"), F.col(f"{v}_a")) for v in values})
