"""Distances between array columns, summed from the left in double precision, and their SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vectrail.types import Metric


def _fold(a: Column, b: Column, term) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def dot_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm_squared(a: Column) -> Column:
    return F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """dot / sqrt(|a|^2 |b|^2); 0 where either vector is zero."""
    scale = norm_squared(a) * norm_squared(b)
    return F.when(scale > 0, dot_product(a, b) / F.sqrt(scale)).otherwise(F.lit(0.0))


def compute_distance(a: Column, b: Column, metric: Metric | str) -> Column:
    metric = Metric.parse(metric)
    if metric is Metric.L2:
        return l2_squared(a, b)
    return -dot_product(a, b) if metric is Metric.DOT else -cosine_similarity(a, b)


def vector_literal(values) -> Column:
    return F.array(*(F.lit(float(x)).cast("float") for x in values))


def register_sql(spark: SparkSession) -> None:
    """Temporary SQL functions vec_l2, vec_dot, vec_cosine and vec_distance(a, b, metric name)."""
    fold = lambda term: f"aggregate(zip_with(a, b, (x, y) -> {term}), 0D, (s, x) -> s + x)"
    dx, dy = "CAST(x AS DOUBLE)", "CAST(y AS DOUBLE)"
    bodies = {
        "vec_l2": fold(f"({dx} - {dy}) * ({dx} - {dy})"),
        "vec_dot": fold(f"{dx} * {dy}"),
        "vec_norm2": f"aggregate(transform(a, x -> {dx} * {dx}), 0D, (s, x) -> s + x)",
        "vec_cosine": "CASE WHEN vec_norm2(a) * vec_norm2(b) > 0 THEN vec_dot(a, b) / sqrt(vec_norm2(a) * vec_norm2(b)) ELSE 0D END",
        "vec_distance": "CASE WHEN lower(metric) IN ('l2', 'euclidean') THEN vec_l2(a, b) WHEN lower(metric) IN ('dot', 'dotproduct', 'dot_product', 'ip') THEN -vec_dot(a, b) WHEN lower(metric) IN ('cosine', 'cos') THEN -vec_cosine(a, b) END",
    }
    for name, body in bodies.items():
        args = {"vec_norm2": "a ARRAY<FLOAT>", "vec_distance": "a ARRAY<FLOAT>, b ARRAY<FLOAT>, metric STRING"}.get(name, "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
