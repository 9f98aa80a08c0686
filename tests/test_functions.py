import math

import pytest
from pyspark.sql import functions as F

from vectrail.functions import distance, filters, metadata, validate
from vectrail.types import METADATA, DimensionMismatch, InvalidInput, Metric, UnsupportedMetric


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def vec(*values):
    return distance.vector_literal(values)


@pytest.mark.parametrize(
    "metric, a, b, want",
    [
        ("l2", (1, 2, -2), (4, 6, 10), 169.0),
        ("l2", (-7,), (-7,), 0.0),
        ("dot", (0.5, -8, 2), (6, 0.25, 1.5), -4.0),
        ("cosine", (3, 4), (-8, 6), 0.0),
        ("cosine", (3, 4), (4, 3), -0.96),
        ("cosine", (1, -1, 1), (-7, 7, -7), 1.0),
        ("cosine", (0, 0, 0), (9, 1, 4), 0.0),
        ("cosine", (1e38, -2e38), (1e38, -2e38), -1.0),
    ],
)
def test_distances(spark, metric, a, b, want):
    assert value(spark, distance.compute_distance(vec(*a), vec(*b), metric)) == pytest.approx(want)


def test_metric_names():
    assert [Metric.parse(x) for x in ("L2", "euclidean", "IP", "dot_product", "cos", 2)] == [Metric.L2, Metric.L2, Metric.DOT, Metric.DOT, Metric.COSINE, Metric.COSINE]
    for bad in ("manhattan", 9):
        with pytest.raises(UnsupportedMetric):
            Metric.parse(bad)


def test_sql_functions(spark):
    distance.register_sql(spark)
    row = spark.sql("SELECT vec_l2(array(5F, 1F), array(2F, 5F)) a, vec_dot(array(1.5F, -4F), array(8F, 0.5F)) b, vec_cosine(array(0F), array(6F)) c, vec_distance(array(7F), array(-3F), 'ip') d").first()
    assert tuple(row) == (25.0, 10.0, 0.0, 21.0)


ROW = {"depot": "oslo", "floor": -3, "load": 12.25, "sealed": False}


def eq(key, value):
    return {"Eq": {"key": key, "value": value}}


def between(key, **ends):
    return {"Range": {"key": key, **ends}}


HOLDS = [
    eq("depot", "oslo"),
    eq("floor", -3),
    eq("load", 12.25),
    eq("sealed", False),
    {"And": []},
    {"In": {"key": "depot", "values": [7, True, "oslo"]}},
    between("floor", min=-3, max=-3),
    between("floor", max=0),
    between("load", min=12.0, max=12.5),
    between("load"),
    between("depot", min="oslo", max="oslp"),
    {"Or": [eq("floor", 8), {"And": [between("load", min=1.0), eq("sealed", False)]}]},
]
FAILS = [
    eq("depot", "Oslo"),
    eq("floor", -3.0),
    eq("load", 12),
    eq("sealed", 0),
    eq("weight", 12.25),
    {"Or": []},
    {"In": {"key": "floor", "values": []}},
    {"In": {"key": "floor", "values": [-3.0, "-3"]}},
    between("floor", min=-2),
    between("floor", max=5.0),
    between("floor", min=-9, max=1.5),
    between("sealed", max=True),
    between("weight"),
    {"And": [eq("depot", "oslo"), {"Or": [eq("floor", 1), between("load", max=12.0)]}]},
]


@pytest.mark.parametrize("found, want", [*((f, True) for f in HOLDS), *((f, False) for f in FAILS)])
def test_filters(spark, found, want):
    column = filters.compile_filter(found, metadata.literal_map(ROW))
    assert value(spark, column) is want
    assert value(spark, ~column) is (not want)


def test_filter_float_total_order(spark):
    def holds(stored, found):
        m = F.create_map(F.lit("x"), metadata.column_value(F.lit(stored), "float")).cast(METADATA)
        return value(spark, filters.compile_filter(found, m))

    assert holds(float("nan"), {"Eq": {"key": "x", "value": float("nan")}})
    assert holds(float("nan"), {"Range": {"key": "x", "min": float("inf")}})
    assert not holds(-0.0, {"Eq": {"key": "x", "value": 0.0}})
    assert holds(-0.0, {"Eq": {"key": "x", "value": -0.0}})
    assert not holds(-0.0, {"Range": {"key": "x", "min": 0.0}})
    assert holds(0.0, {"Range": {"key": "x", "min": -0.0}})
    assert not holds(0.0, {"Range": {"key": "x", "max": -0.0}})


@pytest.mark.parametrize("bad", ["[", "{}", '{"Not": []}', '{"Eq": {"key": "a"}}', '{"Eq": {"key": 1, "value": 2}}', '{"In": {"key": "a", "values": 3}}', '{"And": {}}', '{"Eq": {"key": "a", "value": [1]}}', '{"Range": {"key": "a", "low": 1}}'])
def test_bad_filters(bad):
    with pytest.raises(InvalidInput):
        filters.parse(bad)


def test_no_metadata_matches_no_filter(spark):
    none = F.lit(None).cast(METADATA)
    assert value(spark, filters.search_filter({"And": []}, none)) is False
    assert value(spark, filters.search_filter(None, none)) is True


def test_metadata_values():
    assert metadata.tagged(True)["t"] == 0 and metadata.tagged(1)["t"] == 1 and metadata.tagged(1.0)["t"] == 2
    assert metadata.from_json('{"a": 1, "b": 1.5}') == metadata.tagged_map({"b": 1.5, "a": 1})
    assert metadata.to_json(metadata.tagged_map(ROW)) == '{"depot": "oslo", "floor": -3, "load": 12.25, "sealed": false}'
    for bad in (math.nan, math.inf, None, [1], {"x": 1}, 1 << 70):
        with pytest.raises(InvalidInput):
            metadata.tagged(bad)
    with pytest.raises(InvalidInput):
        metadata.tagged_map({1: 2})
    with pytest.raises(InvalidInput):
        metadata.from_json("[1]")


def test_validation():
    with pytest.raises(DimensionMismatch):
        validate.check_vector([1.0], 2)
    with pytest.raises(InvalidInput):
        validate.check_vector([1.0, math.nan], 2)
    validate.check_search(0)
    for k in (0, 10_001):
        with pytest.raises(InvalidInput):
            validate.check_search(k, edge=True)
