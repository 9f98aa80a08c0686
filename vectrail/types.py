"""Metrics, schemas and errors of vector collections."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class VectorError(Exception):
    """Base of all errors that a collection or index raises."""


class InvalidInput(VectorError):
    pass


class DimensionMismatch(InvalidInput):
    pass


class InvalidFormat(VectorError):
    pass


class ChecksumMismatch(InvalidFormat):
    pass


class NotFound(VectorError):
    pass


class EmptyIndex(VectorError):
    pass


class UnsupportedMetric(VectorError):
    pass


class Metric(IntEnum):
    """Smaller distances are nearer: squared Euclidean, negated dot product, negated cosine."""

    L2 = 0
    DOT = 1
    COSINE = 2

    @classmethod
    def parse(cls, name: str | int | Metric) -> Metric:
        if isinstance(name, int):
            if name in cls._value2member_map_:
                return cls(name)
        else:
            for metric, names in METRIC_NAMES.items():
                if name.lower() in names:
                    return metric
        raise UnsupportedMetric(f"unknown metric {name!r}")


METRIC_NAMES = {
    Metric.L2: ("l2", "euclidean"),
    Metric.DOT: ("dot", "dotproduct", "dot_product", "ip"),
    Metric.COSINE: ("cosine", "cos"),
}

#: A metadata value: t is 0 bool, 1 int, 2 float, 3 str; only the payload of its type is set.
META = T.StructType(
    [
        T.StructField("t", T.ByteType(), False),
        T.StructField("b", T.BooleanType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("s", T.StringType()),
    ]
)
METADATA = T.MapType(T.StringType(), META, False)
VECTOR = T.ArrayType(T.FloatType(), False)
VECTORS = T.StructType([T.StructField("vector_id", T.LongType(), False), T.StructField("vector", VECTOR), T.StructField("metadata", METADATA)])
OP_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("vector_id", T.LongType(), False),
        T.StructField("vector", VECTOR),
        T.StructField("metadata", METADATA),
        T.StructField("crc", T.LongType(), False),
    ]
)
HITS = "q_id long, rank int, vector_id long, distance double"
