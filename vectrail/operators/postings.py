"""Inverted index of metadata: (key, value) to vector ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.functions.filters import _tag
from vectrail.functions.metadata import canonical_key


def postings(vectors: DataFrame) -> DataFrame:
    """(key, value, vector_id), one row for each entry; value is the canonical text of the typed value."""
    entry = vectors.filter("metadata is not null").select("vector_id", F.explode(F.map_entries("metadata")).alias("e"))
    return entry.select(F.col("e.key").alias("key"), canonical_key(F.col("e.value")).alias("value"), "vector_id")


def literal_key(value) -> str:
    v = _tag(value)
    return f"{v['t']}:{str(v['b']).lower() if v['t'] == 0 else v['i'] if v['t'] == 1 else v['s']}" if v["t"] != 2 else ""


def lookup(index: DataFrame, key: str, value) -> DataFrame:
    """(vector_id) of one posting list."""
    v = _tag(value)
    text = F.concat(F.lit("2:"), F.lit(v["f"]).cast("double").cast("string")) if v["t"] == 2 else F.lit(literal_key(value))
    return index.filter((F.col("key") == key) & (F.col("value") == text)).select("vector_id")


def intersect(index: DataFrame, clauses: list[tuple[str, object]]) -> DataFrame:
    """(vector_id) in the lists of all clauses."""
    lists = [lookup(index, k, v) for k, v in clauses]
    return reduce(lambda a, b: a.join(b, "vector_id", "left_semi"), lists)
