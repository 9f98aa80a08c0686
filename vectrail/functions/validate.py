"""Checks of vectors and search parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrail.types import DimensionMismatch, InvalidInput

LIMIT = 10_000


def check_vector(vector, dimension: int) -> list[float]:
    values = [float(x) for x in vector]
    if len(values) != dimension:
        raise DimensionMismatch(f"expected {dimension} components, got {len(values)}")
    if not all(map(math.isfinite, values)):
        raise InvalidInput("vector components are finite")
    return values


def check_search(k: int, ef: int | None = None, edge: bool = False) -> None:
    """k and ef; at the edge of a service they are 1 to 10,000, inside k is clamped and may be 0."""
    for name, value in (("k", k), ("ef", ef)):
        if value is not None and (value < (1 if edge else 0) or edge and value > LIMIT):
            raise InvalidInput(f"{name} is out of range: {value}")


def is_valid(vector: Column, dimension: int) -> Column:
    """True for arrays of the dimension with finite components only; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))
