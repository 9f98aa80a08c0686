"""Filters over metadata, from their JSON form to a two-valued column.

A filter is {"Eq": {"key", "value"}}, {"And": [...]}, {"Or": [...]}, {"In": {"key", "values"}} or
{"Range": {"key", "min", "max"}}. A missing key matches nothing, types never mix, floats are in total order (NaN equals
itself and is greatest, -0.0 is below 0.0), an empty And holds everywhere and an empty Or or In nowhere.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrail.functions.metadata import tagged
from vectrail.types import InvalidInput

_FIELD = {0: "b", 1: "i", 2: "f", 3: "s"}


def _tag(value) -> dict:
    if isinstance(value, float):
        return {"t": 2, "f": value}
    return tagged(value)


def _negative_zero(column: Column) -> Column:
    return (column == 0) & (column.cast("string") == "-0.0")


def _equal(x: Column, value) -> Column:
    v = _tag(value)
    name = _FIELD[v["t"]]
    same = x[name] == F.lit(v[name])
    if v["t"] == 2 and v["f"] == 0:
        negative = math.copysign(1, v["f"]) < 0
        same = same & (_negative_zero(x["f"]) if negative else ~_negative_zero(x["f"]))
    return F.coalesce(same, F.lit(False))


def _beyond(x: Column, value, lower: bool) -> Column:
    v = _tag(value)
    if v["t"] == 0:
        return F.lit(False)
    c, bound = x[_FIELD[v["t"]]], F.lit(v[_FIELD[v["t"]]])
    if v["t"] == 2 and v["f"] == 0:
        negative = math.copysign(1, v["f"]) < 0
        if lower:
            inside = (c > 0) | ((c == 0) if negative else (c == 0) & ~_negative_zero(c))
        else:
            inside = (c < 0) | (_negative_zero(c) if negative else c == 0)
    else:
        inside = c >= bound if lower else c <= bound
    return F.coalesce(inside, F.lit(False))


def parse(found: str | dict) -> dict:
    """A checked filter tree from JSON text or Python objects."""
    if isinstance(found, str):
        try:
            found = json.loads(found)
        except ValueError as e:
            raise InvalidInput(str(e)) from e
    if not isinstance(found, dict) or len(found) != 1:
        raise InvalidInput("a filter is an object with one variant")
    (kind, body), = found.items()
    if kind in ("And", "Or"):
        if not isinstance(body, list):
            raise InvalidInput(f"{kind} takes a list")
        return {kind: [parse(x) for x in body]}
    wanted = {"Eq": ({"key", "value"}, {"key", "value"}), "In": ({"key", "values"}, {"key", "values"}), "Range": ({"key"}, {"key", "min", "max"})}.get(kind)
    if wanted is None:
        raise InvalidInput(f"unknown filter {kind!r}")
    if not isinstance(body, dict) or not wanted[0] <= set(body) <= wanted[1] or not isinstance(body["key"], str):
        raise InvalidInput(f"{kind} has the fields {sorted(wanted[1])}")
    if kind == "In" and not isinstance(body["values"], list):
        raise InvalidInput("In takes a list of values")
    for value in body.get("values", [v for k, v in body.items() if k in ("value", "min", "max") and not (v is None and k != "value")]):
        _tag(value)
    return {kind: dict(body)}


def compile_filter(found: str | dict, metadata: Column) -> Column:
    """The filter as a column that is never null; without metadata (null) it may still hold, see `search_filter`."""
    (kind, body), = parse(found).items()
    if kind == "And":
        return reduce(lambda a, b: a & b, [compile_filter(x, metadata) for x in body], F.lit(True))
    if kind == "Or":
        return reduce(lambda a, b: a | b, [compile_filter(x, metadata) for x in body], F.lit(False))
    x = F.try_element_at(metadata, F.lit(body["key"]))
    if kind == "Eq":
        return _equal(x, body["value"])
    if kind == "In":
        return reduce(lambda a, b: a | b, [_equal(x, v) for v in body["values"]], F.lit(False))
    low, high = body.get("min"), body.get("max")
    out = F.coalesce(F.map_contains_key(metadata, body["key"]), F.lit(False))
    if low is not None:
        out = out & _beyond(x, low, True)
    return out if high is None else out & _beyond(x, high, False)


def search_filter(found: str | dict | None, metadata: Column) -> Column:
    """What a search applies: no filter admits every row, any filter only rows that have metadata."""
    if found is None:
        return F.lit(True)
    return metadata.isNotNull() & compile_filter(found, metadata)


def conjunction(found: dict | None) -> list[tuple[str, object]] | None:
    """The (key, value) clauses of a filter that is Eq or a (nested) And of them, else None."""
    if not found:
        return None
    (kind, body), = found.items()
    if kind == "Eq":
        return [(body["key"], body["value"])]
    if kind != "And":
        return None
    parts = [conjunction(x) for x in body]
    return None if any(p is None for p in parts) else [c for p in parts for c in p]
