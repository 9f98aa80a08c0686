"""Typed metadata: Python and JSON values to tagged structs and back."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrail.types import META, METADATA, InvalidInput

LONG = range(-(1 << 63), 1 << 63)
_FIELDS = ("b", "i", "f", "s")


def tagged(value) -> dict:
    """The struct of a Python value; bool goes before int, and only finite floats are allowed."""
    row = {"t": 0, "b": None, "i": None, "f": None, "s": None}
    if isinstance(value, bool):
        return row | {"b": value}
    if isinstance(value, int):
        if value not in LONG:
            raise InvalidInput(f"integer {value} has over 64 bits")
        return row | {"t": 1, "i": value}
    if isinstance(value, float):
        if not math.isfinite(value):
            raise InvalidInput("metadata floats are finite")
        return row | {"t": 2, "f": value}
    if isinstance(value, str):
        return row | {"t": 3, "s": value}
    raise InvalidInput(f"metadata values are bool, int, float or str, not {type(value).__name__}")


def tagged_map(metadata: dict | None) -> dict | None:
    if metadata is None:
        return None
    if not isinstance(metadata, dict) or not all(isinstance(k, str) for k in metadata):
        raise InvalidInput("metadata is a mapping with string keys")
    return {k: tagged(v) for k, v in sorted(metadata.items())}


def untagged(value) -> bool | int | float | str:
    return value[_FIELDS[value["t"]]]


def from_json(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError as e:
        raise InvalidInput(str(e)) from e
    if not isinstance(found, dict):
        raise InvalidInput("metadata is a JSON object")
    return tagged_map(found)


def to_json(metadata: dict) -> str:
    return json.dumps({k: untagged(v) for k, v in sorted(metadata.items())})


def column_value(column: Column, kind: str) -> Column:
    """A tagged struct from a column of kind bool, int, float or str."""
    tag = ("bool", "int", "float", "str").index(kind)
    cast = ("boolean", "bigint", "double", "string")
    fields = [F.lit(tag).cast("tinyint").alias("t"), *((column if i == tag else F.lit(None)).cast(c).alias(n) for i, (n, c) in enumerate(zip(_FIELDS, cast)))]
    return F.struct(*fields)


def column_map(**values: tuple[Column, str]) -> Column:
    """A metadata map from columns: name=(column, kind)."""
    return F.create_map(*(x for k, (c, kind) in sorted(values.items()) for x in (F.lit(k), column_value(c, kind)))).cast(METADATA)


def canonical_key(value: Column) -> Column:
    """Type tag and payload as text; floats by their text form, so -0.0 is not 0.0 and NaN is itself."""
    return F.concat(value["t"].cast("string"), F.lit(":"), F.coalesce(value["b"].cast("string"), value["i"].cast("string"), value["f"].cast("string"), value["s"]))


def accessors(metadata: Column, key: str) -> dict[str, Column]:
    """get, contains_key, len and sorted entries of a metadata column."""
    return {
        "get": F.try_element_at(metadata, F.lit(key)),
        "contains_key": F.coalesce(F.map_contains_key(metadata, key), F.lit(False)),
        "len": F.cardinality(metadata),
        "entries": F.array_sort(F.transform(F.map_entries(metadata), lambda e: F.struct(e["key"].alias("key"), canonical_key(e["value"]).alias("value")))),
    }


def literal_map(metadata: dict | None) -> Column:
    found = tagged_map(metadata)
    if found is None:
        return F.lit(None).cast(METADATA)
    if not found:
        return F.create_map().cast(METADATA)
    struct = lambda v: F.struct(*(F.lit(v[f.name]).cast(f.dataType).alias(f.name) for f in META.fields))
    return F.create_map(*(x for k, v in found.items() for x in (F.lit(k), struct(v)))).cast(METADATA)
