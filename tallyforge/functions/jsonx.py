"""JSON in texts, through VARIANT: parsing, dotted paths, types, comparisons."""

from __future__ import annotations

import json
from itertools import product
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```(?:json)?\s*\n?(.*?)```"
TYPES = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT"}


def parse(text: Column) -> Column:
    """A text's JSON: that of its first fenced block if it parses, else that of the whole text; null if neither does."""
    fenced = F.try_parse_json(F.nullif(F.trim(F.regexp_extract(text, FENCE, 1)), F.lit("")))
    return F.coalesce(fenced, F.try_parse_json(F.trim(text)))


def paths(dotted: str) -> list[str]:
    """VARIANT paths that a dotted one may mean: a number is a key of an object or a place in an array."""
    if dotted == "":
        return ["$"]
    parts = []
    for p in dotted.split("."):
        key = "['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']"
        parts.append([key, f"[{p}]"] if p.isdigit() else [key])
    return ["$" + "".join(x) for x in product(*parts)]


def lookup(v: Column, dotted: str) -> Column:
    """The value at a path, null if there is none; a JSON null is a VARIANT null, which is not null."""
    return F.coalesce(*[F.try_variant_get(v, p, "variant") for p in paths(dotted)])


def kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)


def is_number(v: Column) -> Column:
    return kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def has_type(v: Column, name: str) -> Column:
    """As Python's isinstance: a boolean is a number but no integer here; a whole number written with a point is no integer."""
    if name == "number":
        out = is_number(v) | (kind(v) == "BOOLEAN")
    elif name in ("array", "object"):
        out = kind(v) == name.upper()
    else:
        out = kind(v) == TYPES.get(name, "NONE")
    return F.coalesce(out, F.lit(False))


def as_number(v: Column) -> Column:
    """Numbers, and booleans as 1 and 0; null for all else."""
    flag = F.when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
    return F.when(is_number(v), F.try_variant_get(v, "$", "double")).otherwise(flag)


def equals(v: Column, value: Any) -> Column:
    """As Python's ==: numbers and booleans by value, strings by text, the rest by structure."""
    if isinstance(value, (bool, int, float)):
        out = as_number(v) == float(value)
    elif isinstance(value, str):
        out = (kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == value)
    elif value is None:
        out = F.is_variant_null(v)
    else:
        out = F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
    return F.coalesce(out, F.lit(False))


def keys(v: Column) -> Column:
    """An object's keys, sorted; null for all else."""
    return F.when(kind(v) == "OBJECT", F.array_sort(F.json_object_keys(F.to_json(v))))


def elements(v: Column) -> Column:
    """An array's elements; null for all else."""
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))
