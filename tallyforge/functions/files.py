"""Checks on edited documents (markdown files), as columns over the new and the original text."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constraints import holds, some, targets
from .text import let


def section(text: Column, heading: str | None) -> Column:
    """Lines under a heading, up to the next heading of any level; all lines without one."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    if not heading:
        return lines
    at = F.array_position(F.transform(lines, lambda x: F.trim(x)), F.lit(heading))
    after = F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    ends = F.transform(after, lambda x: F.startswith(F.ltrim(x), F.lit("#")))
    stop = F.array_position(ends, F.lit(True))
    return F.transform(F.when(stop > 0, F.slice(after, 1, (stop - 1).cast("int"))).otherwise(after), lambda x: F.regexp_replace(x, r"\s+$", ""))


def rows(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")))


def cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))


def body_rows(lines: Column) -> Column:
    r = rows(lines)
    return F.when(F.size(r) > 2, F.slice(r, 3, F.greatest(F.size(r) - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def frontmatter(text: Column, key: str, value: Any) -> Column:
    return F.regexp_extract(text, rf"(?m)^{re.escape(key)}:\s*(\S+)", 1) == str(value)


def section_contains(text: Column, check: dict[str, Any]) -> Column:
    body = F.array_join(section(text, check.get("section")), "\n")
    return some([holds(body, t) for t in targets(check)])


def table_wellformed(text: Column, heading: str | None = None) -> Column:
    r = rows(section(text, heading))
    width = F.size(cells(F.get(r, F.lit(0))))
    return (F.size(r) >= 3) & F.coalesce(F.rlike(F.get(r, F.lit(1)), F.lit(r"^\|[\s:|-]+\|$")), F.lit(False)) & F.forall(r, lambda x: F.size(cells(x)) == width)


def table_rows_preserved(text: Column, original: Column, heading: str | None = None, column: int = 0) -> Column:
    """Every key of the original table is still there; an original without rows is no pass."""
    key = lambda r: F.get(cells(r), F.lit(column))
    before, after = body_rows(section(original, heading)), F.transform(body_rows(section(text, heading)), key)
    kept = let(after, lambda a: F.forall(before, lambda r: F.coalesce(F.array_contains(a, key(r)), F.lit(False))))
    return (F.size(before) > 0) & kept


def table_row_position(text: Column, contains: str, index: int = 0, heading: str | None = None) -> Column:
    """The first row that holds a text is at an index; -1 is the last."""
    r = body_rows(section(text, heading))
    hit = F.array_position(F.transform(r, lambda x: holds(x, contains)), F.lit(True))
    return (hit > 0) & (hit == (F.size(r) if index == -1 else F.lit(index + 1)))


def bullets_wellformed(text: Column, heading: str | None = None) -> Column:
    """Indents are even, and no bullet is more than a level below the one before."""
    marked = F.filter(section(text, heading), lambda x: F.rlike(x, F.lit(r"^\s*[-*]")))
    depth = F.transform(marked, lambda x: F.length(F.regexp_extract(x, "^ *", 0)))
    steps = F.aggregate(
        depth, F.struct(F.lit(True).alias("ok"), F.lit(None).cast("int").alias("last")),
        lambda a, d: F.struct((a["ok"] & (d % 2 == 0) & F.coalesce((d / 2).cast("int") <= a["last"] + 1, F.lit(True))).alias("ok"), (d / 2).cast("int").alias("last")),
        lambda a: a["ok"],
    )
    return steps


def lines_preserved(text: Column, original: Column, heading: str | None = None) -> Column:
    kept = lambda t: F.filter(F.transform(section(t, heading), lambda x: F.trim(x)), lambda x: x != "")
    return F.size(F.array_except(kept(original), kept(text))) == 0


def passes(check: dict[str, Any], text: Column, original: Column) -> Column:
    """One check by its type; unknown types, and files that are missing or empty, fail."""
    heading = check.get("section")
    rules = {
        "frontmatter": lambda: frontmatter(text, check["key"], check["value"]),
        "section_contains": lambda: section_contains(text, check),
        "table_wellformed": lambda: table_wellformed(text, heading),
        "table_rows_preserved": lambda: table_rows_preserved(text, original, heading, check.get("key_column", 0)),
        "table_row_position": lambda: table_row_position(text, str(check["contains"]), check.get("index", 0), heading),
        "bullets_wellformed": lambda: bullets_wellformed(text, heading),
        "lines_preserved": lambda: lines_preserved(text, original, heading),
    }
    rule = rules.get(check.get("type", ""))
    return F.lit(False) if rule is None else F.coalesce(rule(), F.lit(False)) & (F.coalesce(text, F.lit("")) != "")


def fraction(checks: list[dict[str, Any]], text: Column, original: Column) -> Column:
    return sum((passes(c, text, original).cast("double") for c in checks), F.lit(0.0)) / len(checks) if checks else F.lit(1.0)
