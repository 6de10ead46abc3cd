"""Similarities that built-in expressions can't give: plain Python over values, and Arrow functions over columns.

Repeats are common across trials, so callers bring distinct pairs first and join the results back (``on_distinct``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import zip_longest
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

WINDOW, MAX_PERIOD, MIN_RUN = 4096, 64, 200
CONTAINED = 0.8


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions + deletions) / (length of both): twice the longest common subsequence over all characters.

    Bit-parallel: a bit for each place in a, one step for each character of b.
    """
    if not a and not b:
        return 1.0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full  # zeros mark places where the common subsequence grows
    for ch in b:
        hit = free & places.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    common = len(a) - free.bit_count()
    return 2 * common / (len(a) + len(b))


def window_ratio(needle: str, haystack: str) -> float:
    """The best ratio of the needle and any run of as many words of the haystack."""
    words, size = haystack.split(), max(1, len(needle.split()))
    return max((indel_ratio(needle, " ".join(words[i : i + size])) for i in range(len(words) - size + 1)), default=0.0)


def kind(value: Any) -> str:
    """A JSON value's kind; booleans are no numbers here."""
    kinds = {type(None): "null", bool: "truth", int: "number", float: "number", str: "text", list: "array", dict: "object"}
    return kinds[type(value)]


def near_texts(want: str, got: str, _: bool = False) -> float:
    want, got = (x.lower().strip() for x in (want, got))
    return 1.0 if want == got else CONTAINED if want in got or got in want else indel_ratio(want, got)


def across(want: Any, got: Any, strict: bool) -> float:
    """A number and a text: by the number that the text spells, or else as texts."""
    spelt = [as_number(x) for x in (want, got)]
    return 0.0 if strict else near_texts(str(want), str(got)) if None in spelt else float(spelt[0] == spelt[1])


def as_number(value: Any) -> float | None:
    try:
        return float(str(value).strip())
    except ValueError:
        return None


def mean_of(pairs: Iterable[tuple[Any, Any]], strict: bool) -> float:
    """Over what is wanted, so extra parts are free; where nothing is wanted, anything will do."""
    marks = [value_match(want, got, strict) for want, got in pairs]
    return sum(marks) / len(marks) if marks else 1.0


def any_of(want: Any, got: list, strict: bool) -> float:
    return max((value_match(want, one, strict) for one in got), default=0.0)


#: What decides, by the kinds of the wanted and the given value. Other pairs match if they are equal, and null never does.
RULES: dict[tuple[str, str], Callable[[Any, Any, bool], float]] = {
    ("number", "number"): lambda want, got, _: float(float(want) == float(got)),
    ("number", "text"): across,
    ("number", "array"): any_of,
    ("text", "text"): near_texts,
    ("text", "number"): across,
    ("text", "array"): any_of,
    ("array", "array"): lambda want, got, strict: mean_of(zip_longest(want, got[: len(want)]), strict),
    ("object", "object"): lambda want, got, strict: mean_of(((v, got.get(k)) for k, v in want.items()), strict),
}


def value_match(want: Any, got: Any, strict: bool = False) -> float:
    """How far a JSON value matches a wanted one, by RULES; a part that is missing counts as null. strict: a number is no text."""
    decided = RULES.get((kind(want), kind(got)), lambda *_: float(got is not None and want == got))
    return decided(want, got, strict)


def periodicity(run: str) -> float:
    """The best share of characters that equal the one a period before, over short periods."""
    codes = np.frombuffer(run[:WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
    periods = range(1, min(MAX_PERIOD, len(codes) // 2) + 1)
    return max((float((codes[p:] == codes[:-p]).mean()) for p in periods), default=0.0)


def char_loop(text: str) -> float:
    return max((periodicity(run) for run in text.split() if len(run) >= MIN_RUN), default=0.0)


def _over(f: Callable[..., float]) -> Callable[..., Column]:
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*columns, strict=True)], dtype="float64")

    n = f.__code__.co_argcount
    one = lambda a: run(a)
    two = lambda a, b: run(a, b)
    own = one if n == 1 else two
    own.__annotations__ = {x: pd.Series for x in "ab"[:n]} | {"return": pd.Series}
    return F.pandas_udf(own, DoubleType())


def _text_ratio(a: str | None, b: str | None) -> float:
    return indel_ratio(a or "", b or "")


def _text_window(a: str | None, b: str | None) -> float:
    return window_ratio(a or "", b or "")


def _json_match(a: str | None, b: str | None) -> float:
    return value_match(json.loads(a) if a else None, json.loads(b) if b else None)


def _json_match_strict(a: str | None, b: str | None) -> float:
    return value_match(json.loads(a) if a else None, json.loads(b) if b else None, True)


def _char_loop(a: str | None) -> float:
    return char_loop(a or "")


ratio, window, json_match, json_match_strict, char_loop_ratio = map(_over, (_text_ratio, _text_window, _json_match, _json_match_strict, _char_loop))


def on_distinct(df: DataFrame, columns: list[str], name: str, f: Callable[..., Column]) -> DataFrame:
    """Adds f(columns), computed once for each distinct combination."""
    own = [f"_k{i}" for i in range(len(columns))]
    pairs = df.select(*[F.col(c).alias(k) for c, k in zip(columns, own, strict=True)]).distinct().withColumn(name, f(*own))
    keys = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(columns, own, strict=True)]
    return df.join(pairs, keys, "left").drop(*own)
