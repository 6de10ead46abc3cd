"""Values matched as relations, against the matching of one pair in Python."""

import json
import random

import pytest

from tallyforge.functions.fuzzy import value_match
from tallyforge.operators import matching as M

PLAIN = [None, True, False, 0, 1, 5, -3, 5.0, 2.5, 1e3, "", " ", "5", " 5.0 ", "1e3", "1_000", "five", "Five ", "five apples", "inf", "nan", "true", "[1]", "é", "naïve", "naive"]
NESTED = [[], {}, [[]], {"a": {}}, [1, "x"], [1, "X", None], {"a": 1}, {"a": "1", "b": 2}, {"a": {"b": [1, {"c": "deep"}]}}, {"a": {"b": [1, {"c": "deeper"}, 4]}}, ["five", ["5", [5]]], {"a.b": 1, 'q"': "\\\"{["}]


def pairs():
    rng = random.Random(2)

    def value(d):
        r = rng.random()
        if d == 0 or r < 0.5:
            return rng.choice(PLAIN)
        return [value(d - 1) for _ in range(rng.randrange(4))] if r < 0.75 else {rng.choice("abc"): value(d - 1) for _ in range(rng.randrange(4))}

    every = [(w, g) for w in PLAIN + NESTED for g in PLAIN + NESTED]
    return every + [(value(3), value(3)) for _ in range(300)]


@pytest.mark.parametrize("strict", [False, True])
def test_equals_the_matching_of_one_pair(spark, strict):
    from pyspark.sql import functions as F

    own = pairs()
    df = spark.createDataFrame([(i, json.dumps(w), json.dumps(g)) for i, (w, g) in enumerate(own)], "i long, w string, g string")
    found = {r["i"]: r["m"] for r in M.match(df, "w", "g", "m", F.lit(strict)).collect()}
    wrong = [(w, g, found[i], value_match(w, g, strict)) for i, (w, g) in enumerate(own) if abs(found[i] - value_match(w, g, strict)) > 1e-9]
    assert not wrong and len(found) == len(own)


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, "1", None), (2, None, "1"), (3, None, None), (4, "{bad", "1"), (5, "1", "1")], "i long, w string, g string")
    assert {r["i"]: r["m"] for r in M.match(df, "w", "g", "m").collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 1.0}
    assert M.match(df.filter("false"), "w", "g", "m").count() == 0
