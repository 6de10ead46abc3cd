"""The sign test against exact fractions, as a column and as an SQL function."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import sqlfuncs
from tallyforge.operators import stats

CASES = [(0, 0), (0, 1), (1, 1), (2, 1), (3, 7), (15, 16), (16, 17), (5, 40), (0, 30), (1, 60), (537, 537), (538, 538), (538, 537), (500, 600), (0, 1074), (0, 2000), (1000, 1200), (5000, 5300), (9000, 11000), (40, 3000)]


def exact(wins, losses):
    n, term = wins + losses, 1
    total = term
    for i in range(1, min(wins, losses) + 1):
        term = term * (n - i + 1) // i
        total += term
    return float(min(Fraction(1), Fraction(2 * total, 1 << n)))


def test_sign_test_at_any_size(spark):
    sqlfuncs.register(spark)
    spark.createDataFrame(CASES + [(b, a) for a, b in CASES], "w long, l long").createOrReplaceTempView("counts")
    found = spark.table("counts").select("w", "l", stats.sign_test_p(F.col("w"), F.col("l")).alias("p"), F.expr("sign_test_p(w, l)").alias("q")).collect()
    assert all(r["p"] == pytest.approx(exact(r["w"], r["l"]), rel=1e-12, abs=1e-300) == r["q"] for r in found)


def test_sign_test_of_millions(spark):
    rows = spark.createDataFrame([(500_000, 500_000), (499_000, 501_000), (10**9, 10**9 + 10**5)], "w long, l long")
    p = [r["p"] for r in rows.select(stats.sign_test_p(F.col("w"), F.col("l")).alias("p")).collect()]
    # By the normal approximation, with its correction for whole counts.
    assert p[0] == 1.0 and p[1] == pytest.approx(0.045608, abs=1e-5) and p[2] == pytest.approx(0.025352, abs=1e-5)
