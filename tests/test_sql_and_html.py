from math import comb

import pytest
from tallyforge.functions import sqlfuncs
from tallyforge.operators import stats
from tallyforge.sources import html
from pyspark.sql import functions as F


def test_sql_functions_are_the_columns(spark):
    sqlfuncs.register(spark)
    cells = spark.createDataFrame([(w, x) for w in range(0, 20, 3) for x in range(0, 20, 4)], "w long, l long")
    low, high = stats.wilson(F.col("w"), F.col("w") + F.col("l"))
    both = cells.select("w", "l", stats.sign_test_p(F.col("w"), F.col("l")).alias("p"), low.alias("low"), high.alias("high"))
    for r in spark.sql("SELECT *, sign_test_p(w, l) AS q, wilson_low(w, w + l) AS a, wilson_high(w, w + l) AS b, pass_hat_k(w, w + l, 2) AS k FROM {t}", t=both).collect():
        n = r["w"] + r["l"]
        assert r["q"] == pytest.approx(r["p"]) and r["a"] == pytest.approx(r["low"], abs=1e-4) and r["b"] == pytest.approx(r["high"], abs=1e-4)
        assert r["k"] is None if n < 2 else r["k"] == pytest.approx(comb(r["w"], 2) / comb(n, 2))
    assert spark.sql("SELECT indel_ratio('kitten', 'sitting')").first()[0] == pytest.approx(8 / 13)
    assert spark.sql("SELECT count(*) AS n, min(i) AS a FROM haystack(5, 7)").first().asDict() == {"n": 7, "a": 5}


def test_page_cannot_be_closed_by_a_row(spark):
    page = html.render(spark.createDataFrame([(1, "</script><b>")], "rank long, model string"))
    assert page.count("</script>") == 1 and "&lt;/script&gt;" in page


def test_pass_k_as_an_aggregate(spark):
    sqlfuncs.register(spark)
    rows = [("a", 3, 5), ("a", 5, 5), ("a", 0, 4), ("a", 1, 2), ("a", None, 9), ("a", 2, None), ("b", 1, 2), ("c", None, None), ("d", 60, 100)]
    cells = spark.createDataFrame(rows, "g string, c long, n long")
    got = {r["g"]: (r["k1"], r["k3"], r["kn"]) for r in spark.sql("SELECT g, mean_pass_hat_k(c, n, 1) AS k1, mean_pass_hat_k(c, n, 3) AS k3, mean_pass_hat_k(c, n, c) AS kn FROM {t} GROUP BY g", t=cells).collect()}

    def mean(g, of):
        own = [(c, n, of(c)) for x, c, n in rows if x == g and c is not None and n is not None]
        able = [comb(c, k) / comb(n, k) for c, n, k in own if n >= k]
        return sum(able) / len(able) if able else 0.0

    for g in "abcd":
        assert got[g] == pytest.approx((mean(g, lambda c: 1), mean(g, lambda c: 3), mean(g, lambda c: c)))
    assert spark.sql("SELECT mean_pass_hat_k(c, n, 2) AS k FROM {t} WHERE g = 'none'", t=cells).collect() == []


def test_items_as_a_table_function(spark):
    sqlfuncs.register(spark)
    rows = [("t", "m1", "a", "mid", 1, 2, True, False), ("t", "m2", "b", "hard", 2, 2, False, True), ("t", "m3", None, None, None, 2, True, True), ("t", "m4", "a", "anchor", 0, 4, None, None), ("u", "m1", "a", "mid", 1, 0, True, True), (None, "m1", "a", "mid", 3, 3, True, True)]
    cells = spark.createDataFrame(rows, "task_id string, model string, module string, band string, passes long, n long, top boolean, bottom boolean")
    call = "SELECT * FROM item_stats(TABLE(SELECT * FROM {t}) PARTITION BY task_id ORDER BY model)"
    got = {r["task_id"]: tuple(r)[1:] for r in spark.sql(call, t=cells).collect()}
    assert got == {"t": ("b", "anchor", 0.5, -0.5, 1, 3), None: ("a", "mid", 1.0, 0.0, 0, 1)}
    assert spark.sql(call, t=cells.limit(0)).count() == 0
