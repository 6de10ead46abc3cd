"""The library's formulas as functions for SQL, in a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType

from ..operators.stats import STIRLING
from ..sources.haystacks import FILLER
from . import fuzzy

TERM = "a.t * (low - k) / CAST(n - low + k + 1 AS DOUBLE)"
STATEMENTS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION pass_hat_k(c BIGINT, n BIGINT, k INT) RETURNS DOUBLE RETURN CASE WHEN n >= k THEN aggregate(sequence(0, k - 1), CAST(1 AS DOUBLE), (a, i) -> a * greatest(c - i, 0) / (n - i)) END",
    "CREATE OR REPLACE TEMPORARY FUNCTION within_budget(made BIGINT, optimal BIGINT) RETURNS BOOLEAN RETURN made = 0 OR optimal <= 0 OR made <= greatest(2 * optimal, optimal + 3)",
    f"CREATE OR REPLACE TEMPORARY FUNCTION stirling_error(n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n < 16 THEN element_at(array({', '.join(f'{x!r}D' for x in STIRLING)}), CAST(n + 1 AS INT)) "
    "ELSE (1D/12 - (1D/360 - (1D/1260 - (1D/1680 - 1D/1188 / n / n) / n / n) / n / n) / n / n) / n END",
    "CREATE OR REPLACE TEMPORARY FUNCTION binomial_half(n BIGINT, x BIGINT) RETURNS DOUBLE RETURN CASE WHEN x = 0 OR x = n THEN pow(0.5D, n) ELSE sqrt(n / (2 * pi() * x) / (n - x)) * "
    "exp(stirling_error(n) - stirling_error(x) - stirling_error(n - x) - n / 2D * ((2 * x - n) / n * (log1p((2 * x - n) / n) - log1p((n - 2 * x) / n)) + log1p(-pow((2 * x - n) / n, 2)))) END",
    # The tail as a multiple of its largest term.
    "CREATE OR REPLACE TEMPORARY FUNCTION tail_terms(n BIGINT, low BIGINT) RETURNS DOUBLE RETURN CASE WHEN low = 0 THEN 1D ELSE aggregate(sequence(0L, least(low, CAST(ceil(7 * sqrt(n)) AS BIGINT) + 64) - 1), "
    f"named_struct('t', 1D, 's', 1D, 'c', 0D), (a, k) -> named_struct('t', {TERM}, 's', a.s + ({TERM} - a.c), 'c', ((a.s + ({TERM} - a.c)) - a.s) - ({TERM} - a.c)), a -> a.s) END",
    "CREATE OR REPLACE TEMPORARY FUNCTION sign_test_p(w BIGINT, l BIGINT) RETURNS DOUBLE RETURN CASE WHEN w = l THEN 1D ELSE least(1D, 2 * binomial_half(w + l, least(w, l)) * tail_terms(w + l, least(w, l))) END",
    "CREATE OR REPLACE TEMPORARY FUNCTION wilson_low(p BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN round(greatest(0, (p / n + 3.8416D / (2 * n) - 1.96D * sqrt(p / n * (1 - p / n) / n + 3.8416D / (4D * n * n))) / (1 + 3.8416D / n)), 4) ELSE 0 END",
    "CREATE OR REPLACE TEMPORARY FUNCTION wilson_high(p BIGINT, n BIGINT) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN round(least(1, (p / n + 3.8416D / (2 * n) + 1.96D * sqrt(p / n * (1 - p / n) / n + 3.8416D / (4D * n * n))) / (1 + 3.8416D / n)), 4) ELSE 0 END",
)


def mean_pass_hat_k(passes: pd.Series, n: pd.Series, k: pd.Series) -> float:
    """pass^k over the tasks of a group with k attempts or more, 0 without any, as an aggregate: mean_pass_hat_k(passes, n, k).

    Its input is a row for each task (by_task), so a group is no larger than a bank. Nulls don't count. As with all of
    Spark's aggregates in Python, a table without rows gives no row, grouped or not.
    """
    known = passes.notna() & n.notna() & k.notna()
    c, m, most = (x[known].astype("int64") for x in (passes, n, k))
    able = m >= most
    c, m, most = c[able], m[able], most[able]
    if not len(c):
        return 0.0
    share = pd.Series(1.0, index=c.index)
    for i in range(int(most.max())):
        counts = i < most
        share = share.where(~counts, share * (c - i).clip(lower=0) / (m - i).clip(lower=1))
    return float(share.mean())


class ItemStats:
    """What trials tell of a task, as a table function: item_stats(TABLE(rows) PARTITION BY task_id ORDER BY model).

    Rows are a model's passes and n at the task with its module, band and whether it is of the top or bottom third; a row comes out for
    each partition. It holds sums only, whatever the number of rows. Nulls in passes or n don't count; the band is the last model's.
    """

    def __init__(self) -> None:
        self.task = self.module = self.band = None
        self.rates, self.top, self.bottom, self.flaky = [0.0, 0], [0.0, 0], [0.0, 0], 0

    def eval(self, row: Row) -> None:
        if row["passes"] is None or not row["n"]:
            return
        rate = row["passes"] / row["n"]
        self.task, self.band = row["task_id"], row["band"]
        self.module = row["module"] if self.module is None else max(self.module, row["module"] or self.module)
        for sums, own in ((self.rates, True), (self.top, row["top"]), (self.bottom, row["bottom"])):
            if own:
                sums[0], sums[1] = sums[0] + rate, sums[1] + 1
        self.flaky += 0 < rate < 1

    def terminate(self):
        if self.rates[1]:
            mean = lambda s: s[0] / s[1] if s[1] else 0.0
            yield self.task, self.module, self.band, mean(self.rates), mean(self.top) - mean(self.bottom), self.flaky, self.rates[1]


ITEM_STATS = "task_id: string, module: string, band: string, pass_rate: double, discrimination: double, flaky_models: bigint, n_models: bigint"


class Haystack:
    """Filler lines as a table function: haystack(first, count)."""

    def eval(self, first: int, count: int):
        for i in range(first, first + count):
            yield i, FILLER.format(i=i, n=i * 7 % 1000)


def register(spark: SparkSession) -> None:
    for s in STATEMENTS:
        spark.sql(s)
    spark.udf.register("indel_ratio", fuzzy.ratio)
    spark.udf.register("window_ratio", fuzzy.window)
    spark.udf.register("json_match", fuzzy.json_match)
    spark.udf.register("mean_pass_hat_k", pandas_udf(mean_pass_hat_k, DoubleType()))
    spark.udtf.register("item_stats", udtf(ItemStats, returnType=ITEM_STATS))
    spark.udtf.register("haystack", udtf(Haystack, returnType="i: bigint, line: string"))
