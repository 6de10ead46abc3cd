"""Statistics: Wilson intervals, sign tests with Holm's correction, pairs of models, sample sizes, item and fleet analysis."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import by_task, counted, group_scores, whole

Z, Z_ALPHA, Z_BETA = 1.96, 1.959964, 0.841621
FLOOR, LEAST_MODELS = 0.35, 3
#: Tasks whose right answer is to hold back; ranking statistics can't read them.
RESTRAINT = ("adv_09", "adv_11", "adv_21", "ds_14", "ds_15")


def wilson(passes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, within 0 and 1, to four places; (0, 0) without attempts."""
    p, low_n = passes / F.nullif(n, F.lit(0)), 1 + z * z / F.nullif(n, F.lit(0))
    centre = (p + z * z / (2 * F.nullif(n, F.lit(0)))) / low_n
    margin = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z * z / (4 * F.nullif(n, F.lit(0)) * F.nullif(n, F.lit(0)))) / low_n
    low, high = F.round(F.greatest(F.lit(0.0), centre - margin), 4), F.round(F.least(F.lit(1.0), centre + margin), 4)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


#: What Stirling's formula for ln n! lacks, for n up to 15; above, the series has all digits of a double.
STIRLING = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]
#: Binomial terms that are summed: beyond this many root n from the largest, what is left is under a double's last digit.
ROOTS, MORE_TERMS = 7, 64


def stirling_error(n: Column) -> Column:
    d = n.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * d * d)) / (d * d)) / (d * d)) / (d * d)) / d
    return F.when(n < len(STIRLING), F.get(F.array(*map(F.lit, STIRLING)), F.least(n, F.lit(len(STIRLING))).cast("int"))).otherwise(series)


def binomial_half(n: Column, x: Column) -> Column:
    """The chance of x heads in n tosses, 0 < x < n, to a double's digits at any n: by Stirling's formula and its error, without logarithms of large numbers."""
    y, v = n - x, (2 * x - n) / n.cast("double")
    spread = n / F.lit(2.0) * (v * (F.log1p(v) - F.log1p(-v)) + F.log1p(-v * v))
    return F.sqrt(n / (2 * math.pi * x.cast("double") * y)) * F.exp(stirling_error(n) - stirling_error(x) - stirling_error(y) - spread)


def sign_test_p(wins: Column, losses: Column) -> Column:
    """Two-sided sign test at any size: twice the binomial tail up to the smaller count, at most 1; 1 without differences.

    The tail is summed from its largest term down, with a compensated sum, over as many terms as count.
    """
    n, low = (wins + losses).cast("long"), F.least(wins, losses).cast("long")
    top = F.when(low == 0, F.pow(F.lit(0.5), n.cast("double"))).otherwise(binomial_half(n, low))
    terms = F.least(low, F.ceil(ROOTS * F.sqrt(n.cast("double"))).cast("long") + MORE_TERMS)
    ks = F.when(terms > 0, F.sequence(F.lit(0).cast("long"), F.greatest(terms - 1, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    one, zero = F.lit(1.0), F.lit(0.0)
    start = F.struct(one.alias("term"), one.alias("total"), zero.alias("lost"), n.alias("n"), low.alias("low"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * (a["low"] - k) / (a["n"] - a["low"] + k + 1).cast("double")
        part = term - a["lost"]
        total = a["total"] + part
        return F.struct(term.alias("term"), total.alias("total"), ((total - a["total"]) - part).alias("lost"), a["n"].alias("n"), a["low"].alias("low"))

    tail = top * F.aggregate(ks, start, step, lambda a: a["total"])
    return F.when(n == 0, 1.0).when(2 * low == n, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(tests: DataFrame, p: str, tie: list[str]) -> DataFrame:
    """Adds p_adjusted: the running maximum of (m - rank) * p over p ascending. A row for each test, so one window holds them."""
    order = Window.orderBy(p, *tie)
    m = F.count("*").over(Window.partitionBy())
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    running = F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("scaled", scaled).withColumn("p_adjusted", running).drop("scaled")


def ranking(tasks: DataFrame, k: int) -> DataFrame:
    """Models by the mean of their modules' pass^k, best first; ties by name."""
    means = group_scores(tasks, "module", k).groupBy("model").agg(F.round(F.avg("pass_k"), 9).alias("mean"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "model")).cast("long"))


def pairs(tasks: DataFrame, k: int) -> DataFrame:
    """Every pair of models over the tasks they share: wins, losses, sign test, Holm, gap, adjacency.

    tasks is by_task(): a row per model and task. Fractions are compared as whole numbers. The join is on the task, so
    its rows are pairs of models per task.
    """
    ranks = F.broadcast(ranking(tasks, k).select("model", "rank", "mean"))  # a row for each model
    a = tasks.select("model", "task_id", "passes", "n").join(ranks, "model")
    left, right = (a.select("task_id", *[F.col(c).alias(f"{c}_{s}") for c in ("model", "rank", "mean", "passes", "n")]) for s in "ab")
    met = left.join(right, "task_id").filter("rank_a < rank_b")
    diff = F.col("passes_a") * F.col("n_b") - F.col("passes_b") * F.col("n_a")
    sums = met.groupBy("model_a", "model_b").agg(
        whole(diff > 0).alias("wins"), whole(diff < 0).alias("losses"), F.count("*").alias("shared"),
        F.max("rank_a").alias("rank_a"), F.max("rank_b").alias("rank_b"), (F.max("mean_a") - F.max("mean_b")).alias("gap"),
    )
    tested = sums.withColumn("discordant", F.col("wins") + F.col("losses")).withColumn("p", F.round(sign_test_p(F.col("wins"), F.col("losses")), 4))
    return holm(tested, "p", ["rank_a", "rank_b"]).select(
        "model_a", "model_b", "wins", "losses", "shared", "discordant", "gap", "p", "p_adjusted",
        ((F.col("discordant") > 0) & (F.col("p_adjusted") < 0.05)).alias("separable"), (F.col("rank_b") == F.col("rank_a") + 1).alias("adjacent"),
        F.when(F.col("gap") > 0, sample_size_paired(F.try_divide("discordant", "shared"), F.col("gap"))).alias("tasks_needed"),
    )


def sample_size_independent(p: Column, delta: Column) -> Column:
    """Tasks that two separate samples need to tell rates delta apart around p."""
    return F.ceil(2 * (Z_ALPHA + Z_BETA) ** 2 * p * (1 - p) / (delta * delta)).cast("long")


def sample_size_paired(discordant: Column, delta: Column) -> Column:
    """Tasks that a paired comparison needs, with a share of tasks on which the two differ."""
    return F.ceil((Z_ALPHA + Z_BETA) ** 2 * discordant / (delta * delta)).cast("long")


def fractions(tasks: DataFrame) -> DataFrame:
    return tasks.select("model", "task_id", "module", "band", "passes", "n", (F.col("passes") / F.col("n")).alias("frac"))


def band_legs(tasks: DataFrame, cohort: list[str]) -> DataFrame:
    """Along a declared cohort, weakest first: each step's gain, the gain from first to last, whether no step loses.

    A model that never ran a task leaves its steps null, and then nothing is known of the order.
    """
    wanted = [F.max(F.when(F.col("model") == m, F.col("frac"))).alias(f"f{i}") for i, m in enumerate(cohort)]
    wide = fractions(tasks).groupBy("task_id").agg(*wanted)
    legs = [F.round(F.col(f"f{i + 1}") - F.col(f"f{i}"), 4) for i in range(len(cohort) - 1)]
    known = F.exists("legs", lambda x: x.isNull())
    rungs = F.array(*[F.col(f"f{i}") for i in range(len(cohort))])
    held = F.filter(rungs, lambda x: x.isNotNull())
    return wide.select(
        "task_id", F.array(*legs).alias("legs"), F.round(F.col(f"f{len(cohort) - 1}") - F.col("f0"), 4).alias("band_discrimination"),
        ((F.size(held) > 0) & F.forall(held, lambda x: x == 1)).alias("all_pass"),
    ).withColumn("monotonic", F.when((F.size("legs") == 0) | known, None).otherwise(F.forall("legs", lambda x: x >= 0)))


def thirds(tasks: DataFrame, k: int) -> DataFrame:
    """Whether a model is of the fleet's top or bottom third, at least one model each."""
    order = ranking(tasks, k).withColumn("third", F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy()) / 3)))
    return order.withColumn("m", F.count("*").over(Window.partitionBy())).select(
        "model", (F.col("rank") <= F.col("third")).alias("top"), (F.col("rank") > F.col("m") - F.col("third")).alias("bottom"), F.col("m").alias("fleet")
    )


def items(tasks: DataFrame, cohort: list[str], k: int = 1) -> DataFrame:
    """Per task: mean pass rate, discrimination of the top against the bottom third, flaky models, cohort steps, class."""
    met = fractions(tasks).join(F.broadcast(thirds(tasks, k)), "model")  # a row for each model
    mean_of = lambda c: F.avg(F.when(F.col(c), F.col("frac")))
    stats = met.groupBy("task_id").agg(
        F.max("module").alias("module"), F.max_by("band", "model").alias("band"), F.avg("frac").alias("pass_rate"),
        (F.coalesce(mean_of("top"), F.lit(0.0)) - F.coalesce(mean_of("bottom"), F.lit(0.0))).alias("discrimination"),
        whole((F.col("frac") > 0) & (F.col("frac") < 1)).alias("flaky_models"), F.count("*").alias("n_models"),
    )
    return stats.join(band_legs(tasks, cohort), "task_id", "left").withColumn("class", classify())


def classify() -> Column:
    """The first that fits. Tasks that everyone passes, or no one, say nothing; restraint tasks can't be ranked by."""
    settled = (F.col("n_models") >= LEAST_MODELS) & (F.col("flaky_models") == 0)
    inverted = F.coalesce(~F.col("monotonic"), F.lit(False))
    return (
        F.when(settled & (F.col("pass_rate") >= 1), F.when(F.col("band") == "anchor", "anchor").otherwise("dead_easy"))
        .when(settled & (F.col("pass_rate") <= 0), "dead_hard")
        .when(F.col("task_id").isin(*RESTRAINT), "restraint")
        .when((F.col("band_discrimination") <= 0) & (F.col("band") != "anchor") & F.col("all_pass"), "floor_only")
        .when(F.col("discrimination") >= FLOOR, F.when(inverted, "inverted_leg").otherwise("discriminating"))
        .when(F.col("flaky_models") >= F.col("n_models") / 2, "flaky")
        .otherwise("weak")
    )


def model_stats(trials: DataFrame, k: int) -> DataFrame:
    """Per model: tasks with k attempts, those passed k times or more, the interval of that share, tasks left out."""
    tasks = by_task(trials)
    every = trials.groupBy("model").agg(F.count_distinct("task_id").alias("all_tasks"), F.avg(F.when(~F.col("infra_error"), F.col("det_score"))).alias("mean_soft"))
    able = tasks.filter(F.col("n") >= k).groupBy("model").agg(F.count("*").alias("n_tasks"), whole(F.col("passes") >= k).alias("passed"))
    met = every.join(able, "model", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_tasks", "passed")})
    low, high = wilson(F.col("passed"), F.col("n_tasks"))
    return met.select("model", "n_tasks", "passed", low.alias("low"), high.alias("high"), "mean_soft", (F.col("all_tasks") - F.col("n_tasks")).alias("excluded"))


def fleet_monotonicity(tasks: DataFrame, fleet: DataFrame, min_delta: float, k: int = 1) -> DataFrame:
    """Modules on which a smaller model of the fleet (model, pos) beats a larger one by more than min_delta."""
    scores = group_scores(tasks, "module", k).join(F.broadcast(fleet), "model")  # a row for each model
    small, large = (scores.select("module", F.col("model").alias(n), F.col("pos").alias(f"{n}_pos"), F.col("pass_k").alias(f"{n}_score")) for n in ("smaller", "larger"))
    met = small.join(large, "module").filter("smaller_pos < larger_pos")
    return met.withColumn("delta", F.col("smaller_score") - F.col("larger_score")).filter(F.col("delta") > min_delta).select("module", "smaller", "larger", "delta")


def probe_verdict(weak: Column, mid: Column, strong: Column, trials: Column, infra: Column, short: Column) -> Column:
    """What a trial of three models says of a candidate task: their pass fractions, in order of the rules."""
    gap = strong - weak
    need = F.when(trials <= 3, 2 / 3).otherwise(0.4)
    return (
        F.when(infra | short, "INVALID")
        .when(weak > strong, "REJECT:inverted")
        .when(strong < 2 / 3 - 1e-9, "REJECT:broken")
        .when((weak > mid) | (mid > strong), "REJECT:inverted")
        .when(weak >= 1, "REJECT:saturated")
        .when(gap <= 0, "REJECT:no_signal")
        .when((gap >= need - 1e-9) & (weak <= 1 - need + 1e-9), "ACCEPT")
        .otherwise("REPROBE")
    )


def forgetting(turns: DataFrame) -> DataFrame:
    """Per conversation: the first turn's fraction less the last's; 0 with fewer than two turns."""
    own = turns.groupBy("conv_id").agg(F.min_by("fraction", "turn").alias("a"), F.max_by("fraction", "turn").alias("z"), F.count("*").alias("n"))
    return own.select("conv_id", "n", F.when(F.col("n") < 2, 0.0).otherwise(F.col("a") - F.col("z")).alias("forgetting"))


def first_counted(trials: DataFrame, k: int) -> DataFrame:
    """The first k counted trials of each task, in order."""
    order = Window.partitionBy("model", "task_id").orderBy("trial_seq")
    return counted(trials).withColumn("ordinal", F.row_number().over(order).cast("long") - 1).filter(F.col("ordinal") < k)
