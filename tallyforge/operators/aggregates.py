"""Aggregations over trials: per task, module, tier, band, axis and difficulty; pass^k; headlines; speed; coverage.

Trials are first brought to one row per model and task, which is what everything else shares. Rows that the model is not to
blame for (infra_error) don't count, except where noted. Order matters where noted, by trial_seq.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of the capability bands and of the hard tier in their headlines.
BAND_WEIGHTS = {"anchor": 0.10, "mid": 0.30, "hard": 0.40, "frontier": 0.20}
HARD_WEIGHT = 0.66
#: Modules that the judge is not asked about.
JUDGE_SKIPS = ("format", "knowledge")

# What share of the headline each module has, by preset.
MODULE_WEIGHTS = {
    "balanced": {"tools": 0.30, "format": 0.15, "code": 0.15, "multi_turn_if": 0.13, "long_context": 0.12, "adversarial": 0.08, "knowledge": 0.07},
    "agentic": {"tools": 0.38, "multi_turn_if": 0.16, "long_context": 0.12, "format": 0.12, "code": 0.08, "adversarial": 0.08, "knowledge": 0.06},
    "coding": {"code": 0.21, "tools": 0.28, "format": 0.15, "long_context": 0.12, "multi_turn_if": 0.11, "adversarial": 0.07, "knowledge": 0.06},
}
#: The modules in the order in which they are run and told.
MODULES = ("tools", "code", "knowledge", "format", "long_context", "multi_turn_if", "adversarial")


def module_place(module: Column) -> Column:
    """A module's place in that order, from 0; modules that it doesn't name come after it, and are ordered by name."""
    place = F.array_position(F.array(*[F.lit(m) for m in MODULES]), module)
    return F.when(place > 0, place - 1).otherwise(len(MODULES)).cast("long")


def whole(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def counted(trials: DataFrame) -> DataFrame:
    return trials.filter(~F.col("infra_error"))


def by_task(trials: DataFrame) -> DataFrame:
    """Counted trials per model and task; module, tier and band are those of the first trial."""
    return counted(trials).groupBy("model", "task_id").agg(
        F.min_by("module", "trial_seq").alias("module"), F.min_by("tier", "trial_seq").alias("tier"), F.min_by("band", "trial_seq").alias("band"),
        F.count("*").alias("n"), whole(F.col("success")).alias("passes"), whole(F.col("det_success")).alias("det_passes"), F.avg("det_score").alias("mean_det"),
    )


def pass_hat_k(passes: str | Column, n: str | Column, k: int) -> Column:
    """The chance that k attempts drawn from n all pass: C(passes, k) / C(n, k), null with fewer than k attempts.

    Falling factorials: exact for any n, where factorials overflow.
    """
    c, n = (F.col(x) if isinstance(x, str) else x for x in (passes, n))
    top = reduce(lambda a, i: a * F.greatest(c - i, F.lit(0)).cast("double"), range(1, k), F.greatest(c, F.lit(0)).cast("double"))
    low = reduce(lambda a, i: a * (n - i).cast("double"), range(1, k), n.cast("double"))
    return F.when(n >= k, top / low)


def group_scores(tasks: DataFrame, by: str, k: int, passes: str = "passes") -> DataFrame:
    """Per model and group: how many tasks, pass^k and pass^1. A group whose tasks all have too few attempts scores 0."""
    return tasks.groupBy("model", by).agg(
        F.count("*").alias("n_tasks"),
        F.coalesce(F.avg(pass_hat_k(passes, "n", k)), F.lit(0.0)).alias("pass_k"),
        F.coalesce(F.avg(pass_hat_k(passes, "n", 1)), F.lit(0.0)).alias("pass_1"),
    )


def weighted(scores: DataFrame, weights: DataFrame, by: str = "module", score: str = "pass_k") -> DataFrame:
    """Per model the weighted mean of its groups' scores, over the groups it has. weights: a row for each group, (by, w)."""
    met = scores.join(F.broadcast(weights), by)
    total = F.sum(F.col(score) * F.col("w")) / F.sum("w")
    return met.groupBy("model").agg(F.coalesce(total, F.lit(0.0)).alias("headline"))


def band_headline(tasks: DataFrame, k: int) -> DataFrame:
    w = reduce(lambda a, x: F.when(F.col("band") == x[0], x[1]).otherwise(a), BAND_WEIGHTS.items(), F.lit(0.0))
    scores = group_scores(tasks, "band", k).withColumn("w", w)
    return scores.groupBy("model").agg(F.coalesce(F.try_divide(F.sum(F.col("pass_k") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("headline"))


def tier_headline(tasks: DataFrame, k: int) -> DataFrame:
    """The tiers' weighted mean, or the one that a model has."""
    of = lambda t: F.max(F.when(F.col("tier") == t, F.col("pass_k")))
    both = group_scores(tasks, "tier", k).groupBy("model").agg(of("baseline").alias("b"), of("hard").alias("h"))
    mixed = (1 - HARD_WEIGHT) * F.col("b") + HARD_WEIGHT * F.col("h")
    return both.select("model", F.coalesce(mixed, "h", "b", F.lit(0.0)).alias("headline"))


def headline(trials: DataFrame, weights: DataFrame, k: int, scheme: str = "module", judged: bool = True) -> DataFrame:
    tasks = by_task(trials)
    if not judged:
        tasks = tasks.withColumn("passes", F.col("det_passes"))
    if scheme == "module":
        return weighted(group_scores(tasks, "module", k), weights)
    return {"band": band_headline, "legacy": tier_headline}[scheme](tasks, k)


def k_curve(trials: DataFrame, by: str, most: int) -> DataFrame:
    """pass^k for k from 1 to most, one row for each k."""
    tasks = by_task(trials)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), pass_hat_k("passes", "n", k).alias("p")) for k in range(1, most + 1)]))
    rows = tasks.select("model", by, pairs.alias("x")).select("model", by, "x.k", "x.p")
    return rows.groupBy("model", by, "k").agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("pass_k"))


def module_means(trials: DataFrame) -> DataFrame:
    """Over trials: mean deterministic and judge score, and how many trials of a judged module the judge left out."""
    judged = F.count("llm_score")
    return counted(trials).groupBy("model", "module").agg(
        F.avg("det_score").alias("det"), F.avg("llm_score").alias("llm"), F.count("*").alias("n"),
        F.when(judged > 0, F.count("*") - judged).otherwise(0).cast("long").alias("omitted"),
    )


def overall(trials: DataFrame, weights: DataFrame, key: str = "llm") -> DataFrame:
    """The weighted mean of modules' mean scores; a module that the judge never scored has its deterministic mean."""
    score = F.coalesce("llm", "det") if key == "llm" else F.col("det")
    return weighted(module_means(trials).withColumn("pass_k", score), weights).withColumnRenamed("headline", "overall")


def module_success(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("model", "module").agg(F.avg(F.col("passes") / F.col("n")).alias("success"))


def axis_breakdown(trials: DataFrame) -> DataFrame:
    """Per module and axis; a task's axis is the last that its trials name. Trials' scores are averaged over trials."""
    named = F.when(F.col("axis") != "", F.col("axis"))
    tasks = counted(trials).groupBy("model", "task_id").agg(
        F.max_by("module", "trial_seq").alias("module"), F.max_by(named, F.when(named.isNotNull(), F.col("trial_seq"))).alias("axis"),
        F.avg(F.col("success").cast("double")).alias("rate"), F.sum("det_score").alias("det"), F.count("*").alias("n"),
    )
    return tasks.filter("axis is not null").groupBy("model", F.concat_ws("/", "module", "axis").alias("axis")).agg(
        F.avg("rate").alias("pass_rate"), (F.sum("det") / F.sum("n")).alias("mean_det"), F.count("*").alias("n_tasks")
    )


def difficulty_scores(trials: DataFrame) -> DataFrame:
    """A task has the difficulty of its last trial; tasks count alike."""
    tasks = counted(trials).groupBy("model", "task_id").agg(F.max_by("difficulty", "trial_seq").alias("difficulty"), F.avg("det_score").alias("det"))
    return tasks.groupBy("model", "difficulty").agg(F.count("*").alias("n_tasks"), F.avg("det").alias("mean_det"))


def speed(trials: DataFrame) -> DataFrame:
    """Tokens a second per module and for the whole run (module __global__), from trials that ended and made tokens."""
    able = trials.filter("error is null and duration_seconds > 0 and completion_tokens > 0")
    sums = able.rollup("model", "module").agg(F.grouping("module").alias("g"), F.sum("completion_tokens").alias("tokens"), F.sum("duration_seconds").alias("s"))
    return sums.filter("model is not null").select(
        "model", F.when(F.col("g") == 1, "__global__").otherwise(F.col("module")).alias("module"), "tokens", (F.col("tokens") / F.col("s")).alias("tokens_per_second")
    )


def timings(trials: DataFrame) -> DataFrame:
    """Prefill and decode rates, null where no time was taken, the tokens behind them, and the share read from cache."""
    rate = lambda n, s: F.when(F.sum(s) > 0, F.sum(n) / F.sum(s))
    sums = trials.filter("error is null").rollup("model", "module").agg(
        F.grouping("module").alias("g"), rate("prompt_tokens", "prefill_seconds").alias("prefill_rate"), rate("completion_tokens", "generation_seconds").alias("decode_rate"),
        F.sum("prefill_seconds").alias("prefill_seconds"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("cached_prompt_tokens").alias("cached_tokens"),
        timing_source().alias("source"),
    )
    named = sums.filter("model is not null").withColumn("module", F.when(F.col("g") == 1, "__global__").otherwise(F.col("module")))
    return named.drop("g").withColumn("cache_share", F.try_divide("cached_tokens", F.col("prompt_tokens") + F.col("cached_tokens")))


def timing_source() -> Column:
    """The one source that names itself, 'mixed' for several, '' for none."""
    own = F.when(F.col("timing_source") != "", F.col("timing_source"))
    return F.when(F.count_distinct(own) > 1, "mixed").otherwise(F.coalesce(F.max(own), F.lit("")))


def recovery(trials: DataFrame, module: str) -> DataFrame:
    """Solved trials of a module with repair attempts: at once, or after being told what failed."""
    solved = trials.filter((F.col("module") == module) & F.col("det_success"))
    return solved.groupBy("model").agg(F.count("*").alias("solved"), whole(F.col("attempts_used") == 1).alias("one_shot"), whole(F.col("attempts_used") > 1).alias("recovered"))


def structured_call_rate(trials: DataFrame) -> DataFrame:
    """Of trials that say how calls were made, how many made them as calls."""
    return trials.filter("tool_mechanism is not null").groupBy("model").agg(whole(F.col("tool_mechanism")).alias("structured"), F.count("*").alias("total"))


def coverage(trials: DataFrame) -> DataFrame:
    """Per model and module: trials, and those lost to infrastructure or cut off."""
    is_class = lambda c: F.col("truncation_class") == c
    return trials.groupBy("model", "module").agg(
        F.count("*").alias("n_trials"), whole(F.col("infra_error")).alias("infra"), whole(is_class("incomplete")).alias("incomplete"),
        whole(is_class("incomplete") & ~F.col("success")).alias("incomplete_failed"), whole(is_class("degenerate")).alias("degenerate"),
    )


def task_coverage(trials: DataFrame, k: int) -> DataFrame:
    """Per model: tasks without a counted trial, and tasks with some but fewer than k."""
    kept = trials.groupBy("model", "task_id").agg(whole(~F.col("infra_error")).alias("kept"))
    return kept.groupBy("model").agg(
        F.count("*").alias("tasks"), whole(F.col("kept") == 0).alias("excluded"), whole((F.col("kept") > 0) & (F.col("kept") < k)).alias("short")
    )


def judge_coverage(trials: DataFrame, skips: tuple[str, ...] = JUDGE_SKIPS) -> DataFrame:
    """Per model and module that is judged: trials, those with a verdict, their share."""
    asked = counted(trials).filter(~F.col("module").isin(*skips))
    return asked.groupBy("model", "module").agg(F.count("llm_score").alias("judged"), F.count("*").alias("total"), (F.count("llm_score") / F.count("*")).alias("coverage"))


def judge_gaps(trials: DataFrame, skips: tuple[str, ...] = JUDGE_SKIPS) -> DataFrame:
    """Per model the modules that the judge left out wholly or in part, sorted."""
    each = judge_coverage(trials, skips)
    named = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("module")))), ",")
    return each.groupBy("model").agg(
        F.sum("judged").alias("judged"), F.sum("total").alias("total"), named(F.col("judged") == 0).alias("unjudged"),
        named((F.col("judged") > 0) & (F.col("judged") < F.col("total"))).alias("partial"),
    )


def observed_trials(trials: DataFrame, requested: int) -> DataFrame:
    """The attempts that most of a model's tasks have (of ties the most), at least 1 and at most `requested`."""
    per_task = trials.groupBy("model", "module", "task_id").agg(F.count("*").alias("n"))
    modes = per_task.groupBy("model", "n").agg(F.count("*").alias("tasks")).groupBy("model").agg(F.max_by("n", F.struct("tasks", "n")).alias("mode"))
    return modes.select("model", F.greatest(F.lit(1), F.least(F.lit(requested), F.col("mode"))).cast("long").alias("trials"))


def modal_settings(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Each setting's most frequent value over runs, as text; of ties the greatest. Nulls are values."""
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("value")) for f in fields])).alias("x")).select("x.*")
    return long.groupBy("field", "value").agg(F.count("*").alias("n")).groupBy("field").agg(F.max_by("value", F.struct("n", "value")).alias("modal"), F.sum("n").alias("runs"))


def comparability(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Per model the settings, in order, in which it differs from most runs; nothing to say about fewer than two runs."""
    values = [F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("value")) for i, f in enumerate(fields)]
    long = runs.select("model", F.explode(F.array(*values)).alias("x")).select("model", "x.*")
    met = long.join(F.broadcast(modal_settings(runs, fields)), "field")  # a row for each field
    off = F.collect_list(F.when(F.col("value") != F.col("modal"), F.struct("i", "field")))
    mismatches = F.array_join(F.transform(F.array_sort(off), lambda x: x["field"]), ",")
    return met.groupBy("model").agg(F.when(F.max("runs") < 2, "").otherwise(mismatches).alias("mismatch"))


def cost(trials: DataFrame) -> DataFrame:
    """Per task over all models: mean seconds and tokens a trial, and the spread of models' mean scores."""
    per = counted(trials).groupBy("task_id", "model").agg(F.avg("duration_seconds").alias("s"), F.avg("completion_tokens").alias("t"), F.avg("det_score").alias("det"))
    return per.groupBy("task_id").agg(
        F.avg("s").alias("seconds"), F.avg("t").alias("tokens"), F.when(F.count("*") >= 2, F.stddev_pop("det")).otherwise(0.0).alias("soft_spread")
    )


def minutes(trials: DataFrame) -> DataFrame:
    """Minutes a model's run took, and its mean score over counted trials."""
    whole_run = trials.groupBy("model").agg((F.sum("duration_seconds") / 60).alias("minutes"))
    return whole_run.join(counted(trials).groupBy("model").agg(F.avg("det_score").alias("mean_soft")), "model", "left")


def distinct_tasks(trials: DataFrame) -> DataFrame:
    return trials.groupBy("model").agg(F.count_distinct("module", "task_id").alias("n_tasks"))


def pivot_modules(trials: DataFrame, models: list[str]) -> DataFrame:
    """Modules by models: mean task success, for the models that are listed."""
    return module_success(by_task(trials)).groupBy("module").pivot("model", models).agg(F.first("success"))
