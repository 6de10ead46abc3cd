"""What is read off a whole set of runs: the board in all its columns, items, models, pairs and comparisons, each in its order.

Every report starts from one aggregate by model and task, or by model and module; windows without a key see a row for each model,
pair or task of the bank. Positions are columns, so that an order outlives a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import aggregates as A
from . import board as B
from . import ledger as L
from . import stats as N

INVERSIONS, EVIDENCE, OVERSIZED = 12, 6, 8


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds a position in the given order, from 1."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def module_cells(trials: DataFrame, weights: DataFrame, skips: tuple[str, ...] = A.JUDGE_SKIPS) -> DataFrame:
    """Per model and weighted module: mean score and success without the judge, and what the judge changed.

    A model that the judge has seen shows deterministic success beside judged success; one that it hasn't seen shows what it has.
    Coverage is shown only where the judge left trials out.
    """
    tasks = A.by_task(trials)
    rate = lambda c: F.avg(F.col(c) / F.col("n"))
    success = tasks.groupBy("model", "module").agg(rate("passes").alias("judged"), rate("det_passes").alias("plain"))
    covered = A.judge_coverage(trials, skips).select("model", "module", F.col("judged").alias("verdicts"), "coverage")
    seen = covered.groupBy("model").agg((F.sum("verdicts") > 0).alias("has_judge"))
    met = A.module_means(trials).join(F.broadcast(weights), "module").join(success, ["model", "module"])
    met = met.join(covered, ["model", "module"], "left").join(F.broadcast(seen), "model", "left")  # a row for each model
    has = F.coalesce("has_judge", F.lit(False))
    told = has & F.col("llm").isNotNull()
    return met.select(
        "model", "module", F.col("det"), F.when(has, F.col("plain")).otherwise(F.col("judged")).alias("pass"),
        F.when(has & (F.col("coverage") < 1), F.col("coverage")).alias("judge_coverage"), F.col("llm"),
        (F.col("llm") - F.col("det")).alias("delta"), F.when(told, F.col("judged")).alias("judge_pass"),
    )


def board_rows(trials: DataFrame, weights: DataFrame, k: int, repair_module: str, skips: tuple[str, ...] = A.JUDGE_SKIPS) -> DataFrame:
    """A model's row beyond rank and tier: scores with and without the judge, coverage, speed, repairs, time and counts."""
    sums = L.ledger(trials, detailed=True)
    tasks = written(L.by_task(sums), "tasks")
    heads = L.headlines(tasks, weights, k).withColumnsRenamed({"headline": "judged_pass", "det_headline": "det_pass"})
    own = written(L.modules(sums, skips), "modules")
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    means = own.join(F.broadcast(weights), "module").groupBy("model").agg(  # a row for each module
        F.coalesce(mean(F.col("det")), F.lit(0.0)).alias("overall_det"), F.coalesce(mean(F.coalesce("llm", "det")), F.lit(0.0)).alias("overall_llm")
    )
    named = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("module")))), ",")
    gaps = own.groupBy("model").agg(
        F.sum("judged").alias("judged"), F.try_divide(F.sum("judged"), F.sum("total")).alias("coverage"), named(F.col("judged") == 0).alias("unjudged"),
        named((F.col("judged") > 0) & (F.col("judged") < F.col("total"))).alias("partial"),
    )
    rate = lambda n, s: F.when(F.sum(s) > 0, F.sum(n) / F.sum(s))
    repaired = lambda c: F.sum(F.when(F.col("module") == repair_module, F.col(c)))
    runs = sums.groupBy("model").agg(
        rate("prompt_tokens", "prefill_seconds").alias("prefill_rate"), rate("completion_tokens", "generation_seconds").alias("decode_rate"), L.speed(),
        F.try_divide(repaired("one_shot"), repaired("solved")).alias("first_try"), (F.sum("seconds") / 60).alias("trial_minutes"),
    )
    able = tasks.groupBy("model").agg(A.whole(F.col("n") >= k).alias("n_tasks"), F.count("*").alias("known"))
    met = heads
    for part in (means, gaps, runs, able):  # each has a row for each model
        met = met.join(part, "model", "left")
    has = F.coalesce(F.col("judged") > 0, F.lit(False))
    only = lambda c: F.when(has, F.col(c))
    headline = F.col("judged_pass")  # without a judge's verdicts these are the deterministic ones
    return met.select(
        "model", headline.alias("headline"), has.alias("headline_judged"), B.tier(F.round(headline, 6)).alias("tier"), F.when(has, F.col("det_pass")).otherwise(F.col("judged_pass")).alias("overall_pass"),
        only("judged_pass").alias("overall_judge_pass"), "overall_det", only("overall_llm").alias("overall_llm"), only("coverage").alias("judge_coverage"),
        F.when(has, F.col("coverage") >= 1).alias("judge_complete"), only("unjudged").alias("unjudged_modules"), only("partial").alias("partial_modules"), F.col("first_try").alias("first_try_rate"),
        "tokens_per_second", F.col("prefill_rate").alias("prefill_tok_s"), F.col("decode_rate").alias("gen_tok_s"), "n_tasks", (F.col("known") - F.col("n_tasks")).alias("tasks_excluded"), F.round("trial_minutes", 1).alias("trial_minutes"),
    )


def separable_count(pairs: DataFrame) -> DataFrame:
    """How many of all pairs of models the bank tells apart."""
    return pairs.agg(A.whole(F.coalesce("separable", F.lit(False))).alias("separable_pairs"), F.count("*").alias("total_pairs"))


def scorecard(trials: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Per model its modules in the weights' order (pos), and its overall row last (module 'overall', pos null)."""
    tasks = A.by_task(trials)
    own = A.group_scores(tasks, "module", k).join(A.module_means(trials), ["model", "module"]).join(F.broadcast(weights), "module")
    rows = own.select("model", "pos", "module", "n_tasks", "pass_k", "pass_1", "det", "llm", "n", "omitted")
    total = F.sum(F.col("pass_k") * F.col("w")) / F.sum("w")
    overall = own.groupBy("model").agg(
        F.sum("n_tasks").alias("n_tasks"), total.alias("pass_k"), (F.sum(F.col("pass_1") * F.col("w")) / F.sum("w")).alias("pass_1"), (F.sum(F.col("det") * F.col("w")) / F.sum("w")).alias("det"),
        (F.sum(F.coalesce("llm", "det") * F.col("w")) / F.sum("w")).alias("llm"), F.sum("n").alias("n"), F.sum("omitted").alias("omitted"),
    )
    return rows.unionByName(overall.withColumns({"module": F.lit("overall"), "pos": F.lit(None).cast("long")}))


def comparison(trials: DataFrame, weights: DataFrame, k: int, models: list[str]) -> DataFrame:
    """Modules by models: mean deterministic scores, and the headline as a last row; pos is the weights' order, null for the last."""
    named = trials.filter(F.col("model").isin(models))
    cells = A.module_means(named).join(F.broadcast(weights), "module").select("pos", "module", "model", F.col("det").alias("value"))
    total = A.headline(named, weights, k).select(F.lit(None).cast("long").alias("pos"), F.lit("overall").alias("module"), "model", F.col("headline").alias("value"))
    return cells.unionByName(total).groupBy("pos", "module").pivot("model", models).agg(F.first("value"))


def speed_comparison(trials: DataFrame, models: list[str]) -> DataFrame:
    """Modules (and __global__) by models: prefill and decode rates, and each later model's change over the first in percent."""
    rates = A.timings(trials.filter(F.col("model").isin(models))).select("model", "module", F.explode(F.create_map(F.lit("pp"), "prefill_rate", F.lit("tg"), "decode_rate")).alias("metric", "value"))
    wide = rates.groupBy("module", "metric").pivot("model", models).agg(F.first("value"))
    first = F.col(f"`{models[0]}`")
    change = lambda m: F.when((F.col(f"`{m}`") != 0) & (first != 0), (F.col(f"`{m}`") - first) / first * 100)
    return wide.withColumns({f"{m}_change": change(m) for m in models[1:]})


def item_report(trials: DataFrame, cohort: list[str], k: int) -> DataFrame:
    """Tasks, the best at telling models apart first: items() with the spread of mean scores, and mean seconds and tokens of all trials."""
    tasks = A.by_task(trials)
    spread = tasks.groupBy("task_id").agg(F.when(F.count("mean_det") >= 2, F.stddev_pop("mean_det")).otherwise(0.0).alias("soft_spread"))
    spent = A.counted(trials).groupBy("task_id").agg(F.avg("duration_seconds").alias("mean_duration"), F.avg("completion_tokens").alias("mean_completion_tokens"))
    rows = N.items(tasks, cohort, k).join(spread, "task_id").join(spent, "task_id", "left")
    rounded = rows.withColumns({
        "pass_rate": F.round("pass_rate", 4), "discrimination": F.round("discrimination", 4), "soft_spread": F.round("soft_spread", 4),
        "mean_duration": F.round("mean_duration", 2), "mean_completion_tokens": F.round("mean_completion_tokens", 1),
    })
    return placed(rounded, F.desc("discrimination"), "task_id")


def restraint_items(items: DataFrame) -> DataFrame:
    """Tasks of restraint by pass rate: they can't be ranked by, but are read."""
    return placed(items.filter("class = 'restraint'").drop("position"), "pass_rate", "task_id")


def model_report(trials: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Models by headline: the weighted headlines, and the plain share of tasks passed with its interval."""
    tasks = A.by_task(trials)
    able = tasks.filter(F.col("n") >= k).groupBy("model").agg(A.whole(F.col("det_passes") >= k).alias("det_tasks_passed"))
    scores = [A.weighted(A.group_scores(tasks, "module", k, p), weights).withColumnRenamed("headline", name) for p, name in (("passes", "headline"), ("det_passes", "det_headline"))]
    rows = N.model_stats(trials, k).join(able, "model", "left")
    for s in scores:
        rows = rows.join(s, "model", "left")
    rows = rows.select(
        "model", F.round(F.coalesce("headline", F.lit(0.0)), 6).alias("headline"), F.round(F.coalesce("det_headline", F.lit(0.0)), 6).alias("det_headline"), "n_tasks", "excluded",
        F.col("passed").alias("tasks_passed"), F.coalesce("det_tasks_passed", F.lit(0)).cast("long").alias("det_tasks_passed"),
        F.round(F.coalesce(F.try_divide("passed", "n_tasks"), F.lit(0.0)), 4).alias("pass_rate"), F.col("low").alias("ci_low"), F.col("high").alias("ci_high"),
        F.round((F.col("high") - F.col("low")) / 2, 4).alias("ci_margin"), F.round("mean_soft", 4).alias("mean_soft"),
    )
    return placed(rows, F.desc("headline"), "model")


def pair_report(pairs: DataFrame) -> DataFrame:
    """Pairs that stand side by side first, then by how surely they differ."""
    return placed(pairs, F.desc("adjacent"), "p_adjusted", "model_a", "model_b")


def inversions(found: DataFrame, most: int = INVERSIONS) -> DataFrame:
    """The largest cases of a smaller model beating a larger one."""
    return placed(found.orderBy(F.desc("delta"), "module", "smaller", "larger").limit(most), F.desc("delta"), "module", "smaller", "larger")


def cut_evidence(rows: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """Per model the tasks that lost most trials to cut answers (model, task_id, cut)."""
    best = Window.partitionBy("model").orderBy(F.desc("cut"), "task_id")
    return rows.filter("cut > 0").withColumn("position", F.row_number().over(best).cast("long")).filter(F.col("position") <= most)


def oversized_shown(rows: DataFrame, most: int = OVERSIZED) -> DataFrame:
    """The tasks that need the most context (task_id, needs)."""
    return placed(rows.orderBy(F.desc("needs"), "task_id").limit(most), F.desc("needs"), "task_id")


def fleet_order(registry: DataFrame, present: DataFrame) -> DataFrame:
    """Registered models that have runs, small to large by what is active; variants of another model's weights are left out."""
    size = F.coalesce("active_b", "params_b")
    known = registry.filter(size.isNotNull()) if "variant_of" not in registry.columns else registry.filter(size.isNotNull() & F.coalesce(F.col("variant_of") == "", F.lit(True)))
    met = known.join(present.select("model").distinct(), "model", "left_semi").select("model", size.alias("size_b"))
    return placed(met, "size_b", "model").select((F.col("position") - 1).alias("pos"), "model", "size_b")


def verdict_batches(trials: DataFrame, size: int, skips: tuple[str, ...] = A.JUDGE_SKIPS) -> DataFrame:
    """Trials that a judge is to be asked about, as batches of at most `size` within a module: model, module, batch, trial_ids.

    Asked are counted trials of judged modules without a verdict; numbering is within a model and module.
    """
    asked = A.counted(trials).filter(~F.col("module").isin(*skips) & F.col("llm_score").isNull())
    no = F.row_number().over(Window.partitionBy("model", "module").orderBy("trial_id")) - 1
    dealt = asked.withColumn("batch", F.floor(no / size).cast("long"))
    return dealt.groupBy("model", "module", "batch").agg(F.array_sort(F.collect_list("trial_id")).alias("trial_ids"))


def status_report(rescored: DataFrame) -> DataFrame:
    """What became of re-scored trials: how many of each status, and how many of them moved."""
    return rescored.groupBy("status").agg(F.count("*").alias("n"), A.whole(F.coalesce("moved", F.lit(False))).alias("moved"))


def diverged(trials: DataFrame) -> DataFrame:
    """Per model and module, trials whose verdict the judge turned, either way."""
    turned = F.col("success") != F.col("det_success")
    return A.counted(trials).groupBy("model", "module").agg(
        F.count("*").alias("n"), A.whole(turned & F.col("success")).alias("rescued"), A.whole(turned & ~F.col("success")).alias("demoted")
    )


def trials_target(runs: DataFrame, add: int) -> DataFrame:
    """How many attempts a run aims at when some are to be added to what it had."""
    return runs.withColumn("target", F.coalesce("trials", F.lit(0)) + F.lit(add))


def recovered_union(previous: DataFrame, recovered: DataFrame) -> DataFrame:
    """What a run had and what an interrupted session left behind; a trial that is in both counts once, as recovered."""
    key = ["model", "task_id", "trial_seq"]
    return previous.join(recovered.select(*key), key, "left_anti").unionByName(recovered, allowMissingColumns=True)


def utc_stamp(at: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC, whatever the session's zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def infer_tier(module: Column, given: Column, axis: Column, repairs: Column) -> Column:
    """A task's tier where its author gave none: single calls, plain code, forms and facts are baseline, the rest is hard."""
    plain = module.isin("format", "knowledge") | ((module == "tools") & F.coalesce(axis == "call", F.lit(False))) | ((module == "code") & ~F.coalesce(repairs, F.lit(False)))
    return F.coalesce(given, F.when(plain, "baseline").otherwise("hard"))


def shown(value: Column, places: int = 3, percent: bool = False, signed: bool = False) -> Column:
    """A number as a cell, rounded half up from its shortest decimal form; a dash where there is none."""
    text = F.format_string(f"%{'+' if signed else ''}.{places}f{'%%' if percent else ''}", value.cast("double"))
    return F.when(value.isNull(), "—").otherwise(text)
