"""Trials summed once: a row for each model, module and task with every sum that boards are made of.

A board asks a dozen things of the same trials. Asked of the trials, each is a scan of all of them; asked of the ledger, which is written
once, trials are read once (partial sums before the one exchange) and the rest reads as many rows as there are models and tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .aggregates import pass_hat_k, whole


def ledger(trials: DataFrame, detailed: bool = False) -> DataFrame:
    """Written sums by model, module and task; with detail also those of the judge, of times and of repairs.

    n, passes, det_passes and det are over trials that count (not infra_error); first is the first of these with its tier and band.
    """
    kept = ~F.col("infra_error")
    able = F.col("error").isNull() & (F.col("duration_seconds") > 0) & (F.col("completion_tokens") > 0)
    of = lambda c, x: F.when(c, F.col(x) if isinstance(x, str) else x)
    sums = [
        F.min(F.when(kept, F.struct("trial_seq", "tier", "band"))).alias("first"), F.count(of(kept, F.lit(1))).alias("n"),
        whole(of(kept, "success")).alias("passes"), whole(of(kept, "det_success")).alias("det_passes"), F.sum(of(kept, "det_score")).alias("det"), F.count(of(kept, "det_score")).alias("det_n"),
        F.sum(of(able, "completion_tokens")).alias("able_tokens"), F.sum(of(able, "duration_seconds")).alias("able_seconds"),
    ]
    if detailed:
        fine = F.col("error").isNull()
        sums += [F.sum(of(kept, "llm_score")).alias("llm"), F.count(of(kept, "llm_score")).alias("llm_n"), F.sum("duration_seconds").alias("seconds")]
        sums += [F.sum(of(fine, c)).alias(c) for c in ("prompt_tokens", "prefill_seconds", "completion_tokens", "generation_seconds")]
        sums += [whole(F.col("det_success")).alias("solved"), whole(F.col("det_success") & (F.col("attempts_used") == 1)).alias("one_shot")]
    return written(trials.groupBy("model", "module", "task_id").agg(*sums), "ledger")


def by_task(sums: DataFrame) -> DataFrame:
    """What aggregates.by_task() gives, from a ledger."""
    first = F.min_by(F.struct("module", "first.tier", "first.band"), "first.trial_seq").alias("f")
    total = [F.sum(c).alias(c) for c in ("n", "passes", "det_passes")]
    tasks = sums.filter("n > 0").groupBy("model", "task_id").agg(first, *total, F.try_divide(F.sum("det"), F.sum("det_n")).alias("mean_det"))
    return tasks.select("model", "task_id", "f.module", "f.tier", "f.band", "n", "passes", "det_passes", "mean_det")


def headlines(tasks: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Per model the weighted mean of its modules' pass^k, with the judge's verdicts (headline) and without (det_headline)."""
    score = lambda passes: F.coalesce(F.avg(pass_hat_k(passes, "n", k)), F.lit(0.0))
    modules = tasks.groupBy("model", "module").agg(score("passes").alias("s"), score("det_passes").alias("d")).join(F.broadcast(weights), "module")  # a row for each module
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("w")) / F.sum("w"), F.lit(0.0))
    return modules.groupBy("model").agg(mean("s").alias("headline"), mean("d").alias("det_headline"))


def lost(sums: DataFrame, k: int) -> DataFrame:
    """Per model: tasks without a counted trial, and tasks with some but fewer than k."""
    kept = sums.groupBy("model", "task_id").agg(F.sum("n").alias("kept"))
    return kept.groupBy("model").agg(whole(F.col("kept") == 0).alias("excluded"), whole((F.col("kept") > 0) & (F.col("kept") < k)).alias("short"))


def speed() -> F.Column:
    return F.try_divide(F.sum("able_tokens"), F.sum("able_seconds")).alias("tokens_per_second")


def modules(sums: DataFrame, skips: tuple[str, ...]) -> DataFrame:
    """Per model and module: mean scores over trials, how many trials count, and of those that the judge is asked about how many it scored."""
    asked = ~F.col("module").isin(*skips)
    return sums.filter("n > 0").groupBy("model", "module").agg(
        F.try_divide(F.sum("det"), F.sum("det_n")).alias("det"), F.try_divide(F.sum("llm"), F.sum("llm_n")).alias("llm"), F.sum("n").alias("n"),
        F.sum(F.when(asked, F.col("llm_n"))).alias("judged"), F.sum(F.when(asked, F.col("n"))).alias("total"),
    )
