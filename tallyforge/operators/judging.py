"""Judge verdicts: when a judge's score may change a trial's outcome, and the merging of verdicts into trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, RESCUE, RAISED, ECHO, STALE = 0.85, 0.95, 1e-6, 0.02, 1e-9
SKIPPED = ("format", "knowledge")
DISPLAY_ONLY = ("adversarial", "code", "long_context")


def anchor_is_stale(anchor: Column, det: Column) -> Column:
    return F.coalesce(F.abs(anchor - det) > STALE, F.lit(False))


def hard_gate(forbidden: Column, budget: Column, loop: Column, stop: Column, truncation: Column) -> Column:
    """The first gate that a trial fails, or null. budget, loop and stop are null where the scorer had no such measure."""
    return (
        F.when(F.coalesce(forbidden, F.lit(False)), "used_forbidden_tool")
        .when(~F.coalesce(budget, F.lit(True)), "within_budget")
        .when(~F.coalesce(loop, F.lit(True)), "no_loop_detected")
        .when(~F.coalesce(stop, F.lit(True)), "no_premature_stop")
        .when(truncation == "degenerate", "degenerate")
    )


def is_rescue(llm: Column, det: Column) -> Column:
    """A failure becomes a pass only if the judge raised the score, and close to full marks."""
    return (llm >= RESCUE) & ((llm > det + RAISED) | (llm >= 1.0))


def is_demotion(llm: Column, det: Column) -> Column:
    """A score that merely echoes the deterministic one is no demotion."""
    return llm < det - ECHO


def apply_verdicts(trials: DataFrame, gate: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """success after the judge, and what blocked a rescue. Frozen: det_success. Without a score nothing changes."""
    llm, det, passed = F.col("llm_score"), F.col("det_score"), F.col("det_success")
    gate = gate if gate is not None else F.lit(None).cast("string")
    stale = anchor_is_stale(anchor, det) if anchor is not None else F.lit(False)
    rescue = ~passed & (llm >= PASS) & is_rescue(llm, det)
    blocked = F.when(rescue & gate.isNotNull(), gate).when(rescue & stale, "stale_anchor")
    merged = (
        F.when(llm.isNull() | F.col("module").isin(*SKIPPED, *DISPLAY_ONLY), passed)
        .when(passed, ~((llm < PASS) & is_demotion(llm, det)) | F.coalesce(stale, F.lit(False)))
        .otherwise(rescue & blocked.isNull())
    )
    asked = llm.isNotNull() & ~F.col("module").isin(*SKIPPED, *DISPLAY_ONLY)
    return trials.withColumn("judged_success", merged).withColumn("judge_blocked_by", F.when(asked, blocked))


def parse_entries(batches: DataFrame) -> DataFrame:
    """Verdicts from a judge's raw reply (batch_id, reply): the objects that parse, scores within 0 and 1, last of an id."""
    objects = F.posexplode(F.regexp_extract_all("reply", F.lit(r"\{[^{}]*\}"), 0)).alias("pos", "object")
    parsed = batches.select("batch_id", objects).withColumn("v", F.from_json("object", "id string, score double, reasoning string"))
    named = parsed.filter("v.id IS NOT NULL AND v.score IS NOT NULL")
    last = named.groupBy("batch_id", F.col("v.id").alias("id")).agg(F.max_by("v.score", "pos").alias("score"), F.max_by("v.reasoning", "pos").alias("reasoning"))
    return last.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))


def merge(trials: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Trials with their verdict by uid (task#ordinal within model); those without one keep null."""
    return trials.join(verdicts.select("model", "uid", F.col("score").alias("llm_score"), F.col("reasoning").alias("llm_reasoning")), ["model", "uid"], "left")


def asked(trials: DataFrame, skips: tuple[str, ...] = SKIPPED, only: DataFrame | None = None) -> DataFrame:
    """Trials that a judge is asked about: those of judged modules, and of these only some tasks' (module, task_id) where only is given."""
    due = trials.filter(~F.col("module").isin(*skips))
    return due if only is None else due.join(only.select("module", "task_id"), ["module", "task_id"], "left_semi")


def second_pass(due: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of the trials that a judge was asked about (model, module, uid), all of those modules for which it gave no verdict at all.

    One failed call leaves a whole module without verdicts, and would drop it from the judged score unseen. Which modules have one is told
    by partial counts, so a module's trials never meet in one task. A verdict without a score is none.
    """
    scored = verdicts.filter("score IS NOT NULL").select("model", "uid").distinct().withColumn("scored", F.lit(True))
    per_module = due.join(scored, ["model", "uid"], "left").groupBy("model", "module").agg(F.count("scored").alias("n"))
    return due.join(per_module.filter("n = 0").select("model", "module"), ["model", "module"], "left_semi")


def to_retry(trials: DataFrame, verdicts: DataFrame) -> DataFrame:
    return trials.join(verdicts, ["model", "uid"], "left_anti")
