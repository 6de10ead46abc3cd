"""Predicates and selections over trials, runs and tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses and phrases of servers' errors.
TRANSIENT_STATUS = (429, 500, 502, 503, 504)
CONFIG_STATUS = (401, 403, 404)
OVERFLOW_PHRASES = ("context length", "context window", "maximum context", "context size", "too long", "n_ctx", "exceeds the model")
MALFORMED_PHRASES = ("failed to parse tool call", "tool call arguments as json", "parse error at line")


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | F.contains(F.lower(text), F.lit(p)), phrases, F.lit(False))


def error_class(status: Column, body: Column, kind: Column) -> Column:
    """What an error means: the model's own output, the prompt's length, a request that can't work, or a passing fault."""
    return (
        F.when((status == 500) & any_phrase(body, MALFORMED_PHRASES), "malformed_tool_call")
        .when(any_phrase(body, OVERFLOW_PHRASES), "context_overflow")
        .when(status.isin(*CONFIG_STATUS), "config")
        .when(status.isin(*TRANSIENT_STATUS) | kind.isin("timeout", "transport", "read_timeout"), "transient")
        .otherwise("other")
    )


def retryable(error: Column, kind: Column) -> Column:
    """A read timeout would only use up the same time again."""
    return (error == "transient") & (F.coalesce(kind, F.lit("")) != "read_timeout")


def timed_out(error: Column) -> Column:
    return F.coalesce(F.contains(F.substring_index(error, ":", 1), F.lit("Timeout")), F.lit(False))


def outcome(error: Column, det: Column) -> Column:
    return (
        F.when(error.isNotNull() & (error != ""), F.when(timed_out(error), "timed_out").otherwise("failed"))
        .when(det == 1.0, "passed").when(det >= 0.7, "partial").otherwise("failed")
    )


def is_dead(overflow: Column, error: Column, has_calls: Column, response: Column) -> Column:
    """Nothing came back, and not for want of context."""
    return ~overflow & (error.isNotNull() | (~has_calls & (F.trim(F.coalesce(response, F.lit(""))) == "")))


def select_tasks(tasks: DataFrame, modules: list[str] | None = None, substring: str | None = None, fast: bool = False) -> DataFrame:
    """By exact module and by a part of id or module. Modules that don't exist are an error, and so is an empty choice."""
    out = tasks
    if modules:
        known = {r["module"] for r in tasks.select("module").distinct().collect()}  # a row for each module
        if unknown := sorted(set(modules) - known):
            raise ValueError(f"unknown modules: {', '.join(unknown)}")
        out = out.filter(F.col("module").isin(*modules))
    if substring:
        out = out.filter(F.contains("id", F.lit(substring)) | F.contains("module", F.lit(substring)))
    out = out.filter("fast") if fast else out
    if out.isEmpty():
        raise ValueError("no task fits")
    return out


def oversized(tasks: DataFrame, served_context: int) -> DataFrame:
    """Tasks whose filler and answer don't fit the context, neediest first."""
    need = F.col("filler_tokens") + F.col("max_tokens")
    return tasks.withColumn("need", need).filter(F.col("need") > served_context).orderBy(F.desc("need"), "id")


def config_matches(model: str, thinking: bool | None, temperature: float | None, max_tokens: int, explicit: bool = False) -> Column:
    """Runs whose trials may be used again under these settings: budgets no larger than now's, and no looser per module."""
    warm = F.col("temperature")
    same = warm.isNull() if temperature is None else F.coalesce(F.abs(warm - temperature) < 1e-9, F.lit(False))
    guard = F.lit(True) if explicit else ~F.coalesce(F.col("max_tokens_override"), F.lit(False))
    return guard & (F.col("model") == model) & F.col("thinking").eqNullSafe(F.lit(thinking)) & same & F.coalesce(F.col("max_tokens") <= max_tokens, F.lit(False))


def stale_worlds(trials: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks whose stored trials ran against another tool world."""
    now = tasks.select("module", F.col("id").alias("task_id"), F.col("world_hash").alias("now"))
    met = trials.join(now, ["module", "task_id"])
    return met.filter((F.col("world_hash") != "") & ~F.col("world_hash").eqNullSafe(F.col("now"))).select("module", "task_id").distinct()


def keep_cohort(df: DataFrame, cohort: list[str]) -> DataFrame:
    return df.filter(F.col("model").isin(*cohort))
