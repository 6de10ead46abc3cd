"""Rules over the turns of dialogues and the calls of episodes: accumulating constraints, repeats, final answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import CALL
from .aggregates import whole


def active_rules(rules: DataFrame, turns: DataFrame) -> DataFrame:
    """Which rules hold at which turn: from the turn that brings them until one that revokes them.

    rules: conv_id, rule, intro, revoked (turn or null). turns: conv_id, turn. A range join within a conversation.
    """
    met = turns.join(rules, "conv_id")
    return met.filter((F.col("intro") <= F.col("turn")) & (F.col("revoked").isNull() | (F.col("turn") < F.col("revoked")) | (F.col("revoked") <= F.col("intro"))))


def turn_fractions(checked: DataFrame) -> DataFrame:
    """Per turn the share of its active rules that hold (conv_id, turn, ok)."""
    return checked.groupBy("conv_id", "turn").agg((whole(F.col("ok")) / F.count("*")).alias("fraction"), F.count("*").alias("n_rules"))


def instruction_scores(fractions: DataFrame, expected_turns: DataFrame) -> DataFrame:
    """Per conversation the mean over its turns, a missing turn being 0; passed if all turns are."""
    met = expected_turns.join(fractions, ["conv_id", "turn"], "left").withColumn("f", F.coalesce("fraction", F.lit(0.0)))
    return met.groupBy("conv_id").agg(F.avg("f").alias("score"), (F.min("f") >= 0.999).alias("passed"))


def consecutive_repeats(calls: DataFrame) -> DataFrame:
    """Per episode: does a call equal the one before it, which did not fail? calls: episode, pos, name, argument, failed."""
    w = Window.partitionBy("episode").orderBy("pos")
    same = (F.lag("name").over(w) == F.col("name")) & F.lag("argument").over(w).eqNullSafe(F.col("argument")) & ~F.lag("failed").over(w)
    return calls.withColumn("same", F.coalesce(same, F.lit(False))).groupBy("episode").agg(F.max("same").alias("repeats"), F.count("*").alias("n_calls"))


def repeated_calls(calls: DataFrame) -> DataFrame:
    """Per episode the most often that one call was made."""
    return calls.groupBy("episode", "name", "argument").agg(F.count("*").alias("n")).groupBy("episode").agg(F.max("n").alias("most"))


def forbidden(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls to forbidden tools."""
    return calls.join(tools, "name", "left_semi")


def flat_calls(turns: Column) -> Column:
    """All calls of an episode's turns, in order; a turn without calls gives none."""
    none = F.array().cast(f"array<{CALL}>")
    return F.flatten(F.transform(turns, lambda t: F.coalesce(t["tool_calls"], none)))


def tool_results(turns: Column) -> Column:
    """What the tools answered, in the order of the calls; an answer may be null."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "tool"), lambda t: t["content"])


def closing_answer(turns: Column, truncated: Column) -> Column:
    """The model's last words, without its reasoning: empty where the answer was cut, or where it last called a tool instead of speaking."""
    calls = lambda t: F.coalesce(F.size(t["tool_calls"]) > 0, F.lit(False))
    spoke = lambda t: X.stripped(F.coalesce(t["content"], F.lit(""))) != ""
    last = F.try_element_at(F.filter(turns, lambda t: (t["role"] == "assistant") & (calls(t) | spoke(t))), F.lit(-1))
    return F.when(truncated | last.isNull() | calls(last), "").otherwise(X.strip_reasoning(last["content"]))


def final_answers(turns: DataFrame) -> DataFrame:
    """Per conversation the last assistant turn's text."""
    own = turns.filter("role = 'assistant'")
    return own.groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.count("*").alias("n_answers"))


def cut_evidence(turns: DataFrame) -> DataFrame:
    """Per conversation the last turn that was cut, and how many were (conv_id, turn, text, truncated)."""
    return turns.filter("truncated").groupBy("conv_id").agg(F.max("turn").alias("last_cut"), F.max_by("text", "turn").alias("text"), F.count("*").alias("cuts"))
