"""Queries over stored trials under a changed bank, with their SQL: documents are the answers, and what was stored with them follows from their ids."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import grading as G
from ..operators import maintain as M
from ..sources import lake as L
from ..sources.scratch import place
from . import fixtures as X
from . import grades
from .registry import entry

EXTRACT = json.dumps({"extracted": {"odd": 1}})
OVERRIDES = json.dumps({"look": {"error_message": "down"}})
DUE = [("hard", "baseline", "anchor"), ("hard", "hard", "mid"), ("medium", "hard", "hard"), ("easy", "hard", "frontier"), ("easy", "baseline", "mid")]


def bank(spark):
    """Five tasks: the four of the graded bank and an extraction; the second injects errors, the third has a system prompt, the fourth tools."""
    rows = [(i, m, k, a, [json.dumps(c) for c in cs], "{}") for i, m, k, a, cs in grades.BANK] + [("t4", "data_extract", None, None, [], EXTRACT)]
    more = [("now", "now", "s" if n == 2 else None, ["look", "book"] if n == 3 else None, OVERRIDES if n == 1 else None, *DUE[n]) for n in range(5)]
    ddl = "task_id string, module string, answer_type string, answer string, constraints array<string>, expected string, task_hash string, prompt string, system_prompt string, tools array<string>, tool_overrides string, difficulty string, tier string, band string"
    return spark.createDataFrame([a + b for a, b in zip(rows, more, strict=True)], ddl)


def stored(spark, sf_dir):
    a, d = X.answers(spark, sf_dir), F.col("doc_id")
    n = d % 5
    schema = lambda name: F.lit(json.dumps({"function": {"name": name}}))
    results = F.when(d % 17 == 0, F.lit(json.dumps(['{"error": "broken"}']))).when(d % 17 == 1, F.lit(json.dumps(['{"error": "unknown tool z"}', '{"error": " down "}'])))
    return a.select(
        d.alias("trial_id"), F.when(d % 29 == 0, "t9").otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("task_id"),
        F.when(n < 2, "knowledge").when(n == 2, "format").when(n == 3, "long_context").otherwise("data_extract").alias("module"),
        F.when(n == 4, F.concat(F.lit('{"odd": '), (F.col("n_chars") % 2).cast("string"), F.lit("}"))).otherwise(F.col("answer")).alias("text"),
        (d % 19 == 0).alias("truncated"), F.when(d % 23 == 0, "boom").alias("error"), (d % 2).cast("int").alias("n_turns"),
        F.when(d % 6 == 0, "").when(d % 6 == 1, "now").otherwise("old").alias("task_hash"), F.when(d % 7 == 0, "before").when(d % 7 == 1, "").otherwise("now").alias("prompt"),
        F.when(d % 11 != 0, "s").alias("system_prompt"),
        F.when((n == 3) & (d % 13 == 0), F.array(schema("book"))).when((n == 3) & (d % 13 > 1), F.array(schema("book"), schema("look"), schema("look"))).alias("tools_schema"),
        results.alias("results"), F.lit("none").alias("difficulty"), F.lit("none").alias("tier"), F.lit("none").alias("band"), F.lit("{}").alias("expected"),
        F.when(d % 3 == 0, 0.0).otherwise(1.0).alias("det_score"), (d % 3 != 0).alias("det_success"), (d % 3 != 0).alias("success"), (d % 6 == 0).alias("infra_error"), F.lit("").alias("truncation_class"),
        F.when(d % 9 == 0, 0.0).when(d % 9 == 1, 1.0).alias("judge_anchor_det"), F.lit(None).cast("string").alias("judge_blocked_by"), F.when(d % 4 == 0, 0.97).when(d % 4 == 1, 0.3).alias("llm_score"),
    )


def due_sql(i: int) -> str:
    return "CASE k " + " ".join(f"WHEN {n} THEN '{d[i]}'" for n, d in enumerate(DUE)) + " END"


SQL = f"""WITH {X.ANSWERS_SQL}, {grades.FRAC.replace("doc_id % 4", "doc_id % 5")}, sc AS (
  SELECT f.doc_id, CASE WHEN f.doc_id % 19 = 0 THEN 0 ELSE {grades.SCORE.replace("doc_id % 4", "doc_id % 5").replace("ELSE round", "WHEN 4 THEN CAST(a.n_chars % 2 AS DOUBLE) ELSE round")} END AS s
  FROM fr f JOIN answers a ON a.doc_id = f.doc_id
), st AS (
  SELECT doc_id AS d, doc_id % 5 AS k, s, doc_id % 6 > 1 AS changed, CASE WHEN doc_id % 23 = 0 THEN 'boom' END AS error, CASE WHEN doc_id % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE 1 END AS was, doc_id % 3 <> 0 AS passed_before,
    CASE doc_id % 9 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN 1 END AS anchor, CASE doc_id % 4 WHEN 0 THEN CAST(0.97 AS DOUBLE) WHEN 1 THEN 0.3 END AS llm,
    doc_id % 7 = 0 OR (doc_id % 5 = 2 AND doc_id % 11 = 0) OR (doc_id % 5 = 3 AND doc_id % 13 = 0) OR (doc_id % 5 = 1 AND doc_id % 17 = 0) AS other FROM sc
), q AS (
  SELECT *, CASE WHEN d % 29 = 0 THEN 'unknown' WHEN error IS NOT NULL AND d % 2 = 0 THEN 'error_no_turns' WHEN changed AND other THEN 'drifted' ELSE 'rescored' END AS status FROM st
), m AS (
  SELECT *, status = 'rescored' AS fresh, status = 'rescored' AND (abs(s - was) > 1e-9 OR (s >= 0.999) <> passed_before) AS moved FROM q
), j AS (
  SELECT *, CASE WHEN fresh AND moved AND llm IS NOT NULL AND anchor IS NULL THEN was ELSE anchor END AS anchored FROM m
), v AS (
  SELECT *, coalesce(abs(anchored - s) > 1e-9, false) AS stale, CASE WHEN fresh THEN s ELSE was END AS det, CASE WHEN fresh THEN s >= 0.999 ELSE passed_before END AS det_ok FROM j
), z AS (
  SELECT *, CASE WHEN NOT fresh THEN passed_before WHEN k <> 4 OR llm IS NULL THEN det_ok WHEN det_ok THEN NOT (llm < 0.85 AND llm < s - 0.02) OR stale ELSE llm >= 0.95 AND NOT stale END AS ok FROM v
)"""


@entry(f"""{SQL} SELECT d AS trial_id, status, d % 29 <> 0 AND changed AND other AS drift, fresh AND changed AND NOT other AS regraded_only, moved, fresh AND llm IS NOT NULL AND stale AS stale_judge,
CASE WHEN fresh AND ok AND NOT passed_before THEN 'pass' WHEN fresh AND NOT ok AND passed_before THEN 'fail' END AS flipped, CASE WHEN fresh AND d % 6 <> 0 THEN 'now' WHEN d % 6 = 0 THEN '' WHEN d % 6 = 1 THEN 'now' ELSE 'old' END AS task_hash,
CASE WHEN fresh THEN {due_sql(0)} ELSE 'none' END AS difficulty, CASE WHEN fresh THEN {due_sql(1)} ELSE 'none' END AS tier, CASE WHEN fresh THEN {due_sql(2)} ELSE 'none' END AS band,
CASE WHEN fresh AND error IS NULL THEN false ELSE d % 6 = 0 END AS infra_error, round(det, 6) AS det_score, det_ok AS det_success, ok AS success, anchored AS judge_anchor_det,
CASE WHEN fresh AND k = 4 AND llm IS NOT NULL AND NOT det_ok AND llm >= 0.95 AND stale THEN 'stale_anchor' END AS judge_blocked_by FROM z""")
def rescore(spark, sf_dir):
    """Stored answers under a bank whose tasks changed: every status, all four stimuli, restamps, verdicts."""
    found = G.rescore(stored(spark, sf_dir), bank(spark), backend="none")
    return found.select(
        "trial_id", "status", "drift", "regraded_only", "moved", "stale_judge", "flipped", "task_hash", "difficulty", "tier", "band", "infra_error", F.round("det_score", 6).alias("det_score"),
        "det_success", "success", "judge_anchor_det", "judge_blocked_by",
    )


KINDS = {0: "numeric", 1: "factual", 2: "text"}


@entry(f"""{SQL} SELECT d AS trial_id, round(det, 6) AS det_score, ok AS success, CASE WHEN fresh THEN {due_sql(2)} ELSE 'none' END AS band, anchored AS judge_anchor_det,
CASE WHEN fresh AND k < 3 THEN CASE k {" ".join(f"WHEN {k} THEN '{v}'" for k, v in KINDS.items())} END END AS answer_type, CAST(2 AS BIGINT) AS version FROM z""")
def rescore_written(spark, sf_dir):
    """The same, written back into a lake by parts, twice: the second time nothing changes. answer_type is told by the stored rubric."""
    lake = place(spark, "rescored")
    L.upsert(stored(spark, sf_dir), lake, ["trial_id"], "module")
    for _ in range(2):
        version = G.rescore_lake(spark, lake, bank(spark), backend="none")
    own = L.read(spark, lake)
    return own.select("trial_id", F.round("det_score", 6).alias("det_score"), "success", "band", "judge_anchor_det", F.get_json_object("expected", "$.answer_type").alias("answer_type"), F.lit(version).cast("long").alias("version"))


@entry(f"""{SQL} SELECT d AS trial_id, CASE WHEN k < 2 THEN 'knowledge' WHEN k = 3 THEN 'long_context' WHEN k = 2 THEN 'format' ELSE 'data_extract' END AS module, changed AND NOT other AS rehashed, changed AND other AS stale,
CASE WHEN d % 6 = 0 THEN '' WHEN changed AND other THEN 'old' ELSE 'now' END AS task_hash FROM z WHERE d % 29 <> 0""")
def migrate_rehash(spark, sf_dir):
    """Trials of tasks that are gone go; hashes follow the task only where a model would see the same."""
    return M.migrate(stored(spark, sf_dir), bank(spark)).select("trial_id", "module", "rehashed", "stale", "task_hash")
