"""Table schemas of the trial lake, and defaults for columns that older files lack."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = "struct<name:string,arguments:string>"
TURN = f"struct<role:string,content:string,tool_calls:array<{CALL}>,reasoning:string,completion_tokens:bigint,truncated:boolean>"

#: One attempt of a model at a task. Free-form objects are JSON text and are read as VARIANT where they are used.
TRIAL = (
    "task_id string, module string, axis string, prompt string, system_prompt string, difficulty string, tier string, band string, "
    "tools_schema array<string>, expected string, response_raw string, "
    f"turns array<{TURN}>, final_state string, det_score double, success boolean, det_success boolean, det_breakdown string, "
    "completion_tokens bigint, prompt_tokens bigint, cached_prompt_tokens bigint, prefill_seconds double, generation_seconds double, "
    "timing_source string, truncated boolean, truncation_class string, attempts_used int, context_overflow boolean, "
    "malformed_tool_call boolean, duration_seconds double, llm_score double, llm_reasoning string, judge_anchor_det double, "
    "judge_blocked_by string, error string, infra_error boolean, raw_api_responses array<string>, task_hash string, world_hash string"
)
RUN = (
    "model string, endpoint string, timestamp string, duration_seconds double, bench_version string, fast boolean, profile string, "
    "trials bigint, thinking boolean, temperature double, max_tokens bigint, seed bigint, sampling string, sandbox_backend string, "
    "python_version string, max_tokens_override boolean, concurrency bigint, served_context bigint, task_set_hash string, task_count bigint"
)



def struct(ddl: str) -> str:
    """A table's columns as the fields of a struct."""
    return "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl) + ">"


#: A result file: the run's settings and its trials, in order.
RESULT_FILE = f"meta {struct(RUN)}, results array<{struct(TRIAL)}>"
TASK = (
    "id string, module string, axis string, prompt string, system_prompt string, difficulty string, tier string, band string, fast boolean, "
    "max_tokens bigint, answer_type string, expected string, constraints array<string>, tools array<string>, optimal_turns bigint, task_hash string, world_hash string"
)
MODEL = ("name string, params_b double, active_b double, arch string, family string, variant_of string, base_model string, notes string")

#: What a missing value means, by column.
TRIAL_DEFAULTS = {
    "difficulty": "medium", "tier": "baseline", "band": "mid", "response_raw": "", "det_score": 0.0, "success": False, "det_success": False,
    "completion_tokens": 0, "prompt_tokens": 0, "cached_prompt_tokens": 0, "prefill_seconds": 0.0, "generation_seconds": 0.0, "timing_source": "",
    "truncated": False, "truncation_class": "", "attempts_used": 1, "context_overflow": False, "malformed_tool_call": False,
    "duration_seconds": 0.0, "infra_error": False, "task_hash": "", "world_hash": "", "expected": "{}", "final_state": "{}", "det_breakdown": "{}",
}
RUN_DEFAULTS = {"fast": False, "profile": "full", "trials": 1, "max_tokens_override": False, "sampling": "", "sandbox_backend": "", "task_set_hash": ""}


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Nulls of the columns that have a default become that; columns that are not there are added."""
    have = set(df.columns)
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()}
    return df.withColumns(filled)
