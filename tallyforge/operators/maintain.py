"""Keeping stored trials current: what can be used again, what to run, what drifted, what a re-grade moved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

#: Modules that a task of a module may have come from.
PREDECESSORS = {"tools": ("tool_simple", "tool_loop", "tool_state", "tool_discovery", "tool_arg_typing"), "format": ("data_extract", "tool_arg_typing")}
OWN_ERRORS = ("unknown tool", "invalid arguments for", "unknown first_call_behavior")


#: What names a selected task of a run.
KEYS = ["model", "module", "task_id"]


def reusable(trials: DataFrame, tasks: DataFrame, target: int) -> DataFrame:
    """The first `target` counted trials of each model's selected tasks (KEYS, task_hash) whose task is still the same."""
    now = tasks.select(*KEYS, F.col("task_hash").alias("now"))
    same = trials.filter(~F.col("infra_error")).join(now, KEYS).filter(F.col("task_hash") == F.col("now")).drop("now")
    n = F.row_number().over(Window.partitionBy(*KEYS).orderBy("trial_seq"))
    return same.withColumn("_n", n).filter(F.col("_n") <= target).drop("_n")


def passthrough(trials: DataFrame, tasks: DataFrame) -> DataFrame:
    """Trials of tasks that are not selected: they stay as they are."""
    return trials.join(tasks.select(*KEYS), KEYS, "left_anti")


def work(trials: DataFrame, tasks: DataFrame, target: int, seed: int | None = None) -> DataFrame:
    """One row for each attempt that is still to run, with its ordinal and seed."""
    have = reusable(trials, tasks, target).groupBy(*KEYS).agg(F.count("*").alias("have"))
    todo = tasks.select(*KEYS).join(have, KEYS, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    rows = todo.filter(F.col("have") < target).withColumn("ordinal", F.explode(F.sequence("have", F.lit(target - 1).cast("long"))))
    return rows.select(*KEYS, "ordinal", (F.lit(seed) + F.col("ordinal") if seed is not None else F.lit(None)).cast("long").alias("seed"))


def top_up(passed_through: DataFrame, kept: DataFrame, new: DataFrame) -> DataFrame:
    return passed_through.unionByName(kept).unionByName(new)


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """df with null columns of these types where it has none of that name."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


#: What tells drift: of a stored trial (tools_schema: the offered tools' schemas; results: a JSON list of what its calls gave), and of a task.
OF_STORED = {"prompt": "string", "system_prompt": "string", "tools_schema": "array<string>", "results": "string"}
OF_BANK = {"prompt": "string", "system_prompt": "string", "tools": "array<string>", "tool_overrides": "string"}


def no_texts() -> Column:
    return F.array().cast("array<string>")


def names_offered(schemas: Column) -> Column:
    """The names in tools' JSON schemas, each once; schemas without one are passed over."""
    return F.filter(F.array_distinct(F.transform(F.coalesce(schemas, no_texts()), lambda t: F.get_json_object(t, "$.function.name"))), lambda n: n.isNotNull())


def errors_seen(results: Column) -> Column:
    """The error texts in tools' results (a JSON list of texts), without what tools say of themselves."""
    error = lambda r: F.try_variant_get(F.try_parse_json(r), "$.error", "variant")
    told = F.transform(F.coalesce(F.from_json(results, "array<string>"), no_texts()), lambda r: F.when(F.schema_of_variant(error(r)) == "STRING", stripped(F.try_variant_get(error(r), "$", "string"))))
    return F.filter(told, lambda e: e.isNotNull() & ~reduce(lambda x, own: x | F.startswith(e, F.lit(own)), OWN_ERRORS, F.lit(False)))


def errors_producible(overrides: Column) -> Column:
    """The error texts that a task's overrides ({tool: {error_message, require_args_error}}) can put into results."""
    each = F.map_values(F.from_json(overrides, "map<string,struct<error_message:string,require_args_error:string>>"))
    texts = F.flatten(F.transform(each, lambda o: F.array(o["error_message"], o["require_args_error"])))
    return F.filter(F.transform(F.coalesce(texts, no_texts()), stripped), lambda e: F.coalesce(e != "", F.lit(False)))


def stimulus_changed(prompt: Column, prompt_now: Column, system: Column, system_now: Column, offered: Column, tools_now: Column) -> Column:
    """Did the model see something else than the task shows now? A system prompt that wasn't stored counts as changed."""
    prompts = F.coalesce((prompt != "") & ~prompt.eqNullSafe(prompt_now), F.lit(False))
    systems = system_now.isNotNull() & ~system.eqNullSafe(system_now)
    same = lambda names: F.array_sort(F.array_distinct(F.coalesce(names, no_texts())))
    tools = (F.size(same(offered)) > 0) & (same(offered) != same(tools_now))
    return prompts | systems | tools


def injected_errors_changed(results: Column, overrides: Column) -> Column:
    """Errors in a trial's results that the task, where it overrides tools, can no longer inject."""
    overridden = F.coalesce(F.size(F.json_object_keys(overrides)) > 0, F.lit(False))
    return overridden & (F.size(F.array_except(errors_seen(results), errors_producible(overrides))) > 0)


def drifted() -> Column:
    """All four stimuli of a trial (OF_STORED) against its task (OF_BANK as now_...)."""
    c = F.col
    seen = stimulus_changed(c("prompt"), c("now_prompt"), c("system_prompt"), c("now_system_prompt"), names_offered(c("tools_schema")), c("now_tools"))
    return seen | injected_errors_changed(c("results"), c("now_tool_overrides"))


def rescore_status(trials: DataFrame, tasks: DataFrame, allow_drift: bool = False) -> DataFrame:
    """Each trial with what a re-grade does with it: unknown task, error without turns, drifted, or rescored.

    trials: module, task_id, task_hash, error, n_turns and OF_STORED; tasks: module, task_id, task_hash and OF_BANK. Adds the task's hash
    (now_hash), whether it is another one than the trial's (task_changed; a trial without a hash can't tell) and whether the model would
    see something else now (drift). Changes of what the model never saw, such as what is expected, are no drift.
    """
    trials, tasks = with_columns(trials, **OF_STORED), with_columns(tasks, **OF_BANK)
    own = ["task_hash", *OF_BANK]
    now = tasks.select("module", "task_id", *[F.col(c).alias(f"now_{c.removeprefix('task_')}") for c in own])
    met = trials.join(now, ["module", "task_id"], "left")
    c = F.col
    changed = F.coalesce((c("task_hash") != "") & (c("task_hash") != c("now_hash")), F.lit(False))
    met = met.withColumns({"task_changed": changed, "drift": changed & drifted()})
    status = (
        F.when(c("now_hash").isNull(), "unknown").when(F.coalesce(c("error") != "", F.lit(False)) & (c("n_turns") == 0), "error_no_turns")
        .when(c("drift") & F.lit(not allow_drift), "drifted").otherwise("rescored")
    )
    return met.withColumn("status", status).drop(*[f"now_{x}" for x in OF_BANK])


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose score or success a re-grade moved."""
    o = old.select(*keys, F.col("det_score").alias("old_score"), F.col("success").alias("old_success"))
    n = new.select(*keys, F.col("det_score").alias("new_score"), F.col("success").alias("new_success"))
    moved = (F.abs(F.col("old_score") - F.col("new_score")) > 1e-9) | ~F.col("old_success").eqNullSafe(F.col("new_success"))
    return o.join(n, keys, "full_outer").filter(F.coalesce(moved, F.lit(True)))


def migrate(trials: DataFrame, tasks: DataFrame) -> DataFrame:
    """Trials under the current bank: tasks are known by id, a former module gets its present name, unknown tasks go.

    A trial's hash becomes the task's where the model would see the same now (rehashed), and stays where it wouldn't (stale), so that the
    mark of drift isn't lost; columns as rescore_status() takes them.
    """
    trials, tasks = with_columns(trials, axis="string", **OF_STORED), with_columns(tasks, axis="string", **OF_BANK)
    own = [c for c in tasks.columns if c in ("module", "axis", "task_hash", *OF_BANK)]
    now = tasks.select("task_id", *[F.col(c).alias(f"now_{c}") for c in own])
    known = F.lit(False)
    for module, former in PREDECESSORS.items():
        known = known | ((F.col("now_module") == module) & F.col("module").isin(*former))
    c = F.col
    fits = (c("module") == c("now_module")) | known
    met = trials.join(now, "task_id").withColumn("relabelled", c("module") != c("now_module"))
    checked = F.when(fits, c("now_module")).otherwise(F.raise_error(F.concat(F.lit("no known move from module "), "module", F.lit(" to "), "now_module")))
    met = met.withColumns({"module": checked, "axis": F.coalesce(F.nullif(c("now_axis"), F.lit("")), c("axis"))})
    if "task_hash" in trials.columns:
        changed = F.coalesce((c("task_hash") != "") & (c("task_hash") != c("now_task_hash")), F.lit(False))
        met = met.withColumns({"rehashed": changed & ~drifted(), "stale": changed & drifted()}).withColumn("task_hash", F.when(c("rehashed"), c("now_task_hash")).otherwise(c("task_hash")))
    return met.drop(*[f"now_{x}" for x in own])
