"""The tool world: a query tool over small tables, answers of stateless tools, and stateful tools as folds over ordered calls.

Most of the state is the last write by key, or a sum of what was admitted: that needs no order beyond the calls' positions
and is computed by aggregation. ``episodes`` runs whole episodes in order where results depend on one another.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tools
from .arithmetic import evaluate as calculate  # noqa: F401  (the tool's arithmetic, for callers)
from .tools import MANAGER, REFUND_LIMIT, TABLES, under

def world_tables(spark: SparkSession, name: str) -> DataFrame:
    rows = TABLES.get(name, [])
    fields = {"orders": "id long, customer string, total long, status string", "tmp_import": "id long, source string, rows long, status string"}
    return spark.createDataFrame([tuple(r.values()) for r in rows], fields.get(name, "id long"))


def db_query(df: DataFrame, filters: dict[str, Any] | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """Equality filters, then order, then limit. An unknown filter column fits no row; an unknown order is no order."""
    for key, value in (filters or {}).items():
        df = df.filter(F.col(key).eqNullSafe(F.lit(value)) if key in df.columns else F.lit(False))
    df = df.orderBy(order_by) if order_by in df.columns else df
    return df.limit(max(0, limit)) if limit is not None else df


def kv_state(calls: DataFrame) -> DataFrame:
    """The store after an episode: the last value of each key (episode, pos, key, value)."""
    return calls.groupBy("episode", "key").agg(F.max_by("value", "pos").alias("value"))


def admitted(amount: Column, code: Column) -> Column:
    return (amount <= REFUND_LIMIT) | F.coalesce(code == MANAGER, F.lit(False))


def refund_state(calls: DataFrame, seed: float = 0) -> DataFrame:
    """Per episode the balance after its admitted refunds, and how many were refused."""
    ok = admitted(F.col("amount"), F.col("code"))
    return calls.groupBy("episode").agg((F.lit(seed) - F.sum(F.when(ok, F.col("amount")).otherwise(0))).alias("balance"), F.sum((~ok).cast("long")).alias("refused"))


def order_state(events: DataFrame) -> DataFrame:
    """The last status of each order, of those that exist (episode, pos, order_id, status)."""
    return events.groupBy("episode", "order_id").agg(F.max_by("status", "pos").alias("status"))


def memory_state(writes: DataFrame) -> DataFrame:
    """Facts in the order they were written."""
    return writes.groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact"))), lambda x: x["fact"]).alias("memory"))


def listing(files: DataFrame, prefix: str) -> DataFrame:
    """Paths under a prefix; ways to say 'here' list all."""
    return files.filter(F.startswith("path", F.lit(under(prefix)))).orderBy("path")


def rejection(name: str, rule: dict, nth: int, given: dict[str, Any]) -> Any:
    """What a tool says instead of doing its work, if its rule has it fail: always, the first time, or for an argument."""
    first = rule.get("first_call_behavior") if nth == 1 else None
    same = lambda want, got: want.strip().lower() == got.strip().lower() if isinstance(want, str) and isinstance(got, str) else want == got
    unfit = [key for key, want in (rule.get("require_args") or {}).items() if not same(want, given.get(key))]
    replies = (
        (rule.get("always_fail"), {"error": rule.get("error_message", f"{name} is unavailable: the upstream service is down")}),
        (first == "empty", []),
        (first == "error", {"error": rule.get("error_message", f"temporary failure in {name}: resource busy, please retry")}),
        (first, {"error": f"unknown first_call_behavior: {first}"}),
        (unfit, {"error": rule.get("require_args_error", f"rejected by {name}: the {unfit[0] if unfit else None!r} argument is not accepted")}),
    )
    return next((say for hit, say in replies if hit), None)


class World:
    """Runs calls one after another, over a state of their own; rules make tools fail.

    A world without a state knows the stateless tools alone; one with a state prefers the stateful ones.
    """

    def __init__(self, state: dict[str, Any] | None = None, overrides: dict[str, dict] | None = None, stateful: bool = True):
        self.state = json.loads(json.dumps(state or {}))
        self.tools = tools.STATELESS | (tools.STATEFUL if stateful else {})
        self.overrides, self.counts = overrides or {}, Counter()

    def call(self, name: str, args: dict[str, Any]) -> Any:
        self.counts[name] += 1
        said = rejection(name, self.overrides.get(name, {}), self.counts[name], args) if name in self.tools or name in self.overrides else None
        return tools.call(name, self.tools, self.state, args) if said is None else said


def answers(calls: DataFrame) -> DataFrame:
    """Adds `answer`, the JSON that a stateless tool gives (name, arguments JSON). Equal calls are answered once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [json.dumps(tools.call(n, tools.STATELESS, {}, json.loads(a or "{}")), ensure_ascii=False) for n, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], ["a_name", "a_arguments", "answer"])

    own = calls.select(F.col("name").alias("a_name"), F.col("arguments").alias("a_arguments")).distinct()
    said = own.mapInArrow(run, "a_name string, a_arguments string, answer string")
    return calls.join(said, F.col("name").eqNullSafe(F.col("a_name")) & F.col("arguments").eqNullSafe(F.col("a_arguments"))).drop("a_name", "a_arguments")


def schemas(spark: SparkSession) -> DataFrame:
    """name, stateful and schema (JSON) of every tool; there are 31."""
    rows = [(n, kind == "stateful", json.dumps(t.schema(n))) for kind, of in (("stateless", tools.STATELESS), ("stateful", tools.STATEFUL)) for n, t in of.items()]
    return spark.createDataFrame(rows, "name string, stateful boolean, schema string")


def offered(tasks: DataFrame) -> DataFrame:
    """Adds `payload`, the JSON array of function schemas that a task's `tools` offer a model, in their order.

    Of a name in both sets the stateful tool's schema counts. Tools are few, so the schemas are broadcast.
    """
    merged = schemas(tasks.sparkSession).groupBy("name").agg(F.max_by("schema", "stateful").alias("schema"))
    asked = tasks.select("task_id", F.posexplode("tools").alias("pos", "name")).join(F.broadcast(merged), "name")
    one = F.concat(F.lit('{"type": "function", "function": '), F.col("schema"), F.lit("}"))
    lists = asked.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("s")))).alias("found"))
    found = lists.select(F.col("task_id").alias("p_id"), F.concat(F.lit("["), F.array_join(F.col("found.s"), ", "), F.lit("]")).alias("payload"))
    return tasks.join(found, tasks.task_id == found.p_id, "left").drop("p_id").withColumn("payload", F.coalesce("payload", F.lit("[]")))


def episodes(calls: DataFrame, state: dict[str, Any] | None = None, overrides: dict[str, dict] | None = None) -> DataFrame:
    """Run each episode's calls (episode, pos, name, arguments JSON) in order; gives its final state and how many failed."""

    def run(group: pa.Table) -> pa.Table:
        world, failed = World(state, overrides), 0
        for r in sorted(group.to_pylist(), key=lambda r: r["pos"]):
            result = world.call(r["name"], json.loads(r["arguments"] or "{}"))
            failed += isinstance(result, dict) and "error" in result
        final = json.dumps(world.state, sort_keys=True)
        return pa.table({"episode": pa.array([group.column("episode")[0].as_py()], pa.int64()), "final_state": [final], "failed": pa.array([failed], pa.int64())})

    return calls.groupBy("episode").applyInArrow(run, "episode long, final_state string, failed long")
