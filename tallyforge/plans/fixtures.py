"""The driver's tables seen as evaluation data: the same projections as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Weights of the modules that the event types stand for.
WEIGHTS = {"click": 0.30, "view": 0.25, "error": 0.20, "purchase": 0.15, "signup": 0.10}
#: Parameters of the models, in billions: (total, active); None where a model is dense or unknown.
MODELS = {
    "m00": (0.8, None), "m01": (1.2, None), "m02": (2.6, None), "m03": (4.0, None), "m04": (8.0, 1.5), "m05": (9.0, None),
    "m06": (12.0, None), "m07": (26.0, 4.0), "m08": (27.0, None), "m09": (31.0, None), "m10": (35.0, 3.0),
}
COHORT = ("m01", "m04", "m07", "m10")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_digits(column) -> F.Column:
    return F.lpad(column.cast("string"), 2, "0")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model, task and attempt, from every event. Attempts are in the order of events: trial_seq tells it, and isn't dense."""
    e, no, task = F.col("event_id"), F.col("user_id") % 12, F.col("event_id") % 8
    rows = table(spark, sf_dir, "events").select(
        "event_id", no.alias("model_no"), F.concat(F.lit("m"), two_digits(no)).alias("model"), F.col("event_type").alias("module"),
        F.concat("event_type", F.lit("_"), two_digits(task)).alias("task_id"), task.alias("task_no"), "value",
    )
    cents = F.floor(F.col("value")).cast("long") % 100
    passed = F.col("value") < 12 + 6 * F.col("model_no")
    return rows.select(
        "event_id", "model_no", "model", "module", "task_id", "task_no", F.col("event_id").alias("trial_seq"), "value",
        F.when(F.col("task_no") < 3, "easy").when(F.col("task_no") < 6, "medium").otherwise("hard").alias("difficulty"),
        F.when(F.col("task_no") < 4, "baseline").otherwise("hard").alias("tier"),
        F.when(task % 4 == 0, "anchor").when(task % 4 == 1, "mid").when(task % 4 == 2, "hard").otherwise("frontier").alias("band"),
        F.when(e % 5 == 0, None).otherwise(F.concat(F.lit("ax"), (e % 3).cast("string"))).alias("axis"),
        passed.alias("det_success"), (passed & (e % 29 != 0)).alias("success"), F.when(passed, 1.0).otherwise(cents / 100.0).alias("det_score"),
        F.when(e % 7 == 0, None).otherwise(((e * 37) % 101) / 100.0).alias("llm_score"),
        F.floor(F.col("value") * 10).cast("long").alias("completion_tokens"), (100 + e % 400).alias("prompt_tokens"), (e % 50).alias("cached_prompt_tokens"),
        ((e % 20) / 10.0).alias("prefill_seconds"), ((e % 90) / 10.0).alias("generation_seconds"), ((e % 200) / 10.0).alias("duration_seconds"),
        F.when(e % 97 == 0, "ReadTimeout: took too long").when(e % 101 == 0, "HTTPStatusError: 500").alias("error"),
        (e % 53 == 0).alias("infra_error"),
        F.when(e % 41 == 0, "incomplete").when(e % 43 == 0, "degenerate").otherwise("").alias("truncation_class"),
        (1 + e % 3).alias("attempts_used"), F.when(e % 3 == 0, "llamacpp").when(e % 3 == 1, "usage").otherwise("").alias("timing_source"),
        F.when(e % 11 == 0, e % 2 == 0).alias("tool_mechanism"),
    )


TRIALS_SQL = """ev AS (
  SELECT event_id, user_id % 12 AS model_no, 'm' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS model, event_type AS module,
         event_type || '_' || lpad(CAST(event_id % 8 AS VARCHAR), 2, '0') AS task_id, event_id % 8 AS task_no, value, event_id AS e FROM events
), trials AS (
  SELECT event_id, model_no, model, module, task_id, task_no, row_number() OVER (PARTITION BY model, task_id ORDER BY event_id) AS trial_seq, value,
    CASE WHEN task_no < 3 THEN 'easy' WHEN task_no < 6 THEN 'medium' ELSE 'hard' END AS difficulty,
    CASE WHEN task_no < 4 THEN 'baseline' ELSE 'hard' END AS tier,
    CASE task_no % 4 WHEN 0 THEN 'anchor' WHEN 1 THEN 'mid' WHEN 2 THEN 'hard' ELSE 'frontier' END AS band,
    CASE WHEN e % 5 = 0 THEN NULL ELSE 'ax' || CAST(e % 3 AS VARCHAR) END AS axis,
    value < 12 + 6 * model_no AS det_success, value < 12 + 6 * model_no AND e % 29 <> 0 AS success,
    CASE WHEN value < 12 + 6 * model_no THEN 1.0 ELSE CAST(CAST(floor(value) AS BIGINT) % 100 AS DOUBLE) / 100.0 END AS det_score,
    CASE WHEN e % 7 = 0 THEN NULL ELSE CAST((e * 37) % 101 AS DOUBLE) / 100.0 END AS llm_score,
    CAST(floor(value * 10) AS BIGINT) AS completion_tokens, 100 + e % 400 AS prompt_tokens, e % 50 AS cached_prompt_tokens,
    CAST(e % 20 AS DOUBLE) / 10.0 AS prefill_seconds, CAST(e % 90 AS DOUBLE) / 10.0 AS generation_seconds, CAST(e % 200 AS DOUBLE) / 10.0 AS duration_seconds,
    CASE WHEN e % 97 = 0 THEN 'ReadTimeout: took too long' WHEN e % 101 = 0 THEN 'HTTPStatusError: 500' END AS error,
    e % 53 = 0 AS infra_error,
    CASE WHEN e % 41 = 0 THEN 'incomplete' WHEN e % 43 = 0 THEN 'degenerate' ELSE '' END AS truncation_class,
    1 + e % 3 AS attempts_used, CASE e % 3 WHEN 0 THEN 'llamacpp' WHEN 1 THEN 'usage' ELSE '' END AS timing_source,
    CASE WHEN e % 11 = 0 THEN e % 2 = 0 END AS tool_mechanism
  FROM ev
)"""

#: Counted trials by model and task, in SQL; needs TRIALS_SQL before it.
TASKS_SQL = """tasks AS (
  SELECT model, task_id, arg_min(module, trial_seq) AS module, arg_min(tier, trial_seq) AS tier, arg_min(band, trial_seq) AS band, count(*) AS n,
         CAST(sum(CAST(success AS INT)) AS BIGINT) AS passes, CAST(sum(CAST(det_success AS INT)) AS BIGINT) AS det_passes, avg(det_score) AS mean_det
  FROM trials WHERE NOT infra_error GROUP BY model, task_id
)"""


def pass_k_sql(c: str, n: str, k: int) -> str:
    top = " * ".join(f"greatest({c} - {i}, 0)" for i in range(k))
    low = " * ".join(f"({n} - {i})" for i in range(k))
    return f"CASE WHEN {n} >= {k} THEN CAST({top} AS DOUBLE) / ({low}) END"


WEIGHTS_SQL = "weights(module, w) AS (VALUES " + ", ".join(f"('{m}', CAST({w} AS DOUBLE))" for m, w in WEIGHTS.items()) + ")"
MODELS_SQL = "models(model, params_b, active_b) AS (VALUES " + ", ".join(f"('{m}', CAST({p} AS DOUBLE), CAST({'NULL' if a is None else a} AS DOUBLE))" for m, (p, a) in MODELS.items()) + ")"


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "module string, w double")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, p, a) for m, (p, a) in MODELS.items()], "model string, params_b double, active_b double")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of settings per model that has trials."""
    no = F.col("user_id") % 12
    own = table(spark, sf_dir, "events").select(no.alias("model_no"), F.concat(F.lit("m"), two_digits(no)).alias("model")).distinct()
    return own.select(
        "model", "model_no", F.when(F.col("model_no") == 4, 2).otherwise(3).cast("long").alias("trials"),
        F.when(F.col("model_no") % 5 == 0, "1.0.1").otherwise("1.0.2").alias("bench_version"), (F.col("model_no") % 2 == 0).alias("thinking"),
        (2048 * (1 + F.col("model_no") % 3)).alias("max_tokens"), F.when(F.col("model_no") == 7, "fast").otherwise("full").alias("profile"),
        F.when(F.col("model_no") % 4 == 0, 0.7).when(F.col("model_no") % 4 == 1, 0.0).alias("temperature"),
    )


RUNS_SQL = """runs AS (
  SELECT model, model_no, CAST(CASE WHEN model_no = 4 THEN 2 ELSE 3 END AS BIGINT) AS trials, CASE WHEN model_no % 5 = 0 THEN '1.0.1' ELSE '1.0.2' END AS bench_version,
         model_no % 2 = 0 AS thinking, 2048 * (1 + model_no % 3) AS max_tokens, CASE WHEN model_no = 7 THEN 'fast' ELSE 'full' END AS profile,
         CASE model_no % 4 WHEN 0 THEN CAST(0.7 AS DOUBLE) WHEN 1 THEN CAST(0.0 AS DOUBLE) END AS temperature
  FROM (SELECT DISTINCT user_id % 12 AS model_no, 'm' || lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS model FROM events)
)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as model answers: a heading, sentences as bullets, a closing number."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("# "), F.col("lang"), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n- ")), F.lit(" "), F.col("n_chars").cast("string"))
    return d.select("doc_id", "lang", "n_chars", text.alias("answer"), F.coalesce("text", F.lit("")).alias("text"))


ANSWERS_SQL = """answers AS (
  SELECT doc_id, lang, n_chars, '# ' || lang || chr(10) || replace(coalesce(text, ''), '. ', '.' || chr(10) || '- ') || ' ' || CAST(n_chars AS VARCHAR) AS answer, coalesce(text, '') AS text FROM documents
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tool calls: an order is an episode, flags name the tool, the quantity is its argument."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("episode"), F.row_number().over(order).cast("long").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("name"),
        F.col("l_quantity").cast("long").alias("argument"), (F.col("l_partkey") % 17 == 0).alias("failed"), F.round("l_extendedprice").cast("long").alias("amount"),
    )


CALLS_SQL = """calls AS (
  SELECT l_orderkey AS episode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS pos,
         l_returnflag || l_linestatus AS name, CAST(l_quantity AS BIGINT) AS argument, l_partkey % 17 = 0 AS failed, CAST(round(l_extendedprice) AS BIGINT) AS amount FROM lineitem
)"""
