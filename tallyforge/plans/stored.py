"""Queries over files: the given tables written as result files, task banks and registries, and read through the batch sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources.scratch import place
from . import fixtures as X
from .registry import entry, rounded


def lined_files(lines: DataFrame, name: str) -> str:
    """Writes (file, pos, value) as the files that they name, a line for each row, in one folder; the folder. Files are few: a move for each."""
    spark = lines.sparkSession
    path = place(spark, name)
    lines.repartition("file").sortWithinPartitions("file", "pos").select(F.col("file").alias("_file"), "value").write.partitionBy("_file").text(f"{path}-lines")
    own = spark._jvm.org.apache.hadoop.fs.Path
    fs = own(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(own(path))
    for folder in fs.listStatus(own(f"{path}-lines")):
        if folder.isDirectory():
            part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, own(f"{path}/{folder.getPath().getName().removeprefix('_file=')}"))
    fs.delete(own(f"{path}-lines"), True)
    return path


def result_files(spark: SparkSession, sf_dir: str) -> str:
    """A raw result file for each model; every third model has a judged one as well, with the judge's scores."""
    t = X.trials(spark, sf_dir)
    raw, judged = F.concat("model", F.lit("_raw_results.json")), F.concat("model", F.lit("_raw_results_judged.json"))
    both = t.withColumn("file", F.explode(F.when(F.col("model_no") % 3 == 0, F.array(raw, judged)).otherwise(F.array(raw))))
    score = F.when(F.endswith("file", F.lit("_judged.json")), F.col("llm_score")).alias("llm_score")
    trial = F.to_json(F.struct("module", "task_id", "band", "success", "det_score", "completion_tokens", score, F.lit("[\"x\", {\"results\": 1}]").alias("response_raw")))
    comma = F.when(F.min("event_id").over(Window.partitionBy("file")) == F.col("event_id"), "").otherwise(",")
    body = both.select("file", F.col("event_id").alias("pos"), F.concat(comma, trial).alias("value"))
    runs = both.select("file", "model").distinct()
    # A third of the files tell their run after the trials.
    late = F.endswith("model", F.lit("1")) | F.endswith("model", F.lit("4")) | F.endswith("model", F.lit("7"))
    meta = F.concat(F.lit('"meta": '), F.to_json(F.struct("model", F.lit(3).alias("trials"))))
    head = runs.select("file", F.lit(-1).cast("long").alias("pos"), F.concat(F.lit("{"), F.when(late, "").otherwise(F.concat(meta, F.lit(", "))), F.lit('"results": [')).alias("value"))
    tail = runs.select("file", F.lit(2**62).cast("long").alias("pos"), F.concat(F.lit("]"), F.when(late, F.concat(F.lit(", "), meta)).otherwise(""), F.lit("}")).alias("value"))
    return lined_files(head.unionByName(body).unionByName(tail), "results")


PREFERRED = "model || '_raw_results' || CASE WHEN model_no % 3 = 0 THEN '_judged' ELSE '' END || '.json'"


@entry(f"""WITH {X.TRIALS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY event_id) - 1 AS seq FROM trials)
SELECT model, {PREFERRED} AS source_file, seq AS trial_seq, module, task_id, band, success, round(det_score, 6) AS det_score, completion_tokens, CASE WHEN model_no % 3 = 0 THEN round(llm_score, 6) END AS llm_score
FROM n WHERE module IN ('click', 'error')""")
def s1_result_files(spark, sf_dir):
    """Two modules' trials from each run's judged file, or its raw one."""
    rows = S.load_preferred(spark, result_files(spark, sf_dir), modules=["click", "error"])
    return rounded(rows.select("model", "source_file", "trial_seq", "module", "task_id", "band", "success", "det_score", "completion_tokens", "llm_score"))


@entry(f"""WITH {X.TRIALS_SQL} SELECT model || '_raw_results_judged.json' AS source_file, count(*) AS n, count(llm_score) AS scored FROM trials WHERE model_no % 3 = 0 GROUP BY model""")
def s3_judged_files(spark, sf_dir):
    """Judged files alone: the raw ones aren't opened."""
    return S.load_results(spark, result_files(spark, sf_dir), judged=True).groupBy("source_file").agg(F.count("*").alias("n"), F.count("llm_score").alias("scored"))


def bank_files(spark: SparkSession, sf_dir: str) -> str:
    """Parts as tasks, a file for each type of part; files of even length of name hold a list, the others a document with tasks."""
    p = X.table(spark, sf_dir, "part").withColumn("module", F.lower("p_type"))
    task = F.to_json(F.struct(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("prompt"), F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.col("p_size") % 3 + 1).alias("difficulty"),
        F.when(F.col("p_size") % 4 == 0, True).alias("fast"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 64).alias("max_tokens"), F.struct(F.col("p_partkey").alias("answer")).alias("expected"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("max_words").alias("type"), F.col("p_size").alias("value")))).alias("constraints"),
    ))
    file = F.concat("module", F.lit(".yaml"))
    body = p.select(file.alias("file"), F.col("p_partkey").alias("pos"), F.concat(F.lit("- "), task).alias("value"))
    head = p.filter(F.length("module") % 2 == 1).select(file.alias("file"), F.lit(-1).cast("long").alias("pos"), F.lit("tasks:").alias("value")).distinct()
    return lined_files(head.unionByName(body), "bank")


@entry("""SELECT 'p' || CAST(p_partkey AS VARCHAR) AS id, lower(p_type) AS module, p_name AS prompt, CASE p_size % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, 'hard' AS tier,
CASE p_size % 3 WHEN 0 THEN 'anchor' WHEN 1 THEN 'mid' ELSE 'hard' END AS band, p_size % 4 = 0 AS fast, CASE WHEN p_size % 5 > 0 THEN CAST(p_size * 64 AS BIGINT) END AS max_tokens, p_partkey AS answer,
CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) END AS most_words FROM part WHERE p_type IN ('ECONOMY', 'STANDARD', 'PROMO')""")
def s5_task_bank(spark, sf_dir):
    """Three modules' tasks of the bank; other modules' files aren't opened."""
    tasks = S.load_tasks(spark, bank_files(spark, sf_dir), ["economy", "standard", "promo"])
    most = F.get_json_object(F.get("constraints", F.lit(0)), "$.value").cast("long").alias("most_words")
    return tasks.select("id", "module", "prompt", "difficulty", "tier", "band", "fast", "max_tokens", F.get_json_object("expected", "$.answer").cast("long").alias("answer"), most)


@entry("""SELECT s_name AS name, CAST(s_nationkey AS DOUBLE) / 2 AS params_b, CASE WHEN s_nationkey % 3 = 0 THEN CAST(s_nationkey AS DOUBLE) / 8 END AS active_b, 'dense' AS arch FROM supplier WHERE s_suppkey % 7 <> 0""")
def s7_registry_file(spark, sf_dir):
    """Suppliers as a registry of models; entries without a name don't count."""
    s = X.table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).alias("name")
    model = F.to_json(F.struct(name, (F.col("s_nationkey") / 2).alias("params_b"), F.when(F.col("s_nationkey") % 3 == 0, F.col("s_nationkey") / 8).alias("active_b"), F.lit("dense").alias("arch")))
    body = s.select(F.lit("models.yaml").alias("file"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("  - "), model).alias("value"))
    head = spark.createDataFrame([("models.yaml", -1, "models:")], "file string, pos long, value string")
    return S.load_registry(spark, lined_files(head.unionByName(body), "registry") + "/models.yaml").select("name", "params_b", "active_b", "arch")
