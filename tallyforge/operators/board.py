"""The ranked board: one row per model with headline, tier, size, coverage, speed and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import aggregates, ledger, stats

# The floors of tiers and of size classes (billions of parameters in all).
TIERS = (("S", 0.90), ("A", 0.80), ("B", 0.70), ("C", 0.60), ("D", 0.45), ("E", 0.30), ("F", 0.0))
SIZES = (("xl", 24.0), ("l", 7.0), ("m", 3.0), ("s", 0.0))


def tier(score: Column) -> Column:
    out = F.lit(TIERS[-1][0])
    for letter, floor in reversed(TIERS):
        out = F.when(score >= floor, letter).otherwise(out)
    return out


def size_bucket(params_b: Column) -> Column:
    out = F.lit(SIZES[-1][0])
    for key, floor in reversed(SIZES):
        out = F.when(params_b >= floor, key).otherwise(out)
    return F.when(params_b.isNull(), None).otherwise(out)


def plain(x: Column) -> Column:
    """A number without trailing zeros."""
    text = F.format_string("%.6f", x.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def size_cells(models: DataFrame) -> DataFrame:
    """The registry's sizes as the board shows them; sorted by what is active, grouped by the total."""
    label = F.when(F.col("params_b").isNull(), "?").when(F.col("active_b").isNull(), F.concat(plain(F.col("params_b")), F.lit("B")))
    label = label.otherwise(F.concat(plain(F.col("params_b")), F.lit("B · A"), plain(F.col("active_b")), F.lit("B")))
    return models.select(
        "model", "params_b", "active_b", F.coalesce("active_b", "params_b").alias("sort_b"), F.col("active_b").isNotNull().alias("sparse"),
        label.alias("label"), size_bucket(F.col("params_b")).alias("bucket"),
    )


def fleet_k(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.max("trials"), F.lit(1)).cast("long").alias("k"))


def prefer_judged(files: DataFrame) -> DataFrame:
    """Of each run's files the judged one; a judged file without its raw one counts as well."""
    judged = F.endswith("file", F.lit("_judged.json"))
    stem = F.regexp_replace("file", r"(_judged)?\.json$", "")
    named = files.withColumn("judged", judged).withColumn("stem", stem)
    best = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("judged"), "file"))
    return named.withColumn("_n", best).filter("_n = 1").select("stem", "file", "judged")


def board(trials: DataFrame, weights: DataFrame, models: DataFrame, k: int) -> DataFrame:
    """Ranked rows, all from one ledger: trials are read once."""
    sums = ledger.ledger(trials)
    tasks = written(ledger.by_task(sums), "tasks")
    heads, speed, lost = ledger.headlines(tasks, weights, k), sums.groupBy("model").agg(ledger.speed()), ledger.lost(sums, k)
    ties = tied_with_above(stats.pairs(tasks, k))
    size = F.broadcast(size_cells(models))  # a row for each model
    rows = heads.join(speed, "model", "left").join(lost, "model", "left").join(size, "model", "left").join(ties, "model", "left")
    score = F.round("headline", 6)
    return rows.select(
        F.row_number().over(Window.orderBy(F.desc(score), "model")).cast("long").alias("rank"), "model", score.alias("headline"), F.round("det_headline", 6).alias("det_headline"),
        tier(score).alias("tier"), F.coalesce("label", F.lit("?")).alias("size"), "bucket", F.round("tokens_per_second", 4).alias("tokens_per_second"), "excluded", "short",
        F.coalesce("tied", F.lit(False)).alias("tied_with_above"),
    )


def tied_with_above(pairs: DataFrame) -> DataFrame:
    """Models that nothing separates from the one ranked above."""
    return pairs.filter("adjacent").select(F.col("model_b").alias("model"), (~F.col("separable")).alias("tied"))


def tier_counts(rows: DataFrame) -> DataFrame:
    """How many rows each tier has, none included."""
    all_tiers = rows.sparkSession.createDataFrame([(i, t) for i, (t, _) in enumerate(TIERS)], "pos long, tier string")
    return all_tiers.join(rows.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("pos", "tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bucket_counts(models: DataFrame) -> DataFrame:
    """Dense and sparse models of each size class, none included."""
    all_sizes = models.sparkSession.createDataFrame([(i, b) for i, (b, _) in enumerate(SIZES)], "pos long, bucket string")
    own = size_cells(models).groupBy("bucket").agg(aggregates.whole(~F.col("sparse")).alias("dense"), aggregates.whole(F.col("sparse")).alias("sparse"))
    return all_sizes.join(own, "bucket", "left").select("pos", "bucket", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("dense", "sparse")])


def module_ranks(tasks: DataFrame, k: int) -> DataFrame:
    """Models by each module's pass^k; equal scores share a rank."""
    scores = aggregates.group_scores(tasks, "module", k).withColumn("pass_k", F.round("pass_k", 6))
    return scores.select("module", "model", "pass_k", F.rank().over(Window.partitionBy("module").orderBy(F.desc("pass_k"))).cast("long").alias("rank"))
