"""Streaming queries, run to the end of what there is; where batch SQL can say the same, it does."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lake
from ..sources.scratch import cleaned, place
from ..streaming import log, topup
from ..streaming import trials as L
from . import fixtures as X
from .registry import entry

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """What a stream gives over all its input. Rows that are appended are as many as the input has keys, so files of the shared folder hold them; tallies are few, and a memory table does."""
    name = f"s_{uuid.uuid4().hex[:12]}"
    if mode == "append":
        path = place(spark, name)
        L.run_to_files(df, path, f"{path}-state")
        dropped(spark, f"{path}-state")
        return spark.read.schema(df.schema).parquet(path)
    L.run_to_end(df, name, place(spark, name), mode)
    return spark.table(name)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def kept_short(spark: SparkSession, bounded: bool) -> Iterator[None]:
    """For as long as a stream runs: of state and its logs only what the last batches need is kept, and stores are as many as cores, as each costs every batch something.

    State that isn't `bounded` by what a batch brings goes to RocksDB with bounded memory, one store for each partition of a join of streams; that takes about three times as long.
    """
    state = "spark.sql.streaming.stateStore"
    settings = {f"{state}.maintenanceInterval": "5s", f"{state}.minDeltasForSnapshot": "2", "spark.sql.streaming.minBatchesToRetain": "2"}
    if bounded:
        settings["spark.sql.shuffle.partitions"] = str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    else:
        settings |= {f"{state}.providerClass": ROCKS, f"{state}.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.join.stateFormatVersion": "3"}
    with ExitStack() as own:
        for name, value in settings.items():
            own.enter_context(setting(spark, name, value))
        yield


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for as long as a stream runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.read_events(spark, sf_dir, X.table(spark, sf_dir, "events").schema)


@entry("SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def stream_tally(spark, sf_dir):
    return drained(spark, L.tally(events(spark, sf_dir), "event_type"), "complete")


@entry("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily(spark, sf_dir):
    daily = drained(spark, L.daily(events(spark, sf_dir)), "complete")
    return daily.select(F.to_date("day").cast("string").alias("day"), "event_type", "n")


@entry("""SELECT 'u' || CAST(user_id AS VARCHAR) AS model, bool_and(user_id % 3 = 0) AS abort FROM events GROUP BY ALL HAVING count(*) >= 2""")
def stream_dead_gate(spark, sf_dir):
    """A run for each user, dead or alive by the user's number; two finished trials decide."""
    rows = events(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("model"), (F.col("user_id") % 3 == 0).alias("dead"))
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        return drained(spark, L.dead_gate(rows, 2), "append")


@entry("SELECT event_id FROM events")
def stream_top_up(spark, sf_dir):
    """The same events streamed twice into one lake: each is there once."""
    lake = place(spark, "lake")
    for run in ("first", "second"):
        L.top_up(events(spark, sf_dir).select("event_id"), lake, "event_id", place(spark, run))
    return spark.read.parquet(lake)


@entry("SELECT event_id, user_id, event_type, value FROM events")
def stream_trial_log(spark, sf_dir):
    """Events through the log's sink, in epochs; what its commits name is read back."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    path = place(spark, "log")
    log.write_log(rows, path, place(spark, "log-state"))
    return log.read_log(spark, path, rows.schema)


@entry("SELECT event_id, event_type, value FROM events")
def stream_top_up_buckets(spark, sf_dir):
    """Clicks alone, then all events, streamed into a lake of buckets: each is there once."""
    at, rows = place(spark, "buckets"), events(spark, sf_dir).select("event_id", "event_type", "value")
    for run, own in (("clicks", rows.filter("event_type = 'click'")), ("all", rows)):
        topup.top_up(own, at, "event_id", place(spark, run), buckets=8)
    return lake.read(spark, at)


@entry("""WITH o AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS model, event_type = 'error' AS dead, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
WHERE ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events)) SELECT model, bool_and(dead) AS abort FROM o WHERE n <= 2 GROUP BY model HAVING count(*) = 2""")
def stream_gate_in_order(spark, sf_dir):
    """A run for each user; the first two events in order of their times decide, whatever order files hold them in."""
    rows = events(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("model"), "ts", F.col("event_id").alias("uid"), (F.col("event_type") == "error").alias("dead"))
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        return drained(spark, L.dead_gate_in_order(rows, 2, "1 day"), "append")


CALL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@entry(f"""WITH c AS (SELECT {", ".join(CALL)}, l_shipdate AS called, CASE WHEN l_partkey % 17 <> 0 THEN l_shipdate + l_linenumber * INTERVAL 5 HOUR END AS due, l_quantity FROM lineitem),
r AS (SELECT *, due <= called + INTERVAL 1 DAY AS timely FROM c), w AS (SELECT least(max(called), max(due)) - INTERVAL 1 HOUR AS mark FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS price, CAST(CAST(called AS DATE) AS VARCHAR) AS day, CASE WHEN timely THEN l_quantity END AS result
FROM r, w WHERE coalesce(timely, false) OR called + INTERVAL 1 DAY < mark""")
def stream_call_results(spark, sf_dir):
    """Line items as calls, and most of them again as results some hours later; those that come after a day, or never, are unanswered."""
    path, table = place(spark, "calls"), X.table(spark, sf_dir, "lineitem").select(*CALL, "l_quantity")
    with cleaned(spark):
        rows, sliced = L.in_order(table, ["l_shipdate", "l_orderkey", "l_linenumber"], path)
        a_day = table.groupBy("l_shipdate").count().agg(F.max("count")).first()[0] or 0  # state reaches back a day
    at = F.col("l_shipdate").cast("timestamp")
    calls = rows.select(*CALL, at.alias("called"))
    results = rows.filter("l_partkey % 17 <> 0").select(*CALL, F.timestamp_add("HOUR", F.col("l_linenumber") * 5, at).alias("answered"), F.col("l_quantity").alias("result"))
    paired = L.pair_results(calls, results, CALL).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"), F.to_date("called").cast("string").alias("day"), "result"
    )
    with kept_short(spark, sliced and a_day <= L.AT_ONCE), cleaned(spark):
        found = drained(spark, paired, "append")
    dropped(spark, path)
    return found
