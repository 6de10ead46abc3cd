"""Trials as streams: ingestion once for each uid, live tallies, a gate for dead endpoints, stateful tool episodes, windows."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.toolworld import World

#: Rows that a stream in order brings at a time, and the files that hold them.
AT_ONCE, FILES = 500_000, 6


def read_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Events as a stream of Parquet files; times are instants, which watermarks need."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def once(rows: DataFrame, uid: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each uid within the delay."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark([uid])


def tally(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).count()


def daily(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily windows per type. An extension: the batch side has no time windows."""
    own = rows.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type")
    return own.agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All there is now, into a memory table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is appended now, as Parquet files of a folder that all machines share: nothing of it passes through the driver."""
    sink = df.writeStream.outputMode("append").format("parquet").option("path", path).option("compression", "zstd").option("checkpointLocation", checkpoint)
    q = sink.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def in_order(rows: DataFrame, by: list[str], path: str, at_once: int = AT_ONCE) -> tuple[DataFrame, bool]:
    """The rows as a stream that brings them in order of `by`, about `at_once` at a time, from a sorted copy in a folder that all machines share.

    Tables that aren't in order of time can only be streamed as one batch: with more, the watermark would drop rows, and one batch has
    all rows in its shuffles and its state. A stream takes files by their age, so the copy's files get times in their order; where the
    file system doesn't keep these, the stream is one batch. Says too whether it comes in parts.
    """
    spark = rows.sparkSession
    files = FILES * max(1, -(-rows.count() // at_once))
    rows.repartitionByRange(files, *by).write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    parts = sorted((f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda p: (int(p.getName().split("-")[1]), p.getName()))
    first = int(time.time() * 1000) - 10 * len(parts)
    for n, part in enumerate(parts):
        fs.setTimes(part, first + 10 * n, -1)
    times = {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(place)}
    aged = [times[p.getName()] for p in parts]
    sliced, stream = all(a < b for a, b in zip(aged, aged[1:], strict=False)), spark.readStream.schema(rows.schema)
    return (stream.option("maxFilesPerTrigger", FILES) if sliced else stream).parquet(path), sliced


def top_up(rows: DataFrame, lake: str, uid: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's trials to a lake of trials, each uid once, whether it came before in the stream or in an earlier run.

    A batch that is run again after a failure finds its rows in the lake and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([uid])
        place = spark._jvm.org.apache.hadoop.fs.Path(lake)
        if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(lake).select(uid), uid, "left_anti").select(*batch.columns)
        fresh.write.mode("append").parquet(lake)

    q = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class DeadGate(StatefulProcessor):
    """Keyed by run: says once whether the first `need` finished trials were all dead."""

    def __init__(self, need: int = 5):
        self.need = need

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, dead long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, dead = self.seen.get() if self.seen.exists() else (0, 0)
        before = n
        for pdf in rows:
            for is_dead in pdf["dead"]:
                if n < self.need:
                    n, dead = n + 1, dead + int(is_dead)
        self.seen.update((n, dead))
        if before < self.need <= n:
            yield pd.DataFrame({"model": [key[0]], "abort": [dead == n]})

    def close(self) -> None:
        pass


def dead_gate(rows: DataFrame, need: int = 5) -> DataFrame:
    """(model, abort) for each run (model, dead) once `need` of its trials have finished."""
    return rows.groupBy("model").transformWithStateInPandas(DeadGate(need), "model string, abort boolean", "append", "none")


class GateInOrder(StatefulProcessor):
    """Keyed by run: says once whether the first `need` trials to finish, by their own times, were all dead.

    A trial waits in a list until the watermark has passed its time, since an earlier one may still come; only then does it count. Ties go by uid.
    """

    def __init__(self, need: int = 5):
        self.need = need

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, uid string, dead boolean")
        self.seen = handle.getValueState("seen", "n long, dead long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        settled = self.seen.exists() and self.seen.get()[0] >= self.need
        for pdf in rows:
            if not settled:
                times = pdf["at"].astype("int64").tolist()
                self.waiting.appendList(list(zip(times, pdf["uid"].astype(str).tolist(), pdf["dead"].astype(bool).tolist(), strict=True)))
                for at in set(times):
                    self.handle.registerTimer(at // 1000 + 1)  # whole milliseconds, not before its time
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, dead = self.seen.get() if self.seen.exists() else (0, 0)
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(r) for r in held if r[0] < now), key=lambda r: r[:2])
        if n < self.need and due:
            for _, _, is_dead in due[: self.need - n]:
                n, dead = n + 1, dead + int(is_dead)
            self.seen.update((n, dead))
            left = [tuple(r) for r in held if r[0] >= now]
            if n >= self.need or not left:
                self.waiting.clear()
            else:
                self.waiting.put(left)
            if n >= self.need:
                yield pd.DataFrame({"model": [key[0]], "abort": [dead == n]})

    def close(self) -> None:
        pass


def dead_gate_in_order(rows: DataFrame, need: int = 5, delay: str = "1 hour") -> DataFrame:
    """(model, abort) for each run (model, ts, uid, dead) once `need` of its trials have finished, in order of ts.

    Rows may come in any order: with shuffled input the verdict is the same, as long as no row comes later than the delay. Rows behind the
    watermark are dropped. A verdict is given when the watermark has passed the trial that decides.
    """
    own = rows.withWatermark("ts", delay).select("model", "ts", F.unix_micros("ts").alias("at"), F.col("uid").cast("string").alias("uid"), "dead")
    return own.groupBy("model").transformWithStateInPandas(GateInOrder(need), "model string, abort boolean", "append", "eventTime")


def pair_results(calls: DataFrame, results: DataFrame, keys: list[str], within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Every call (keys, called, ...) with its result (keys, answered, ...), which comes no earlier than the call and no later than `within` after it.

    Both are streams; their watermarks bound what is kept of each. A call that is still unanswered when its time is over comes with
    nulls, once the watermark has passed it; a result without a call is dropped.
    """
    left, right = calls.withWatermark("called", delay), results.withWatermark("answered", delay)
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in results.columns if c not in keys])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    timely = [F.col("answered") >= F.col("called"), F.col("answered") <= F.col("called") + F.expr(f"INTERVAL {within}")]
    return left.join(right, [*same, *timely], "left_outer").drop(*[f"_{k}" for k in keys])


class Episode(StatefulProcessor):
    """Keyed by episode: applies calls to its world as they come, and says what they gave."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.world = handle.getValueState("world", "state string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        world = World(json.loads(self.world.get()[0]) if self.world.exists() else {})
        calls = pd.concat(list(rows)).sort_values("pos")
        out = [json.dumps(world.call(n, json.loads(a or "{}")), sort_keys=True) for n, a in zip(calls["name"], calls["arguments"], strict=True)]
        self.world.update((json.dumps(world.state),))
        yield pd.DataFrame({"episode": [key[0]] * len(out), "pos": calls["pos"].tolist(), "result": out})

    def close(self) -> None:
        pass


def live_episodes(calls: DataFrame) -> DataFrame:
    return calls.groupBy("episode").transformWithStateInPandas(Episode(), "episode long, pos long, result string", "update", "none")
