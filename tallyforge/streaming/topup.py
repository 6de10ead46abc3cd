"""Topping up a lake of trials from a stream, each uid once, without reading the lake again for every batch.

Uids are dealt to buckets by hash. Each bucket has Bloom filters of the uids it holds, kept beside the data and committed with it. A batch reads the filters of
the buckets that it touches; a uid that they don't know is new, and is added without a look at the data. Only where a uid may be known are the
uids of its bucket read. A filter takes ``PER_FILTER`` uids, then the bucket gets another, so that false alarms stay rare however large it grows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import lake as L

#: Bits of a filter and how many it tests for a uid: with PER_FILTER uids one in about 8,000 unknown ones looks known.
BITS, PROBES, PER_FILTER = 1 << 21, 8, 100_000
FILTERS = "_part string, seq int, n long, bits binary"
KEYS = "_part string, h1 long, h2 long"


def places(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The bits of uids with these two hashes: a row for each, PROBES columns."""
    step = h2.astype(np.uint64) | np.uint64(1)
    return (h1.astype(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(BITS)


def hashes(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return keys["h1"].to_numpy(), keys["h2"].to_numpy()


def filters_of(rows: pa.Table) -> list[tuple[int, int, np.ndarray]]:
    """(seq, n, bits) of a bucket's filters, in order."""
    found = [(r["seq"], r["n"], np.unpackbits(np.frombuffer(r["bits"], np.uint8))) for r in rows.to_pylist()]
    return sorted(found, key=lambda f: f[0])


def suspects(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The uids of a batch that a bucket's filters know."""
    if not keys.num_rows:
        return keys
    at, known = places(*hashes(keys)), np.zeros(keys.num_rows, bool)
    for _, _, bits in filters_of(filters):
        known |= bits[at].all(axis=1)
    return keys.filter(pa.array(known))


def grown(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """A bucket's filters with the uids of a batch."""
    own = filters_of(filters)
    at = places(*hashes(keys)) if keys.num_rows else np.zeros((0, PROBES), np.uint64)
    while len(at):
        if not own or own[-1][1] >= PER_FILTER:
            own.append((len(own), 0, np.zeros(BITS, np.uint8)))
        seq, n, bits = own[-1]
        now, at = at[: PER_FILTER - n], at[PER_FILTER - n :]
        bits = bits.copy()
        bits[now.ravel()] = 1
        own[-1] = (seq, n + len(now), bits)
    part = (keys if keys.num_rows else filters)["_part"][0].as_py()
    rows = [{"_part": part, "seq": s, "n": n, "bits": np.packbits(b).tobytes()} for s, n, b in own]
    return pa.Table.from_pylist(rows, pa.schema([("_part", pa.string()), ("seq", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())]))


def bucket(uid: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(buckets)).cast("string")


def read_filters(spark: SparkSession, lake: str, found: dict, parts: list[str]) -> DataFrame:
    paths = [f"{lake}/{found['filters'][p]}" for p in parts if p in found.get("filters", {})]
    return spark.read.schema(FILTERS).parquet(*paths) if paths else spark.createDataFrame([], FILTERS)


def add_new(batch: DataFrame, lake: str, uid: str, buckets: int) -> dict:
    """Adds the rows whose uid the lake doesn't hold, the first of each uid; the lake's manifest afterwards.

    Its entry read names the buckets whose uids had to be read. A batch that is run again finds its uids and adds nothing.
    """
    spark, before, name = batch.sparkSession, L.manifest(batch.sparkSession, lake), uuid.uuid4().hex[:12]
    if before.get("buckets", buckets) != buckets:
        raise ValueError(f"{lake} has {before['buckets']} buckets")
    staged, data = f"{lake}/_staged-{name}", f"v{before['version'] + 1}-{name}"
    keyed = [F.col("_part"), F.xxhash64(uid).alias("h1"), F.xxhash64(F.lit("again"), uid).alias("h2")]
    try:
        batch.dropDuplicates([uid]).withColumn("_part", bucket(uid, buckets)).write.parquet(f"{staged}/rows")
        fresh = spark.read.schema(f"{L.ddl_of(batch)}, _part string").parquet(f"{staged}/rows")
        touched = [r["_part"] for r in fresh.select("_part").distinct().collect()]  # a row for each bucket
        filters = read_filters(spark, lake, before, touched)
        fresh.select(*keyed).groupBy("_part").cogroup(filters.groupBy("_part")).applyInArrow(suspects, KEYS).write.parquet(f"{staged}/suspects")
        read = sorted(r["_part"] for r in spark.read.schema(KEYS).parquet(f"{staged}/suspects").select("_part").distinct().collect())
        if read:
            known = L.read(spark, lake, before["version"], read).select(F.col(uid).alias("_known"))
            fresh = fresh.join(known, F.col(uid).eqNullSafe(F.col("_known")), "left_anti")
        fresh.write.partitionBy("_part").parquet(f"{lake}/{data}")
        added = spark.read.option("basePath", f"{lake}/{data}").schema(f"{L.ddl_of(batch)}, _part string").parquet(f"{lake}/{data}")
        new = sorted(r["_part"] for r in added.select("_part").distinct().collect())
        if not new:
            return before | {"read": read}
        filters = read_filters(spark, lake, before, new)
        bits = added.select(*keyed).groupBy("_part").cogroup(filters.groupBy("_part")).applyInArrow(grown, FILTERS)
        bits.withColumn("_bucket", F.col("_part")).write.partitionBy("_bucket").parquet(f"{lake}/{data}-filters")
        found = {
            "version": before["version"] + 1, "schema": L.ddl_of(batch), "buckets": buckets, "read": read,
            "parts": before["parts"] | {p: [*before["parts"].get(p, []), f"{data}/_part={p}"] for p in new},
            "filters": before.get("filters", {}) | {p: f"{data}-filters/_bucket={p}" for p in new},
        }
        L.commit(spark, lake, found)
        return found
    finally:
        L.remove(spark, staged)


def top_up(rows: DataFrame, lake: str, uid: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Append a stream's trials to a lake (read with sources.lake), each uid once, whether it came before in the stream or in an earlier run."""
    q = rows.writeStream.foreachBatch(lambda batch, _: add_new(batch, lake, uid, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
