"""Sharding by sampled splitters, in DataFrame operations alone.

A sample of keys, drawn with chances in proportion to bytes, gives quantile boundaries; records are range-partitioned
between them, and ranges that turn out overfull are subdivided by a hash. Exact byte and row totals of the ranges then
place every range in the order of keys, and a record goes to the shard that holds the middle of its bytes: shard sizes
differ by no more than a record. Law ``bytes``: sizes near equal.

Defined cases: a null text has 8 bytes and checksum 0; a null doc_id comes before all others; rows that are equal in
doc_id and text are counted together, so one key may hold any share of them, and are given consecutive slots; columns
beyond doc_id and text are ignored. An empty table gives an empty table. The sample only steers how work is divided: no
result but the order among records of one overfull range depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

SHARDS, RANGES_PER_SHARD, SAMPLE_PER_RANGE, RANGE_ROWS = 24, 16, 25, 250_000
LOWEST = -(1 << 63)


def splitters(keyed: DataFrame, total: int, ranges: int, per_range: int) -> list[int]:
    """Up to ranges - 1 boundaries from about ranges * per_range sampled keys (parameters bound what reaches the driver)."""
    chance = F.col("size") * F.col("n") * F.lit(ranges * per_range) / F.lit(float(max(total, 1)))
    uniform = F.shiftrightunsigned(F.xxhash64("key", "size", "text_crc32"), 11) / F.lit(float(1 << 53))
    # A record with a chance over 1 is drawn for sure and counts for all its share.
    sample = keyed.filter(uniform < chance).select("key", F.greatest(chance, F.lit(1.0)).alias("w"))
    running = F.sum("w").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    part = sample.withColumn("part", F.floor(running * ranges / F.sum("w").over(Window.partitionBy())))
    ends = part.groupBy("part").agg(F.max("key").alias("key")).select("key").distinct().orderBy("key")
    return [r["key"] for r in ends.collect()][:-1]


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries lie below the key: binary search by halving steps over a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(array, at + step - 1) < key), at + step).otherwise(at),
    )


def shard(documents: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, sample_per_range: int = SAMPLE_PER_RANGE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    keyed = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    keyed = materialize(keyed.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST))), "keyed")
    total = keyed.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    bounds = splitters(keyed, total, shards * ranges_per_shard, sample_per_range)

    ranged = keyed.withColumn("range", range_of(F.col("key"), bounds))
    full = ranged.groupBy("range").agg(F.count("*").alias("records")).select("range", F.ceil(F.col("records") / range_rows).alias("parts"))
    # One row for each of the ranges that the splitters bound.
    sub = F.pmod(F.xxhash64("key", "size", "text_crc32"), F.col("parts"))
    ranged = ranged.join(F.broadcast(full), "range").withColumn("sub", sub).drop("parts")

    # Parts grow with the rows, one for range_rows of them; their totals are summed in two steps, along ranges and within.
    sums = ranged.groupBy("range", "sub").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("r"))
    within = Window.partitionBy("range").orderBy("sub")
    sums = sums.select("range", "sub", (F.sum("b").over(within) - F.col("b")).alias("b1"), (F.sum("r").over(within) - F.col("r")).alias("r1"))
    tops = ranged.groupBy("range").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("r"))
    along = Window.orderBy("range")  # at most shards * ranges_per_shard rows
    tops = tops.select("range", (F.sum("b").over(along) - F.col("b")).alias("b0"), (F.sum("r").over(along) - F.col("r")).alias("r0"))
    before = sums.join(F.broadcast(tops), "range").select("range", "sub", (F.col("b0") + F.col("b1")).alias("bytes_before"), (F.col("r0") + F.col("r1")).alias("rows_before"))

    before = materialize(before, "before")  # small: a row for each range and range_rows; Spark sees its size and picks the join

    order = Window.partitionBy("range", "sub").orderBy("key", "size", "text_crc32")
    placed = ranged.join(before, ["range", "sub"]).select(
        "doc_id", "size", "text_crc32", "n",
        (F.col("bytes_before") + F.sum(F.col("size") * F.col("n")).over(order) - F.col("size") * F.col("n")).alias("first_byte"),
        (F.col("rows_before") + F.sum("n").over(order) - F.col("n")).alias("first_row"),
    )
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    middle = (F.col("first_byte") + F.col("copy") * F.col("size")) * 2 + F.col("size")
    copies = copies.select(
        "doc_id", "size", "text_crc32",
        F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(2 * total, 1)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("first_row") + F.col("copy")).alias("row"),
    )
    firsts = copies.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return copies.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
