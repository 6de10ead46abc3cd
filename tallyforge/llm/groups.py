"""Maximal repeat groups with all their occurrences, of any length, over a whole corpus.

A string of ``least`` bytes or more is a maximal repeat if it occurs twice, and neither all its occurrences are preceded by one
byte nor all are followed by one (the edge of a text is like no byte). The groups are the intervals of the common-prefix tree of an
enhanced suffix array; the array holds the suffixes that can begin a maximal repeat, and no others:

1. Windows of ``least`` bytes that occur twice are found through minimizers (``repeats.segments``), equal segments counted
   before they are shuffled. Where all segments of a minimizer are equal, all their windows but the first are preceded by one
   byte. Where they differ, their windows are counted by their bytes, of each different segment once.
2. A suffix can begin a maximal repeat only where its first window occurs after different bytes: that is where copied stretches
   begin, not within them. Such suffixes reach to the end of the stretch of repeated windows they lie in.
3. Spark sorts them: dealt by sampled ranges of whole suffixes, ties by place, so that suffixes with one beginning, however
   common, are spread over tasks. Each task scans its sorted part with a stack, holding only common prefixes and left bytes.
4. Intervals that touch a part's edge are open. Of these a part gives blocks (between falls of the common prefix towards its edges),
   and one more scan over all parts' blocks closes them. Blocks are few: as many as different common prefixes at edges.

A group is told as a range of ranks (lo to hi) in the sorted suffixes, so exact copies are not multiplied: occurrences stand once in
``places``, and nested groups share them. ``occurrences`` spells them out.

Defined cases: a null text is empty; rows are documents of their own, so repeated rows repeat each other, and a null doc_id
is kept as such; columns beyond doc_id and text are ignored; an empty table has no groups. Repeats longer than ``reach``
are told with that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import KMER, LEAST, batched, segments
from .shared import materialize, parts_for, sliced, text_bytes

REACH, PART_BYTES, BLOCK = 1 << 16, 32 << 20, 1 << 20
EDGE = -1  # before a text's first byte
ENTRY = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("sh", pa.int64()), ("left", pa.int32()), ("start", pa.int64()), ("len", pa.int32())])
SUFFIX = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("left", pa.int32()), ("suffix", pa.binary())])
FOUND = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("length", pa.int64()), ("row", pa.int64()), ("start", pa.int64()),
    ("low", pa.int32()), ("high", pa.int32()), ("first", pa.binary()), ("last", pa.binary()),
])
FOUND_DDL = "kind int, part int, lo long, hi long, length long, row long, start long, low int, high int, first binary, last binary"
GROUP, PLACE, BLOCK_ROW = 0, 1, 2


def entry_rows(least: int, kmer: int, block: int):
    """Rows (row, text) to one for each segment, with the byte before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for row, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                for at in range(0, max(0, len(t) - least + 1), block):  # long texts in parts; each window is in one
                    data = np.frombuffer(t, np.uint8)[at : at + block + least - 1]
                    a, z, key, sh = segments(data, np.zeros(len(data), np.int32), least, kmer)
                    before = np.concatenate(([t[at - 1] if at else EDGE], data[:-1].astype(np.int32)))[a].astype(np.int32)
                    columns = (np.full(len(a), row, np.int64), (key >> np.uint64(1)).astype(np.int64), sh.view(np.int64), before, a + at, (z - a).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=ENTRY)

    return run


def marks(rows: DataFrame, entries: DataFrame, least: int) -> DataFrame:
    """(key, sh, repeated, diverse): places in a segment at which repeated windows begin, and those that follow different bytes."""
    place = F.struct("row", "start", "len")
    classes = entries.groupBy("key", "sh").agg(F.count("*").alias("n"), F.min("left").alias("low"), F.max("left").alias("high"), F.min(place).alias("at"))
    keys = classes.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1")
    met = materialize(classes.join(keys.select("key", "kinds"), "key"), "classes")
    differ = (F.col("low") < F.col("high")) | (F.col("low") == EDGE)
    all_of = F.sequence(F.lit(0), F.col("at.len") - least)
    none = F.array().cast("array<int>")
    single = met.filter("kinds = 1").select("key", "sh", all_of.alias("repeated"), F.when(differ, F.array(F.lit(0))).otherwise(none).alias("diverse"))

    wanted = met.filter("kinds > 1").select("key", "sh", "n", "low", "high", "at.*")
    data = F.substring(F.encode("text", "UTF-8"), F.col("start").cast("int") + 1, F.col("len"))
    strings = wanted.join(rows.select("row", "text"), "row").select("key", "sh", "n", "low", "high", data.alias("s"))
    byte_at = lambda i: F.conv(F.hex(F.substring(F.col("s"), i, F.lit(1))), 16, 10).cast("int")
    window = lambda i: F.struct(
        i.alias("i"), F.substring(F.col("s"), i + 1, F.lit(least)).alias("w"),
        F.when(i == 0, F.col("low")).otherwise(byte_at(i)).alias("low"), F.when(i == 0, F.col("high")).otherwise(byte_at(i)).alias("high"),
    )
    windows = strings.select("key", "sh", "n", F.explode(F.transform(F.sequence(F.lit(0), F.octet_length("s") - least), window)).alias("x")).select("key", "sh", "n", "x.*")
    windows = materialize(windows, "windows")
    counted = windows.groupBy("w").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("n > 1")
    found = windows.select("key", "sh", "i", "w").join(counted.select("w", differ.alias("diverse")), "w")
    several = found.groupBy("key", "sh").agg(F.collect_list("i").alias("repeated"), F.collect_list(F.when(F.col("diverse"), F.col("i"))).alias("diverse"))
    return single.unionByName(several)


def suffix_rows(least: int, reach: int):
    """Rows (row, text, marks) to the suffixes that can begin a maximal repeat."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in sliced(batches, 50):
            for row, t, found in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                again, begins = np.zeros(len(t) + 1, bool), []
                for m in found:
                    again[np.array(m["repeated"], np.int64) + m["start"]] = True
                    begins += [m["start"] + i for i in m["diverse"]]
                stops = np.flatnonzero(~again)  # the last is beyond the text
                for at in sorted(begins):
                    end = int(stops[np.searchsorted(stops, at)]) + least - 1
                    yield row, at, t[at - 1] if at else EDGE, t[at : min(end, at + reach)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), SUFFIX)

    return run


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def united(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """The lowest and highest left byte of two sets; EDGE stands for itself, as lowest."""
    return min(a[0], b[0]), max(a[1], b[1])


def intervals(prefix: list[int], lefts: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int, int, tuple[int, int]]]:
    """(first, last, length, left bytes) of every interval of the tree of at least `least`; prefix[i] is shared by i - 1 and i."""
    stack: list[list] = []
    for i in range(1, len(lefts) + 1):
        now = prefix[i] if i < len(lefts) else -1
        first, seen = i - 1, lefts[i - 1]
        while stack and stack[-1][0] > now:
            length, first, own = stack.pop()
            seen = united(own, seen)
            yield first, i - 1, length, seen
        if now >= least:
            if stack and stack[-1][0] == now:
                stack[-1][2] = united(stack[-1][2], seen)
            else:
                stack.append([now, first, seen])


def diverse(left: tuple[int, int]) -> bool:
    return left[0] == EDGE or left[0] < left[1]


def falls(prefix: list[int]) -> list[int]:
    """Where the common prefix falls below all before it, from the left; the first counts."""
    out, least = [], None
    for i in range(1, len(prefix)):
        if least is None or prefix[i] < least:
            out.append(i)
            least = prefix[i]
    return out


def scan_rows(least: int):
    """Sorted suffixes (row, start, left, suffix) of one part to its places, its closed groups, and blocks for the open ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        prefix, lefts, first, before, n = [], [], b"", b"", 0
        for b in sliced(batches):
            for row, start, left, suffix in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                first = suffix if not n else first
                prefix.append(common(before, suffix) if n else 0)
                lefts.append((left, left))
                yield PLACE, part, n, None, None, row, start, None, None, None, None
                before, n = suffix, n + 1
        for lo, hi, length, left in intervals(prefix, lefts, least):
            if lo > 0 and hi < n - 1 and diverse(left):
                yield GROUP, part, lo, hi, length, None, None, None, None, None, None
        if n:
            back = [0, *prefix[:0:-1]]
            cuts = sorted({0, n, *falls(prefix), *(n - i for i in falls(back))})
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                low, high = min(x[0] for x in lefts[a:z]), max(x[1] for x in lefts[a:z])
                yield BLOCK_ROW, part, a, z - 1, prefix[a], None, None, low, high, first if a == 0 else None, before if z == n else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), FOUND)

    return run


def close_rows(least: int):
    """All parts' blocks, in order (part, lo, hi, length, low, high, first, last), to the groups that touch a part's edge."""
    schema = pa.schema([("part", pa.int32()), ("lo", pa.int64()), ("to_part", pa.int32()), ("hi", pa.int64()), ("length", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        blocks, prefix, lefts, before = [], [], [], b""
        ends: dict[int, int] = {}
        for b in sliced(batches):
            for part, lo, hi, length, low, high, first, last in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                prefix.append(common(before, first) if first is not None else length)
                blocks.append((part, lo, hi))
                lefts.append((low, high))
                before = last if last is not None else before
                ends[part] = hi
        for a, z, length, left in intervals(prefix, lefts, least):
            (part, lo, _), (to_part, _, hi) = blocks[a], blocks[z]
            if a < z and (part != to_part or lo == 0 or hi == ends[part]) and diverse(left):
                yield part, lo, to_part, hi, length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), schema)

    return run


def suffixes(documents: DataFrame, least: int = LEAST, kmer: int = KMER, reach: int = REACH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The written documents with numbered rows, and the suffixes that can begin a maximal repeat."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(rows, "numbered")
    entries = materialize(rows.select("row", "text").mapInArrow(entry_rows(least, kmer, block), "row long, key long, sh long, left int, start long, len int"), "entries")
    known = marks(rows, entries, least)
    mark = F.struct("start", "repeated", "diverse")
    per_row = entries.join(known, ["key", "sh"]).groupBy("row").agg(F.collect_list(mark).alias("marks"))
    found = rows.select("row", "text").join(per_row, "row").select("row", "text", "marks").mapInArrow(suffix_rows(least, reach), "row long, start long, left int, suffix binary")
    return rows, materialize(found, "suffixes")


def repeat_groups(documents: DataFrame, least: int = LEAST, kmer: int = KMER, reach: int = REACH, block: int = BLOCK, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(groups, places): lo, hi (ranks), length and n of each maximal repeat; rank, doc_id, row and start of each sorted suffix."""
    spark = documents.sparkSession
    rows, found = suffixes(documents, least, kmer, reach, block)
    size = found.agg(F.sum(F.octet_length("suffix") + 40)).first()[0] or 0
    parts = parts_for(spark, size, part_bytes)
    dealt = found.repartitionByRange(parts, "suffix", "row", "start").sortWithinPartitions("suffix", "row", "start")
    scanned = materialize(dealt.select("row", "start", "left", "suffix").mapInArrow(scan_rows(least), FOUND_DDL), "scanned")
    blocks = scanned.filter(F.col("kind") == BLOCK_ROW).select("part", "lo", "hi", "length", "low", "high", "first", "last")
    closed = blocks.repartition(1).sortWithinPartitions("part", "lo").mapInArrow(close_rows(least), "part int, lo long, to_part int, hi long, length long")
    # Ranks within parts become ranks: one row for each part.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("part").agg((F.max("hi") + 1).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).select("part", "base")
    inner = scanned.filter(F.col("kind") == GROUP).select("part", "lo", F.col("part").alias("to_part"), "hi", "length")
    to = base.select(F.col("part").alias("to_part"), F.col("base").alias("to_base"))
    groups = inner.unionByName(closed).join(F.broadcast(base), "part").join(F.broadcast(to), "to_part")
    groups = groups.select((F.col("lo") + F.col("base")).alias("lo"), (F.col("hi") + F.col("to_base")).alias("hi"), "length")
    places = scanned.filter(F.col("kind") == PLACE).join(F.broadcast(base), "part").select((F.col("lo") + F.col("base")).alias("rank"), "row", "start")
    places = places.join(rows.select("row", "doc_id"), "row").select("rank", "doc_id", "row", "start")
    return groups.withColumn("n", F.col("hi") - F.col("lo") + 1), places


def occurrences(groups: DataFrame, places: DataFrame) -> DataFrame:
    """lo, hi, length, doc_id, row and start: every occurrence of every group, spelt out."""
    each = groups.select("lo", "hi", "length", F.explode(F.sequence("lo", "hi")).alias("rank"))
    return each.join(places, "rank").select("lo", "hi", "length", "doc_id", "row", "start")
