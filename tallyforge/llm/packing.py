"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

Documents are tokenised and closed by an end id. Longer ones than a sequence are cut so that their first piece takes the
rest and every other piece is full. Only lengths matter to packing, and there are at most ``capacity`` different ones: the
plan is made on the histogram of piece lengths, whatever the number of documents. The reduction fixes sets that provably
dominate every other set holding the largest piece; what is left is packed best-fit decreasing. The plan comes back as
runs of slots per length, and each piece takes the slot of its rank among the pieces of its length.

Defined cases: a null text is empty and gives the end id alone; rows with equal ids are packed as separate documents; ties
in rank are between pieces of equal length and fall to (doc_id, hash, piece); columns beyond doc_id and text are ignored.
An empty table gives an empty table. Tokenising takes whole texts; those with very long runs of white space (from ``BLANKS``
characters) or with the special token's text are coded by the tokenizers library, all others by the faster tiktoken.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import files_for, materialize, sliced

CAPACITY, END_ID, PART_ROWS, ROW_BYTES = 2048, 0, 500_000, 64
#: A text that holds this goes to the tokenizers library itself, which gives it an id of its own.
SPECIAL = "<|endoftext|>"
#: So does one with a run of white space that the fast encoder's pattern can't step back through (from about 500,000).
BLANKS = 10_000
blank_run = re.compile(rf"(?<!\s)\s{{{BLANKS}}}").search  # tried only where a run begins
_loaded: dict[tuple[str, str], tuple] = {}


def encoders(json_path: str, ranks_path: str) -> tuple:
    """The tokenizers library's encoder and, for the same vocabulary as ranks, the faster tiktoken one (once a process)."""
    if (json_path, ranks_path) not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[json_path, ranks_path] = (Tokenizer.from_file(json_path), fast)
    return _loaded[json_path, ranks_path]


def encode(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """The ids that the tokenizers library gives (add_special_tokens=False); both libraries agree on ordinary text."""
    slow, fast = encoders(json_path, ranks_path)
    plain = SPECIAL not in text and (len(text) < BLANKS or not blank_run(text))
    ids = fast.encode_ordinary(text) if plain else slow.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4")


def pieces(documents: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, th, piece, start, length, ids_crc32 of every piece."""
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(2)):
                ids = np.append(encode(text.as_py() or "", json_path, ranks_path), np.uint32(END_ID)).astype("<u4")
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - at) % capacity or capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at, k = at + n, k + 1
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "th", "piece", "start", "length", "ids_crc32"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Plan:
    """Bins as (pattern of lengths, how many such bins)."""

    bins: list[tuple[tuple[int, ...], int]]
    fixed: int  # bins that the reduction settled

    def runs(self) -> dict[int, np.ndarray]:
        """For each length, rows (first rank, first sequence, offset): equal ranks of a run go to consecutive sequences."""
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        ranks: dict[int, int] = defaultdict(int)
        base = 0
        for pattern, n in self.bins:
            at = 0
            for size in pattern:
                out[size].append((ranks[size], base, at))
                ranks[size] += n
                at += size
            base += n
        return {size: np.array(x, np.int64) for size, x in out.items()}


class Stock:
    """How many pieces of each length there are, with the largest length up to each room."""

    def __init__(self, count: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for size, n in count.items():
            self.count[size] = n
        self.refresh()

    def refresh(self) -> None:
        have = self.count > 0
        self.sizes = np.flatnonzero(have)
        self.floor = np.maximum.accumulate(np.where(have, np.arange(len(have)), 0))

    def largest(self, room: np.ndarray, *taken: np.ndarray) -> np.ndarray:
        """For each room the largest piece that fits beside the taken ones; 0 if none."""
        found = self.floor[np.maximum(room, 0)]
        for _ in taken:  # each can use up one length
            used = sum((found == t).astype(np.int64) for t in taken)
            found = np.where((found > 0) & (self.count[found] <= used), self.floor[np.maximum(found - 1, 0)], found)
        return found

    def smallest(self, n: int, j: int) -> int | None:
        """The weight of the n smallest pieces beside one of length j."""
        total = 0
        for s in self.sizes[: n + 1].tolist():
            k = min(n, int(self.count[s]) - (s == j))
            total, n = total + k * s, n - k
            if not n:
                return total
        return None


def dominating(stock: Stock, capacity: int, j: int) -> tuple[int, ...] | None:
    """A set with j that dominates every other set with j, if one is known.

    Let r be what j leaves. Such are {j} if nothing fits; {j, k} if k fills r exactly, or if k is the largest that fits, no three
    others fit, and no two that fit weigh more than k; {j, a, b} if no three fit, a is the largest that fits at all and b, the
    largest beside it, is no smaller than the smaller one of any two that fit. In each case the pieces of any other set with j
    can be swapped for the dominating ones without any other sequence growing.
    """
    room, own = capacity - j, np.array([j])
    k = int(stock.largest(np.array([room]), own)[0])
    if not k:
        return (j,)
    two, three = stock.smallest(2, j), stock.smallest(3, j)
    if k == room or two is None or two > room:
        return (j, k)
    if three is not None and three <= room:
        return None
    x = stock.sizes[(stock.count[stock.sizes] > (stock.sizes == j)) & (stock.sizes <= room)]
    y = stock.largest(room - x, np.broadcast_to(own, x.shape), x)
    if int((x + y)[y > 0].max(initial=0)) <= k:
        return (j, k)
    b = int(stock.largest(np.array([room - k]), own, np.array([k]))[0])
    if b and b >= int(np.minimum(x, y).max(initial=0)):
        return (j, k, b)
    return None


def reduce_by_dominance(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, piece by piece from the largest, and again while any was fixed; count keeps the rest.

    Taking a set away leaves fewer pieces, so the set dominates again while its pieces last: all such are fixed at once.
    """
    bins = []
    stock = Stock(count, capacity)
    shrunk = True
    while shrunk:
        shrunk = False
        for j in stock.sizes[::-1].tolist():
            while stock.count[j] and (found := dominating(stock, capacity, j)):
                need = {s: found.count(s) for s in found}
                n = min(int(stock.count[s]) // k for s, k in need.items())
                for s, k in need.items():
                    stock.count[s] -= n * k
                stock.refresh()
                bins.append((tuple(sorted(found, reverse=True)), n))
                shrunk = True
    count.clear()
    count.update((s, int(stock.count[s])) for s in stock.sizes.tolist())
    return bins


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: each length goes, as a block, to the fullest bins with room for it."""
    left: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # room left -> bins
    for size in sorted(count, reverse=True):
        n = count[size]
        room = size
        while n and room <= capacity:
            # Bins whose room becomes large enough again after this piece are met again, fuller, before looser ones.
            groups = left.get(room)
            if not groups:
                room += 1
                continue
            pattern, m = groups.pop()
            if not groups:
                del left[room]
            k = min(m, n)
            if m > k:
                left[room].append((pattern, m - k))
            left[room - size].append(((*pattern, size), k))
            n -= k
            room = size  # the fullest that fits may now be another
        if n:
            per = capacity // size
            if n // per:
                left[capacity - per * size].append(((size,) * per, n // per))
            if n % per:
                left[capacity - n % per * size].append(((size,) * (n % per), 1))
    return [g for groups in left.values() for g in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    count = {s: n for s, n in histogram.items() if n}
    full = count.pop(capacity, 0)
    bins = [((capacity,), full)] if full else []
    bins += reduce_by_dominance(count, capacity)
    fixed = sum(n for _, n in bins)
    return Plan(bins + best_fit(count, capacity), fixed)


def pack(documents: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = documents.sparkSession
    cut = materialize(pieces(documents, capacity, json_path, ranks_path), "pieces")
    # The rank among pieces of one length: any length may be common, so each is ranked in parts, with the parts' offsets.
    # A part holds the pieces of a length whose hash falls to it; more pieces make more parts.
    n_pieces = cut.count()
    parts = max(8, n_pieces // PART_ROWS)
    keyed = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "th", "piece"), F.lit(parts)))
    sums = keyed.groupBy("length", "part").agg(F.count("*").alias("n"))
    # At most `capacity` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity).runs()
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "part").orderBy("doc_id", "th", "piece")
    ranked = keyed.withColumn("own", F.row_number().over(order)).join(before, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    ranked = ranked.coalesce(files_for(spark, n_pieces * ROW_BYTES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = length == size
                slots = runs[int(size)]
                i = np.searchsorted(slots[:, 0], rank[at], "right") - 1
                sequence[at] = slots[i, 1] + rank[at] - slots[i, 0]
                offset[at] = slots[i, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
