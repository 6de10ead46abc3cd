"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at ``threshold`` (3) or fewer differing bits. By the pigeonhole principle two linked
fingerprints differ in at most one bit of their upper or of their lower 32 bits. On each half the anchors are the words of
a covering code of radius 1: the perfect Hamming code of 31 bits, times the last bit. A fingerprint is at home at its
nearest anchor (distance 0 or 1) and is replicated to every anchor within covering radius plus threshold, 1 + 1 (2 or 17
anchors): so each linked pair meets at the home of either. Fingerprints are compared per anchor only.

Equal fingerprints are one class before anything is replicated, so copies cost nothing further. Anchors with more than
``limit`` fingerprints are split by the bytes of the other half (of four bytes, three differing bits leave one equal), and
inside a group only a spanning forest of its links is emitted, never all pairs.

Defined cases: a null text has no words, and no words give fingerprint zero, linked like any other. Rows with equal ids
stay separate rows. A null doc_id takes part; it is never the smallest id unless its whole component has none. Columns
beyond doc_id and text are ignored by ``components`` and kept by ``keep_first``. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import files_for, materialize, sliced, text_bytes, unsigned_hex

SHINGLE, SEED, THRESHOLD, LIMIT = 3, 42, 3, 4096
EDGES_A_FILE = 250_000
#: Bytes that a fingerprint takes at its anchors.
REPLICAS = 500
ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text, unsigned. bytes.lower and bytes.split treat exactly A-Z and the six white-space bytes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    if len(words) > shingle:
        first, last = starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist()
    else:
        first, last = [0], [len(joined)]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(first)
    for at in range(0, n, 65536):  # a bounded part at a time, however long the text
        part = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + 65536], last[at : at + 65536], strict=True)], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(documents: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long."""
    rows = documents.select(*keep, F.col("text").cast("string").alias("text"))
    fields = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = np.array([fingerprint(t) for t in text_bytes(b.column(b.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], [*b.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp long"]))


# The code of 31 bits: a word's syndrome is the XOR of the positions (1 to 31) of its set bits; position p is bit p - 1.
MASKS = [np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)) for k in range(5)]
#: For each syndrome s > 0, the 15 words of two bits at positions i < j with i XOR j = s.
PAIRS = np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)], np.uint64)


def home(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest anchor of words of 32 bits, and their syndromes."""
    low = word & np.uint64(0x7FFFFFFF)
    s = np.zeros(len(word), np.uint64)
    for k, mask in enumerate(MASKS):
        s |= (np.bitwise_count(low & mask).astype(np.uint64) & ONE) << np.uint64(k)
    flip = np.where(s > 0, ONE << (np.maximum(s, ONE) - ONE), np.uint64(0))
    return word ^ flip, s


def halves(fps: np.ndarray) -> list[np.ndarray]:
    return [fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32)]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of its fingerprint) for all anchors within distance 2, on both halves; the half is bit 32."""
    keys, rows, every = [], [], np.arange(len(fps))
    for side, word in enumerate(halves(fps)):
        at, s = home(word)
        mark = np.uint64(side << 32)
        keys += [at | mark, (at ^ np.uint64(1 << 31)) | mark]
        rows += [every, every]
        off = np.flatnonzero(s)
        keys.append((word[off, None] ^ PAIRS[(s[off] - ONE).astype(np.int64)] | mark).ravel())
        rows.append(np.repeat(off, 15))
    return np.concatenate(keys), np.concatenate(rows)


def forest(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a group: each member is compared once with those not yet reached."""
    a, b = [], []
    rest = fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= threshold
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                front.extend(found)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def sub_keys(anchor: int, fps: np.ndarray) -> np.ndarray:
    """For members of a crowded anchor: one key for each byte of the other half."""
    other = halves(fps)[0 if anchor >> 32 else 1]
    k = np.arange(4, dtype=np.uint64)
    byte = other[:, None] >> (k * np.uint64(8)) & np.uint64(255)
    return (np.uint64(anchor) << np.uint64(10)) | (k << np.uint64(8)) | byte


def small_links(keys: np.ndarray, fps: np.ndarray, cuts: np.ndarray, at_home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many groups at once. cuts: the groups' bounds. Members not at home are compared with those at home."""
    sizes = np.diff(cuts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    h = np.flatnonzero(at_home)
    per = sizes[group[h]]
    left = np.repeat(h, per)
    right = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(cuts[:-1][group[h]], per)
    near = (np.bitwise_count(fps[left] ^ fps[right]) <= threshold) & (fps[left] != fps[right])
    return fps[left[near]], fps[right[near]]


def link_rows(limit: int, threshold: int, level: int):
    """Rows (key, fp), sorted by key, to rows (kind 0: link a, b; kind 1: member b of sub-group a)."""

    def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"]
        )

    def done(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        bounds = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        sizes = np.diff(bounds)
        at_home = np.ones(len(keys), bool)
        if level == 1:
            side = keys >> np.uint64(32) > 0
            low, high = halves(fps)
            at_home = home(np.where(side, high, low))[0] == keys & np.uint64(0xFFFFFFFF)
        use = (sizes > 1) & (sizes <= 48) & (np.add.reduceat(at_home, bounds[:-1]) > 0)
        inside = np.repeat(use, sizes)
        if inside.any():
            cuts = np.concatenate(([0], np.cumsum(sizes[use])))
            a, b = small_links(keys[inside], fps[inside], cuts, at_home[inside], threshold)
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield out(0, *spanning(pair[0], pair[1]))
        for g in np.flatnonzero(sizes > 48):
            a, b = forest(np.unique(fps[bounds[g] : bounds[g + 1]]), threshold)
            if len(a):
                yield out(0, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, crowded = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if crowded is not None:  # the rest of a group that was handed on
                more = int(np.searchsorted(k != crowded, True)) if (k != crowded).any() else len(k)
                if more:
                    yield out(1, sub_keys(int(crowded), f[:more]).ravel(), np.repeat(f[:more], 4))
                k, f = k[more:], f[more:]
                if len(k):
                    crowded = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            if not len(keys):
                continue
            start = int(np.flatnonzero(keys == keys[-1])[0])  # the last group may go on
            yield from done(keys[:start], fps[:start])
            keys, fps = keys[start:], fps[start:]
            if level == 1 and len(keys) > limit:
                crowded = keys[-1]
                yield out(1, sub_keys(int(crowded), fps).ravel(), np.repeat(fps, 4))
                keys, fps = keys[:0], fps[:0]
        yield from done(keys, fps)

    return run


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of given links, one from each node to its component's smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


LINK = "kind int, a long, b long"


def links(classes: DataFrame, limit: int = LIMIT, threshold: int = THRESHOLD, files: int | None = None) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints fp. files: how many are written, at most."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 20_000):
                key, row = anchors(part := fps[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row].view(np.int64))], ["key", "fp"])

    met = classes.select("fp").mapInArrow(replicate, "key long, fp long")
    first = met.repartition("key").sortWithinPartitions("key").mapInArrow(link_rows(limit, threshold, 1), LINK)
    first = materialize(first.coalesce(files) if files else first, "links")
    crowded = first.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    second = crowded.repartition("key").sortWithinPartitions("key").mapInArrow(link_rows(limit, threshold, 2), LINK)
    return first.unionByName(second).filter("kind = 0").select("a", "b")


def connect(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large-star and small-star steps."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")).toDF("u", "v") if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(low, "u")
        if large:
            new = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        return new.filter("a <> b").distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.distinct().coalesce(files) if files else edges.distinct(), "edges")
    seen = sign(now)
    while seen[0]:
        # Stars never add edges, so the files needn't be more than this many were worth.
        new = materialize(star(star(now, True), False).coalesce(1 + seen[0] // EDGES_A_FILE), "edges")
        again = sign(new)
        if again == seen:
            break
        now, seen = new, again
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def fingerprinted(documents: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n (its bytes) and fp of each row, written."""
    rows = documents.withColumn("th", F.xxhash64("text")).withColumn("n", F.octet_length("text"))
    return materialize(fingerprints(rows, "doc_id", "th", "n"), "fingerprints")


def named(classes: DataFrame, limit: int) -> DataFrame:
    """Classes (fp, ...), one row for each fingerprint, with the root that names their component."""
    files = files_for(classes.sparkSession, REPLICAS * classes.count())
    roots = connect(links(classes, limit, files=files), files)
    return classes.join(roots, classes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def components(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """For each row doc_id, fp, th (hash of the text), root (fingerprint that names the component) and component_id."""
    return grouped(fingerprinted(documents), limit)


def grouped(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """components() from rows that have their fingerprint fp."""
    found = named(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), limit)
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(found.select("fp", "root").join(ids, "root"), "fp")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    return components(documents).select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row of each component, whole: that with the smallest (doc_id, hash of text); of equal rows one.

    Copies are combined before they are shuffled: only a row for each fingerprint meets the links.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("th").alias("th"))
    prints = fingerprinted(documents)
    n_bytes = prints.agg(F.sum("n")).first()[0] or 0
    classes = prints.groupBy("fp").agg(F.min(order).alias("k"))
    first = named(classes, limit).groupBy("root").agg(F.min("k").alias("k")).select(*[F.col(f"k.{c}").alias(f"k_{c}") for c in KEY])
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)])
    wide = documents.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("th"), own.alias("own"))
    met = wide.join(first, [wide[c] == first[f"k_{c}"] for c in KEY], "left_semi")
    one = met.groupBy(*KEY).agg(F.first("own").alias("own"))  # dealt as the join has dealt it
    one = one.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(documents.columns)])
    return one.coalesce(files_for(documents.sparkSession, n_bytes))


KEY = ("none", "id", "th")
