"""Suffix-array dedup: maximal repeats by the common-prefix interval tree of an enhanced suffix array.

A repeat is a string of ``least`` (50) bytes or more that occurs twice. Whole texts are UTF-8 bytes; repeats never cross
documents. The suffix array of a corpus is never built in one place. Every window of ``least`` bytes is assigned to its
minimizer (the 24-byte substring of smallest hash), and the maximal runs of windows with one minimizer, segments of 50 to
76 bytes, are the unit of work: equal windows have equal minimizers, so all suffixes that share 50 bytes meet.

1. ``index``: the segments' hashes, packed per bucket of minimizers, are shuffled once (about one entry in 14 bytes).
   Of equal segments all but those of the smallest document are repeats throughout: that is settled within the task
   that reads them where it can be, so a segment in a third of all documents sends one entry a task.
2. ``resolve``: minimizers that have one segment are done. Where segments differ, one document's copies of each are wanted.
3. ``fetch``: the wanted segments' bytes are cut from the texts and dealt by minimizer; those of a crowded minimizer are
   dealt suffix by suffix, by the suffix's first ``least`` bytes, equal ones combined before they are sent.
4. ``scan``: of what meets, an enhanced suffix array (suffixes, common prefixes, left neighbours) is scanned with a stack;
   intervals with different left neighbours are the maximal repeat groups of what was fetched.

Which bytes of each document are repeats is exact. Repeat groups with all their occurrences are not an output: an interval
holds the fetched copy of each different segment alone (equal segments, and so exact copies of whole documents, are settled
by hash in steps 1 and 2 and give no interval), and it reaches over one segment. To give groups, every settled copy would
have to be shuffled again by its hash and overlapping groups be chained over whole documents; nothing here does that.

Defined cases: a null text is empty; a null doc_id is smaller and larger than none, so such rows neither lose nor remove
anything; rows with one doc_id are no smaller documents to each other; repeated rows get equal results; columns beyond
doc_id and text are ignored by ``report`` and kept by ``dedup_text``, which drops the bytes of a character that a repeat
cuts through. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import files_for, materialize, parts_for, sliced, text_bytes

LEAST, KMER = 50, 24
BLOCK, FLUSH, LEAST_BUCKETS, BUCKET = 1 << 18, 350_000, 12, 12 << 20
#: More wanted strings than this under one minimizer are dealt suffix by suffix.
HOT = 1000
BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


TABLE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size, both = max(n, 1 << 16), []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


def prefixes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers(len(data) + 1)[1][: len(data)], out=out[1:])
    return out


def hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end), the same wherever they are."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[0][start]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def segments(data: np.ndarray, owner: np.ndarray, least: int, kmer: int) -> tuple[np.ndarray, ...]:
    """Of texts that lie end to end (owner: whose byte each is): segment starts, ends, minimizer and segment hashes."""
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    q = prefixes(data)
    n = len(data) - kmer + 1
    h = (q[kmer:] - q[:-kmer]) * powers(len(q))[0][:n]
    order = _mixed(h)
    low = np.uint64((1 << 22) - 1)
    at = sliding_min((order & ~low) | np.arange(n, dtype=np.uint64), least - kmer + 1) & low
    inside = owner[: len(at)] == owner[least - 1 :]
    new = np.empty(len(at), bool)
    new[0], new[1:] = True, (at[1:] != at[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    # A run ends before the next start, or where windows begin to cross texts.
    count = np.add.reduceat(inside, first)
    end = first + count + least - 1
    place = at[first].astype(np.int64)
    key = _mixed(h[place] + np.uint64(1))
    whole = _mixed(hashes(q, first, end) + ((end - first) * 1024 + place - first).astype(np.uint64))
    return first, end, key, whole



def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def restore(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


ENTRY = (("mh", "<u4"), ("sh", "<u8"), ("doc", "<i8"), ("rk", "<i4"), ("start", "<u4"), ("len", "u1"))
SPAN = np.dtype([("start", "<u4"), ("len", "<u4")])
WANT = np.dtype([("start", "<u4"), ("len", "<u4"), ("key", "<i8")])


def packed(e: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    """Entries as one compressed blob, column after column; documents as differences."""
    doc = e["doc"][at]
    parts = {name: e[name][at] for name, _ in ENTRY} | {"doc": np.diff(doc, prepend=0)}
    return squeeze(b"".join(parts[name].astype(t).tobytes() for name, t in ENTRY))


def unpacked(blob: bytes) -> dict[str, np.ndarray]:
    raw = restore(blob)
    n, at, out = len(raw) // sum(np.dtype(t).itemsize for _, t in ENTRY), 0, {}
    for name, t in ENTRY:
        out[name] = np.frombuffer(raw, t, n, at)
        at += n * np.dtype(t).itemsize
    out["doc"] = np.cumsum(out["doc"])
    return out


def by_document(doc: np.ndarray, rk: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, rk, packed rows) of each document."""
    order = np.lexsort((rows["start"], rk, doc))
    doc, rk, rows = doc[order], rk[order], rows[order]
    cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (rk[1:] != rk[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
        if b > a:
            yield int(doc[a]), int(rk[a]), rows[a:b].tobytes()


def index_rows(buckets: int, least: int, kmer: int, block: int, flush: int):
    """Rows (doc_id, rk, text) to rows (bucket, doc_id, rk, data): packed entries, or, with a doc_id, settled spans."""

    def emit(held: list[dict[str, np.ndarray]]) -> Iterator[tuple]:
        e = {k: np.concatenate([x.pop(k) for x in held]) for k in list(held[0])}
        order = np.lexsort((e["doc"], e["sh"], e["key"]))
        key, sh, doc = (e[x][order] for x in ("key", "sh", "doc"))
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (sh[1:] != sh[:-1])
        least_doc = doc[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        settled = np.zeros(len(key), bool)
        settled[order] = doc > least_doc
        bucket = ((e["key"] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
        e["mh"] = e["key"] >> np.uint64(32)
        go = np.flatnonzero(~settled)
        go = go[np.argsort(bucket[go], kind="stable")]
        for part in np.split(go, np.flatnonzero(np.diff(bucket[go])) + 1):
            if len(part):
                yield int(bucket[part[0]]), None, None, packed(e, part)
        spans = np.zeros(int(settled.sum()), SPAN)
        spans["start"], spans["len"] = e["start"][settled], e["len"][settled]
        yield from ((d % buckets, d, r, data) for d, r, data in by_document(e["doc"][settled], e["rk"][settled], spans))

    def entries(texts: list[bytes], docs: list[int], rks: list[int], base: list[int]) -> dict[str, np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        a, b, key, sh = segments(data, owner, least, kmer)
        of = owner[a]
        return {
            "key": key, "sh": sh, "doc": np.array(docs, np.int64)[of], "rk": np.array(rks, np.int32)[of],
            "start": (a - starts[of] + np.array(base, np.int64)[of]).astype(np.uint32), "len": (b - a).astype(np.uint8),
        }

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int, int]]:
        for b in sliced(batches):
            docs, rks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for d, r, t in zip(docs, rks, text_bytes(b.column(2)), strict=True):
                if len(t) >= least:
                    for at in range(0, max(1, len(t) - least + 1), block):  # long texts in parts; each window is in one
                        yield t[at : at + block + least - 1], d, r, at

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: list[tuple[bytes, int, int, int]] = []
        size, held, n = 0, [], 0
        for piece in pieces(batches):
            now.append(piece)
            size += len(piece[0])
            if size >= block:
                held.append(entries(*map(list, zip(*now, strict=True))))
                n += len(held[-1]["key"])
                now, size = [], 0
                if n >= flush:
                    yield from emit(held)
                    held, n = [], 0
        if now:
            held.append(entries(*map(list, zip(*now, strict=True))))
        if held:
            yield from emit(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), ENTRIES)

    return run


ENTRIES = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("rk", pa.int32()), ("data", pa.binary())])
RESOLVED = pa.schema([("doc_id", pa.int64()), ("rk", pa.int32()), ("spans", pa.binary()), ("wants", pa.binary())])


def resolve_rows(hot: int):
    """Rows of whole buckets to spans that are repeats throughout, and segments whose bytes are wanted.

    Blobs are unpacked as they come, and only arrays are held. The wants of a minimizer with more than `hot` of them get a
    negative key: their suffixes are dealt one by one.
    """

    def settled(bucket: int, held: list[dict[str, np.ndarray]]) -> Iterator[tuple]:
        e = {name: np.concatenate([x.pop(name) for x in held]) for name, _ in ENTRY}
        order = np.lexsort((e["doc"], e["sh"], e["mh"]))
        for name in e:
            e[name] = e[name][order]
        mh, sh, doc = e["mh"], e["sh"], e["doc"]
        new_mh = np.ones(len(mh), bool)
        new_mh[1:] = mh[1:] != mh[:-1]
        new_sh = new_mh.copy()
        new_sh[1:] |= sh[1:] != sh[:-1]
        group_of = np.cumsum(new_mh) - 1
        starts = np.flatnonzero(new_mh)
        several = (np.add.reduceat(new_sh, starts) > 1) & (np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts))
        first_doc = doc[np.maximum.accumulate(np.where(new_sh, np.arange(len(mh)), 0))]
        repeat, want = doc > first_doc, (doc == first_doc) & several[group_of]
        crowded = np.add.reduceat(want, starts, dtype=np.int64)[group_of] > hot
        spans = np.zeros(int(repeat.sum()), SPAN)
        spans["start"], spans["len"] = e["start"][repeat], e["len"][repeat]
        yield from ((d, r, x, None) for d, r, x in by_document(doc[repeat], e["rk"][repeat], spans))
        wants = np.zeros(int(want.sum()), WANT)
        wants["start"], wants["len"] = e["start"][want], e["len"][want]
        name = mh[want].astype(np.int64) << 31 | bucket  # a name for the minimizer
        wants["key"] = np.where(crowded[want], -1 - name, name)
        yield from ((d, r, None, x) for d, r, x in by_document(doc[want], e["rk"][want], wants))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[int, list[dict[str, np.ndarray]]] = {}
        for b in sliced(batches):
            for bucket, d, r, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if d is None:
                    held.setdefault(bucket, []).append(unpacked(data))
                else:
                    yield d, r, data, None
        for bucket in list(held):
            yield from settled(bucket, held.pop(bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), RESOLVED)

    return run


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Sorted disjoint intervals that cover the spans; touching ones are one."""
    if not len(spans):
        return []
    order = np.argsort(spans["start"], kind="stable")
    a = spans["start"][order].astype(np.int64)
    b = np.maximum.accumulate(a + spans["len"][order])
    cut = np.flatnonzero(a[1:] > b[:-1]) + 1
    return list(zip(a[np.concatenate(([0], cut))].tolist(), b[np.concatenate((cut - 1, [len(a) - 1]))].tolist(), strict=True))


def settle(text: bytes, spans: np.ndarray, with_text: bool) -> tuple[int, int, str, str | None]:
    """n_removed, n_spans, SHA-256 of what is left, and what is left as text."""
    cut = merged(spans)
    at, rest = 0, []
    for a, b in cut:
        rest.append(text[at:a])
        at = b
    left = b"".join([*rest, text[at:]])
    return len(text) - len(left), len(cut), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None


FETCHED = pa.schema(
    [("kind", pa.int32()), ("doc_id", pa.int64()), ("rk", pa.int32()), ("key", pa.int64()), ("starts", pa.binary()), ("data", pa.binary()),
     ("spans", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string()), ("left", pa.string())]
)
FETCHED_DDL = "kind int, doc_id long, rk int, key long, starts binary, data binary, spans binary, n_removed long, n_spans long, sha string, left string"
DONE, WAITS, SEGMENT = 0, 1, 2


def fetch_rows(with_text: bool, least: int):
    """Rows (doc_id, rk, text, spans, wants) to results, documents that wait (text compressed), and wanted strings.

    A wanted string is a segment, or, where its minimizer is crowded, each of its suffixes alone, cut to `least` bytes and
    keyed by them. Of equal suffixes in the rows at hand those of the smallest document go on; the others are settled here,
    so that a suffix in a third of all documents is sent once a batch.
    """

    def wanted(texts: list[bytes], docs: list[int], wants: list[np.ndarray], covered: list[list[bytes]]) -> Iterator[tuple[int, int, bytes, list[int]]]:
        """(row, key, string, its starts) of what is sent; what is settled here goes to covered."""
        suffixes: dict[bytes, dict[int, list[int]]] = {}
        for i, (t, want) in enumerate(zip(texts, wants, strict=True)):
            plain: dict[tuple[int, bytes], list[int]] = {}
            for start, length, key in want.tolist():
                if key >= 0:
                    plain.setdefault((key, t[start : start + length]), []).append(start)
                else:
                    for at in range(start, start + length - least + 1):
                        suffixes.setdefault(t[at : at + least], {}).setdefault(i, []).append(at)
            yield from ((i, key, string, starts) for (key, string), starts in plain.items())
        for string, found in suffixes.items():
            smallest = min(docs[i] for i in found)
            for i, starts in found.items():
                if docs[i] > smallest:
                    spans = np.zeros(len(starts), SPAN)
                    spans["start"], spans["len"] = starts, least
                    covered[i].append(spans.tobytes())
                else:
                    yield i, xxhash.xxh64_intdigest(string) >> 1, string, starts

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in sliced(batches):
            docs, rks, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))
            covered = [list(x) for x in b.column(3).to_pylist()]
            wants = [np.frombuffer(b"".join(x), WANT) for x in b.column(4).to_pylist()]
            for i, key, string, starts in wanted(texts, docs, wants, covered):
                yield SEGMENT, docs[i], rks[i], key, np.array(starts, "<u4").tobytes(), string, None, None, None, None, None
            for d, r, t, want, spans in zip(docs, rks, texts, wants, covered, strict=True):
                if len(want):
                    yield WAITS, d, r, None, None, squeeze(t), b"".join(spans), None, None, None, None
                else:
                    yield DONE, d, r, None, None, None, None, *settle(t, np.frombuffer(b"".join(spans), SPAN), with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), FETCHED)

    return run


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded numbers and bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes | str))
        if size > 4 << 20:
            yield batch(held, schema)
            held, size = [], 0
    if held:
        yield batch(held, schema)


def suffix_array(texts: list[bytes], least: int) -> tuple[list[bytes], np.ndarray, np.ndarray, list[int]]:
    """The suffixes of at least `least` bytes whose first `least` bytes occur twice, sorted.

    Gives the suffixes, whose they are, where they start, and the common prefix of each with the one before.
    """
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(lengths) - lengths
    per = np.maximum(lengths - least + 1, 0)
    who = np.repeat(np.arange(len(texts)), per)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    place = base[who] + at
    h = hashes(prefixes(data), place, place + least)
    order = np.argsort(h, kind="stable")
    twin = np.zeros(len(h), bool)
    equal = h[order][1:] == h[order][:-1]
    twin[order[1:][equal]] = twin[order[:-1][equal]] = True
    who, at = who[twin], at[twin]
    suffixes = [texts[w][a:] for w, a in zip(who.tolist(), at.tolist(), strict=True)]
    order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
    if not len(order):
        return [], who, at, []
    suffixes = [suffixes[i] for i in order.tolist()]
    who, at = who[order], at[order]
    prefix = [0]
    for a, b in zip(suffixes[:-1], suffixes[1:], strict=True):
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            prefix.append(n)
        elif a[:least] != b[:least]:
            prefix.append(0)
        else:
            low, high = least, n  # equal up to low, different within high
            while high - low > 1:
                mid = (low + high) // 2
                if a[low:mid] == b[low:mid]:
                    low = mid
                else:
                    high = mid
            prefix.append(low)
    return suffixes, who, at, prefix


def maximal_repeats(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeat groups of at least `least` bytes: (length, whose, start) with all occurrences.

    A stack holds the open intervals of the common-prefix tree; an interval is closed when the common prefix falls below
    its own. It is a maximal repeat if its suffixes are preceded by different bytes, or one begins a text.
    """
    suffixes, who, at, prefix = suffix_array(texts, least)
    n = len(suffixes)
    edge = -1  # before a text's first byte: unlike any other
    left = [texts[w][a - 1] if a else edge for w, a in zip(who.tolist(), at.tolist(), strict=True)]
    stack: list[list] = []  # [common prefix, first suffix, left byte or None if they differ]
    for i in range(1, n + 1):
        now = prefix[i] if i < n else 0
        first, before = i - 1, left[i - 1] if left[i - 1] != edge else None
        while stack and stack[-1][0] > now:
            length, first, byte = stack.pop()
            byte = byte if byte is not None and byte == before else None
            if byte is None:
                yield length, who[first:i], at[first:i]
            before = byte
        if now < least:
            continue
        if stack and stack[-1][0] == now:
            top = stack[-1]
            top[2] = top[2] if top[2] is not None and top[2] == before else None
        else:
            stack.append([now, first, before])


def repeated_spans(texts: list[bytes], docs: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(whose, start, length) of each occurrence in a document that is not the smallest of its group, longest first.

    Groups come from the inside out, so what an inner group has settled need not be told again by those around it.
    """
    told: set[tuple[int, int]] = set()
    for length, who, at in maximal_repeats(texts, least):
        of = docs[who]
        for i in np.flatnonzero(of > of.min()).tolist():
            key = (int(who[i]), int(at[i]))
            if key not in told:
                told.add(key)
                yield *key, length


SCANNED = pa.schema([("doc_id", pa.int64()), ("rk", pa.int32()), ("spans", pa.binary())])


def scan_rows(least: int):
    """Rows (key, doc_id, rk, starts, data), sorted by key, to spans by document.

    A key's rows are bounded: a crowded minimizer's suffixes have keys of their own.
    """

    def done(rows: list[tuple]) -> Iterator[tuple]:
        found = list(repeated_spans([x[4] for x in rows], np.array([x[1] for x in rows], np.int64), least))
        if not found:
            return
        who, at, length = np.array(found, np.int64).T
        starts = [np.frombuffer(x[3], "<u4").astype(np.int64) for x in rows]
        times = np.array([len(x) for x in starts])[who]
        spans = np.zeros(int(times.sum()), SPAN)
        spans["start"] = np.concatenate([starts[w] for w in who.tolist()]) + np.repeat(at, times)
        spans["len"] = np.repeat(length, times)
        docs, rks = np.array([x[1] for x in rows], np.int64), np.array([x[2] for x in rows], np.int32)
        yield from by_document(np.repeat(docs[who], times), np.repeat(rks[who], times), spans)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        size = 0
        for b in sliced(batches):
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= 1 << 19 and row[0] != held[-1][0]:
                    yield from done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from done(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(spans(batches), SCANNED)

    return run


def settle_rows(with_text: bool):
    """Waiting documents (doc_id, rk, data, spans, more) to results."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in sliced(batches):
            for d, r, data, spans, more in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                yield d, r, *settle(restore(data), np.frombuffer(spans + b"".join(more or []), SPAN), with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), RESULT)

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("rk", pa.int32()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string()), ("left", pa.string())])
RESULT_DDL = "doc_id long, rk int, n_removed long, n_spans long, sha string, left string"


def row_key(text: str | Column = "text") -> Column:
    """With doc_id, what tells rows apart: 32 bits of the text's hash."""
    return F.shiftright(F.xxhash64(text), 32).cast("int")


def text_total(documents: DataFrame) -> int:
    return documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def changes(documents: DataFrame, with_text: bool, least: int = LEAST, kmer: int = KMER, block: int = BLOCK, flush: int = FLUSH, hot: int = HOT, bucket_bytes: int = BUCKET, total: int | None = None) -> DataFrame:
    """RESULT rows of the documents that lose bytes (and of some that lose none). total: the texts' bytes, where they are known."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text")
    total = text_total(documents) if total is None else total
    buckets = parts_for(documents.sparkSession, total, bucket_bytes, LEAST_BUCKETS)

    # A bucket's number is its partition: hashing numbers would leave some tasks empty and give others several.
    entries = rows.mapInArrow(index_rows(buckets, least, kmer, block, flush), "bucket int, doc_id long, rk int, data binary")
    resolved = entries.repartitionById(buckets, F.col("bucket")).mapInArrow(resolve_rows(hot), "doc_id long, rk int, spans binary, wants binary")
    resolved = materialize(resolved, "resolved")

    per_document = resolved.groupBy("doc_id", "rk").agg(F.collect_list("spans").alias("spans"), F.collect_list("wants").alias("wants"))
    met = rows.join(per_document, ["doc_id", "rk"]).select("doc_id", "rk", "text", "spans", "wants")
    fetched = met.mapInArrow(fetch_rows(with_text, least), FETCHED_DDL)
    fetched = materialize(fetched.coalesce(files_for(documents.sparkSession, total)), "fetched")

    wanted = fetched.filter(F.col("kind") == SEGMENT).select("key", "doc_id", "rk", "starts", "data")
    scanned = wanted.repartition("key").sortWithinPartitions("key").mapInArrow(scan_rows(least), "doc_id long, rk int, spans binary")
    more = scanned.groupBy("doc_id", "rk").agg(F.collect_list("spans").alias("more"))
    waiting = fetched.filter(F.col("kind") == WAITS).select("doc_id", "rk", "data", "spans").join(more, ["doc_id", "rk"], "left")
    late = waiting.select("doc_id", "rk", "data", "spans", "more").mapInArrow(settle_rows(with_text), RESULT_DDL)
    early = fetched.filter(F.col("kind") == DONE).select("doc_id", "rk", "n_removed", "n_spans", "sha", "left")
    return early.union(late)


def report(documents: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    found = changes(documents, False, **limits).dropDuplicates(["doc_id", "rk"])
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", row_key().alias("rk"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    return rows.join(found, ["doc_id", "rk"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"),
    )


def dedup_text(documents: DataFrame, **limits: int) -> DataFrame:
    """The documents, all of them, without their repeated bytes."""
    total = text_total(documents)
    found = changes(documents, True, total=total, **limits).filter("n_removed > 0").dropDuplicates(["doc_id", "rk"])
    found = found.select(F.col("doc_id").alias("r_id"), F.col("rk").alias("r_rk"), F.col("left").alias("r_left"))
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)])
    wide = documents.select(F.col("doc_id").cast("long").alias("d_id"), row_key(F.coalesce("text", F.lit(""))).alias("d_rk"), own.alias("own"))
    met = wide.join(found, (F.col("d_id") == F.col("r_id")) & (F.col("d_rk") == F.col("r_rk")), "left")
    at = documents.columns.index("text")
    text = F.when(F.col("r_id").isNotNull(), F.col("r_left")).otherwise(F.col(f"own.c{at}"))
    left = met.select(*[(text if i == at else F.col(f"own.c{i}")).alias(c) for i, c in enumerate(documents.columns)])
    return left.coalesce(files_for(documents.sparkSession, total))
