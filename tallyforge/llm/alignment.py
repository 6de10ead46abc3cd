"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A is a byte-level BPE over a space and the text, B a SentencePiece model over the text (it adds the space itself). The tokens of B are
disjoint byte intervals in order, so their ends and starts, as two sorted arrays, are a static interval index: each A token
bisects both for the first and the last interval that it overlaps. An A token's end that no interval spans is a group boundary.

Texts are aligned in blocks of about ``BLOCK`` bytes, end to end: a text's end is a boundary for both, so nothing crosses it. A block
is one row of a written table, with the links of its documents as numbers of its distinct id pairs. How many links of the corpus hold a pair is then
a sum over the blocks' pairs, a B id's best count a maximum over its partners, and both go back to the blocks by a join on the pair: rows are
dealt by pair and block, never by document, and a pair that every document holds is one row for each block. No table is broadcast by hint.

Defined cases: null and empty texts, and texts whose joined bytes by A or B aren't a space and the text (such as those that hold
U+2581, which B can't tell from a space), have no tokens: zeros and ''. Strings of special tokens in a text are plain text. Repeated
rows are documents of their own and count in the corpus; a null doc_id stays null; columns beyond doc_id and text are ignored; an empty table
gives an empty table. Texts are aligned whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .divergence import within
from .shared import by_bytes, materialize

BLOCK = 2 << 20
NOTHING = (np.zeros(0, np.int32), np.zeros(0, np.int32))
#: Texts with a run of so many white space characters are coded by the tokenizers library (the fast pattern can't step back so far).
blank_run = re.compile(r"(?<!\s)\s{10000}").search


@dataclass(frozen=True)
class Files:
    """The two vocabularies: A as JSON and, the same, as ranks (which name each entry's bytes); B's model."""

    a: str
    ranks: str
    b: str

    @classmethod
    def public(cls) -> Files:
        return cls(*map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


class Coders:
    """Both encoders and the bytes of every id; loaded once in a process."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken

        self.files = files
        with open(files.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = sorted(ranks, key=ranks.__getitem__)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.b)
        self.b_bytes = [self.piece_bytes(i) for i in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    @cached_property
    def slow(self):
        """The tokenizers library's encoder, loaded where a text needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.files.a)
        found.encode_special_tokens = True  # their strings in a text are plain text
        return found

    def piece_bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B; none where one of them doesn't give the bytes back."""
        if not text:
            return NOTHING
        spaced = " " + text
        a = self.slow.encode(spaced, add_special_tokens=False).ids if len(text) >= 10_000 and blank_run(text) else self.fast.encode_ordinary(spaced)
        b = self.pieces.encode(text, num_threads=1)
        want = spaced.encode()
        fits = b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want
        return (np.array(a, np.int32), np.array(b, np.int32)) if fits else NOTHING


@lru_cache(maxsize=4)
def coders(files: Files) -> Coders:
    return Coders(files)


@dataclass
class Alignment:
    """Tokens of A and B over the same bytes. Links are pairs of token places; groups are cut after these tokens."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray  # for each A token: does a group end with it
    group_a: np.ndarray
    group_b: np.ndarray


def align(a_size: np.ndarray, b_size: np.ndarray) -> Alignment:
    """Of the lengths in bytes of both tokenizers' tokens, which cover the same bytes; all are positive."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    first = np.searchsorted(b_end, a_end - a_size, "right")
    last = np.searchsorted(b_end - b_size, a_end, "left")
    n = last - first
    cut = b_end[last - 1] == a_end if len(a_end) else np.zeros(0, bool)
    ends = a_end[cut]
    return Alignment(np.repeat(np.arange(len(n)), n), np.repeat(first, n) + within(n), cut, np.searchsorted(ends, a_end, "left"), np.searchsorted(ends, b_end, "left"))


@lru_cache(maxsize=1)
def written(n: int) -> list[bytes]:
    """Each id before a comma, a bar and a semicolon."""
    return [b"%d%s" % (i, sep) for i in range(n) for sep in (b",", b"|", b";")]


def group_texts(a: np.ndarray, b: np.ndarray, found: Alignment, a_cuts: np.ndarray, b_cuts: np.ndarray, vocabulary: int) -> list[bytes]:
    """For each document (its places in a and b) its groups as `a1,a2|b1;a3|b2,b3`."""
    last_a, last_b = found.cut_a, np.append(found.group_b[1:] != found.group_b[:-1], True)[: len(b)]
    a_before, b_before = np.searchsorted(found.group_b, found.group_a, "left"), np.searchsorted(found.group_a, found.group_b, "right")
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + a_before] = a * 3 + last_a
    order[np.arange(len(b)) + b_before] = b * 3 + 2 * last_b
    texts, cuts = written(vocabulary), (a_cuts + b_cuts).tolist()
    return [b"".join(map(texts.__getitem__, order[x:y].tolist()))[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def packed(values: np.ndarray) -> bytes:
    raw = values.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), "<u4")


BLOCKS = (
    "block long, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, slots binary, pairs array<struct<slot:int,a:int,b:int,n:bigint>>"
)


def encode_all(texts: list[str | None], coder: Coders) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of A and B of all texts, one after the other, and where each text's begin (and the last ends)."""
    both = [coder.encode(t or "") for t in texts]
    out = []
    for side in (0, 1):
        sizes = np.array([len(x[side]) for x in both], np.int64)
        ids = np.concatenate([np.zeros(0, np.int32), *(x[side] for x in both)]).astype(np.int64)
        out.append((ids, np.concatenate([[0], np.cumsum(sizes)])))
    return out[0][0], out[0][1], out[1][0], out[1][1]


def blocks(documents: DataFrame, files: Files) -> DataFrame:
    """A row for each block of documents: their counts and digests, their links, and its distinct id pairs with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, number = coders(files), TaskContext.get().partitionId() << 32
        for batch in by_bytes(batches, 1, BLOCK):
            a, a_cuts, b, b_cuts = encode_all(batch.column(1).to_pylist(), coder)
            found = align(coder.a_size[a], coder.b_size[b])
            key = a[found.link_a] * len(coder.b_bytes) + b[found.link_b]
            slots, pairs = pd.factorize(key)
            n_groups = np.diff(np.concatenate([[0], np.cumsum(found.cut_a)])[a_cuts])
            n_links = np.diff(np.searchsorted(found.link_a, a_cuts))
            texts = group_texts(a, b, found, a_cuts, b_cuts, max(len(coder.a_bytes), len(coder.b_bytes)))
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
            row = {
                "block": number, "doc_id": batch.column(0).to_pylist(), "n_a": np.diff(a_cuts), "n_b": np.diff(b_cuts), "n_groups": n_groups,
                "n_links": n_links, "groups_sha256": digests, "slots": packed(slots),
            }
            times = np.bincount(slots, minlength=len(pairs))
            columns = [np.arange(len(pairs)), pairs // len(coder.b_bytes), pairs % len(coder.b_bytes)]
            entries = pa.StructArray.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(times)], ["slot", "a", "b", "n"])
            listed = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), entries)
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)), listed], [*row, "pairs"])
            number += 1

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def pair_counts(written_blocks: DataFrame) -> DataFrame:
    """a, b, n of every id pair: how many links of the corpus hold it; and best, the largest n of its b."""
    pairs = written_blocks.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.withColumn("best", F.max("n").over(Window.partitionBy("b")))  # at most A's vocabulary for each b


def report(documents: DataFrame, files: Files | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    aligned = materialize(blocks(documents, files or Files.public()), "aligned")
    counts = pair_counts(aligned).withColumnRenamed("n", "total")
    own = aligned.select("block", F.inline("pairs"))
    told = own.join(counts, ["a", "b"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slot", "total", (F.col("total") == F.col("best")).alias("top")))).alias("told"))
    rows = aligned.drop("pairs").join(told, "block", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", F.col("told.total").alias("total"), F.col("told.top").alias("top")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, n_a, n_b, n_groups, n_links, digests = (batch.column(c)[i].values for c in range(6))
                slots = unpacked(batch.column(6)[i].as_py())
                cuts = np.concatenate([[0], np.cumsum(n_links.to_numpy())])
                sums = []
                for c in (8, 7):
                    of_pair = batch.column(c)[i].values
                    of_link = of_pair.to_numpy(zero_copy_only=False).astype(np.int64)[slots] if len(slots) else np.zeros(0, np.int64)
                    sums.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(of_link)])[cuts])))
                yield pa.RecordBatch.from_arrays([doc_id, n_a, n_b, n_groups, n_links, *sums, digests], NAMES)

    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in NAMES))


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignments(documents: DataFrame, files: Files | None = None) -> DataFrame:
    """doc_id, a and b (ids), groups (how many of a and of b each takes, in order), links (places in a and in b) of every document."""
    chosen = files or Files.public()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coders(chosen)
        for batch in by_bytes(batches, 1, BLOCK >> 3):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = coder.encode(text or "")
                found = align(coder.a_size[a], coder.b_size[b])
                n = int(found.cut_a.sum())
                groups = zip(*(np.bincount(g, minlength=n).tolist() for g in (found.group_a, found.group_b)), strict=True)
                links = zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)
                out.append({"doc_id": doc_id, "a": a.tolist(), "b": b.tolist(), "groups": [{"n_a": x, "n_b": y} for x, y in groups], "links": [{"a": x, "b": y} for x, y in links]})
            yield pa.RecordBatch.from_pylist(out, pa.schema(ALIGNED))

    pair = lambda x, y: pa.list_(pa.struct([(x, pa.int32()), (y, pa.int32())]))
    ALIGNED = [("doc_id", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("groups", pair("n_a", "n_b")), ("links", pair("a", "b"))]  # noqa: N806
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a array<int>, b array<int>, groups array<struct<n_a:int,n_b:int>>, links array<struct<a:int,b:int>>")
