"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation is that of the highest sum of piece scores. Positions are taken from left to right; a position's best
way in comes from at most ``longest`` positions back, so scores are held of at most ``longest`` + 1 positions. Ids are committed as
soon as every surviving way leads through one boundary: at a position that no piece spans, or, where back-pointers have
piled up, at the last boundary that the ways to all live positions share. Where ways don't meet at all (periodic text such
as "aaaa...", whose best beginning depends on how it ends), they are folded from ``FOLD`` * ``longest`` back-pointers on: each of
the at most ``longest`` live positions keeps the ids of its way as repeated blocks. What a search holds is so bounded by the
model, not by the text; ``Model.held`` tells the most that was held.

Text is prepared as such models do: a leading space is added, and spaces become U+2581. Characters that no piece covers
fall back to their UTF-8 bytes' pieces. Pieces hold U+2581 only at their beginning (or nothing else), so a word with its
leading spaces is always closed by boundaries that no piece spans, where the search commits whatever came before. The ids
of such words are remembered in a bounded table, and only words that aren't in it are searched; there is one search for all.

Defined cases: null and empty texts have no ids and decode to the empty string; ties go to the longer last piece; U+2581 in a
text is a space to the model and decodes as one; ids outside the model are refused. Decoding gives back any other text
exactly. Rows are independent: repeated ones are coded alike, and columns beyond doc_id and text are ignored. An empty
table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sliced

SPACE = "▁"
REMEMBERED, LONG_WORD = 500_000, 400
#: Back-pointers, in lengths of the longest piece, from which ways that don't meet are folded.
FOLD = 16


class Ways:
    """The surviving ways of a search: back-pointers from positions, and roots from which the ways go on.

    At first there is one root, the start. Where ways don't meet for long they are folded: each position that can still be gone
    on from becomes a root with the ids of its way, as blocks of ids and how often they repeat. Ways that don't meet run
    through periodic text, so their ids are periodic too, and a root has few blocks.
    """

    def __init__(self, model: Model):
        self.model = model
        self.back: dict[int, tuple[int, int]] = {}  # position -> start and id of the last piece
        self.roots: dict[int, list[tuple[tuple[int, ...], int]]] = {0: []}
        self.most = self.folded = 0  # the most ids and back-pointers held at once; ids held in roots

    def note(self) -> None:
        held = len(self.back)
        if held > self.most - self.folded:
            self.most = held + self.folded

    def trace(self, text: str, end: int) -> tuple[int, list[int]]:
        """The root of the way to end, and the ids from there."""
        model, back, out = self.model, self.back, []
        while end in back:
            start, piece = back[end]
            if piece == model.unknown and model.bytes:
                out.extend(model.bytes[b] for b in reversed(text[start:end].encode("utf-8", "surrogatepass")))
            else:
                out.append(piece)
            end = start
        return end, out[::-1]

    def meeting(self, live: list[int]) -> int | None:
        """The last boundary on the ways to all live positions, if back-pointers still tell one."""
        held = set(live)
        while len(held) > 1:
            top = max(held)
            if top not in self.back:
                return None
            held.discard(top)
            held.add(self.back[top][0])
        found = held.pop()
        return None if list(self.roots) == [found] else found

    def commit(self, text: str, cut: int) -> list[int]:
        """The ids up to cut, which all ways lead through; it is the only root from now on."""
        self.note()
        root, ids = self.trace(text, cut)
        done = [i for block, times in self.roots[root] for _ in range(times) for i in block] if self.roots[root] else []
        self.back = {p: x for p, x in self.back.items() if p > cut} if max(self.back) > cut else {}
        self.roots, self.folded = {cut: []}, 0
        return done + ids if done else ids

    def fold(self, text: str, live: list[int]) -> None:
        self.note()
        found = {p: self.trace(text, p) for p in live}
        self.roots = {p: folded(self.roots[root], ids) for p, (root, ids) in found.items()}
        self.folded = sum(len(ids) for blocks in self.roots.values() for ids, _ in blocks)
        self.back = {}


def folded(blocks: list[tuple[tuple[int, ...], int]], ids: list[int], longest: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """Blocks and further ids as blocks: a last block that came once is taken up again, and repeats become one block."""
    out = list(blocks)
    if out and out[-1][1] == 1:
        ids = [*out.pop()[0], *ids]
    at = 0
    while at < len(ids):
        if out:  # the last block goes on
            block, times = out[-1]
            more = 0
            while tuple(ids[at : at + len(block)]) == block:
                at, more = at + len(block), more + 1
            out[-1] = (block, times + more)
            if more:
                continue
        best, reps = 1, 1
        for p in range(1, min(longest, (len(ids) - at) // 2) + 1):
            k = 1
            while ids[at + k * p : at + (k + 1) * p] == ids[at : at + p]:
                k += 1
            if k > 1 and k * p > best * reps:
                best, reps = p, k
        if reps > 1:
            out.append((tuple(ids[at : at + best]), reps))
            at += best * reps
        elif out and out[-1][1] == 1:
            out[-1] = ((*out[-1][0], ids[at]), 1)
            at += 1
        else:
            out.append(((ids[at],), 1))
            at += 1
    return out


class Model:
    """The pieces of a model file and the search over them."""

    def __init__(self, path: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(file.get_piece_size())
        self.names = [file.id_to_piece(i) for i in ids]
        usual = [i for i in ids if not (file.is_byte(i) or file.is_control(i) or file.is_unused(i) or file.is_unknown(i))]
        self.ids = {self.names[i]: (i, file.get_score(i)) for i in usual}
        self.bytes = {int(self.names[i][3:5], 16): i for i in ids if file.is_byte(i)}
        self.unknown = file.unk_id()
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(s for _, s in self.ids.values()) - 10
        # What each id adds to the decoded bytes; control pieces add nothing.
        self.out = [self.names[i].replace(SPACE, " ").encode() for i in ids]
        for i in ids:
            if file.is_control(i):
                self.out[i] = b""
            elif file.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
        for value, i in self.bytes.items():
            self.out[i] = bytes([value])
        # character -> (the characters that may follow, the id of the piece that ends here or -1, its score)
        self.trie: dict[str, tuple] = {}
        for name, (i, gain) in self.ids.items():
            node = self.trie
            for character in name[:-1]:
                node = node.setdefault(character, ({}, -1, 0.0))[0]
            node[name[-1]] = (node[name[-1]][0] if name[-1] in node else {}, i, gain)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "".join(re.escape(c) for c in "\n\t\r" if not any(c in p for p in self.ids))
        apart = f"[{alone}]" if alone else "(?!)"
        self.word = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|{apart}")
        # Remembered words in two generations: when the younger is full, it becomes the elder.
        self.known: dict[str, bytes] = {}
        #: The most back-pointers and folded ids that one search has held.
        self.held = 0
        self.elder: dict[str, bytes] = {}

    def segment(self, text: str) -> Iterator[list[int]]:
        """Lists of ids, in order, as they are committed."""
        root, longest, unknown_score, unknown = self.trie, self.longest, self.unknown_score, self.unknown
        n, none = len(text), float("-inf")
        score = {0: 0.0}  # of the positions from here to `longest` further
        ways = Ways(self)
        back = ways.back
        spanned, patience = 0, 2 * longest  # the farthest end of a piece that began before; back-pointers held until the next look
        for at in range(n):
            if at == spanned:  # no piece spans this position: all ways lead through it
                if at:
                    yield ways.commit(text, at)
                    back = ways.back
            elif len(back) > patience:
                live = [at, *(p for p in score if p > at)] if at in score else list(score)
                cut = ways.meeting(live)
                if cut is not None:
                    yield ways.commit(text, cut)
                elif len(back) > FOLD * longest:
                    ways.fold(text, live)
                back = ways.back
                patience = len(back) + 2 * longest
            here = score.pop(at, none)
            if here == none:
                continue
            node, end = root, at
            for character in text[at : at + longest]:
                step = node.get(character)
                if step is None:
                    break
                node, piece, gain = step
                end += 1
                if piece >= 0 and here + gain > score.get(end, none):  # starts come in order: of equal ways the longer last piece stays
                    score[end] = here + gain
                    back[end] = (at, piece)
                    if end > spanned:
                        spanned = end
            if here + unknown_score > score.get(at + 1, none):  # a piece of one character always beats this
                score[at + 1] = here + unknown_score
                back[at + 1] = (at, unknown)
                spanned = max(spanned, at + 1)
        if n:
            yield ways.commit(text, n)
        if ways.most > self.held:
            self.held = ways.most

    def coded(self, word: str) -> bytes:
        found = self.elder.get(word)
        if found is None:
            found = array("I", [i for part in self.segment(word) for i in part]).tobytes()
        if len(word) <= LONG_WORD:
            if len(self.known) >= REMEMBERED:
                self.known, self.elder = {}, self.known
            self.known[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        text = SPACE + text.replace(" ", SPACE)
        if not self.splits:
            return np.array([i for part in self.segment(text) for i in part], "<u4")
        coded, out = self.coded, []
        for word in self.word.findall(text):
            out.append(self.known.get(word) or coded(word))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and int(ids.max()) >= len(self.out):
            raise ValueError(f"id {int(ids.max())} is outside the model of {len(self.out)} pieces")
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model of a file, once a process."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in sliced(batches):
            found = [m.encode(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of doc_id, ids; a null list decodes to the empty string."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in sliced(batches):
            texts = [m.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def report(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (ids as little-endian unsigned 32-bit numbers), n_bytes and whether decoding gave the text back."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in sliced(batches):
            n, crc, size, same = [], [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                ids = m.encode(text)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
                size.append(len(text.encode("utf-8", "surrogatepass")))
                same.append(m.decode(ids) == text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_ids", "ids_crc32", "n_bytes", "round_trip"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, round_trip boolean")
