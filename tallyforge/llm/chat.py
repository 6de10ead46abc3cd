"""Transcript parsing and chat formatting.

A transcript comes in chunks of raw text (conv_id, turn, text), in order of turn. Every line is seen through its speaker
marker and a few line features; a hidden Markov model, whose states are (role, does the line begin a turn), recovers who
speaks by Viterbi; each recovered turn is then rendered canonically, without its marker. Scores are whole numbers
(thousandths of a nat), so that results don't depend on how work is divided.

A conversation may hold any share of all rows. It is cut into blocks; a block's six by six matrix of best scores between
its ends, and the order in which ties fall, are all that its conversation needs to settle the states at the cuts, and then
every block is decoded by itself. The pieces of a turn that goes on over cuts are joined before anything is trimmed, so that
every row is a whole turn (continues, which older readers know, is always false).

Defined cases: a null text is an empty line; a null turn comes first; a null conv_id is a conversation like another; equal
rows (conv_id, turn, text) are chunks of their own, one after the other; chunks of one turn number are in the order of their texts' hashes
(with over ``ROWS`` equal ones, in rounds of so many copies of each); ties between
ways go to the state listed first; a conversation without any marker is one turn of the role its first line is likeliest
to have. Columns beyond these three are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, sliced

ROLES = ("system", "user", "assistant")
STATES = [(r, b) for r in ROLES for b in (True, False)]  # (role, begins a turn)
NEVER = -(1 << 40)
TURNS, ROWS = 1024, 20_000  # turn numbers of a block; rows beyond which a block is cut further

# Names that transcripts give to speakers.
NAMES = {
    "system": ("system", "instructions", "instruction", "context", "s"),
    "user": ("user", "human", "customer", "question", "prompt", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "model", "answer", "response", "a"),
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_ANY = "|".join(sorted(ROLE_OF, key=len, reverse=True))
MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?\s*({_ANY})\s*(?:\|>)?|\[({_ANY})\]:?|#+\s*({_ANY})\s*:|\*\*({_ANY}):?\*\*:?|({_ANY})\s*[:>])\s*", re.IGNORECASE)

#: Scores of going from state to state: within a turn, to another speaker, to the same speaker again.
STAY, ANSWER, OTHER, AGAIN = -200, -700, -1800, -3500


def transitions() -> np.ndarray:
    t = np.full((6, 6), NEVER, np.int64)
    likely = {("system", "user"), ("user", "assistant"), ("assistant", "user")}
    for i, (role, _) in enumerate(STATES):
        for j, (other, begins) in enumerate(STATES):
            if not begins:
                t[i, j] = STAY if other == role else NEVER
            else:
                t[i, j] = AGAIN if other == role else ANSWER if (role, other) in likely else OTHER
    return t


T = transitions()
#: A transcript begins with a turn.
START = np.array([{"system": -900, "user": -600, "assistant": -2500}[r] if b else NEVER for r, b in STATES], np.int64)


def marker(line: str) -> tuple[str | None, int]:
    """The role that a line's marker names, and where its text begins."""
    m = MARKER.match(line)
    return (ROLE_OF[next(filter(None, m.groups())).lower()], m.end()) if m else (None, 0)


def emission(line: str, first: bool) -> np.ndarray:
    """Scores of a line in each state. first: it begins a chunk."""
    named, at = marker(line)
    text = line[at:].strip()
    asks, long = text.endswith("?"), len(text) > 400
    out = np.zeros(6, np.int64)
    for i, (role, begins) in enumerate(STATES):
        if begins:
            s = (-100 if named == role else -7000) if named else (-3500 if first else -6000)
        else:
            s = -5500 if named else (-900 if first else -60)
        if text:
            s += {"user": -400, "assistant": -1100, "system": -1500}[role] if asks else {"user": -900, "assistant": -700, "system": -800}[role]
            s += {"user": -900, "assistant": -300, "system": -600}[role] if long else 0
        out[i] = s
    return out


def emissions(lines: list[tuple[str, bool]]) -> np.ndarray:
    return np.array([emission(*x) for x in lines], np.int64)


def ranked(e: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best scores from each state before the block to each state at its end, and how these ways rank among ties.

    Before the first block all are as START. viterbi() goes backwards and takes the first of equal ways; of two ways to one
    end the lower ranked is the one that it would take if both were best.
    """
    v = np.full((6, 6), NEVER, np.int64)
    np.fill_diagonal(v, 0)
    rank = np.repeat(np.arange(6), 6).reshape(6, 6)
    for i, row in enumerate(e):
        if first and i == 0:
            v = np.broadcast_to(START, (6, 6)) + row
        else:
            ways = v[:, :, None] + T
            best = ways.argmax(1)
            v = np.take_along_axis(ways, best[:, None], 1)[:, 0] + row
            rank = (best * 6 + np.take_along_axis(rank, best, 1)).argsort(0).argsort(0)
        v = np.maximum(v, NEVER)
    return v, rank


def matrix(e: np.ndarray, first: bool) -> np.ndarray:
    """Best scores from each state before the block to each state at its end."""
    return ranked(e, first)[0]


def viterbi(e: np.ndarray, entry: int | None = None, end: int | None = None) -> list[int]:
    """The states of a block's lines. entry: the state before it; end: that of its last line."""
    v = (START if entry is None else T[entry]) + e[0]
    back = []
    for row in e[1:]:
        ways = v[:, None] + T
        best = ways.argmax(0)
        back.append(best)
        v = ways[best, np.arange(6)] + row
    at = int(v.argmax()) if end is None else end
    states = [at]
    for best in reversed(back):
        at = int(best[at])
        states.append(at)
    return states[::-1]


def settle_ends(group: pa.Table) -> pa.Table:
    """Matrices of a conversation's blocks: the states before and at the end of each."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["g"], r["sub"], r["part"]))
    forward, v = [], None
    for r in rows:
        m = np.frombuffer(r["matrix"], np.int64).reshape(6, 6)
        v = m.max(0) if v is None else (v[:, None] + m).max(0)
        forward.append(v)
    at = int(forward[-1].argmax())
    ends: list[tuple[int | None, int]] = []
    for k in range(len(rows) - 1, -1, -1):
        m = np.frombuffer(rows[k]["matrix"], np.int64).reshape(6, 6)
        before = None
        if k:
            scores = forward[k - 1] + m[:, at]
            equal = np.flatnonzero(scores == scores.max())
            before = int(equal[np.frombuffer(rows[k]["ranks"], np.int8).reshape(6, 6)[equal, at].argmin()])
        ends.append((before, at))
        at = before
    ends.reverse()
    out = pa.schema([f for f in group.schema if f.name not in ("matrix", "ranks")])
    columns = [pa.array([r[f.name] for r in rows], f.type) for f in out]
    return pa.Table.from_arrays([*columns, pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32())], [*out.names, "entry", "exit"])


KEYS = ["conv_id", "g", "sub", "part"]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that come sorted, block by block."""
    key, held = None, []
    for b in sliced(batches):
        for row in b.to_pylist():
            now = tuple(row[k] for k in KEYS)
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


def lines_of(rows: list[dict]) -> list[tuple[str, bool]]:
    return [(line, i == 0) for r in rows for i, line in enumerate((r["text"] or "").split("\n"))]


def block_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, rows in blocks(batches):
        m, rank = ranked(emissions(lines_of(rows)), bool(rows[0]["first"]))
        yield pa.RecordBatch.from_pylist([dict(zip(KEYS, key, strict=True)) | {"matrix": m.tobytes(), "ranks": rank.astype(np.int8).tobytes()}], MATRIX)


MATRIX = pa.schema([("conv_id", pa.int64()), ("g", pa.int64()), ("sub", pa.int64()), ("part", pa.int64()), ("matrix", pa.binary()), ("ranks", pa.binary())])
PIECE = pa.schema([
    ("conv_id", pa.int64()), ("g", pa.int64()), ("sub", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("turn", pa.int64()), ("line", pa.int64()),
    ("role", pa.string()), ("begins", pa.bool_()), ("last", pa.bool_()), ("text", pa.string()),
])
PIECES = "conv_id long, g long, sub long, part long, n long, turn long, line long, role string, begins boolean, last boolean, text string"


def decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of each block, untrimmed; the first may go on from the block before, the last over the block's end."""
    out: list[dict] = []
    for key, rows in blocks(batches):
        lines = lines_of(rows)
        states = viterbi(emissions(lines), rows[0]["entry"], rows[0]["exit"])
        places = [(r["turn"], i) for r in rows for i in range((r["text"] or "").count("\n") + 1)]
        at = n = 0
        while at < len(lines):
            role, begins = STATES[states[at]]
            end = at + 1
            while end < len(lines) and not STATES[states[end]][1]:
                end += 1
            texts = [line for line, _ in lines[at:end]]
            if begins and marker(texts[0])[0] == role:
                texts[0] = texts[0][marker(texts[0])[1] :]
            turn, line = places[at]
            out.append(dict(zip(KEYS, key, strict=True)) | {"n": n, "turn": turn, "line": line, "role": role, "begins": begins, "last": end == len(lines), "text": "\n".join(texts)})
            at, n = end, n + 1
        if len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out, PIECE)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, PIECE)


def joined(pieces: DataFrame) -> DataFrame:
    """Whole turns from the pieces of blocks. A turn that crosses cuts is the last of the block where it begins, and is known by that block."""
    inner = pieces.filter("begins AND NOT last")
    edges = pieces.filter("NOT begins OR last")
    order = Window.partitionBy("conv_id").orderBy("g", "sub", "part", "n")
    start = F.last(F.when(F.col("begins"), F.struct("g", "sub", "part", "turn", "line")), ignorenulls=True).over(order)
    owners = edges.select(*KEYS, "n", "begins", "turn", "line").select(*[F.col(k).alias(f"o_{k}") for k in (*KEYS, "n")], start.alias("start"))
    same = [edges[k].eqNullSafe(owners[f"o_{k}"]) for k in (*KEYS, "n")]
    piece = F.struct("g", "sub", "part", "n", "text")
    crossing = edges.join(owners, same).groupBy("conv_id", "start", "role").agg(F.array_sort(F.collect_list(piece)).alias("found"))
    crossing = crossing.select("conv_id", "start.turn", "start.line", "role", F.array_join(F.col("found.text"), "\n").alias("text"))
    return inner.select(*crossing.columns).unionByName(crossing)


def rendered(turns: DataFrame) -> DataFrame:
    """Turns without blank lines at their ends, and their canonical form."""
    found = turns.withColumn("text", F.btrim("text", F.lit("\n")))
    return found.select("conv_id", "turn", "line", "role", F.lit(False).alias("continues"), "text", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n")).alias("rendered"))


def parse(chunks: DataFrame, turns: int = TURNS, rows: int = ROWS, copies: int = ROWS) -> DataFrame:
    """conv_id, turn and line where it begins, role, continues, text and rendered of every recovered turn."""
    own = chunks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Equal rows are counted first and dealt in rounds, so that however many there are, no block holds them all.
    whole = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / copies))
    own = own.groupBy("conv_id", "turn", "text").agg(F.count("*").alias("times")).withColumn("round", F.explode(whole))
    own = own.withColumn("times", F.least(F.col("times") - F.col("round") * copies, F.lit(copies)))
    own = own.withColumn("h", F.xxhash64("text")).withColumn("g", F.coalesce(F.floor(F.col("turn") / turns), F.lit(-(1 << 62))).cast("long"))
    own = materialize(own, "chunks")
    sizes = own.groupBy("conv_id", "g").agg(F.sum("times").alias("n"))
    # Blocks with too many rows are cut by turn, and a turn's rows by their hash.
    over = sizes.filter(F.col("n") > rows).select(F.col("conv_id").alias("o_conv"), F.col("g").alias("o_g"), F.ceil(F.col("n") / rows).alias("parts"))
    spread = F.lit(0.5) + F.col("h") / F.lit(2.0**64)  # from 0 to 1, in the order of h
    cut = own.join(over, own.conv_id.eqNullSafe(over.o_conv) & (own.g == over.o_g), "left").select(
        "conv_id", "g", F.when(F.col("parts").isNotNull(), F.coalesce("turn", F.lit(0))).otherwise(0).cast("long").alias("sub"),
        (F.shiftleft("round", 32) + F.coalesce(F.floor(spread * F.col("parts")), F.lit(0))).cast("long").alias("part"), "turn", "h", "text",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    ).drop("copy")
    cut = materialize(cut, "blocks")
    order = [F.asc_nulls_first(c) for c in (*KEYS, "turn", "h", "text")]

    heads = cut.select(*KEYS).distinct()
    first = F.struct("g", "sub", "part")
    several = heads.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(first).alias("f")).filter("n > 1").select(F.col("conv_id").alias("s_conv"), "f")
    several = materialize(several, "several")
    in_parts = cut.join(several, cut.conv_id.eqNullSafe(several.s_conv)).withColumn("first", first == F.col("f"))
    dealt = in_parts.select(*KEYS, "turn", "h", "text", "first").repartition(*KEYS).sortWithinPartitions(*order)
    matrices = dealt.mapInArrow(block_matrices, "conv_id long, g long, sub long, part long, matrix binary, ranks binary")
    ends = matrices.groupBy("conv_id").applyInArrow(settle_ends, "conv_id long, g long, sub long, part long, entry int, exit int")
    ends = materialize(ends, "ends").select(*[F.col(k).alias(f"e_{k}") for k in KEYS], "entry", "exit")
    decoded = lambda d: d.repartition(*KEYS).sortWithinPartitions(*order).mapInArrow(decode_blocks, PIECES)
    columns = [*KEYS, "turn", "h", "text"]
    same = [cut[k].eqNullSafe(ends[f"e_{k}"]) for k in KEYS]
    pieces = materialize(decoded(cut.join(ends, same).select(*columns, "entry", "exit")), "pieces")
    alone = cut.join(several, cut.conv_id.eqNullSafe(several.s_conv), "left_anti").select(*columns, F.lit(None).cast("int").alias("entry"), F.lit(None).cast("int").alias("exit"))
    return rendered(decoded(alone).select("conv_id", "turn", "line", "role", "text").unionByName(joined(pieces)))


#: How raw transcripts mark speakers, by conversation.
STYLES = (
    ("System: ", "User: ", "Assistant: "), ("### Instructions: ", "### Human: ", "### AI: "), ("[system] ", "[user] ", "[bot] "),
    ("S: ", "Q: ", "A: "), ("<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n"), ("**System:** ", "**Customer:** ", "**Model:** "),
)


def transcribe(conversations: DataFrame) -> DataFrame:
    """Chunks as raw transcripts have them, from turns with known roles: markers by conversation, none for unknown roles."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    mark = F.lit("")
    for i, marks in enumerate(STYLES):
        for role, text in zip(ROLES, marks, strict=True):
            mark = F.when((style == i) & (F.col("role") == role), text).otherwise(mark)
    return conversations.select("conv_id", "turn", F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))
