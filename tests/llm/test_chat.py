from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyforge.llm import chat

DATA = "/root/testdata/sf0.001"


def brute(e):
    """The best way by trying all."""
    best = None
    for way in product(range(6), repeat=len(e)):
        score = chat.START[way[0]] + sum(chat.T[a, b] for a, b in zip(way[:-1], way[1:], strict=True)) + sum(e[i][s] for i, s in enumerate(way))
        if best is None or score > best[0]:
            best = (score, list(way))
    return best


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_and_matrices_against_all_ways(seed):
    e = np.random.default_rng(seed).integers(-4000, 0, (6, 6))
    score, way = brute(e)
    assert chat.viterbi(e) == way
    a, b = chat.matrix(e[:2], True), chat.matrix(e[2:], False)
    assert (a.max(0)[:, None] + b).max() == score


def test_roles_are_recovered(spark):
    c = spark.read.parquet(f"{DATA}/conversations.parquet")
    found = chat.parse(chat.transcribe(c))
    met = c.join(found.withColumnRenamed("text", "parsed").withColumnRenamed("role", "found"), ["conv_id", "turn"], "left")
    rate = met.select(F.avg((F.col("role") == F.col("found")).cast("int")), F.avg((F.trim(F.col("text")) == F.trim("parsed")).cast("int"))).first()
    assert rate[0] >= 0.98 and rate[1] >= 0.95


def plain(rows):
    return sorted(((r["conv_id"], r["turn"], r["line"], r["role"], r["rendered"]) for r in rows), key=repr)


@pytest.mark.parametrize(("turns", "rows"), [(2, 20_000), (1000, 1), (7, 3)])
def test_cutting_into_blocks_changes_nothing(spark, turns, rows):
    chunks = chat.transcribe(spark.read.parquet(f"{DATA}/conversations.parquet")).union(
        spark.createDataFrame([(10**6, i, ("Human: " if i % 2 == 0 else "AI: ") + f"x{i}\nmore?") for i in range(90)], "conv_id long, turn long, text string")
    )
    whole, parts = chat.parse(chunks).collect(), chat.parse(chunks, turns, rows).collect()
    text = lambda rs: {c: "".join(r["rendered"] for r in sorted((x for x in rs if x["conv_id"] == c), key=lambda r: (r["turn"], r["line"]))) for c in {x["conv_id"] for x in rs}}
    assert text(whole) == text(parts)


def test_awkward_rows(spark):
    rows = [(None, None, None, "x"), (1, 0, "hello", "x"), (1, 0, "hello", "x"), (1, 1, "there", "x"), (2, None, "User: hi", "x"), (2, 3, "Bot: hello\n\nUser: quoted?", "x"), (3, 0, "a\n" * 3000, "x")]
    found = plain(chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")).collect())
    second = sorted((r for r in found if r[0] == 2), key=lambda r: (-1 if r[1] is None else r[1], r[2]))  # a turn without a number comes first
    assert [(r[1], r[2], r[3], r[4]) for r in second] == [(None, 0, "user", "<|user|>\nhi\n"), (3, 0, "assistant", "<|assistant|>\nhello\n"), (3, 2, "user", "<|user|>\nquoted?\n")]
    assert [r for r in found if r[0] == 1][0][4].endswith("\nhello\nhello\nthere\n") and len([r for r in found if r[0] == 1]) == 1
    assert len([r for r in found if r[0] is None]) == 1


@pytest.mark.parametrize(("line", "role"), [("User: x", "user"), ("### AI: x", "assistant"), ("[system] x", "system"), ("**Model:** x", "assistant"), ("<|im_start|>user", "user"), ("A: x", "assistant"), ("Aside: x", None), ("users: x", None)])
def test_markers(line, role):
    assert chat.marker(line)[0] == role


@pytest.mark.parametrize(("turns", "rows", "copies"), [(1024, 20_000, 20_000), (1, 2, 3), (1024, 2, 7), (2, 5, 5)])
def test_repeated_rows_are_chunks_of_their_own(spark, turns, rows, copies):
    said = [(1, 0, "Human: hi"), (1, 1, "AI: yo"), (1, 1, "AI: yo"), *[(1, 2, "Human: again")] * 11, (1, 3, "AI: end")]
    chunks = spark.createDataFrame(said * 1 + [(2, 0, "User: x")] * 4, "conv_id long, turn long, text string")
    found = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.parse(chunks, turns, rows, copies).collect())
    want = [(1, 0, "user", "hi"), *[(1, 1, "assistant", "yo")] * 2, *[(1, 2, "user", "again")] * 11, (1, 3, "assistant", "end"), *[(2, 0, "user", "x")] * 4]
    assert found == want


def test_empty(spark):
    assert chat.parse(spark.createDataFrame([], "conv_id long, turn long, text string")).count() == 0


def test_turns_over_cuts_keep_their_blank_lines(spark):
    rows = [(1, 0, "Human: hello\n\n"), (1, 1, "and more"), (1, 2, "\n\n"), (1, 3, "\nthe end\n\n"), (1, 4, "AI: yes\n"), (1, 5, "\n"), (1, 6, "Human: bye\n")]
    rows += [(2, None, "User: first\n\n"), (2, 0, "second\n"), (None, 0, "Q: x\n\n"), (None, 1, "\ny"), (3, 5, "one\n\n"), (3, 5, "two\n\n"), (3, 5, "three\n\n"), (3, 6, "four\n\n")]
    chunks = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    whole = chat.parse(chunks).collect()
    assert not any(r["continues"] for r in whole)
    assert [r["text"] for r in whole if r["conv_id"] == 1 and r["turn"] == 0] == ["hello\n\n\nand more\n\n\n\n\nthe end"]
    assert [r["text"] for r in whole if r["conv_id"] == 2] == ["first\n\n\nsecond"]
    for turns, most in ((1, 20_000), (2, 20_000), (1000, 1)):
        parts = chat.parse(chunks, turns, most).collect()
        assert plain(parts) == plain(whole) and not any(r["continues"] for r in parts)


def test_cuts_change_no_row(spark):
    chunks = chat.transcribe(spark.read.parquet(f"{DATA}/conversations.parquet")).union(
        spark.createDataFrame([(10**6, i // 2, f"x{i}\n\n" if i % 5 else "AI: \n\n?") for i in range(90)], "conv_id long, turn long, text string")
    )
    whole = plain(chat.parse(chunks).collect())
    assert plain(chat.parse(chunks, 2, 20_000).collect()) == whole and plain(chat.parse(chunks, 7, 3).collect()) == whole


@pytest.mark.parametrize("seed", range(60))
def test_ties_fall_as_in_one_block(seed):
    random = np.random.default_rng(seed)
    e = random.integers(-3, 1, (12, 6)) * 500  # so that many ways are equally good
    cuts = [0, *sorted(random.choice(np.arange(1, 12), 3, replace=False).tolist()), 12]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    rows = []
    for k, (a, b) in enumerate(spans):
        m, rank = chat.ranked(e[a:b], k == 0)
        rows.append({"conv_id": 1, "g": k, "sub": 0, "part": 0, "matrix": m.tobytes(), "ranks": rank.astype(np.int8).tobytes()})
    ends = chat.settle_ends(pa.Table.from_pylist(rows, chat.MATRIX)).to_pylist()
    assert sum((chat.viterbi(e[a:b], r["entry"], r["exit"]) for (a, b), r in zip(spans, ends, strict=True)), []) == chat.viterbi(e)
