import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyforge.llm import alignment as L

from .corpus import documents, empty, rows

FILES = L.Files.public()


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(FILES.a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES.b)


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def tokens(text, a, b):
    """(id, bytes) of both, or nothing."""
    if not text:
        return [], []
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    ids = a.encode(" " + text, add_special_tokens=False).ids
    left = [(i, bytes(letter[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>") for i in ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (left, right) if all(b"".join(x for _, x in s) == want for s in (left, right)) else ([], [])


def brute(docs, a, b):
    count, per = Counter(), []
    for doc_id, text in docs:
        left, right = tokens(text, a, b)
        sa, sb = spans([x for _, x in left]), spans([x for _, x in right])
        links = [(left[i][0], right[j][0]) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if x < v and u < y]
        cuts = sorted({y for _, y in sa} & {v for _, v in sb})
        side = lambda ids, sp, lo, hi: ",".join(str(i) for (i, _), (x, y) in zip(ids, sp, strict=True) if lo <= x and y <= hi)
        groups = ";".join(f"{side(left, sa, lo, hi)}|{side(right, sb, lo, hi)}" for lo, hi in zip([0, *cuts][:-1], cuts, strict=True))
        per.append((doc_id, len(left), len(right), len(cuts), links, groups))
        count.update(links)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [
        (d, na, nb, ng, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for d, na, nb, ng, links, g in per
    ]


EXTRA = ["a▁b", "▁", " lead", "two  spaces\n\n\ttabs ", "<s> </s> <unk> <0x41> <|endoftext|><|endoftext|>", "日本語のテキスト", "é" * 50, "́é", "\x00\x01", "\U0010ffff x", "naïve café — “quotes” … 1234567890", "﻿bom", "a b　c"]


def test_report_equals_brute_force(spark, tokenizers):
    docs = [(r[0], r[1] and r[1][:2500]) for r in rows(n=20)] + [(1000 + i, t) for i, t in enumerate(EXTRA)]
    found = L.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(docs, *tokenizers)))


def test_small_blocks_change_nothing(spark, tokenizers):
    docs = [(i, t) for i, t in enumerate(EXTRA)] * 2
    whole = sorted(map(repr, map(tuple, L.report(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect())))
    split = sorted(map(repr, map(tuple, L.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(11)).collect())))
    assert whole == split == sorted(map(repr, brute(docs, *tokenizers)))


@pytest.mark.parametrize("seed", range(20))
def test_links_and_groups_of_any_lengths(seed):
    rng = np.random.default_rng(seed)
    total = int(rng.integers(1, 60))
    cut = lambda: np.diff([0, *sorted(set(rng.integers(1, total + 1, rng.integers(1, 30)).tolist()) - {total}), total])
    a, b = cut(), cut()
    sa, sb = spans([b"x" * n for n in a]), spans([b"x" * n for n in b])
    found = L.align(a, b)
    assert list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == [(i, j) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if x < v and u < y]
    ends = sorted({y for _, y in sa} & {v for _, v in sb})
    assert np.array([y for _, y in sa])[found.cut_a].tolist() == ends
    assert found.group_a.tolist() == [sum(e < y for e in ends) for _, y in sa] and found.group_b.tolist() == [sum(e < v for e in ends) for _, v in sb]


def test_alignments_hold_the_tokens(spark, tokenizers):
    docs = [(i, t) for i, t in enumerate([*EXTRA, None, ""])]
    by_id = {r["doc_id"]: r for r in L.alignments(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        left, right = tokens(text, *tokenizers)
        r = by_id[i]
        assert (r["a"], r["b"]) == ([x for x, _ in left], [x for x, _ in right])
        assert sum(g["n_a"] for g in r["groups"]) == len(left) and sum(g["n_b"] for g in r["groups"]) == len(right)
        at = [0, 0]
        for g in r["groups"]:
            ends = [at[0] + g["n_a"], at[1] + g["n_b"]]
            assert b"".join(x for _, x in left[at[0] : ends[0]]) == b"".join(x for _, x in right[at[1] : ends[1]]) != b""
            at = ends


def test_every_entry_has_its_bytes(tokenizers):
    coder = L.coders(FILES)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    entries = {i: bytes(letter[c] for c in e) for e, i in tokenizers[0].get_vocab().items() if i != 50256}
    assert coder.a_bytes == [entries[i] for i in range(50256)] and all(coder.b_bytes) and coder.piece_bytes(3) == b"\x00"


@pytest.mark.parametrize("text", ["a" * 300_000, "ab c" * 100_000, " " * 1_000_000, "é" * 100_000])
def test_very_long_texts(spark, text):
    r = L.report(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")).filter("doc_id = 1").collect()[0]
    assert r["n_a"] > 0 and r["n_links"] >= max(r["n_a"], r["n_b"]) and r["n_groups"] >= 1


def test_awkward_columns_and_empty(spark):
    assert L.report(documents(spark).limit(3)).count() == 3
    assert L.report(empty(spark)).count() == 0 and L.alignments(empty(spark)).count() == 0
