import random

import numpy as np
import pytest
from tallyforge.llm import groups, repeats

from .corpus import documents, empty, rows


def all_repeats(texts, least):
    """Maximal repeats by sorting all suffixes: right-maximal strings are common prefixes of neighbours."""
    places = sorted(((t[p:], i, p) for i, t in enumerate(texts) for p in range(len(t) - least + 1)))
    strings = set()
    for (a, *_), (b, *_) in zip(places[:-1], places[1:], strict=True):
        n = groups.common(a, b)
        if n >= least:
            strings.add(a[:n])
    out = set()
    for s in strings:
        at = [(i, p) for t, i, p in places if t.startswith(s)]
        left = {texts[i][p - 1] if p else None for i, p in at}
        if None in left or len(left) > 1:
            out.add((len(s), frozenset(at)))
    return out


def found(spark, texts, **limits):
    frame = spark.createDataFrame(list(enumerate(t.decode() for t in texts)), "doc_id long, text string").repartition(3)
    g, p = groups.repeat_groups(frame, **limits)
    spelt = {}
    for r in groups.occurrences(g, p).collect():
        spelt.setdefault((r["lo"], r["hi"], r["length"]), set()).add((r["doc_id"], r["start"]))
    assert len(spelt) == g.count()
    return {(length, frozenset(at)) for (_, _, length), at in spelt.items()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed):
    """Passages of 50 to 5,000 bytes shared whole, in part and nested; copies, near copies and repeats within a text."""
    rng = random.Random(seed)
    long, short = words(rng, 1100)[:5000], words(rng, 30)[:51]
    cut = long[:900] + "X" + long[901:2500]
    texts = [words(rng, 20) + long + words(rng, 9), long, cut, short + words(rng, 5) + short, "q" + short + "z", words(rng, 40), long[300:420] + "!" + short]
    texts += [words(rng, 60)] * 3 + ["", "x" * 49, "ab" * 60, "ab" * 45]
    return [t.encode() for t in texts]


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"part_bytes": 3000}), (3, {"part_bytes": 300, "block": 700})])
def test_groups_against_brute_force(spark, seed, limits):
    texts = corpus(seed)
    want = all_repeats(texts, 50)
    assert found(spark, texts, **limits) == want
    assert max(n for n, _ in want) >= 4500 and min(n for n, _ in want) <= 51


@pytest.mark.parametrize("seed", range(3))
def test_small_alphabet(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))).encode() for _ in range(12)]
    assert found(spark, texts, least=6, kmer=3, part_bytes=400, block=20) == all_repeats(texts, 6)


def test_a_passage_in_many_documents_is_spread_over_parts(spark):
    rng = random.Random(7)
    passage = words(rng, 40)
    texts = [(words(rng, 8) + " " + passage + " " + words(rng, 8)).encode() for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(t.decode() for t in texts)), "doc_id long, text string")
    g, p = groups.repeat_groups(frame, part_bytes=1500)
    best = g.orderBy("length", ascending=False).first()
    assert best["n"] >= 2 and g.agg({"n": "max"}).first()[0] == 60
    assert found(spark, texts, part_bytes=1500) == all_repeats(texts, 50)


def test_the_digests_of_documents_follow_from_the_groups(spark):
    """A byte goes if a group's occurrence covers it, in a document larger than the group's smallest."""
    texts = corpus(4)
    frame = spark.createDataFrame(list(enumerate(t.decode() for t in texts)), "doc_id long, text string")
    cover = [np.zeros(len(t), bool) for t in texts]
    for length, at in found(spark, texts):
        for d, p in at:
            if d > min(i for i, _ in at):
                cover[d][p : p + length] = True
    assert {r["doc_id"]: r["n_removed"] for r in repeats.report(frame).collect()} == {i: int(c.sum()) for i, c in enumerate(cover)}


def test_intervals_in_blocks_are_those_of_the_whole():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        prefix, lefts = [0, *rng.integers(0, 8, n - 1).tolist()], [(int(x), int(x)) for x in rng.integers(-1, 3, n)]
        assert len({(a, z) for a, z, *_ in groups.intervals(prefix, lefts, 1)}) == len(list(groups.intervals(prefix, lefts, 1)))


def test_awkward_rows(spark):
    g, p = groups.repeat_groups(documents(spark))
    texts = [(r[1] or "").encode() for r in rows()]
    assert {r["n"] for r in g.collect()} <= set(range(2, 10**6)) and p.count() > 0
    spelt = {}
    for r in groups.occurrences(g, p).collect():
        spelt.setdefault((r["lo"], r["hi"], r["length"]), []).append(r)
    assert len(spelt) == g.count() and len(spelt) == len(all_repeats(texts, 50))
    g, p = groups.repeat_groups(empty(spark))
    assert g.count() == 0 and p.count() == 0
