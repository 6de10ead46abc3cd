import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tallyforge.llm import packing
from tokenizers import Tokenizer

from .corpus import documents, empty, rows, texts


def test_pieces_and_places(spark):
    found = packing.pack(documents(spark), capacity=64).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows():
        ids = [*slow.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(str(r[0]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted((str(r[0]), *tuple(r)[1:5]) for r in found) == sorted(want)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * -(-sum(r["length"] for r in found) // 64) + 1


def best(sizes, capacity):
    """The fewest bins, by search."""
    sizes = sorted(sizes, reverse=True)
    least = [len(sizes)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(sizes):
            least[0] = len(bins)
            return
        for room in {b for b in bins if b >= sizes[i]}:
            k = bins.index(room)
            go(i + 1, [*bins[:k], room - sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return least[0]


@pytest.mark.parametrize("seed", range(25))
def test_reduction_never_costs_a_bin(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(3, 40) for _ in range(11)]
    count = defaultdict(int)
    for s in sizes:
        count[s] += 1
    left = dict(count)
    fixed = packing.reduce_by_dominance(left, 40)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (best(rest, 40) if rest else 0) == best(sizes, 40)
    plan = packing.plan(dict(count), 40)
    packed = sorted(s for pattern, n in plan.bins for _ in range(n) for s in pattern)
    assert packed == sorted(sizes) and all(sum(p) <= 40 for p, _ in plan.bins)
    assert sum(n for _, n in plan.bins) <= best(sizes, 40) + 1


@pytest.mark.parametrize("seed", range(4))
def test_reduction_goes_on_past_pieces_that_it_cannot_settle(seed):
    rng = random.Random(seed)
    count = defaultdict(int)
    for _ in range(3000):
        count[rng.randint(2, 2047)] += 1
    left = dict(count)
    fixed = packing.reduce_by_dominance(left, 2048)
    again = dict(left)
    assert packing.reduce_by_dominance(again, 2048) == [] and again == left  # nothing settled is left over
    # Every exact pair of what was there is settled: of two such lengths one has run out.
    assert not any(n and (left.get(2048 - s, 0) > (2 * s == 2048)) for s, n in left.items())
    assert sum(n for _, n in fixed) > 0
    packed = defaultdict(int, left)
    for pattern, n in fixed:
        for s in pattern:
            packed[s] += n
    assert dict(packed) == dict(count)


def test_three_smaller_pieces_can_beat_one():
    # {4, 5} dominates all pairs beside 4, but not {4, 2, 2, 2}.
    assert packing.dominating(packing.Stock({4: 1, 5: 1, 2: 3}, 10), 10, 4) is None


def test_plan_has_no_step_for_each_sequence():
    began = time.time()
    plan = packing.plan({682: 3_000_000})
    assert plan.bins == [((682, 682, 682), 1_000_000)] and time.time() - began < 1


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n"])
def test_long_runs_of_white_space(blank):
    json_path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = "a b" + blank * (1_000_000 // len(blank)) + "c"
    slow, _ = packing.encoders(json_path, ranks)
    assert packing.encode(text, json_path, ranks).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_the_guard_takes_many_runs_of_blanks():
    text = ("x" + " " * (packing.BLANKS - 1)) * 200 + "y"  # 2 MB
    began = time.time()
    assert not packing.blank_run(text) and packing.blank_run(text + " " * packing.BLANKS) and packing.blank_run(" " * packing.BLANKS)
    assert time.time() - began < 1


def test_pack_takes_a_blank_text(spark):
    rows = packing.pack(spark.createDataFrame([(1, " " * 1_000_000), (2, "x")], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {1, 2}


def test_both_libraries_agree_on_every_character():
    slow, fast = packing.encoders(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        text = "".join(f"a{c}1 {c}\n" for c in points[at : at + 20_000])
        assert slow.encode(text, add_special_tokens=False).ids == fast.encode_ordinary(text)
    for t in texts():
        if t and packing.SPECIAL not in t:
            assert slow.encode(t, add_special_tokens=False).ids == fast.encode_ordinary(t)


def test_empty(spark):
    assert packing.pack(empty(spark)).count() == 0
