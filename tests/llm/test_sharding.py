import zlib
from collections import Counter, defaultdict

import pytest
from tallyforge.llm import sharding

from .corpus import documents, empty, rows


def check(found, given):
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(sizes.values()) / 24, max((r["size"] for r in found), default=0)
    assert all(0 <= s < 24 for s in slots) and all(abs(n - share) <= largest for n in sizes.values())


@pytest.mark.parametrize("limits", [{}, {"range_rows": 3}, {"sample_per_range": 1, "ranges_per_shard": 1, "range_rows": 5}])
def test_every_row_has_a_slot_and_shards_are_even(spark, limits):
    check(sharding.shard(documents(spark), **limits).collect(), [(r[0], r[1]) for r in rows()])


def test_a_third_of_all_rows_under_one_key(spark):
    given = [(i, f"text {i} " * (i % 9)) for i in range(400)] + [(7, "the same")] * 150 + [(8, f"other {i}") for i in range(150)]
    check(sharding.shard(spark.createDataFrame(given, "doc_id long, text string"), range_rows=20).collect(), given)


def test_order_of_keys_is_kept(spark):
    given = [(i * 3 - 200, "x" * (i % 50)) for i in range(500)]
    found = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert [found[d] for d, _ in given] == sorted(found.values())


def test_empty(spark):
    assert sharding.shard(empty(spark)).count() == 0
