import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tallyforge.llm import simhash

from .corpus import documents, empty, rows


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.array(ids, float)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_report_against_brute_force(spark):
    want_fp = [brute_fingerprint(r[1]) for r in rows()]
    comp = brute_components([np.inf if r[0] is None else r[0] for r in rows()], want_fp)
    want = sorted((str(r[0]), f"{f:016x}", c) for r, f, c in zip(rows(), want_fp, comp, strict=True))
    got = sorted((str(r["doc_id"]), r["fingerprint"], float(r["component_id"])) for r in simhash.report(documents(spark)).collect())
    assert got == want


def test_hash_is_the_engines_own(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("on the way"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"on the way", 42)


@pytest.mark.parametrize("limit", [2, 30, 4096])
def test_dense_clusters_need_no_pairs(spark, limit):
    rng = np.random.default_rng(5)
    fps = set()
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(50):
            x = int(base)
            for _ in range(rng.integers(0, 7)):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(i, i, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(fps)], "doc_id long, th long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.grouped(frame, limit).collect()}
    assert [got[i] for i in range(len(fps))] == brute_components(range(len(fps)), fps).tolist()
    links = simhash.links(frame.select("fp"), limit).count()
    assert links <= 34 * len(fps)


def test_anchors_cover_all_close_words():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    for x, y in zip(a, b, strict=True):
        homes = {int(h) | side << 32 for side, w in enumerate(simhash.halves(np.array([x]))) for h in simhash.home(w)[0]}
        assert homes & set(simhash.anchors(np.array([y]))[0].tolist())


def test_keep_first_keeps_one_whole_row_of_each(spark):
    docs = documents(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    comps = {r["root"] for r in simhash.components(docs).select("root").distinct().collect()}
    assert kept.count() == len(comps)
    by_id = {(r[0], r[1]) for r in rows()}
    assert all((r["doc_id"], r["text"]) in by_id for r in kept.collect())


def test_empty(spark):
    assert simhash.report(empty(spark)).count() == 0
    assert simhash.keep_first(empty(spark)).count() == 0
