import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import divergence as D

from .corpus import documents, empty, rows

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, least_docs):
    """docs: (text, lang, source)."""
    lower = {c: c + 32 for c in range(65, 91)}
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = [t.translate(lower) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        tf[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least_docs]
        sources = sorted(s for x, s in groups if x == lang)
        whole = {t: sum(tf[lang, s][t] for s in sources) for t in kept}

        def shares(n, kept=kept):
            total = sum(n[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 5) // total for t in kept}

        q, p = shares(whole), {s: shares(tf[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if tf[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def corpus(seed=5, n=260):
    rng = np.random.default_rng(seed)
    words = ["The", "été", "a", "b", "naïve", "x1y", "Über", "ab-cd", "日本", "ß", "A", "é", "\x00z", "tail\x7f", "[Z]", "`q`", "{r}", " ", "😀"]
    words += [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    out = []
    for i in range(n):
        odds = rng.dirichlet(np.full(len(words), 0.3))
        text = " ".join(rng.choice(words, size=rng.integers(0, 60), p=odds))
        out.append((i, text, ["en", "fr", None][i % 3], [f"s{i % 7}", None, "é", "Z"][i % 4]))
    return [*out, out[0], (900, None, "en", "s1"), (901, "", "xx", "only"), (902, None, "xx", None), (903, "Solo " * 9000, "one", "one"), (None, "the The THE", None, "s3")]


@pytest.mark.parametrize("least_docs", [1, 4, 30, 10_000])
def test_equals_brute_force(spark, least_docs):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    found = sorted(tuple(r) for r in D.audit(df, least_docs).collect())
    assert found == brute([r[1:] for r in docs], least_docs)


def test_blocks_and_tiles_change_nothing(spark):
    docs = corpus(n=120)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert sorted(tuple(r) for r in D.audit(df, 3, block_terms=5, tile=3).collect()) == brute([r[1:] for r in docs], 3)


def test_tiles_see_each_pair_once():
    shape = {"vocabulary": 2, "lang_total": 60, "total": 10, "n": 0, "lang_n": 0, "term": None}
    at = lambda i, **more: shape | {"i": i} | more
    types = pa.schema([(c, pa.string() if c == "term" else pa.int64()) for c in at(0)])
    sources = [at(i) for i in range(4)]
    kept = [at(0, term="a", n=10, lang_n=10), at(2, term="b", n=10, lang_n=50)]
    key = lambda a, b: (pa.scalar("en"), pa.scalar(0), pa.scalar(a), pa.scalar(b))
    same = D.block_sums(key(0, 0), pa.Table.from_pylist([*sources[:2], kept[0]], schema=types), 2).to_pylist()
    across = D.block_sums(key(0, 1), pa.Table.from_pylist([*sources, *kept], schema=types), 2).to_pylist()
    assert [(r["i"], r["j"], r["seen"]) for r in same if r["term"] is None] == [(0, 1, 1)]
    assert [(r["i"], r["j"], r["seen"]) for r in across] == [(0, 2, 2), (0, 3, 2), (1, 2, 2), (1, 3, 2)]
    # Shares of 15 and 5 in 20: 750,000,001 and 250,000,001.
    assert [r["value"] for r in across] == [10**9, 5 * 10**8, 5 * 10**8, 0]
    assert [(r["i"], r["term"]) for r in same if r["term"]] == [(0, "a")]


@pytest.mark.parametrize("hashed", [len, lambda b: 7, lambda b: b[0]])
def test_collisions_split_by_bytes(hashed):
    data = np.frombuffer(b"the cat The dog tho cat a b the", np.uint8)
    starts, ends = D.boundaries(data, np.array([0, len(data)]))
    number, terms = D.group_slices(data, starts, ends, hashed)
    slices = [data.tobytes()[a:b] for a, b in zip(starts, ends, strict=True)]
    assert [terms[i] for i in number] == slices and len(set(number.tolist())) == len(set(slices))


def test_colliding_hashes_in_a_job(spark):
    docs = corpus(n=60)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    assert sorted(tuple(r) for r in D.audit(df, 2, lambda b: b[0] % 3).collect()) == brute([r[1:] for r in docs], 2)


def test_terms_end_with_their_text():
    data = np.frombuffer("aébç".encode(), np.uint8)
    starts, ends = D.boundaries(data, np.array([0, 0, 3, 3, 6, 6]))
    assert (starts.tolist(), ends.tolist()) == ([0, 3], [3, 6])


def test_shares_are_exact_for_large_counts():
    count, total = np.array([5, 8 * 10**15, 3]), np.array([9 * 10**15, 8 * 10**15 + 1, 7])
    assert D.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]


def test_awkward_rows_and_sql(spark, tmp_path):
    df = documents(spark)
    found = sorted(tuple(r) for r in D.audit(df, 2).collect())
    assert found == brute([(r[1], r[2], r[3]) for r in rows()], 2)
    db = duckdb.connect()
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    db.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(db.sql(D.oracle_sql(2)).fetchall()) == found


def test_empty(spark):
    assert D.audit(empty(spark)).collect() == []
