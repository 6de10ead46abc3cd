import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tallyforge.llm import quality, queries
from tokenizers import Tokenizer

from .corpus import documents, empty
from .test_quality import brute as brute_quality
from .test_simhash import brute_components, brute_fingerprint

DATA = "/root/testdata/sf0.001"


def accepted(text):
    """The base measures and the threshold table, said over again."""
    n, chars, symbols, dups, _, failed = brute_quality(text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.sub("[\x20\x09-\x0d]", "", x)]
    stops = sum(w.lower() in set(quality.STOP_WORDS) for w in words)
    return not failed and 2 * n <= chars <= 15 * n and 10 * symbols <= n and 25 * stops >= n and 10 * dups <= 4 * len(lines)


def without_repeats(rows, least=50):
    """Each row's text without the bytes of strings that a smaller doc_id holds."""
    texts, seen = [(r["doc_id"], (r["text"] or "").encode()) for r in rows], {}
    for d, b in texts:
        for p in range(len(b) - least + 1) if d is not None else ():
            w = b[p : p + least]
            seen[w] = min(d, seen.get(w, d))
    out = []
    for d, b in texts:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1) if d is not None else ():
            if seen[b[p : p + least]] < d:
                cover[p : p + least] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~cover]).decode("utf-8", "ignore"))
    return out


def check(given, step):
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    kept = step["quality_rules"]
    assert Counter(map(key, kept)) == Counter(key(r) for r in given if accepted(r["text"]))
    ids = [r["doc_id"] for r in kept]
    roots = brute_components(range(len(ids)), [brute_fingerprint(r["text"]) for r in kept])
    groups = defaultdict(list)
    for r, root in zip(kept, roots, strict=True):
        groups[root].append(r)
    first = step["simhash_near_dedup"]
    assert len(first) == len(groups)
    smallest = Counter(str(min((r["doc_id"] for r in g if r["doc_id"] is not None), default=None)) for g in groups.values())
    assert Counter(str(r["doc_id"]) for r in first) == smallest
    left = step["suffix_array_dedup"]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left) == sorted((str(r["doc_id"]), t) for r, t in zip(first, without_repeats(first), strict=True))
    assert all(r["n_chars"] == len(r["text"]) for r in left)
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, packed = Counter(), step["best_fit_packing"]
    for r in left:
        ids = [*slow.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((str(r["doc_id"]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((str(r["doc_id"]), *tuple(r)[1:5]) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for at in places.values():
        ends = np.cumsum([n for _, n in sorted(at)])
        assert [o for o, _ in sorted(at)] == [0, *ends[:-1]] and ends[-1] <= 2048


def run_stages(spark, docs, path):
    columns, step = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        assert name == "best_fit_packing" or docs.columns == columns
        step[name] = docs.collect()
    return step


def test_stages_one_by_one_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = docs.collect()
    step = run_stages(spark, docs, tmp_path)
    check(given, step)
    assert len(step["quality_rules"]) > 0.6 * len(given)


def test_awkward_rows_and_clashing_columns(spark, tmp_path, monkeypatch):
    # Invented words hold no stop words, so all but that rule are asked here.
    monkeypatch.setattr(quality, "STOP_WORDS", ["th", "er", "on", "an", "st"])
    docs = documents(spark)
    check(docs.collect(), run_stages(spark, docs, tmp_path))


def test_empty_documents(spark, tmp_path):
    assert not any(run_stages(spark, empty(spark), tmp_path).values())


@pytest.mark.parametrize("i", range(1, 11))
def test_every_operator_has_its_query(i):
    assert sum(n.startswith(f"op{i}_") for n in queries.queries()) == 1
