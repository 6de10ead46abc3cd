import re

import pytest
from tallyforge.llm import quality

from .corpus import documents, empty, rows

SPACE = "[\x20\x09-\x0d]+"


def brute(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_measures_against_brute_force(spark):
    got = sorted((str(r["doc_id"]), *tuple(r)[1:7]) for r in quality.measure(documents(spark)).collect())
    assert got == sorted((str(r[0]), *brute(r[1])) for r in rows())


def test_verdicts_and_filter(spark):
    docs = documents(spark)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == quality.measure(docs).filter("kept").count()
    assert not quality.measure(docs).filter("kept AND base_failed").count()


def test_rules_bind_in_whole_numbers(spark):
    half = "the of and to " * 4 + " ".join(f"word{i}" for i in range(40))
    symbols = half + " #" * 8
    row = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame([(1, half), (2, symbols)], "doc_id long, text string")).collect()}
    assert row[1]["kept"] and row[1]["n_stop_words"] == 16
    assert not row[2]["passes_symbols"] and not row[2]["kept"]


@pytest.mark.parametrize("f", [quality.measure, quality.filter_documents])
def test_empty(spark, f):
    assert f(empty(spark)).count() == 0
