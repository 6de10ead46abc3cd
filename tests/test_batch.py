"""Batch sources: documents walked in pieces, filters that keep files shut, files that aren't what their name says."""

import io
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tallyforge.sources import batch, files

LEAF = st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12)
VALUE = st.recursive(LEAF, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


@given(st.lists(VALUE, max_size=6), st.dictionaries(st.text(max_size=4), VALUE, max_size=3), st.integers(1, 9), st.sampled_from([None, 0, 2]), st.booleans())
@settings(max_examples=150, deadline=None)
def test_a_document_is_walked_in_pieces(results, more, chunk, indent, ascii_only):
    whole = {k: v for k, v in more.items() if k != "results"} | {"results": results}
    text = json.dumps(whole, indent=indent, ensure_ascii=ascii_only)
    if "\ud800" <= max(text, default="") <= "\udfff":
        return
    walk, got = batch.Walk(io.BytesIO(text.encode("utf-8", "surrogatepass")), chunk), {}
    for name in walk.fields():
        got[name] = [json.loads(walk.value()[1]) for _ in walk.several("[", "]")] if name == "results" else walk.value()[0]
    assert got == whole and walk.mark() == ""


@pytest.mark.parametrize("text", ["", "[]", "{", '{"results": [1, ', '{"results": [1 2]}', '{"results" [1]}', '{"results": []}}', "nonsense"])
def test_what_is_no_document_is_an_error(spark, tmp_path, text):
    (tmp_path / "m_raw_results.json").write_text(text)
    with pytest.raises(Exception, match="m_raw_results.json"):
        files.load_results(spark, str(tmp_path)).collect()


def test_filters_keep_files_shut(spark, tmp_path):
    meta = {"model": "m", "trials": 1}
    trials = [{"module": random.Random(i).choice("ab"), "task_id": f"t{i}", "prompt": "p" * i} for i in range(40)]
    (tmp_path / "m_raw_results.json").write_text(json.dumps({"results": [*trials, None, 3], "meta": meta}))
    (tmp_path / "n_raw_results_judged.json").write_text("broken")
    (tmp_path / "other.json").write_text("broken")
    rows = files.load_results(spark, str(tmp_path), judged=False, modules=["a", "z"])
    assert [(r["trial_seq"], r["task_id"], r["model"], r["prompt"]) for r in rows.orderBy("trial_seq").collect()] == [(i, t["task_id"], "m", t["prompt"]) for i, t in enumerate(trials) if t["module"] == "a"]
    assert rows.filter("task_id = 't3' OR module IS NULL").count() == sum(t["task_id"] == "t3" and t["module"] == "a" for t in trials)
    with pytest.raises(Exception, match="n_raw_results_judged.json"):
        files.load_results(spark, str(tmp_path)).collect()
    reader = batch.ResultReader(str(tmp_path))
    left = list(reader.pushFilters([batch.EqualTo(("judged",), False), batch.In(("module",), ("a",)), batch.EqualTo(("model",), "m")]))
    assert [f.attribute for f in left] == [("model",)] and [p.name for p in reader.partitions()] == ["m_raw_results.json"]


def test_a_banks_other_files_stay_shut(spark, tmp_path):
    (tmp_path / "code.yaml").write_text("- id: c1\n  prompt: p\n- id: c2\n  fast: true\n  tools: [look]\n  constraints: [{type: x}]\n")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "bare.yaml").write_text("tasks:\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    assert files.load_tasks(spark, str(tmp_path), ["code", "empty", "bare"]).count() == 2
    fast = files.load_tasks(spark, str(tmp_path), ["code"], fast=True).collect()
    assert [(r["id"], r["tools"], r["constraints"], r["max_tokens"]) for r in fast] == [("c2", ["look"], ['{"type": "x"}'], None)]
    with pytest.raises(Exception, match="bad.yaml"):
        files.load_tasks(spark, str(tmp_path)).collect()
    assert files.load_tasks(spark, str(tmp_path / "none")).count() == 0


def test_a_registry_by_name(spark, tmp_path):
    (tmp_path / "models.yaml").write_text("models:\n- name: a\n  params_b: 1\n- params_b: 2\n- name: 7\n")
    found = files.load_registry(spark, str(tmp_path / "models.yaml"))
    assert {(r["name"], r["params_b"]) for r in found.collect()} == {("a", 1.0), ("7", None)}
    assert [r["params_b"] for r in found.filter(F.col("name") == "a").collect()] == [1.0]
