"""What a reviewer found in round 3."""

import tracemalloc

import duckdb
import pyarrow.fs
import yaml
from tallyforge.plans import catalog
from tallyforge.sources import batch, lake


def test_capitals_of_letters_that_have_no_single_one(spark, tmp_path):
    texts = ["Die Straße ist groß", "Ein ﬁsch aß", "Maß und Übermaß über Füße", "tous les élèves", "", "Größe", "ŉ ǰ groß", "mañana"]
    rows = [(8 * n + k, text) for n, text in enumerate(texts) for k in (3, 7)]
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    db.sql(f"create view benchmark as select * from '{tmp_path}/benchmark.parquet/*.parquet'")
    got = catalog.queries()["r3_factual"](spark, str(tmp_path)).select("item_id", "held", "ratio", "score").collect()
    want = db.sql(catalog.oracle_sql()["r3_factual"]).select("item_id, held, ratio, score").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert all(r["held"] for r in got if r["item_id"] % 8 == 7)


def test_what_streams_append_is_in_files(spark):
    """A memory table is a list of rows on the driver."""
    found = catalog.queries()["stream_call_results"](spark, "/root/testdata/sf0.001")
    files = found.inputFiles()
    assert files and all(f.endswith(".parquet") for f in files)
    assert found.count() > 5000


DOCUMENTS = [
    "", "# nothing\n", "- {id: a}\n- id: b\n  prompt: |\n    - x\n    - y\n", "tasks:\n- {id: a}\n- &x {id: b, n: [1, {c: 2}]}\n- <<: *x\n  id: c\nother: {k: 1}\n",
    "base: &b {fast: true}\ntasks:\n  - {<<: *b, id: a}\n  - *b\n", "tasks: [{id: a}]\ntasks: [{id: b}]\n", "<<: {tasks: [{id: m}]}\nz: 1\n", "l: &l [{id: a}]\ntasks: *l\n", "tasks:\n", "tasks: null\nz: [1, 2]\n",
    "z: 1\n", "? [1, 2]\n: 3\n", "tasks: &t\n- {id: a}\nagain: *t\n", "﻿tasks: [{id: ä}]\n", "---\ntasks: [{id: 2001-01-01}]\n...\n",
]


def test_yaml_lists_are_read_entry_by_entry(tmp_path):
    def known(text, bare):
        try:
            data = yaml.safe_load(text) or {}
            return list((data.get("tasks") or []) if isinstance(data, dict) or not bare else data)
        except (yaml.YAMLError, AttributeError):
            return "an error"

    def read(path, bare):
        try:
            return list(batch.yaml_entries(pyarrow.fs.LocalFileSystem(), path, "tasks", bare))
        except (ValueError, AttributeError):
            return "an error"

    path = tmp_path / "x.yaml"
    for text in [*DOCUMENTS, "tasks: [", "tasks: [{a: 1}]\n---\nb: 1\n", "- a\n--- b\n", "tasks: [*y]\n", "z: !q 1\ntasks: []\n"]:
        path.write_text(text, "utf-8")
        for bare in (True, False):
            assert read(str(path), bare) == known(text, bare), (text, bare)


def test_a_long_bank_is_not_held(tmp_path):
    path = tmp_path / "bank.yaml"
    path.write_text("tasks:\n" + "".join(f'- {{"id": "p{n}", "prompt": "a rather long prompt", "expected": {{"answer": {n}}}}}\n' for n in range(6000)))
    tracemalloc.start()
    count = sum(1 for _ in batch.TaskReader(str(tmp_path)).read(batch.File(str(path))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 6000 and peak < 1 << 20


def test_plans_of_episodes_are_small(spark):
    """What a plan holds several times over fills the driver's memory, and that of its log."""
    found = catalog.queries()["r14_episodes"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < 20 and len(plan) < 60_000, (plan.count("Join"), len(plan))


def test_an_upsert_writes_rows_once(spark, tmp_path):
    at = str(tmp_path / "lake")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, module string, text string")
    lake.upsert(rows((1, "a", "x"), (2, "a", "y"), (3, "b", "z")), at, ["id"], "module")
    lake.upsert(rows((2, "a", "new")), at, ["id"], "module")
    assert sorted(map(tuple, lake.read(spark, at).collect())) == [(1, "a", "x"), (2, "a", "new"), (3, "b", "z")]
    fresh = [f for f in tmp_path.glob("lake/v2-*") if not f.name.endswith("-kept")]
    assert [r["id"] for r in spark.read.parquet(str(fresh[0])).collect()] == [2]
