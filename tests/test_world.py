import json

import pytest
from pyspark.sql import functions as F
from tallyforge.operators import filters as P
from tallyforge.operators import judging as J
from tallyforge.operators import maintain as M
from tallyforge.operators import sandbox, toolworld
from tallyforge.plans import fixtures
from tallyforge.sources import files, haystacks
from tallyforge.streaming import trials as live

DATA = "/root/testdata/sf0.001"


def test_world_and_overrides():
    w = toolworld.World({"orders": [{"id": 101, "status": "open"}], "balance": 200}, {"kv_set": {"first_call_behavior": "error"}, "issue_refund": {"require_args": {"order_id": 101}}})
    assert "error" in w.call("kv_set", {"key": "a", "value": 1}) and w.call("kv_set", {"key": "a", "value": 1})["status"] == "ok"
    assert "error" in w.call("issue_refund", {"order_id": 7, "amount": 5}) and w.call("issue_refund", {"order_id": 101, "amount": 20})["balance"] == 180
    assert "error" in w.call("issue_refund", {"order_id": 101, "amount": 80}) and w.call("issue_refund", {"order_id": 101, "amount": 80, "manager_code": "MGR-9"})["balance"] == 100
    assert w.call("create_order", {"customer": "A", "total": 3})["order"]["id"] == 102 and w.call("cancel_order", {"order_id": 999})["error"]
    w.call("write_file", {"path": "a/b", "content": "x  \r\n\r\n"})
    assert w.state["files"] == {"a/b": "x\n"} and w.call("list_files", {"prefix": "./a"})["count"] == 1
    assert "unknown tool" in w.call("nope", {})["error"] and "invalid arguments" in w.call("kv_set", {"what": 1})["error"]
    assert w.call("calculate", {"expression": "2*(3-1)**2 % 5"})["result"] == 3 and "error" in w.call("calculate", {"expression": "__import__('os')"})
    assert [r["id"] for r in w.call("db_query", {"table": "orders", "filters": {"status": "shipped"}, "order_by": "total", "limit": 1})["rows"]] == [101]


def test_episodes_fold_like_aggregates(spark):
    calls = [(e, p, "kv_set", json.dumps({"key": f"k{p % 2}", "value": e * 10 + p})) for e in range(5) for p in range(7)]
    got = {r["episode"]: json.loads(r["final_state"])["kv"] for r in toolworld.episodes(spark.createDataFrame(calls, "episode long, pos long, name string, arguments string").repartition(3)).collect()}
    want = toolworld.kv_state(spark.createDataFrame([(e, p, json.loads(a)["key"], json.loads(a)["value"]) for e, p, _, a in calls], "episode long, pos long, key string, value long"))
    assert all(got[r["episode"]][r["key"]] == r["value"] for r in want.collect())


def test_sandbox_fails_closed_and_runs_when_asked():
    assert sandbox.run("print(1)", backend="rlimit").status == "skipped_no_sandbox"
    cases = [{"args": [2], "expected": 4}, {"args": [3], "expected": 5}]
    assert sandbox.run_cases("def f(x):\n    return x * 2", "f", cases, backend="rlimit", allow_unsandboxed=True) == ("ok", [True, False])
    assert sandbox.run("while True: pass", timeout=1, backend="rlimit", allow_unsandboxed=True).status in ("timeout", "error", "oom")
    assert sandbox.run("raise SystemExit(3)", backend="rlimit", allow_unsandboxed=True).status == "error"


@pytest.fixture
def programs(tmp_path, monkeypatch):
    """Stands in for sandboxes: notes how it is called and runs nothing."""

    def install(name, info=0, image=0):
        (tmp_path / name).write_text(f"""#!/bin/sh
[ "$1" = info ] && exit {info}
[ "$1" = image ] || [ "$1" = pull ] && exit {image}
echo "{name} $@" > {tmp_path}/called
cat > {tmp_path}/given
""")
        (tmp_path / name).chmod(0o755)
        monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
        return tmp_path

    return install


@pytest.mark.parametrize("name", ["docker", "podman"])
def test_containers_are_wrapped(programs, name):
    folder = programs(name)
    script = f"open('{folder}/ran', 'w').write('x')"
    done = sandbox.run(script, backend=name)
    assert (done.status, done.backend) == ("ok", name) and not (folder / "ran").exists()
    called = (folder / "called").read_text()
    assert called.startswith(f"{name} run --rm -i") and all(x in called for x in ("--network none", "--read-only", "--memory 256m", "--cap-drop ALL", "--user 65534:65534"))
    assert (folder / "given").read_text() == script


def test_backends_that_do_not_work_fail_closed(programs):
    folder = programs("docker", info=1)
    script = f"open('{folder}/ran', 'w').write('x')"
    assert sandbox.detect() != "docker"
    assert sandbox.run(script, backend="docker", allow_unsandboxed=True).status == "skipped_no_sandbox"
    programs("podman", image=1)
    assert sandbox.run(script, backend="podman", allow_unsandboxed=True).status == "unavailable"
    assert sandbox.run(script, backend="no such", allow_unsandboxed=True).status == "skipped_no_sandbox"
    assert not (folder / "ran").exists()


def test_sandbox_exec_is_wrapped(programs, monkeypatch):
    monkeypatch.setattr(sandbox.platform, "system", lambda: "Darwin")
    programs("sandbox-exec")
    command = sandbox.wrapped("sandbox-exec", "print(1)", "/scratch", 256, "n")
    assert sandbox.available("sandbox-exec") and command[:2] == ["sandbox-exec", "-p"] and "(deny network*)" in command[2] and '(subpath "/scratch")' in command[2]


@pytest.mark.parametrize(
    ("det", "llm", "passed", "gate", "anchor", "want"),
    [(0.9, 0.9, False, None, None, False), (0.9, 0.96, False, None, None, True), (0.9, 0.96, False, "degenerate", None, False), (0.9, 0.96, False, None, 0.5, False), (0.8333, 0.83, True, None, None, True), (1.0, 0.4, True, None, None, False), (1.0, None, True, None, None, True), (0.5, None, False, None, None, False)],
)
def test_verdicts(spark, det, llm, passed, gate, anchor, want):
    t = spark.createDataFrame([("tools", det, llm, passed, gate, anchor)], "module string, det_score double, llm_score double, det_success boolean, gate string, anchor double")
    assert J.apply_verdicts(t, F.col("gate"), F.col("anchor")).first()["judged_success"] == want
    shown = J.apply_verdicts(t.withColumn("module", F.lit("code")), F.col("gate")).first()
    assert shown["judged_success"] == passed


def test_selection_and_errors(spark):
    tasks = spark.createDataFrame([("a1", "tools", True), ("b1", "code", False)], "id string, module string, fast boolean")
    assert P.select_tasks(tasks, ["code"]).count() == 1 and P.select_tasks(tasks, substring="tool").count() == 1
    with pytest.raises(ValueError, match="unknown"):
        P.select_tasks(tasks, ["nope"])
    with pytest.raises(ValueError, match="no task"):
        P.select_tasks(tasks, ["code"], fast=True)


def test_unknown_predecessor_is_an_error(spark):
    bank = spark.createDataFrame([("t", "tools", None, "h")], "task_id string, module string, axis string, task_hash string")
    old = lambda m: spark.createDataFrame([("t", m, None)], "task_id string, module string, axis string")
    assert M.migrate(old("tool_loop"), bank).first()["module"] == "tools"
    with pytest.raises(Exception, match="no known move"):
        M.migrate(old("knowledge"), bank).collect()


def test_result_files(spark, tmp_path):
    trial = {"task_id": "a", "module": "x", "success": True, "turns": [{"role": "user", "content": "q"}]}
    meta = {"model": "m", "trials": 1}
    (tmp_path / "m_raw_results.json").write_text(json.dumps({"meta": meta, "results": [trial, trial | {"task_id": "b"}]}, indent=1))
    (tmp_path / "m_raw_results_judged.json").write_text(json.dumps({"meta": meta, "results": [trial | {"llm_score": 1.0}]}))
    rows = files.load_results(spark, str(tmp_path), judged=False).orderBy("trial_seq").collect()
    assert [(r["task_id"], r["trial_seq"], r["band"], r["infra_error"]) for r in rows] == [("a", 0, "mid", False), ("b", 1, "mid", False)]
    assert files.load_preferred(spark, str(tmp_path)).count() == 1
    assert files.load_runs(spark, str(tmp_path)).filter("profile = 'full'").count() == 2


def test_registry_tasks_and_log(spark, tmp_path):
    assert files.load_registry(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "models.yaml").write_text("models:\n  - name: m\n    params_b: 4\n")
    assert files.load_registry(spark, str(tmp_path / "models.yaml")).first()["params_b"] == 4.0
    bank = tmp_path / "bank"
    bank.mkdir()
    (bank / "code.yaml").write_text("- id: c1\n  prompt: p\n  buggy_code: x\n  difficulty: easy\n- id: c2\n  prompt: p\n  fast: true\n")
    got = {r["id"]: (r["tier"], r["band"]) for r in files.load_tasks(spark, str(bank)).collect()}
    assert got == {"c1": ("hard", "anchor"), "c2": ("baseline", "mid")} and files.load_tasks(spark, str(bank), fast=True).count() == 1
    (tmp_path / "log.jsonl").write_text('{"model": "m"}\n{"n": 1}\n{"n": 2}\n{"n": \n{"n": 4}\n')
    assert [r["n"] for r in files.read_log(spark, str(tmp_path / "log.jsonl"), {"model": "m"}, "n long").collect()] == [1, 2]
    assert files.read_log(spark, str(tmp_path / "log.jsonl"), {"model": "other"}, "n long").count() == 0


def test_needles_sit_at_their_depths(spark):
    lines = haystacks.filler(spark, 600)
    n = lines.count()
    got = [r["line"] for r in haystacks.with_needles(lines, [("FIRST", 0.0), ("MIDDLE", 0.5), ("LAST", 1.0)], n).collect()]
    want = [r["line"] for r in lines.orderBy("pos").collect()]
    for text, depth in (("FIRST", 0.0), ("MIDDLE", 0.5), ("LAST", 1.0)):
        want.insert(min(len(want), int(len(want) * depth)), text)
    assert got == want and n == lines.count()


def test_specs_hide_what_they_say(spark):
    hop = {"type": "multi_hop", "chain": ["A", "B", "C"], "latent": ["L"], "distractors": ["D"], "filler_tokens": 900}
    got = [r["line"] for r in haystacks.build(spark, hop).collect() if len(r["line"]) == 1]
    assert sorted(got) == ["A", "B", "C", "D", "L"] and got.index("A") < got.index("B") < got.index("C")
    counted = haystacks.needles({"type": "aggregation", "inject": {"x": 3, "y": 2}})
    assert len(counted) == 5 and [d for _, d in counted] == sorted(d for _, d in counted) and sum("x is" in t for t, _ in counted) == 3
    assert haystacks.needles({"needle": "N", "distractors": ["p", "q"]}) == [("p", 0.15), ("q", 0.15 + 0.6 / 2), ("N", 0.5)]


def test_streams_equal_batches(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    rows = live.read_events(spark, DATA, schema)
    live.run_to_end(live.tally(rows, "event_type"), "tally", str(tmp_path / "a"))
    batch = {r["event_type"]: r["count"] for r in fixtures.table(spark, DATA, "events").groupBy("event_type").count().collect()}
    assert {r["event_type"]: r["count"] for r in spark.table("tally").collect()} == batch
    live.run_to_end(live.daily(rows), "daily", str(tmp_path / "b"))
    want = fixtures.table(spark, DATA, "events").groupBy(F.to_date("ts").alias("day"), "event_type").count()
    assert {(str(r["day"])[:10], r["event_type"], r["n"]) for r in spark.table("daily").collect()} == {(str(r["day"]), r["event_type"], r["count"]) for r in want.collect()}


def test_duplicate_trials_are_taken_once(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    rows = live.read_events(spark, DATA, schema)
    live.run_to_end(live.once(rows.union(rows), "event_id"), "once", str(tmp_path / "c"), "append")
    assert spark.table("once").count() == fixtures.table(spark, DATA, "events").count()


def test_gate_and_live_episodes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    runs = [("dead", True)] * 6 + [("fine", True)] * 4 + [("fine", False)] * 3 + [("short", True)] * 3
    spark.createDataFrame(runs, "model string, dead boolean").coalesce(1).write.parquet(str(tmp_path / "runs"))
    rows = spark.readStream.schema("model string, dead boolean").parquet(str(tmp_path / "runs"))
    live.run_to_end(live.dead_gate(rows), "gate", str(tmp_path / "g"), "append")
    assert {r["model"]: r["abort"] for r in spark.table("gate").collect()} == {"dead": True, "fine": False}
    calls = [(e, p, "kv_set", json.dumps({"key": "k", "value": p})) for e in range(3) for p in range(4)] + [(e, 9, "kv_get", '{"key": "k"}') for e in range(3)]
    spark.createDataFrame(calls, "episode long, pos long, name string, arguments string").coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("episode long, pos long, name string, arguments string").parquet(str(tmp_path / "calls"))
    live.run_to_end(live.live_episodes(stream), "played", str(tmp_path / "e"), "update")
    got = {r["episode"]: json.loads(r["result"])["value"] for r in spark.table("played").filter("pos = 9").collect()}
    assert got == {0: 3, 1: 3, 2: 3}


def test_factual_answers_by_containment_ratio_and_to_the_letter(spark):
    from tallyforge.operators import scorers

    rows = [
        (1, "It is in Lisbon.", ["lisbon"], False), (2, "It is in Lisbon.", ["lisbon"], True), (3, "the treaty of westfalia ended it", ["Treaty of Westphalia"], False),
        (4, "the treaty of westfalia ended it", ["Treaty of Westphalia"], True), (5, "no idea", ["Rome", "no idea"], None), (6, None, ["x"], False), (7, "Paris", [], False),
    ]
    got = {r["trial_id"]: (r["held"], r["score"]) for r in scorers.factual_rows(spark.createDataFrame(rows, "trial_id long, text string, candidates array<string>, exact boolean")).collect()}
    assert got == {1: (True, 1.0), 2: (False, 0.0), 3: (False, 1.0), 4: (False, 0.0), 5: (True, 1.0), 6: (False, 0.0), 7: (False, 0.0)}
