import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F
from tallyforge import schema
from tallyforge.operators import reports
from tallyforge.sources import files, haystacks, settings


def test_styles_are_deterministic_and_weigh_their_target():
    for style in haystacks.STYLES:
        lines = haystacks.styled(style, 2000, "task_1")
        assert lines == haystacks.styled(style, 2000, "task_1") != haystacks.styled(style, 2000, "task_2")
    audit = haystacks.styled("ops_audit", 3000, "x")
    assert sum(len(x) // 2 for x in audit) >= 3000 > sum(len(x) // 2 for x in audit[:-1]) and all(x.startswith("2026-0") and x[19] == "Z" for x in audit)
    meeting = haystacks.styled("meeting", 3000, "x")
    assert all(x.split(":")[0] in haystacks.CAST for x in meeting) and any("as yours" in x or "Done." in x or " has " in x for x in meeting)
    assert haystacks.styled("log", 100)[0].startswith("Log entry 1:") and not haystacks.styled("log", 100, "s")[0].startswith("Log entry 1:")


def test_styles_follow_the_random_stream():
    import random

    rnd = random.Random("ops-audit::s")
    month, day, hour, minute, second = (rnd.randrange(*x) for x in haystacks.TIMES)
    assert haystacks.styled("ops_audit", 1, "s")[0].startswith(f"2026-0{month}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}Z")


def test_meetings_follow_the_random_stream():
    """Short names stand for what is talked of, whole ones for what else there is; the draws come in their order."""
    for salt in map(str, range(40)):
        rnd = random.Random(f"meeting::{salt}")
        topic, short = rnd.choice(haystacks.TOPICS)
        other = rnd.choice([t for t, _ in haystacks.TOPICS if t != topic])
        a, b = rnd.sample(haystacks.CAST, 2)
        forms = haystacks.OWNERSHIP if rnd.random() < 0.1 else haystacks.CHATTER
        want = rnd.choice(forms).replace("{topic}", short).replace("{other}", other).replace("{a}", a).replace("{b}", b).replace("{n}", str(rnd.randrange(3, 400)))
        assert "\n".join(haystacks.styled("meeting", 500, salt)).startswith(want)


def test_documents_of_specs(spark):
    specs = [("a", {"needle": "NEEDLE", "filler_tokens": 600, "filler_style": "ops_audit", "position": 0.0}), ("b", {"type": "multi_key", "needle": "N", "distractors": ["D"], "filler_tokens": 300, "filler_style": "meeting"})]
    frame = spark.createDataFrame([(i, json.dumps(s)) for i, s in specs], "task_id string, spec string")
    got = {r["task_id"]: r["text"] for r in haystacks.documents(frame).collect()}
    assert got == {i: haystacks.document(s, i) for i, s in specs}
    assert got["a"].split("\n")[0] == "NEEDLE" and {"N", "D"} <= set(got["b"].split("\n"))


def test_trial_log_survives_a_torn_end(spark, tmp_path):
    settings_now = {"model": "m", "temperature": 0.5, "seed": None, "endpoint": "here"}
    own = files.run_fingerprint(settings_now)
    path = files.log_path(tmp_path / "m.json")
    with files.TrialLog(path, own) as log:
        log.append({"task_id": "a", "module": "x"})
    with files.TrialLog(path, own) as log:
        log.append({"task_id": "b", "module": "x"})
    with path.open("a") as f:
        f.write('{"task_id": "c", "mod')
    read = lambda fp: [r["task_id"] for r in files.read_trial_log(spark, str(path), fp, schema.TRIAL).orderBy("line_no").collect()]
    assert read(own) == ["a", "b"] and read(own | {"seed": 1}) == [] and path.name == "m.json.partial.jsonl"
    with files.TrialLog(path, own) as log:
        log.discard()
    assert not path.exists()


def test_folders_guards_and_expectations(tmp_path):
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks" / "code.yaml").write_text("tasks:\n- id: t\n  probe_expect: {order: up}\n- id: u\n")
    assert files.find_tasks_dir(tmp_path / "no", tmp_path) == tmp_path / "tasks"
    with pytest.raises(FileNotFoundError):
        files.find_tasks_dir(tmp_path / "no")
    assert files.read_expectation(tmp_path / "tasks", "code", "t") == {"order": "up"} and files.read_expectation(tmp_path / "tasks", "code", "u") is None
    assert len(files.candidate_fingerprint(tmp_path / "tasks", "code")) == 12 and files.candidate_fingerprint(tmp_path, "code") == ""
    assert files.probe_paths("p", "a b")["run"].name == "a_b"
    files.assert_outside(tmp_path / "probe", tmp_path / "results")
    for bad in ("results", "results/x/y"):
        with pytest.raises(ValueError, match="inside"):
            files.assert_outside(tmp_path / bad, tmp_path / "results")
    files.append_log(tmp_path / "l" / "log.jsonl", {"task_id": "t"})
    assert json.loads((tmp_path / "l" / "log.jsonl").read_text())["at"].endswith("+00:00")


def test_served_context(spark):
    bodies = [(json.dumps({"default_generation_settings": {"n_ctx": 16384}}),), (json.dumps({"default_generation_settings": {"n_ctx": 0}}),), ("no json",), ("{}",)]
    assert [r[0] for r in spark.createDataFrame(bodies, "b string").select(files.served_context(F.col("b"))).collect()] == [16384, None, None, None]
    assert files.context_urls("http://x/v1/", "m") == ["http://x/props", "http://x/upstream/m/props"]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nBENCH_TRIALS=5\nBENCH_MODEL='m'\nexport PROBE_MODELS=a, b\nBENCH_TEMPERATURE=none\n")
    monkeypatch.setenv("BENCH_TRIALS", "7")
    monkeypatch.setenv("BENCH_THINKING", "true")
    b = settings.Bench.load(tmp_path / ".env")
    assert (b.trials, b.model, b.thinking, b.temperature, b.max_tokens) == (7, "m", True, None, 8192)
    assert settings.Probe.load(tmp_path / ".env").cohort() == ["a", "b"] and settings.Judge.load(tmp_path / "none").max_attempts == 6
    monkeypatch.setenv("BENCH_ALLOW_UNSANDBOXED", "maybe")
    with pytest.raises(ValueError, match="neither"):
        settings.Bench.load(tmp_path / ".env")


def test_board_as_json(spark, tmp_path):
    files.save_board(spark.createDataFrame([(1, "m")], "rank long, model string"), tmp_path / "b" / "board.json", headline_k=3)
    assert json.loads((tmp_path / "b" / "board.json").read_text()) == {"headline_k": 3, "rows": [{"rank": 1, "model": "m"}]}


def test_small_reports(spark):
    found = spark.createDataFrame([("m", "a", "b", float(i)) for i in range(20)], "module string, smaller string, larger string, delta double")
    assert [r["delta"] for r in reports.inversions(found).orderBy("position").collect()] == [float(x) for x in range(19, 7, -1)]
    registry = spark.createDataFrame([("a", 9.0, 1.0, None), ("b", 2.0, None, ""), ("c", 1.0, None, "a"), ("d", None, None, None)], "model string, params_b double, active_b double, variant_of string")
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "model string")
    assert [(r["pos"], r["model"]) for r in reports.fleet_order(registry, runs).orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    big = spark.createDataFrame([(f"t{i:02}", i) for i in range(12)], "task_id string, needs long")
    assert [r["needs"] for r in reports.oversized_shown(big).orderBy("position").collect()] == list(range(11, 3, -1))
    moved = spark.createDataFrame([("rescored", True), ("rescored", False), ("stale", None)], "status string, moved boolean")
    assert {r["status"]: (r["n"], r["moved"]) for r in reports.status_report(moved).collect()} == {"rescored": (2, 1), "stale": (1, 0)}
    items = spark.createDataFrame([("x", "restraint", 0.5, 3), ("y", "weak", 0.1, 1), ("z", "restraint", 0.2, 2)], "task_id string, class string, pass_rate double, position long")
    assert [r["task_id"] for r in reports.restraint_items(items).orderBy("position").collect()] == ["z", "x"]


@contextmanager
def splits_of(spark, size):
    """Files are read in splits of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_a_log_is_read_by_several_tasks(spark, tmp_path):
    rng, want = random.Random(5), {}
    for f in range(6):
        lines = [json.dumps({"model": "m" if f != 2 else "other"})]
        torn = {0: None, 1: 700, 2: None, 3: 1, 4: 3, 5: None}[f]
        lines += [json.dumps({"n": i, "t": "é" * rng.randrange(40)}, ensure_ascii=bool(i % 2)) for i in range(1, 900 if f < 5 else 1)]
        if torn is not None:
            lines[torn] = lines[torn][:-1] if f != 3 else ""
        want[f"log{f}.jsonl"] = [] if f == 2 else list(range(1, len(lines) if torn is None else torn))
        (tmp_path / f"log{f}.jsonl").write_text("\n".join(lines) + ("\n" if f % 2 else ""), encoding="utf-8")
    (tmp_path / "log9.jsonl").write_text("")
    with splits_of(spark, 3000):
        assert spark.read.text(str(tmp_path / "log0.jsonl")).rdd.getNumPartitions() > 8
        rows = files.read_log(spark, str(tmp_path), {"model": "m"}, "n long").collect()
    got = {f: sorted((r["line_no"], r["n"]) for r in rows if r["file"] == f) for f in want}
    assert got == {f: [(n, n) for n in ns] for f, ns in want.items()}


def test_a_trial_logs_settings_are_compared_as_values(spark, tmp_path):
    own = files.run_fingerprint({"model": "m", "temperature": 0.5, "seed": 7, "thinking": True})
    body = '\n{"task_id": "a"}\n'
    heads = {"same": own, "turned": dict(reversed(own.items())), "elsewhere": own | {"endpoint": "x"}, "text": own | {"seed": "7"}, "less": {"model": "m"}, "more": own | {"z": 1}}
    for name, head in heads.items():
        (tmp_path / name).write_text(json.dumps({"__checkpoint__": head}) + body)
    (tmp_path / "bare").write_text(json.dumps(own) + body)
    (tmp_path / "torn").write_text(json.dumps({"__checkpoint__": own})[:-3] + body)
    got = {r["file"] for r in files.read_trial_log(spark, str(tmp_path), own).collect()}
    assert got == {"same", "turned", "elsewhere"}
