"""Stored trials under a changed bank: what drifts, what is graded anew, how it is written back."""

import json

import pytest

from tallyforge.operators import grading as G
from tallyforge.operators import maintain as M
from tallyforge.sources import lake as L

TRIAL = (
    "trial_id string, task_id string, module string, text string, truncated boolean, error string, n_turns int, task_hash string, prompt string, system_prompt string, tools_schema array<string>, "
    "results string, calls string, difficulty string, tier string, band string, expected string, det_score double, det_success boolean, success boolean, infra_error boolean, truncation_class string, "
    "judge_anchor_det double, judge_blocked_by string, llm_score double, opening string, closing string"
)
BASE = {
    "task_id": "say", "module": "adversarial", "text": "yes", "truncated": False, "n_turns": 1, "task_hash": "old", "prompt": "p", "system_prompt": "s", "difficulty": "easy", "tier": "baseline", "band": "mid",
    "expected": "{}", "det_score": 0.0, "det_success": False, "success": False, "infra_error": True, "truncation_class": "",
}
SCHEMA = json.dumps({"function": {"name": "look"}})
BOOK = json.dumps({"function": {"name": "book"}})
BANK = (
    "task_id string, module string, task_hash string, prompt string, system_prompt string, tools array<string>, tool_overrides string, difficulty string, tier string, band string, "
    "expected string, answer_type string, answer string, constraints array<string>, has_tools boolean, function_name string, test_cases string"
)
YES = ['{"type": "contains", "all": ["yes"]}']
LOOP = json.dumps({"goal_tool": "book", "goal_args": {}, "optimal_turns": 1})
TASKS = [
    ("say", "adversarial", "new", "p", "s", None, None, "hard", "hard", "frontier", "{}", "constraint", None, YES, False, None, None),
    ("plain", "adversarial", "new", "p", None, None, None, "hard", "hard", "frontier", "{}", "constraint", None, YES, False, None, None),
    ("tool", "tools", "new", "p", None, ["look", "book"], json.dumps({"look": {"error_message": " down "}, "book": {"require_args_error": "what?"}}), "hard", "hard", "anchor", LOOP, None, None, [], False, None, None),
    ("code", "code", "new", "p", None, None, None, "hard", "hard", "hard", None, None, None, [], False, "f", json.dumps([{"args": [], "expected": 1}])),
    ("asked", "knowledge", "new", "p", None, None, None, "hard", "hard", "hard", '{"x": 1}', "numeric", "5", [], False, None, None),
    ("deploy", "tools", "new", "p", None, None, None, "hard", "hard", "hard", LOOP, None, None, [], False, None, None),
]
CALL = json.dumps([{"name": "book", "arguments": {}}])
#: name, what differs from BASE, status, drift, then what else is to be found.
CASES = [
    ("graded", {}, "rescored", False, {"det_score": 1.0, "success": True, "task_hash": "new", "regraded_only": True, "moved": True, "flipped": "pass", "band": "frontier", "tier": "hard", "difficulty": "hard", "infra_error": False}),
    ("same hash", {"task_hash": "new", "prompt": "other"}, "rescored", False, {"regraded_only": False, "task_hash": "new"}),
    ("no hash", {"task_hash": "", "prompt": "other"}, "rescored", False, {"regraded_only": False, "task_hash": ""}),
    ("null hash", {"task_hash": None, "prompt": "other"}, "rescored", False, {"task_hash": None}),
    ("other prompt", {"prompt": "other"}, "drifted", True, {"det_score": 0.0, "task_hash": "old", "band": "mid", "flipped": None}),
    ("no prompt", {"prompt": ""}, "rescored", False, {}),
    ("other system", {"system_prompt": "t"}, "drifted", True, {}),
    ("unstored system", {"system_prompt": None}, "drifted", True, {}),
    ("no system now", {"task_id": "plain", "system_prompt": "gone"}, "rescored", False, {}),
    ("unknown", {"task_id": "none"}, "unknown", False, {"det_score": 0.0}),
    ("error", {"error": "boom", "n_turns": 0}, "error_no_turns", False, {"infra_error": True}),
    ("crashed later", {"error": "boom"}, "rescored", False, {"infra_error": True, "det_score": 1.0}),
    ("tools", {"task_id": "tool", "module": "tools", "calls": CALL, "tools_schema": [BOOK, SCHEMA, SCHEMA, "{}"]}, "rescored", False, {"det_score": 1.0, "expected": json.dumps(json.loads(LOOP), sort_keys=True)}),
    ("fewer tools", {"task_id": "tool", "module": "tools", "calls": CALL, "tools_schema": [SCHEMA]}, "drifted", True, {}),
    ("tools to a task without", {"task_id": "say", "tools_schema": [SCHEMA]}, "drifted", True, {}),
    ("injected", {"task_id": "tool", "module": "tools", "calls": CALL, "results": json.dumps(['{"error": "down"}', '{"error": "what? "}'])}, "rescored", False, {}),
    ("no longer injected", {"task_id": "tool", "module": "tools", "calls": CALL, "results": json.dumps(['{"error": "broken"}'])}, "drifted", True, {}),
    ("tools' own errors", {"task_id": "tool", "module": "tools", "calls": CALL, "results": json.dumps(['{"error": "unknown tool x"}', '{"error": 5}', '["error"]', "plain", None])}, "rescored", False, {}),
    ("no overrides", {"results": json.dumps(['{"error": "broken"}'])}, "rescored", False, {}),
    ("code", {"task_id": "code", "module": "code", "text": "def f():\n    return 1"}, "skipped_sandbox", False, {"det_score": 0.0, "band": "mid"}),
    ("truncated", {"text": "yes " * 400, "truncated": True, "truncation_class": "incomplete"}, "rescored", False, {"truncation_class": "degenerate", "det_score": 0.0, "moved": False}),
    ("whole again", {"truncation_class": "incomplete"}, "rescored", False, {"truncation_class": ""}),
    ("knowledge", {"task_id": "asked", "module": "knowledge", "system_prompt": None, "text": "5"}, "rescored", False, {"expected": '{"answer_type":"numeric","x":1}', "det_score": 1.0}),
    ("judge demotes", {"task_id": "deploy", "module": "tools", "system_prompt": None, "calls": CALL, "llm_score": 0.2, "det_score": 1.0, "det_success": True, "judge_anchor_det": 1.0}, "rescored", False, {"det_success": True, "success": False, "stale_judge": False}),
    ("judge's anchor", {"task_id": "deploy", "module": "tools", "system_prompt": None, "calls": CALL, "llm_score": 0.2}, "rescored", False, {"judge_anchor_det": 0.0, "stale_judge": True, "success": True}),
    ("judge rescues", {"task_id": "deploy", "module": "tools", "system_prompt": None, "calls": "[]", "llm_score": 1.0, "det_score": 0.2}, "rescored", False, {"det_success": False, "judge_blocked_by": "no_premature_stop"}),
]


def frames(spark):
    names = [c.split(" ")[0] for c in TRIAL.split(", ")]
    rows = [tuple((BASE | own | {"trial_id": name}).get(c) for c in names) for name, own, *_ in CASES]
    return spark.createDataFrame(rows, TRIAL), spark.createDataFrame(TASKS, BANK)


@pytest.fixture(scope="module")
def found(spark):
    return {r["trial_id"]: r.asDict() for r in G.rescore(*frames(spark), backend="none").collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_each_trial(found, case):
    name, _, status, drift, more = case
    got = found[name]
    assert (got["status"], got["drift"]) == (status, drift)
    same = lambda k: json.loads(got[k]) == json.loads(more[k]) if k == "expected" else got[k] == more[k]
    assert all(same(k) for k in more), {k: got[k] for k in more}
    assert len(found) == len(CASES)


def test_drift_can_be_allowed(spark):
    got = {r["trial_id"]: r for r in G.rescore(*frames(spark), allow_drift=True, backend="none").collect()}
    assert {"other prompt", "fewer tools", "unstored system"} <= {n for n, r in got.items() if r["status"] == "rescored" and r["task_hash"] == "new" and not r["regraded_only"]}


def test_migration_rehashes_what_shows_the_same(spark):
    trials, bank = frames(spark)
    got = {r["trial_id"]: r for r in M.migrate(trials, bank).collect()}
    assert "unknown" not in got and got["graded"]["task_hash"] == "new" and got["graded"]["rehashed"] and not got["graded"]["stale"]
    assert got["other prompt"]["task_hash"] == "old" and got["other prompt"]["stale"] and got["no hash"]["task_hash"] == "" and not got["no hash"]["rehashed"]


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_a_lake_is_changed_by_parts_and_once(spark, tmp_path):
    lake, (trials, bank) = str(tmp_path / "lake"), frames(spark)
    assert L.upsert(trials, lake, ["trial_id"], "module") == 1 and rows(L.read(spark, lake)) == rows(trials)
    want = G.rescore(trials, bank, backend="none").select(*trials.columns)
    assert G.rescore_lake(spark, lake, bank, backend="none") == 2
    assert rows(L.read(spark, lake)) == rows(want) and rows(L.read(spark, lake, 1)) == rows(trials)
    assert G.rescore_lake(spark, lake, bank, backend="none") == 2  # nothing left to change
    parts = [L.manifest(spark, lake, v)["parts"] for v in (1, 2)]
    assert sum(parts[0][p] == parts[1][p] for p in parts[0]) == 1  # code wasn't touched
    # One task changes: grading what changed gives what grading all does.
    again = spark.createDataFrame([t if t[0] != "plain" else (*t[:2], "newer", *t[3:13], ['{"type": "contains", "all": ["no"]}'], *t[14:]) for t in TASKS], BANK)
    full = G.rescore(L.read(spark, lake), again, backend="none").select(*trials.columns)
    assert G.rescore_lake(spark, lake, again, only_changed=True, backend="none") == 3
    assert rows(L.read(spark, lake)) == rows(full)


def test_what_ends_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    lake, (trials, bank) = str(tmp_path / "lake"), frames(spark)
    L.upsert(trials, lake, ["trial_id"], "module")
    commit = L.commit
    monkeypatch.setattr(L, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        G.rescore_lake(spark, lake, bank, backend="none")
    assert rows(L.read(spark, lake)) == rows(trials) and L.versions(spark, lake) == [1]
    monkeypatch.setattr(L, "commit", commit)
    assert G.rescore_lake(spark, lake, bank, backend="none") == 2
    with pytest.raises(L.Overtaken):
        L.commit(spark, lake, {"version": 2, "schema": "", "parts": {}})


def test_rows_are_added_to_their_parts(spark, tmp_path):
    lake = str(tmp_path / "lake")
    df = lambda *r: spark.createDataFrame(list(r), "k long, p string, v long")
    L.upsert(df((1, "a/b", 1), (2, None, 2), (3, "", 3)), lake, ["k"], "p")
    assert L.upsert(df(), lake, ["k"], "p") == 1
    assert L.upsert(df((2, None, 20), (4, "c", 4)), lake, ["k"], "p") == 2
    assert rows(L.read(spark, lake)) == rows(df((1, "a/b", 1), (2, None, 20), (3, "", 3), (4, "c", 4)))
    with pytest.raises(ValueError, match="columns"):
        L.upsert(df().drop("v"), lake, ["k"], "p")
    with pytest.raises(FileNotFoundError):
        L.read(spark, str(tmp_path / "nothing"))
