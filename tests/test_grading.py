import json

import pytest
from tallyforge.operators import grading as G

ASK = {"goal_tool": "ticket", "goal_args": {"id": "a1"}, "optimal_turns": 2, "content_arg": "body"}
CHECKS = ['{"type": "contains", "all": ["disk", "full"]}', '{"type": "not_contains", "value": "maybe"}']
FINAL = {"final_text_checks": [{"type": "contains", "any": ["filed"]}]}
STATE = {"expected_state": {"k": "new"}, "unchanged": ["o"], "optimal_turns": 1}
FILE = {"file_checks": {"a.md": [{"type": "section_contains", "section": "## S", "value": "yes"}, {"type": "lines_preserved"}]}, "optimal_turns": 1}
BEFORE = {"k": "old", "o": 1, "files": {"a.md": "## S\nkeep"}}


def call(name, **arguments):
    return {"name": name, "arguments": arguments}


def look(n):
    return call("look", at=n)


#: name, module, expected, content checks, calls, results, closing, final state, more, score, passed
EPISODES = [
    ("plain", "tools", ASK, None, [look(1), call("ticket", id="a1")], [], "", None, {}, 1.0, True),
    ("errored goal", "tools", ASK, None, [call("ticket", id="a1")], ['{"error": "no"}'], "", None, {}, 0.3, False),
    ("loops", "tools", ASK, None, [look(1), look(1), call("ticket", id="a1")], ["1", "1", "1"], "", None, {}, 0.7, False),
    ("best goal call", "tools", ASK, CHECKS, [call("ticket", id="a1", body="maybe"), call("ticket", id="a1", body="disk is full")], [], "", None, {}, 1.0, True),
    ("half of the content", "tools", ASK, CHECKS, [look(1), call("ticket", id="a1", body="disk")], [], "", None, {}, 0.875, False),
    ("no goal, no content", "tools", ASK, CHECKS, [look(1)], [], "", None, {}, 0.25, False),
    ("goal must be last", "tools", ASK | {"goal_must_be_last": True}, None, [call("ticket", id="a1"), look(1)], [], "", None, {}, 0.3, False),
    ("min_calls", "tools", ASK | {"min_calls": 3}, None, [look(1), call("ticket", id="a1")], [], "", None, {}, 0.9, False),
    ("answered in text", "tools", ASK | {"text_answer_ok": True}, None, [], [], "I can't do that.", None, {}, 1.0, True),
    ("silent", "tools", ASK | {"text_answer_ok": True}, None, [], [], "  ", None, {}, 0.3, False),
    ("forbidden", "tools", ASK | {"forbidden_tools": ["look"]}, None, [look(1), call("ticket", id="a1")], [], "", None, {}, 0.0, False),
    ("final text", "tools", ASK | FINAL, None, [look(1), call("ticket", id="a1")], [], "It is filed.", None, {}, 1.0, True),
    ("bad final text", "tools", ASK | FINAL, None, [look(1), call("ticket", id="a1", body="filed")], [], "Bye.", None, {}, 0.8, False),
    ("goal call's words close", "tools", ASK | FINAL, None, [look(1), call("ticket", id="a1", body="filed")], [], "", None, {}, 1.0, True),
    ("state", "tools", STATE, None, [look(1)], [], "", {"k": "new", "o": 1}, {}, 1.0, True),
    ("state untouched", "tools", STATE, None, [], [], "", {"k": "old", "o": 1}, {}, 0.4, False),
    ("state, side effect", "tools", STATE, None, [look(1)], [], "", {"k": "new", "o": 2}, {}, 0.8, False),
    ("state, final text", "tools", STATE | FINAL, None, [look(1)], [], "", {"k": "new", "o": 1}, {}, 0.8, False),
    ("state, forbidden", "tools", STATE | {"forbidden_tools": ["look"]}, None, [look(1)], [], "", {"k": "new", "o": 1}, {}, 0.0, False),
    ("loose types", "tools", {"expected_state": {"k": 5}}, None, [look(1)], [], "", {"k": "5"}, {}, 1.0, True),
    ("strict types", "tools", {"expected_state": {"k": 5}, "strict_types": True}, None, [look(1)], [], "", {"k": "5"}, {}, 0.4, False),
    ("files", "tools", FILE, None, [look(1)], [], "", {"files": {"a.md": "## S\nkeep\nyes"}}, {}, 1.0, True),
    ("half of the files' checks", "tools", FILE, None, [look(1)], [], "", {"files": {"a.md": "## S\nkeep"}}, {}, 0.7, False),
    ("file gone", "tools", FILE, None, [look(1)], [], "", {"files": {}}, {}, 0.4, False),
    ("files and state", "tools", FILE | STATE, None, [look(1)], [], "", {"k": "new", "o": 1, "files": {}}, {}, 0.7, False),
    ("single call", "tools", {"tool_name": "look", "required_args": {"at": 1}}, None, [look(1)], [], "", None, {}, 1.0, True),
    ("rightly none", "tools", {"no_call": True}, None, [], [], "", None, {"opening": "Hello."}, 1.0, True),
    ("degenerate", "tools", ASK, None, [look(1), call("ticket", id="a1")], [], "", None, {"truncated": True, "truncation_class": "degenerate"}, 0.0, False),
    ("cut, no words", "tools", ASK | {"text_answer_ok": True}, None, [], [], "I can't", None, {"truncated": True, "truncation_class": "incomplete"}, 0.3, False),
    ("attacked", "adversarial", ASK, None, [look(1), call("ticket", id="a1")], [], "", None, {"has_tools": True}, 1.0, True),
    ("attacked, none", "adversarial", {"no_call": True}, None, [], [], "", None, {"has_tools": True, "text": "No."}, 1.0, True),
    ("attacked in text", "adversarial", {}, None, [], [], "", None, {"text": "disk is full", "constraints": CHECKS}, 1.0, True),
    ("half in text", "adversarial", {}, None, [], [], "", None, {"text": "all good", "constraints": CHECKS}, 0.5, False),
    ("nothing said", "adversarial", {}, None, [], [], "", None, {"text": " ", "constraints": CHECKS}, 0.0, False),
    ("extract", "data_extract", {"extracted": {"a": 1, "b": 2}}, None, [], [], "", None, {"text": '{"a": 1, "b": 3}'}, 0.5, False),
    ("extract as format", "format", {"extracted": {"a": 1}}, None, [], [], "", None, {"text": '{"a": 1}'}, 1.0, True),
    ("format", "format", {}, None, [], [], "", None, {"text": "disk is full", "constraints": CHECKS}, 1.0, True),
]


@pytest.fixture(scope="module")
def graded(spark):
    answers, bank = [], []
    for name, module, expected, content, calls, results, closing, final, more, *_ in EPISODES:
        answers.append((name, name, more.get("text"), more.get("truncated", False), more.get("truncation_class"), json.dumps(calls), json.dumps(results), json.dumps(final), more.get("opening"), closing))
        bank.append((name, module, "constraint", None, more.get("constraints", []), json.dumps(expected), json.dumps(BEFORE), content, more.get("has_tools")))
    a = spark.createDataFrame(answers, "trial_id string, task_id string, text string, truncated boolean, truncation_class string, calls string, results string, final_state string, opening string, closing string")
    b = spark.createDataFrame(bank, "task_id string, module string, answer_type string, answer string, constraints array<string>, expected string, initial_state string, content_checks array<string>, has_tools boolean")
    return {r["trial_id"]: (round(r["score"], 4), r["passed"]) for r in G.grade(a, b).collect()}


@pytest.mark.parametrize("row", EPISODES, ids=[e[0] for e in EPISODES])
def test_every_module_is_graded(graded, row):
    assert graded[row[0]] == row[-2:] and len(graded) == len(EPISODES)


DIALOGUE = [
    {"constraints": [{"id": "a", "type": "contains", "any": ["alpha"]}]},
    {"constraints": [{"type": "bullets_kept"}, {"id": "b", "type": "not_contains", "value": "beta"}]},
    {"revokes": ["a"], "constraints": []},
]
TURNS = {
    "all hold": (["alpha\n- x", "alpha\n- x", "- y"], 1.0, True),
    "forgotten": (["alpha\n- x", "- x", "- y"], 0.8889, False),
    "bullets lost": (["alpha\n- x", "alpha", "gone"], 0.8889, False),
    "cut": (["alpha", None, "y"], 0.6667, False),
    "too few": (["alpha", "alpha"], 0.8333, False),
}
CODE = {
    "right": ("```python\ndef f(x):\n    return add(x, x)\n```", 1, 1.0, True),
    "second try": ("def f(x):\n    return x * 2", 2, 0.85, True),
    "half": ("def f(x):\n    return 4", 1, 0.3333, False),
    "no code": ("I don't know", 1, 0.0, False),
}


def others(spark):
    dialogues = [(n, "d", None, json.dumps([{"content": t or "alpha", "truncated": t is None} for t in turns]), 1) for n, (turns, *_) in TURNS.items()]
    code = [(n, "c", text, None, tries) for n, (text, tries, *_) in CODE.items()]
    a = spark.createDataFrame([(n, t, x, False, None, turns, k) for n, t, x, turns, k in dialogues + code], "trial_id string, task_id string, text string, truncated boolean, truncation_class string, turns string, attempts_used int")
    cases = [json.dumps([{"args": [2], "expected": 4}, {"args": [3], "expected": 6}]), json.dumps([{"args": [0], "expected": 0}])]
    bank = [("d", "multi_turn_if", "", None, [], json.dumps(DIALOGUE), None, None, None, None), ("c", "code", "", None, [], None, "f", "from pack.tools import add", *cases)]
    b = spark.createDataFrame(bank, "task_id string, module string, answer_type string, answer string, constraints array<string>, conversation string, function_name string, support_code string, test_cases string, regression_cases string")
    from pyspark.sql import functions as F

    return a, b.withColumn("context_files", F.lit(json.dumps({"pack/base.py": "def plus(a, b):\n    return a + b", "pack/tools.py": "from .base import plus as add"})))


def test_dialogues_and_code_are_graded(spark):
    a, b = others(spark)
    found = {r["trial_id"]: (r["score"], r["passed"]) for r in G.grade(a, b, backend="rlimit", allow_unsandboxed=True).collect()}
    assert found == {n: v[-2:] for n, v in (TURNS | CODE).items()}


def test_code_without_a_sandbox_has_no_score(spark):
    found = {r["trial_id"]: (r["score"], r["passed"]) for r in G.grade(*others(spark), backend="rlimit").collect()}
    assert found["right"] == (None, None) and found["no code"] == (0.0, False)


def test_rescored_trials_get_new_scores(spark):
    from pyspark.sql import functions as F

    a, b = others(spark)
    b = b.withColumn("task_hash", F.lit("new")).withColumn("prompt", F.lit("p"))
    t = a.withColumn("module", F.when(F.col("task_id") == "d", "multi_turn_if").otherwise("code")).withColumn("n_turns", F.lit(0)).withColumn("error", F.when(F.col("trial_id") == "cut", "boom"))
    t = t.withColumn("task_hash", F.lit("old")).withColumn("prompt", F.when(F.col("trial_id") == "too few", "q").otherwise("p")).withColumn("det_score", F.lit(0.5)).withColumn("success", F.lit(False))
    found = {r["trial_id"]: (r["status"], r["det_score"], r["success"], r["moved"]) for r in G.rescore(t, b, backend="rlimit").collect()}
    assert found["all hold"] == ("rescored", 1.0, True, True) and found["forgotten"] == ("rescored", 0.8889, False, True)
    assert found["cut"] == ("error_no_turns", 0.5, False, False) and found["too few"] == ("drifted", 0.5, False, False) and found["right"] == ("skipped_sandbox", 0.5, False, False)


def test_rules_of_dialogues_add_up_until_revoked(spark):
    import random

    rnd, tasks = random.Random(2), []
    for t in range(40):
        turns = []
        for _ in range(rnd.randrange(5)):
            turn = {}
            if rnd.random() < 0.8:
                own = [{"type": rnd.choice(["max_words", "bullets_kept"]), "value": rnd.randrange(9)} for _ in range(rnd.randrange(3))]
                turn["constraints"] = [c | ({"id": rnd.choice("abc")} if rnd.random() < 0.7 else {}) for c in own]
            if rnd.random() < 0.4:
                turn["revokes"] = rnd.sample("abc", rnd.randrange(3))
            turns.append(turn)
        tasks.append((f"t{t}", json.dumps(turns)))
    want = {}
    for task, text in tasks:
        held, turns = [], json.loads(text)
        for i, turn in enumerate(turns):
            held = [c for c in held if c.get("id") not in turn.get("revokes", [])] + turn.get("constraints", [])
            want[task, i] = (len(turns), [c for c in held if c["type"] != "bullets_kept"], sum(c["type"] == "bullets_kept" for c in held))
    rows = G.dialogue_rules(spark.createDataFrame([*tasks, ("none", None)], "task_id string, conversation string")).collect()
    assert {(r["task_id"], r["turn"]): (r["n_turns"], [json.loads(c) for c in r["checks"]], r["crossing"]) for r in rows} == want and len(rows) == len(want)


def test_a_bank_is_broadcast_only_if_it_was_counted_to_be_small(spark):
    from tallyforge.sources.scratch import small

    side = spark.createDataFrame([("t", "x" * 1000), ("u", None)], "task_id string, text string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(side)) and not hinted(small(side, 1000)) and hinted(small(side.limit(0), 0))
    assert sorted(map(tuple, small(side, 1000).collect()), key=str) == sorted(map(tuple, side.collect()), key=str)
