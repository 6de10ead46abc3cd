import json

import pytest
from pyspark.sql import functions as F
from tallyforge.functions import constraints as C
from tallyforge.functions import files as D
from tallyforge.functions import fuzzy as Z
from tallyforge.functions import text as X
from tallyforge.operators import calls as K
from tallyforge.operators import scorers as R


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("<think>a</think>b", "b"), ("a</think> b", "b"), ("b <think>rest", "b"), ("<THINK>a\nb</Think>\nc", "c"), ("plain ", "plain"), ("<think>x", "")],
)
def test_strip_reasoning(spark, text, want):
    assert one(spark, X.strip_reasoning(F.col("t")), text) == want


def test_repetition_and_tail(spark):
    loop = "I need to check whether this is right or not now. " * 6
    assert one(spark, X.repetition(F.col("t")), loop) > 0.5
    assert one(spark, X.repetition(F.col("t")), "one two three") == 0
    head = " ".join(f"word{i}" for i in range(200))
    late = f"{head} " + "so it goes on and on again here " * 10
    assert one(spark, X.loop_ratio(F.col("t")), late) > one(spark, X.repetition(F.col("t")), late)


@pytest.mark.parametrize(("text", "want"), [("it is 1,234.5 then -7", -7.0), ("none", None), ("12,000 EUR", 12000.0)])
def test_last_number(spark, text, want):
    assert one(spark, X.last_number(F.col("t")), text) == want


def test_vacuous_checks_and_empty_text(spark):
    ok = lambda check, text: one(spark, C.passes(check, F.col("t")), text)
    assert ok({"type": "not_contains"}, "x") and ok({"type": "regex"}, "x") and ok({"type": "json_has_keys"}, "{}")
    assert not ok({"type": "contains"}, "x") and not ok({"type": "no such"}, "x")
    assert not ok({"type": "not_contains", "value": "q"}, "   ")
    assert not ok({"type": "valid_json"}, "null") and ok({"type": "valid_json"}, "```json\n[1]\n```")
    assert ok({"type": "json_value", "path": "a", "value": 1}, '{"a": true}') and ok({"type": "json_value", "path": "a", "value": 1}, '{"a": 1.0}')
    assert not ok({"type": "json_path_type", "path": "a", "value": "integer"}, '{"a": true}') and ok({"type": "json_path_type", "path": "a", "value": "number"}, '{"a": true}')
    assert ok({"type": "json_all_values_in", "path": "a", "values": [1]}, '{"a": []}')
    assert ok({"type": "json_value", "path": "a.1.b", "value": "x"}, '{"a": [0, {"b": "x"}]}')


def test_punctuation_is_no_word(spark):
    assert one(spark, C.passes({"type": "min_words", "value": 3}, F.col("t")), "- one\n- two\n* ** three")
    assert not one(spark, C.passes({"type": "min_words", "value": 4}, F.col("t")), "- one\n- two\n* ** three")


def test_file_checks(spark):
    ok = lambda check, text, original=None: one(spark, D.passes(check, F.col("t"), F.lit(original if original is not None else text)), text)
    table = "# A\n| k | v |\n|---|---|\n| a | 1 |\n| b | 2 |\n# B\n"
    assert ok({"type": "table_wellformed", "section": "# A"}, table)
    assert not ok({"type": "table_wellformed", "section": "# B"}, table)
    assert ok({"type": "table_row_position", "section": "# A", "contains": "B", "index": -1}, table)
    assert not ok({"type": "table_rows_preserved", "section": "# A"}, table.replace("| a | 1 |\n", ""), table)
    assert not ok({"type": "table_rows_preserved", "section": "# C"}, table)
    assert ok({"type": "bullets_wellformed"}, "- a\n  - b\n- c") and not ok({"type": "bullets_wellformed"}, "- a\n    - b") and not ok({"type": "bullets_wellformed"}, "- a\n - b")
    assert ok({"type": "bullets_wellformed"}, "none")
    assert not ok({"type": "lines_preserved"}, "a\nc", "a\nb") and ok({"type": "frontmatter", "key": "k", "value": 3}, "x\nk: 3 y")
    assert not ok({"type": "lines_preserved"}, "", "")


def slow_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize(("a", "b"), [("", ""), ("abc", "xyz"), ("kitten", "sitting"), ("flaw", "lawn"), ("aaaa", "aa"), ("héllo wörld", "hello world"), ("abcabba", "cbabac"), ("x", "")])
def test_indel_ratio(a, b):
    assert Z.indel_ratio(a, b) == pytest.approx(slow_ratio(a, b))


@pytest.mark.parametrize(
    ("want", "got", "score"),
    [(None, None, 0), (True, 1, 1), (True, "true", 0), (1, 1.0, 1), ("5432", 5432, 1), ("1", 10, 0), ("", "x", 0.8), ("Ops", " ops ", 1), ({"a": 1, "b": 2}, {"a": 1, "c": 3}, 0.5), ([1, 2], [1], 0.5), ([], [9], 1), ("q", ["a", "q"], 1), ({}, {"a": 1}, 1)],
)
def test_value_match(want, got, score):
    assert Z.value_match(want, got) == pytest.approx(score)


def test_strict_types():
    assert Z.value_match("5432", 5432, strict=True) == 0


def test_char_loop():
    assert Z.char_loop("20s" * 100) == 1.0 and Z.char_loop("short") == 0.0


CALL = {"name": "get_weather", "arguments": {"city": "Tokyo"}}
SPEC = {"tool_name": "get_weather", "required_args": {"city": "Tokyo"}}
ROME = {"name": "get_weather", "arguments": {"city": "Rome", "units": "c"}}
DRY = {"forbidden_tools": ["d"], "forbidden_unless": {"d": {"dry": True}}, "tool_name": "d"}
#: expected, parallel, calls, answer, score, passed
TOOLS = [
    (SPEC, None, [CALL], "", 1.0, True),
    ({"no_call": True}, None, [], "no", 1.0, True),
    ({"no_call": True}, None, [], " ", 0.0, False),
    ({"no_call": True}, None, [CALL], "no", 0.0, False),
    ({"forbidden_tools": ["get_weather"]}, None, [CALL], "", 0.0, False),
    (DRY, None, [{"name": "d", "arguments": {"dry": True}}], "", 1.0, True),
    (DRY, None, [{"name": "d", "arguments": {"dry": False}}], "", 0.0, False),
    (DRY, None, [{"name": "d", "arguments": {}}], "", 0.0, False),
    (SPEC, None, [], "", 0.0, False),
    (SPEC, None, [ROME, CALL], "", 0.15 + 0.25 + 0.35 + 0.25 * 0.2222, False),
    (SPEC | {"optional_args": {"units": "c"}}, None, [CALL], "", 0.875, False),
    ({"tool_name": "f", "required_args": {"n": 5}, "strict_types": True}, None, [{"name": "f", "arguments": {"n": "5"}}], "", 0.75, False),
    ({"tool_name": "f"}, None, [{"name": "f", "arguments": None}], "", 1.0, True),
    ({}, [SPEC], [CALL, CALL], "", 0.9, False),
    ({}, [SPEC, {"tool_name": "get_weather", "required_args": {"city": "Rome"}, "optional_args": {"units": "c"}}], [ROME, CALL], "", 1.0, True),
    ({}, [SPEC, SPEC], [CALL], "", 0.5, False),
    ({}, [SPEC, SPEC], [], "", 0.0, False),
    ({}, [{"tool_name": "x", "required_args": {"q": 1}}], [CALL], "", 0.0, False),
    # The first takes the better call although the second needs it more: the best left over, in order.
    ({}, [{"tool_name": "get_weather"}, SPEC], [CALL, {"name": "get_weather", "arguments": {}}], "", round((1 + 0.34) / 2, 4), False),
]


def test_tool_scorers(spark):
    rows = [(i, json.dumps(e), json.dumps(p), json.dumps(c), a) for i, (e, p, c, a, *_) in enumerate(TOOLS)]
    df = spark.createDataFrame(rows, "trial_id long, expected string, parallel string, calls string, answer string").withColumn("results", F.lit(None).cast("string"))
    found = {r["trial_id"]: (r["score"], r["passed"]) for r in K.tool_scores(df).collect()}
    for i, (*_, score, passed) in enumerate(TOOLS):
        assert found[i] == (pytest.approx(score, abs=1e-4), passed), TOOLS[i]


STATES = [
    ({"expected_state": {"kv": {"a": 2}}, "unchanged": ["files"]}, {"kv": {"a": 1}, "files": {"x": "y"}}, {"kv": {"a": 2}, "files": {"x": "y"}}, 1.0, 1.0),
    ({"expected_state": {"kv": {"a": 2, "b": 1}}}, {"kv": {"a": 1, "b": 1}}, {"kv": {"a": 1, "b": 1}}, 0.0, 1.0),
    ({"expected_state": {"k": 1}, "accept_state": {"k": [2, 3]}}, {}, {"k": 3}, 1.0, 1.0),
    ({"unchanged": ["a", "b"]}, {"a": 1, "b": 1}, {"a": 1, "b": 2}, 1.0, 0.5),
    ({"unchanged": ["a"]}, {}, {}, 1.0, 0.0),
    ({"unchanged_paths": {"f": ["x", "y", "z"]}}, {"f": {"x": 1, "y": 1}}, {"f": {"x": 1, "y": 2, "z": 0}}, 1.0, 1 / 3),
    ({"unchanged_paths": {"f": ["z"], "g": ["z"]}}, {}, {"f": {"z": None}}, 1.0, 0.5),
    ({}, None, None, 1.0, 1.0),
]


def test_state_match(spark):
    rows = [(i, json.dumps(e), json.dumps(a), json.dumps(b), None, None) for i, (e, a, b, *_) in enumerate(STATES)]
    df = spark.createDataFrame(rows, "trial_id long, expected string, initial_state string, final_state string, calls string, results string")
    found = {r["trial_id"]: (r["goal"], r["side"]) for r in K.state_scores(df).collect()}
    assert found == {i: (pytest.approx(g), pytest.approx(s)) for i, (*_, g, s) in enumerate(STATES)}


def test_extracted_fields(spark):
    cases = [
        ({"extracted": {"a": 1, "b.0.c": "x"}}, '{"a": 1, "b": [{"c": "X"}]}', 1.0),
        ({"extracted": {"a": 1, "b": 2}}, '```json\n{"a": 1}\n```', 0.5),
        ({"extracted": {"a": "one"}, "accept": {"a": [1, "I"]}}, '{"a": 1}', 1.0),
        ({"extracted": {"a": None}}, '{"a": null}', 0.0),
        ({"extracted": {"0": 5}}, "[5]", 1.0),
        ({"extracted": {"0": 5}}, '{"0": 5}', 1.0),
        ({"extracted": {"a": 1}}, "no JSON", 0.0),
        ({"extracted": {}}, "{}", 0.0),
        ({"extracted": {"a": 1}}, None, 0.0),
    ]
    df = spark.createDataFrame([(i, json.dumps(e), r) for i, (e, r, _) in enumerate(cases)], "trial_id long, expected string, response string")
    assert {r["trial_id"]: r["score"] for r in K.extract_scores(df).collect()} == {i: s for i, (*_, s) in enumerate(cases)}


GOALS = [
    ({"goal_tool": "p", "goal_args": {"n": 3}, "goal_args_exact": ["n"]}, [{"name": "p", "arguments": {"n": "3"}}], None, []),
    ({"goal_tool": "p", "goal_args": {"n": 3}}, [{"name": "p", "arguments": {"n": "3"}}], None, [(0, "3")]),
    ({"goal_tool": "p", "goal_args": {"s": "Ab"}, "goal_args_exact": ["s"]}, [{"name": "p", "arguments": {"s": " aB "}}, {"name": "p", "arguments": {"s": "abc"}}, {"name": "q", "arguments": {"s": "ab"}}], None, [(0, " aB ")]),
    ({"goal_tool": "p"}, [{"name": "p", "arguments": {"a": "long text", "b": "x", "n": 5}}, {"name": "p", "arguments": {}}], ['{"error": ""}', '{"error": "bad"}'], [(0, "long text")]),
    ({"goal_tool": "p", "content_arg": "n"}, [{"name": "p", "arguments": {"a": "x", "n": 5}}, {"name": "p", "arguments": {"a": "x"}}], ["[]", "not JSON"], [(0, "5"), (1, "x")]),
    ({"goal_tool": "p", "goal_args": {"a": 1, "b": 2}}, [{"name": "p", "arguments": {"a": 1}}, {"name": "p", "arguments": {"b": 2, "a": 1}}], None, [(1, "")]),
]


def test_goals_are_found_with_their_content(spark):
    rows = [(i, "t", "tools", json.dumps(e), json.dumps(c), json.dumps(r)) for i, (e, c, r, _) in enumerate(GOALS)]
    df = spark.createDataFrame(rows, "trial_id long, task_id string, module string, expected string, calls string, results string")
    more = {c: F.lit(None).cast("string") for c in ("parallel", "initial_state", "final_state", "text", "opening", "closing")}
    found = {r["trial_id"]: [tuple(x) for x in r["landed"]] for r in K.episodes(df.withColumns(more).withColumn("truncated", F.lit(False))).collect()}
    assert found == {i: w for i, (*_, w) in enumerate(GOALS)}


def test_a_fold_assigns_calls(spark):
    cases = [([[0.5, 1.0], [1.0, 1.0]], [1.0, 1.0]), ([[1.0, 1.0], [0.2, 0.9]], [1.0, 0.9]), ([[0.0, 0.0], [0.3, 0.1]], [0.0, 0.3]), ([[0.4], [0.9]], [0.4, 0.0]), ([[], []], [0.0, 0.0])]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i long, m array<array<double>>")
    assert {r["i"]: r["a"] for r in df.select("i", K.assigned(F.col("m")).alias("a")).collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_extract_code():
    two = "```python\nimport math\n```\ntext\n```python\ndef f(x):\n    return math.sqrt(x)\n```\n```json\n{}\n```"
    assert R.extract_code(two) == "import math\n\ndef f(x):\n    return math.sqrt(x)"
    assert R.extract_code("```python\ndef f():\n    return 1") == "def f():\n    return 1" and R.extract_code("no code") == ""


def test_char_loop_reads_whole_texts(spark, tmp_path):
    from tallyforge.plans import texts

    made_up = {1: "x " + "20s" * 100, 2: "x " + "20s" * 100, 3: "plain words only", 4: "plain words only", 6: "a b " + "q" * 199, 8: None, 10: "on and on " + "abcdefg" * 60}
    spark.createDataFrame(list(made_up.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["char_loop"] for r in texts.x4_char_loop(spark, str(tmp_path)).collect()}
    assert found == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 6: 0.0, 8: 0.0, 10: 1.0}
