from math import comb

import pytest
from pyspark.sql import functions as F
from tallyforge.operators import aggregates as A
from tallyforge.operators import board as B
from tallyforge.operators import stats as N

TRIAL = "model string, task_id string, module string, tier string, band string, difficulty string, axis string, trial_seq long, success boolean, det_success boolean, det_score double, llm_score double, infra_error boolean, truncation_class string"


def trials(spark, rows):
    """rows: (model, task, module, seq, success) and overrides."""
    out = []
    for model, task, module, seq, ok, *more in rows:
        r = {"model": model, "task_id": task, "module": module, "tier": "baseline", "band": "mid", "difficulty": "medium", "axis": None, "trial_seq": seq, "success": ok, "det_success": ok, "det_score": float(ok), "llm_score": None, "infra_error": False, "truncation_class": ""}
        r |= more[0] if more else {}
        out.append(tuple(r.values()))
    return spark.createDataFrame(out, TRIAL)


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_pass_hat_k_is_the_ratio_of_binomials(spark, k):
    cells = [(c, n) for n in (1, 2, 3, 20, 208) for c in {0, 1, n // 2, n - 1, n} if c >= 0]
    rows = spark.createDataFrame(cells, "c long, n long").select("c", "n", A.pass_hat_k("c", "n", k).alias("p")).collect()
    for r in rows:
        assert r["p"] is None if r["n"] < k else r["p"] == pytest.approx(comb(r["c"], k) / comb(r["n"], k))


def test_grouping_counts_and_first_values(spark):
    t = trials(spark, [("m", "a", "x", 0, True, {"band": "hard"}), ("m", "a", "x", 1, False, {"band": "mid"}), ("m", "a", "x", 2, True), ("m", "a", "x", 3, True, {"infra_error": True})])
    r = A.by_task(t).first()
    assert (r["n"], r["passes"], r["band"]) == (3, 2, "hard")


def test_module_without_enough_attempts_scores_zero_and_keeps_its_weight(spark):
    t = trials(spark, [("m", "a", "x", i, True) for i in range(3)] + [("m", "b", "y", 0, True)])
    w = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("absent", 5.0)], "module string, w double")
    assert A.headline(t, w, 3).first()["headline"] == pytest.approx(0.5)


def test_tier_headline(spark):
    t = trials(spark, [("m", "a", "x", i, True) for i in range(2)] + [("m", "b", "x", i, False, {"tier": "hard"}) for i in range(2)])
    w = spark.createDataFrame([("x", 1.0)], "module string, w double")
    assert A.headline(t, w, 2, "legacy").first()["headline"] == pytest.approx(0.34)


def test_presets_are_whole(spark):
    for preset in A.MODULE_WEIGHTS.values():
        assert sum(preset.values()) == pytest.approx(1.0)
    assert sum(A.BAND_WEIGHTS.values()) == pytest.approx(1.0)


def test_judge_coverage_and_gaps(spark):
    t = trials(spark, [("m", "a", "tools", 0, True, {"llm_score": 1.0}), ("m", "a", "tools", 1, True), ("m", "b", "code", 0, True), ("m", "c", "format", 0, True)])
    r = A.judge_gaps(t).first()
    assert (r["judged"], r["total"], r["unjudged"], r["partial"]) == (1, 3, "code", "tools")


def test_observed_trials_is_the_mode_and_ties_go_up(spark):
    rows = [("m", t, "x", i, True) for t, n in (("a", 3), ("b", 3), ("c", 1)) for i in range(n)] + [("q", t, "x", i, True) for t, n in (("a", 2), ("b", 3)) for i in range(n)]
    got = {r["model"]: r["trials"] for r in A.observed_trials(trials(spark, rows), 5).collect()}
    assert got == {"m": 3, "q": 3}
    assert A.observed_trials(trials(spark, rows), 2).filter("model = 'm'").first()["trials"] == 2


def test_wilson(spark):
    cells = spark.createDataFrame([(9, 10), (45, 45), (0, 45), (0, 0)], "p long, n long")
    low, high = N.wilson(F.col("p"), F.col("n"))
    got = [tuple(r) for r in cells.select(low, high).collect()]
    assert 0.55 < got[0][0] < 0.60 and got[1][1] == 1 and got[2][0] == 0 and got[3] == (0, 0)


def test_sign_test(spark):
    cells = [(w, x) for w in range(0, 26, 3) for x in range(0, 26, 4)]
    for r in spark.createDataFrame(cells, "w long, l long").select("w", "l", N.sign_test_p(F.col("w"), F.col("l")).alias("p")).collect():
        n, low = r["w"] + r["l"], min(r["w"], r["l"])
        assert r["p"] == pytest.approx(1.0 if not n else min(1, 2 * sum(comb(n, i) for i in range(low + 1)) / 2**n))


def test_holm_is_monotone_and_never_below_p(spark):
    t = spark.createDataFrame([(i, p) for i, p in enumerate([0.04, 0.01, 0.01, 0.5, 0.03])], "i long, p double")
    got = {r["i"]: r["p_adjusted"] for r in N.holm(t, "p", ["i"]).collect()}
    assert got == pytest.approx({1: 0.05, 2: 0.05, 4: 0.09, 0: 0.09, 3: 0.5})


def test_pairs_clear_and_tied(spark):
    rows = [("a", f"t{i}", "x", s, True) for i in range(20) for s in range(2)] + [("b", f"t{i}", "x", s, False) for i in range(20) for s in range(2)] + [("c", f"t{i}", "x", s, True) for i in range(20) for s in range(2)]
    got = {(r["model_a"], r["model_b"]): r for r in N.pairs(A.by_task(trials(spark, rows)), 2).collect()}
    assert got["a", "b"]["separable"] and got["a", "b"]["wins"] == 20 and not got["a", "b"]["adjacent"]
    assert not got["a", "c"]["separable"] and got["a", "c"]["p"] == 1 and got["a", "c"]["adjacent"]


def test_item_classes(spark):
    rows = []
    for i, m in enumerate("abcdef"):
        rows += [(m, "easy", "x", s, True) for s in range(3)] + [(m, "hard", "x", s, False) for s in range(3)]
        rows += [(m, "split", "x", s, i >= 3) for s in range(3)] + [(m, "noise", "x", s, s % 2 == 0) for s in range(3)]
        rows += [(m, "adv_09", "x", s, i == 0 and s == 0) for s in range(3)]
    got = {r["task_id"]: r["class"] for r in N.items(A.by_task(trials(spark, rows)), ["a", "c", "f"]).collect()}
    assert got == {"easy": "dead_easy", "hard": "dead_hard", "split": "discriminating", "noise": "flaky", "adv_09": "restraint"}


@pytest.mark.parametrize(
    ("w", "m", "s", "want"),
    [(0, 1 / 3, 1, "ACCEPT"), (1, 2 / 3, 2 / 3, "REJECT:inverted"), (0, 0, 1 / 3, "REJECT:broken"), (1, 1, 1, "REJECT:saturated"), (2 / 3, 2 / 3, 2 / 3, "REJECT:no_signal"), (2 / 3, 2 / 3, 1, "REPROBE"), (1 / 3, 2 / 3, 1, "ACCEPT"), (2 / 3, 1 / 3, 1, "REJECT:inverted")],
)
def test_probe_table(spark, w, m, s, want):
    f = lambda x: F.lit(float(x))
    assert spark.range(1).select(N.probe_verdict(f(w), f(m), f(s), F.lit(3), F.lit(False), F.lit(False))).first()[0] == want


def test_tiers_sizes_labels(spark):
    got = spark.createDataFrame([(0.9,), (0.899,), (0.45,), (0.1,)], "h double").select(B.tier(F.col("h"))).collect()
    assert [r[0] for r in got] == ["S", "A", "D", "F"]
    models = spark.createDataFrame([("a", 26.0, 4.0), ("b", 2.6, None), ("c", None, None)], "model string, params_b double, active_b double")
    got = {r["model"]: (r["label"], r["bucket"], r["sort_b"]) for r in B.size_cells(models).collect()}
    assert got == {"a": ("26B · A4B", "xl", 4.0), "b": ("2.6B", "s", 2.6), "c": ("?", None, None)}


def test_comparability_needs_two_runs(spark):
    runs = lambda rows: spark.createDataFrame(rows, "model string, trials long, profile string")
    got = {r["model"]: r["mismatch"] for r in A.comparability(runs([("a", 3, "full"), ("b", 3, "full"), ("c", 2, "fast")]), ["trials", "profile"]).collect()}
    assert got == {"a": "", "b": "", "c": "trials,profile"}
    assert A.comparability(runs([("a", 3, "full")]), ["trials"]).first()["mismatch"] == ""


def test_second_pass_takes_whole_modules(spark):
    from tallyforge.operators import judging as J

    due = spark.createDataFrame([("m", "a", 1), ("m", "a", 2), ("m", "b", 3), ("m", "b", 4), ("n", "a", 1), ("n", "format", 9), ("n", None, 5)], "model string, module string, uid long")
    verdicts = spark.createDataFrame([("m", 1, 0.5), ("m", 1, 0.7), ("m", 3, None), ("x", 4, 1.0)], "model string, uid long, score double")
    asked = J.asked(due)
    assert {(r["model"], r["module"], r["uid"]) for r in J.second_pass(asked, verdicts).collect()} == {("m", "b", 3), ("m", "b", 4), ("n", "a", 1)}
    assert J.second_pass(asked, verdicts.limit(0)).count() == 5 and J.second_pass(asked.limit(0), verdicts).count() == 0


def test_turns_in_order_and_last_words(spark):
    from tallyforge import schema
    from tallyforge.operators import dialogues as D

    say = lambda text, *calls: ("assistant", text, [(c, "{}") for c in calls] or None, None, None, None)
    tool = lambda text: ("tool", text, None, None, None, None)
    rows = [
        ("plain", [say("let me", "a", "b"), tool("1"), tool(None), say("<think>x</think> so ")], False, ["a", "b"], ["1", None], "so"),
        ("cut", [say("words")], True, [], [], ""),
        ("calls", [say("words"), say("more", "a")], False, ["a"], [], ""),
        ("blank", [say("words"), say(" \n"), tool("x")], False, [], ["x"], "words"),
        ("thought", [say("words"), say("<think>never ends")], False, [], [], ""),
        ("none", [], False, [], [], ""),
        ("null", [say(None)], False, [], [], ""),
    ]
    frame = spark.createDataFrame([(n, t, c) for n, t, c, *_ in rows], f"k string, turns array<{schema.TURN}>, cut boolean")
    turns = frame["turns"]
    got = frame.select("k", D.flat_calls(turns)["name"].alias("calls"), D.tool_results(turns).alias("results"), D.closing_answer(turns, frame["cut"]).alias("words")).collect()
    assert {r["k"]: (r["calls"], r["results"], r["words"]) for r in got} == {n: tuple(want) for n, _, _, *want in rows}
