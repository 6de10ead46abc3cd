"""Grading of whole trial tables: each module's answers by its own rule, under constraints that differ from task to task.

The bank's different checks are known before the plan is made (a bank is small: as many as its authors wrote), so each is
compiled once, and an answer is held against its own task's checks alone.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constraints as C
from ..functions import files as D
from ..functions import jsonx as J
from ..functions import text as X
from ..functions.fuzzy import char_loop_ratio
from ..sources import lake as lakes
from ..sources.scratch import small, written
from . import calls as K
from . import judging as V
from . import maintain as M
from . import scorers as R
from .maintain import with_columns

MOST_CHECKS = 2000


def check_results(answers: DataFrame, bank: DataFrame) -> DataFrame:
    """One row for each answer and check of its task (answers: trial_id, task_id, text; bank: task_id, constraints)."""
    checks = bank.select("task_id", F.posexplode("constraints").alias("check_no", "check"))
    kinds = [r["check"] for r in checks.select("check").distinct().limit(MOST_CHECKS + 1).collect()]
    if len(kinds) > MOST_CHECKS:
        raise ValueError(f"a bank has at most {MOST_CHECKS} different checks")
    met = answers.withColumn("parsed", J.parse(F.col("text"))).join(small(checks), "task_id")
    ok = F.lit(False)
    for text in kinds:
        ok = F.when(F.col("check") == text, C.passes(json.loads(text), F.col("text"), F.col("parsed"))).otherwise(ok)
    return met.select("trial_id", "task_id", "check_no", "check", ok.alias("ok"))


def fractions(answers: DataFrame, bank: DataFrame) -> DataFrame:
    """The share of its checks that each answer meets; null for tasks without checks."""
    return check_results(answers, bank).groupBy("trial_id").agg(F.avg(F.col("ok").cast("double")).alias("fraction"))


def knowledge(text: Column, kind: Column, answer: Column, exact: Column, fact: Column) -> Column:
    """By the task's answer type; fact is what scorers.factual_rows gives."""
    return (
        F.when(kind == "numeric", R.numeric(text, answer.try_cast("double"), exact))
        .when(kind == "calibration", X.is_uncertain(text).cast("double"))
        .when(kind == "multiple_choice", F.coalesce(R.multiple_choice(text) == F.upper(F.trim(answer)), F.lit(False)).cast("double"))
        .otherwise(F.coalesce(fact, F.lit(0.0)))
    )


def text_shares(texts: DataFrame, bank: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the share of its task's checks that each text (trial_id, task_id, at, text) meets: null for tasks without checks."""
    checks = bank.select("task_id", F.col(column).alias("constraints")).filter(F.size("constraints") > 0)
    if checks.isEmpty():
        return texts.withColumn(name, F.lit(None).cast("double"))
    own = texts.select(F.struct("trial_id", "at").alias("trial_id"), "task_id", "text")
    found = fractions(own, checks).select(F.col("trial_id").alias("key"), F.col("fraction").alias(name))
    return texts.join(found, F.struct("trial_id", "at") == F.col("key"), "left").drop("key")


def file_shares(trials: DataFrame, bank: DataFrame) -> DataFrame:
    """The share of a task's file checks that hold at an episode's end (trials: trial_id, task_id, initial_state, final_state)."""
    spec = F.from_json(F.get_json_object("expected", "$.file_checks"), "map<string,array<string>>")
    checks = bank.select("task_id", F.explode(spec).alias("path", "list")).select("task_id", "path", F.explode("list").alias("check"))
    kinds = [r["check"] for r in checks.select("check").distinct().limit(MOST_CHECKS + 1).collect()]
    if len(kinds) > MOST_CHECKS:
        raise ValueError(f"a bank has at most {MOST_CHECKS} different checks")
    if not kinds:
        return trials.filter("false").select("trial_id", F.lit(None).cast("double").alias("files"))
    files = lambda c: F.from_json(F.get_json_object(c, "$.files"), "map<string,string>")
    met = trials.select("trial_id", "task_id", files("final_state").alias("now"), files("initial_state").alias("then")).join(small(checks), "task_id")
    met = met.withColumn("new", F.try_element_at("now", F.col("path"))).withColumn("old", F.coalesce(F.try_element_at("then", F.col("path")), F.lit("")))
    ok = F.lit(False)
    for text in kinds:
        ok = F.when(F.col("check") == text, D.passes(json.loads(text), F.col("new"), F.col("old"))).otherwise(ok)
    held = F.coalesce(F.col("new") != "", F.lit(False)) & F.coalesce(ok, F.lit(False))
    return met.groupBy("trial_id").agg(F.avg(held.cast("double")).alias("files"))


def grade_episodes(trials: DataFrame, bank: DataFrame) -> DataFrame:
    """score and passed of tool episodes: single calls, states and loops, told apart by what the task expects."""
    rows = K.episodes(trials)
    texts = rows.filter("kind = 'loop'").select("trial_id", "task_id", F.explode("landed").alias("l")).select("trial_id", "task_id", F.col("l.at").alias("at"), F.col("l.content").alias("text"))
    said = rows.filter("kind <> 'simple'").select("trial_id", "task_id", F.lit(-1).cast("long").alias("at"), F.col("said").alias("text"))
    wanted = bank.withColumn("final_checks", F.from_json(F.get_json_object("expected", "$.final_text_checks"), "array<string>"))
    marked = text_shares(text_shares(texts.unionByName(said), wanted, "content_checks", "content"), wanted, "final_checks", "final")
    own = F.when(F.col("at") < 0, F.struct("content", "final"))
    call = F.when(F.col("at") >= 0, F.struct("at", "content", "final"))
    # The call whose content is best, and of these the first.
    best = F.max_by(call, F.when(F.col("at") >= 0, F.struct(F.coalesce("content", F.lit(0.0)).alias("c"), (-F.col("at")).alias("a"))))
    found = written(marked.groupBy("trial_id").agg(F.max(own).alias("own"), best.alias("best")), "texts")
    checked = wanted.select("task_id", F.coalesce(F.size("content_checks") > 0, F.lit(False)).alias("has_content"), F.coalesce(F.size("final_checks") > 0, F.lit(False)).alias("has_final"))
    c = F.col
    m = rows.join(found, "trial_id", "left").join(file_shares(trials, bank), "trial_id", "left").join(small(checked), "task_id")
    m = m.withColumn("goal_call", c("best").isNotNull() & ~(c("must_last") & (c("best.at") != c("made") - 1)))
    m = m.withColumn("in_text", c("text_ok") & ~c("goal_call") & ~c("forbidden") & (c("said") != ""))
    zero = F.lit(0.0)
    m = m.withColumn("shown", F.coalesce(F.when(c("in_text"), c("own.content")).when(c("goal_call"), c("best.content")), zero))
    told = F.coalesce(F.when(c("said") != "", c("own.final")).when((c("kind") == "loop") & c("goal_call"), c("best.final")), zero)
    m = m.withColumn("final", F.when(c("has_final"), told).otherwise(1.0))
    reached = (c("goal_call") | c("in_text")) & ~c("forbidden")
    by_loop = [reached, c("made"), c("optimal"), c("loops"), c("early"), c("forbidden")]
    plain, with_content = (R.loop_tail(*by_loop, content, c("final"), c("in_text")) for content in (None, c("shown")))
    goal = F.when(c("files").isNull(), c("goal")).when(c("has_state"), (c("goal") + c("files")) / 2).otherwise(c("files"))
    state = R.state_tail(goal, c("side"), c("made"), c("optimal"), c("loops"), c("final"))
    pick = lambda i, none, own: F.when(c("kind") == "simple", c(own)).when(c("kind") == "state", F.when(c("forbidden"), none).otherwise(state[i])).when(c("has_content"), with_content[i]).otherwise(plain[i])
    # What a judge can't overrule; single calls have no other gate than forbidden tools, and states none for stopping early.
    longer = c("kind") != "simple"
    gate = V.hard_gate(c("forbidden"), F.when(longer, X.within_budget(c("made"), c("optimal"))), F.when(longer, ~c("loops")), F.when(c("kind") == "loop", ~c("early")), F.lit(""))
    return m.select("trial_id", pick(0, F.lit(0.0), "score").alias("score"), pick(1, F.lit(False), "passed").alias("passed"), gate.alias("gate"))


def dialogue_rules(bank: DataFrame) -> DataFrame:
    """task_id, turn, n_turns, checks and crossing (how many compare with the turn before): rules add up from turn to turn until revoked."""
    turns = F.from_json("conversation", "array<struct<constraints:array<string>,revokes:array<string>>>")
    none, told = M.no_texts(), lambda x, name: F.get_json_object(x, f"$.{name}")
    revoked = lambda x, turn: F.coalesce(F.array_contains(turn["revokes"], told(x, "id")), F.lit(False))

    def step(held: Column, turn: Column) -> Column:
        now = F.element_at(held, -1)
        return F.concat(held, F.array(F.concat(F.filter(now, lambda x: ~revoked(x, turn)), F.coalesce(turn["constraints"], none))))

    rows = bank.filter("conversation IS NOT NULL").select("task_id", turns.alias("turns")).select(
        "task_id", F.size("turns").alias("n_turns"), F.posexplode(F.slice(F.aggregate("turns", F.array(none), step), F.lit(2), F.size("turns"))).alias("turn", "held")
    )
    plain = F.filter("held", lambda x: ~F.coalesce(told(x, "type") == "bullets_kept", F.lit(False)))
    return rows.select("task_id", "turn", "n_turns", plain.alias("checks"), "held").select("task_id", "turn", "n_turns", "checks", (F.size("held") - F.size("checks")).alias("crossing"))


def grade_dialogues(trials: DataFrame, bank: DataFrame) -> DataFrame:
    """score (the mean share of rules that hold) and passed (all turns are there, and all rules hold) of dialogues. A turn that was cut has no share."""
    rules, c = dialogue_rules(bank), F.col
    own = trials.select("trial_id", "task_id", F.from_json("turns", "array<struct<content:string,truncated:boolean>>").alias("turns")).join(small(rules), "task_id")
    said = lambda i: F.coalesce(F.try_element_at("turns", i)["content"], F.lit(""))
    own = own.select(
        "trial_id", F.struct("task_id", "turn").alias("task_id"), F.col("turn").alias("at"), "n_turns", F.size("checks").alias("n"), "crossing", F.coalesce(F.size("turns"), F.lit(0)).alias("seen"),
        said(c("turn") + 1).alias("text"), F.when(c("turn") > 0, F.nullif(said(F.greatest(c("turn"), F.lit(1))), F.lit(""))).alias("before"),
        F.coalesce(F.try_element_at("turns", c("turn") + 1)["truncated"], F.lit(False)).alias("cut"),
    )
    met = text_shares(own, rules.select(F.struct("task_id", "turn").alias("task_id"), "checks"), "checks", "share")
    share = F.coalesce("share", F.lit(1.0))
    kept = F.when(C.cross_turn_bullets(c("text"), c("before")), c("crossing")).otherwise(0)
    full = F.when(c("cut"), 0.0).when(c("crossing") > 0, (F.round(share * c("n")) + kept) / (c("n") + c("crossing"))).otherwise(share)
    return met.withColumn("share", full).groupBy("trial_id").agg(
        F.round(F.avg(F.round("share", 4)), 4).alias("score"), ((F.min("share") >= R.FULL) & (F.max("seen") >= F.max("n_turns"))).alias("passed")
    )


#: What grade() reads of an answer besides its keys and text, and of a task besides its keys, answer and constraints.
OF_ANSWER = {"calls": "string", "results": "string", "final_state": "string", "opening": "string", "closing": "string", "turns": "string", "attempts_used": "int"}
OF_TASK = {
    "expected": "string", "parallel": "string", "initial_state": "string", "content_checks": "array<string>", "has_tools": "boolean", "conversation": "string", "function_name": "string",
    "accept": "array<string>", "exact": "boolean", "support_code": "string", "test_cases": "string", "regression_cases": "string", "context_files": "string",
}


def grade_texts(own: DataFrame, answers: DataFrame, bank: DataFrame, facts: bool) -> DataFrame:
    """score and passed of answers that are graded as they stand; own: answers with their tasks."""
    module, text = F.col("module"), F.col("text")
    shares = fractions(answers, bank.filter("way IN ('text', 'fact')")).withColumnRenamed("trial_id", "f_trial")
    candidates = F.filter(F.concat(F.array("answer"), F.coalesce("accept", M.no_texts())), lambda c: c.isNotNull())
    known = R.factual_rows(own.filter("way = 'fact'").select("trial_id", "text", candidates.alias("candidates"), "exact")) if facts else None
    # What texts tell is told before the joins, so that no text is shuffled for them.
    parsed, kind = J.parse(text), F.col("answer_type")
    gate = (kind == "json") & (parsed.isNull() | F.is_variant_null(parsed))
    own = own.select(
        "trial_id", "module", "truncated", F.when(kind.isin("numeric", "calibration", "multiple_choice"), knowledge(text, kind, F.col("answer"), F.col("exact"), F.lit(None).cast("double"))).alias("answered"),
        F.coalesce(gate, F.lit(False)).alias("no_json"), (X.stripped(F.coalesce(text, F.lit(""))) != "").alias("said"),
    ).join(shares, F.col("trial_id") == F.col("f_trial"), "left").withColumn("fact", F.lit(None).cast("double"))
    if known is not None:
        own = own.drop("fact").join(known.select(F.col("trial_id").alias("k_trial"), F.col("score").alias("fact")), F.col("trial_id") == F.col("k_trial"), "left")
    answered = F.coalesce("answered", "fact", F.lit(0.0))
    formed = F.when(F.col("fraction").isNull(), answered).otherwise(R.with_constraints(answered, F.col("fraction")))
    shaped = F.when(F.col("no_json"), 0.0).otherwise(F.coalesce("fraction", F.lit(0.0)))
    score = (
        F.when(module.isin("knowledge", "long_context"), formed).when(module == "format", F.round(shaped, 4))
        .otherwise(F.when(F.col("truncated") | ~F.col("said"), 0.0).otherwise(F.round(shaped, 4)))
    )
    return own.withColumn("score", score).select("trial_id", "score", (F.col("score") >= R.FULL).alias("passed"))


def grade(answers: DataFrame, bank: DataFrame, **limits) -> DataFrame:
    """score and passed of each answer, as graded() has them."""
    return graded(answers, bank, **limits).select("trial_id", "task_id", "module", "score", "passed")


def graded(answers: DataFrame, bank: DataFrame, **limits) -> DataFrame:
    """score, passed and gate (the first hard gate that a tool episode fails) of each answer (trial_id, task_id, text, truncated, truncation_class).

    bank: task_id, module, answer_type, answer (with accept, more right answers, and exact), constraints. Knowledge and long-context answers weigh their form in; format
    and plain adversarial answers are their checks, and must parse where JSON is asked for; what is extracted is matched field
    by field. Tools, and adversarial tasks with has_tools, are graded as episodes. For these, answers also have, as JSON texts,
    calls ([{name, arguments}]), results (a list of texts in the order of calls) and final_state, and the texts of the first
    turn (opening) and of a last turn without calls (closing); the bank has, as JSON texts, expected, parallel and
    initial_state, and content_checks like constraints. Dialogues have turns ([{content, truncated}], the model's) and the
    bank's conversation ([{constraints, revokes}]). Code has attempts_used and the bank's function_name, support_code and, as
    JSON texts, test_cases, regression_cases ([{args, expected}]) and context_files; it runs under limits (as sandbox.run has
    them), and without a sandbox its score is null. A module without a rule is an error.
    """
    answers, bank = with_columns(answers, **OF_ANSWER), with_columns(bank, **OF_TASK)
    module, text = F.col("module"), F.col("text")
    fields = F.from_json(F.get_json_object("expected", "$.extracted"), "map<string,string>")
    extracted = (module == "data_extract") | ((module == "format") & F.coalesce(F.size(fields) > 0, F.lit(False)))
    tooled = (module == "tools") | ((module == "adversarial") & F.coalesce("has_tools", F.lit(False)))
    by_rule = module.isin("knowledge", "long_context", "format", "adversarial")
    way = F.when(tooled, "tools").when(extracted, "extract").when(module.isin("code", "multi_turn_if"), module).when(by_rule, "text").otherwise("none")
    told = module.isin("knowledge", "long_context") & ~F.coalesce(F.col("answer_type").isin("numeric", "calibration", "multiple_choice"), F.lit(False))
    bank = bank.withColumn("way", F.when((way == "text") & told, "fact").otherwise(way))
    # Only the ways that the bank's tasks take are planned: seven at most.
    ways = {r["way"] for r in bank.select("way").distinct().collect()}
    met = answers.join(small(bank.drop("constraints", "content_checks")), "task_id").withColumn("closing", F.when(F.col("truncated"), "").otherwise(F.col("closing")))
    found = []
    if ways & {"text", "fact"}:
        found.append(grade_texts(met.filter("way IN ('text', 'fact')"), answers, bank, "fact" in ways))
    if "extract" in ways:
        found.append(K.extract_scores(met.filter("way = 'extract'").select("trial_id", "expected", text.alias("response"))))
    if "multi_turn_if" in ways:
        found.append(grade_dialogues(met.filter("way = 'multi_turn_if'"), bank))
    if "code" in ways:
        found.append(R.code_rows(met.filter("way = 'code'"), **limits))
    if "none" in ways:
        fails = F.raise_error(F.concat(F.lit("no rule for module "), module))
        found.append(met.filter("way = 'none'").select("trial_id", fails.cast("double").alias("score"), F.lit(False).alias("passed")))
    found.append(grade_episodes(met.filter("way = 'tools'"), bank) if "tools" in ways else met.filter("false").select("trial_id", F.lit(0.0).alias("score"), F.lit(False).alias("passed"), F.lit("").alias("gate")))
    scored = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    final = R.gated(module, F.col("truncated"), F.col("truncation_class"), F.col("score"))
    cut = (final == 0.0) & (F.col("score") != 0.0)
    out = met.select("trial_id", "task_id", "module", "truncated", "truncation_class").join(scored, "trial_id", "left")
    return out.select("trial_id", "task_id", "module", final.alias("score"), (F.col("passed") & ~F.coalesce(cut, F.lit(False))).alias("passed"), "gate")


#: What a re-grade puts anew into a stored trial.
RESTAMPED = {
    "task_hash": "string", "difficulty": "string", "tier": "string", "band": "string", "expected": "string", "det_score": "double", "det_success": "boolean", "success": "boolean",
    "infra_error": "boolean", "truncation_class": "string", "judge_anchor_det": "double", "judge_blocked_by": "string",
}
#: What else it reads of a trial and of a task.
OF_TRIAL = {"llm_score": "double", "error": "string", "text": "string", "truncated": "boolean", "calls": "string"}
OF_RUBRIC = {"difficulty": "string", "tier": "string", "band": "string", "expected": "string", "answer_type": "string", "constraints": "array<string>", "function_name": "string", "has_tools": "boolean"}


def recorded_expected() -> Column:
    """The rubric that a trial of a task keeps for its judge, as a JSON text: what it expects, and for some modules the answer's type and the checks."""
    c = F.col
    variants = lambda text: F.expr(f"cast(parse_json({text}) as map<string,variant>)")
    own = F.when(F.coalesce(c("expected"), F.lit("")) != "", variants("expected")).otherwise(variants("'{}'"))
    kind = F.create_map(F.lit("answer_type"), F.parse_json(F.to_json(F.struct(c("answer_type")))))
    kind = F.transform_values(kind, lambda _, v: F.coalesce(F.try_variant_get(v, "$.answer_type", "variant"), F.parse_json(F.lit("null"))))
    checks = F.create_map(F.lit("constraints"), F.parse_json(F.concat(F.lit("["), F.array_join(F.coalesce("constraints", M.no_texts()), ","), F.lit("]"))))
    tooled = (c("module") == "adversarial") & F.coalesce("has_tools", F.lit(False))
    return (
        F.when(c("module") == "code", F.to_json(F.struct("function_name")))
        .when((c("module") == "adversarial") & ~tooled, F.to_json(F.map_concat(kind, checks)))
        .when(c("module") == "format", F.to_json(F.map_concat(own, kind, checks)))
        .when(c("module") == "knowledge", F.to_json(F.map_concat(own, kind)))
        .otherwise(F.to_json(own))
    )


def same_calls() -> Column:
    """How often the most frequent of a trial's calls (name and arguments, keys in any order) was made."""
    calls = F.coalesce(F.from_json("calls", "array<struct<name:string,arguments:string>>"), F.array().cast("array<struct<name:string,arguments:string>>"))
    said = F.transform(calls, lambda x: F.concat_ws(" ", x["name"], F.to_json(F.try_parse_json(x["arguments"]))))
    return F.coalesce(F.array_max(F.transform(F.array_distinct(said), lambda s: F.size(F.filter(said, lambda x: x == s)))), F.lit(0))


def truncation_classes(trials: DataFrame) -> DataFrame:
    """truncation_class anew, from the texts and calls that are kept. The Arrow measure gets the texts that were cut; no text is shuffled."""
    cut = F.coalesce("truncated", F.lit(False))
    own = trials.withColumn("truncated", cut).withColumn("_said", F.when(cut, F.coalesce("text", F.lit(""))))
    found = X.truncation_class(F.col("truncated"), X.loop_ratio(F.coalesce("_said", F.lit(""))), char_loop_ratio(F.col("_said")), same_calls())
    return own.withColumn("truncation_class", found).drop("_said")


def rescore(trials: DataFrame, bank: DataFrame, allow_drift: bool = False, only_changed: bool = False, **limits) -> DataFrame:
    """Grades stored trials anew where rescore_status() allows it, and restamps them (RESTAMPED).

    trials: as graded()'s answers, with module, error, n_turns, task_hash, OF_STORED, det_score, success, and llm_score and
    judge_anchor_det where a judge has seen them; bank: as graded()'s, with task_hash, OF_BANK, difficulty, tier and band. Adds status, drift,
    regraded_only (a changed task that shows the same), moved (score or deterministic verdict), stale_judge and flipped ('pass', 'fail'). A judge's
    score stays, and its verdict is derived again; a judged trial without an anchor gets the score that the judge saw. Trials that can't be
    graded, and code without a sandbox (status skipped_sandbox), keep what they had. only_changed: trials of unchanged tasks keep it too (status same).
    """
    given = trials.columns
    trials = with_columns(trials, **RESTAMPED, **OF_TRIAL)
    bank = with_columns(bank, **OF_RUBRIC, **M.OF_BANK)
    stamps = bank.withColumn("expected", recorded_expected()).select("module", "task_id", *[F.col(c).alias(f"new_{c}") for c in ("difficulty", "tier", "band", "expected")])
    c = F.col
    met = M.rescore_status(trials, bank, allow_drift).join(stamps, ["module", "task_id"], "left")
    if only_changed:
        met = met.withColumn("status", F.when((c("status") == "rescored") & ~c("task_changed"), "same").otherwise(c("status")))
    due = truncation_classes(met.filter("status = 'rescored'"))
    own = ["trial_id", "task_id", "text", "truncated", "truncation_class", *(x for x in OF_ANSWER if x in trials.columns)]
    new = graded(due.select(*own), bank.drop("task_hash", *M.OF_BANK, "difficulty", "tier", "band"), **limits).join(due.select("trial_id", c("truncation_class").alias("new_class")), "trial_id")
    new = new.select("trial_id", c("score").alias("new_score"), c("passed").alias("new_passed"), c("gate").alias("new_gate"), "new_class")
    out = met.join(new, "trial_id", "left")
    fresh, was = c("new_score").isNotNull(), F.coalesce("det_success", "success")
    moved = fresh & (~(F.abs(c("new_score") - c("det_score")) <= 1e-9) | ~c("new_passed").eqNullSafe(was) | c("det_score").isNull())
    out = out.withColumns({"moved": F.coalesce(moved, F.lit(False)), "status": F.when((c("status") == "rescored") & ~fresh, "skipped_sandbox").otherwise(c("status")), "was_success": c("success")})
    anchor = F.when(c("moved") & c("llm_score").isNotNull() & c("judge_anchor_det").isNull(), c("det_score")).otherwise(c("judge_anchor_det"))
    put = lambda name, value: F.when(fresh, value).otherwise(c(name))
    unhashed = F.coalesce(c("task_hash"), F.lit("")) == ""
    out = out.withColumns({
        "judge_anchor_det": put("judge_anchor_det", anchor), "task_hash": F.when(fresh & ~unhashed, c("now_hash")).otherwise(c("task_hash")),
        **{x: put(x, c(f"new_{x}")) for x in ("difficulty", "tier", "band", "expected")}, "truncation_class": put("truncation_class", c("new_class")),
        "infra_error": F.when(fresh & (F.coalesce("error", F.lit("")) == ""), F.lit(False)).otherwise(c("infra_error")),
        "det_score": put("det_score", c("new_score")), "det_success": put("det_success", c("new_passed")),
        "regraded_only": fresh & c("task_changed") & ~c("drift"),
    })
    gate = F.coalesce("new_gate", F.when(c("truncation_class") == "degenerate", "degenerate"))
    judged = V.apply_verdicts(out.withColumn("was_blocked", c("judge_blocked_by")), gate, c("judge_anchor_det"))
    asked = fresh & c("llm_score").isNotNull()
    judged = judged.withColumns({
        "success": F.when(asked, c("judged_success")).when(fresh, c("new_passed")).otherwise(c("success")),
        "judge_blocked_by": F.when(asked, F.coalesce("judge_blocked_by", "was_blocked")).otherwise(c("was_blocked")),
        "stale_judge": asked & V.anchor_is_stale(c("judge_anchor_det"), c("det_score")),
    })
    flipped = F.when(fresh & ~c("success").eqNullSafe(c("was_success")), F.when(c("success"), "pass").otherwise("fail"))
    told = ["status", "drift", "regraded_only", "moved", "stale_judge"]
    columns = [*given, *(x for x in RESTAMPED if x not in given), *told]
    return judged.select(*columns, flipped.alias("flipped"))


def rescore_lake(spark: SparkSession, lake: str, bank: DataFrame, **how) -> int:
    """Grades the trials of a lake (sources.lake) anew and writes back those that changed; the lake's version afterwards.

    Only parts with a trial that changed are written. What fails before the commit leaves the lake as it was, and a second run changes nothing.
    """
    trials = lakes.read(spark, lake)
    own = [x for x in RESTAMPED if x in trials.columns]
    old = trials.select(F.col("trial_id").alias("_id"), F.struct(*own).alias("_old"))
    new = rescore(trials, bank, **how).select("trial_id", *own)
    # Only what a re-grade stamps goes through its joins; texts meet it once, on their way into the lake.
    changed = written(new.join(old, new["trial_id"] == old["_id"]).filter(~F.struct(*own).eqNullSafe(F.col("_old"))).select("trial_id", *own), "stamps")
    return lakes.upsert(trials.drop(*own).join(changed, "trial_id").select(*trials.columns), lake, ["trial_id"], "module")
