"""Queries over server responses and whole-table grading, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import responses as S
from ..operators import calls as K
from ..operators import grading as G
from . import fixtures as X
from .registry import entry, rounded

#: A small bank over the answers: documents' remainders by 4 are its tasks.
BANK = [
    ("t0", "knowledge", "numeric", "1500", []),
    ("t1", "knowledge", "factual", "tion", [{"type": "min_bullets", "value": 5}, {"type": "ends_with_number"}]),
    ("t2", "format", "text", None, [{"type": "max_words", "value": 300}, {"type": "min_headings", "value": 1}, {"type": "not_contains", "value": "qu"}]),
    ("t3", "long_context", "calibration", None, [{"type": "max_words", "value": 300}]),
]


def bank(spark):
    rows = [(i, m, k, a, [json.dumps(c) for c in cs]) for i, m, k, a, cs in BANK]
    return spark.createDataFrame(rows, "task_id string, module string, answer_type string, answer string, constraints array<string>")


def graded(spark, sf_dir):
    a = X.answers(spark, sf_dir)
    return a.select(
        F.col("doc_id").alias("trial_id"), F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string")).alias("task_id"), F.col("answer").alias("text"),
        (F.col("doc_id") % 19 == 0).alias("truncated"), F.when(F.col("doc_id") % 19 == 0, "incomplete").otherwise("").alias("truncation_class"),
    )


BULLET = r"(?m)^\s*(?:[-*+•·‣▪◦⁃]|\d+\.)\s+\S"
PUNCT = r"^[*_`~#>|\-–—•·.,:;!?()\[\]{}\"'']+$"
WORDS = f"len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '{PUNCT}'))) <= 300"
BUL = f"len(regexp_extract_all(answer, '{BULLET}')) >= 5"
END = r"""regexp_matches(regexp_replace(answer, '[\s*_`~.,:;!?)\]}"''$]+$', ''), '-?\d[\d,]*(?:\.\d+)?$')"""
NUM = r"CAST(replace(list_extract(regexp_extract_all(answer, '-?\d[\d,]*(?:\.\d+)?'), -1), ',', '') AS DOUBLE)"
ONE = lambda c: f"CAST(({c}) AS INT)"
FRAC = f"""fr AS (SELECT doc_id, answer, CASE doc_id % 4 WHEN 1 THEN CAST({ONE(BUL)} + {ONE(END)} AS DOUBLE) / 2 WHEN 2 THEN CAST({ONE(WORDS)} + 1 + {ONE("NOT contains(lower(answer), 'qu')")} AS DOUBLE) / 3 WHEN 3 THEN CAST({ONE(WORDS)} AS DOUBLE) END AS fraction FROM answers)"""


@entry(f"WITH {X.ANSWERS_SQL}, {FRAC} SELECT doc_id AS trial_id, round(fraction, 6) AS fraction FROM fr WHERE fraction IS NOT NULL")
def r8_check_fractions(spark, sf_dir):
    return rounded(G.fractions(graded(spark, sf_dir), bank(spark)))


UNCERTAIN = "regexp_matches(regexp_replace(lower(answer), '[*_`]', '', 'g'), 'don''t know|do not know|not know|not sure|uncertain|unknowab|unpredictab|impossib|unattainab|unanswerab|cannot|can''t|unable to|not possible|no way|no one|nobody|don''t have access|do not have access|only estimate|only an estimate|rough estimate|beyond anyone|not feasible')"


SCORE = f"""CASE f.doc_id % 4 WHEN 0 THEN CASE WHEN abs({NUM.replace("answer", "f.answer")} - 1500) <= 15 THEN CAST(1 AS DOUBLE) ELSE 0 END
WHEN 1 THEN round(CASE WHEN contains(lower(f.answer), 'tion') THEN CAST(1 AS DOUBLE) ELSE 0 END * (CAST(0.85 AS DOUBLE) + CAST(0.15 AS DOUBLE) * fraction), 4) WHEN 2 THEN round(fraction, 4)
ELSE round(CASE WHEN {UNCERTAIN.replace("(answer)", "(f.answer)")} THEN CAST(1 AS DOUBLE) ELSE 0 END * (CAST(0.85 AS DOUBLE) + CAST(0.15 AS DOUBLE) * fraction), 4) END"""


@entry(f"""WITH {X.ANSWERS_SQL}, {FRAC}, sc AS (SELECT doc_id, {SCORE} AS s FROM fr f)
SELECT doc_id AS trial_id, 't' || CAST(doc_id % 4 AS VARCHAR) AS task_id, CASE doc_id % 4 WHEN 2 THEN 'format' WHEN 3 THEN 'long_context' ELSE 'knowledge' END AS module,
CASE WHEN doc_id % 19 = 0 THEN 0 ELSE s END AS score, CASE WHEN doc_id % 19 = 0 THEN 0 ELSE s END >= 0.999 AS passed FROM sc""")
def r1_grade(spark, sf_dir):
    return G.grade(graded(spark, sf_dir), bank(spark))


def responses(spark, sf_dir):
    """Responses of three kinds of servers, and none."""
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    k = F.get_json_object("props", "$.k")
    own = F.concat(F.lit('{"timings": {"prompt_n": '), k, F.lit(', "cache_n": 3, "prompt_ms": 250, "predicted_ms": 1500}, "usage": {"completion_tokens": '), n, F.lit("}}"))
    timed = F.concat(F.lit('{"usage": {"prompt_tokens": '), k, F.lit(', "prompt_tokens_details": {"cached_tokens": 10}, "prompt_eval_duration": 0.5, "completion_tokens": '), n, F.lit("}}"))
    counts = F.concat(F.lit('{"usage": {"prompt_tokens": '), k, F.lit(', "completion_tokens": "x"}, "choices": [{"finish_reason": "length", "message": {"content": " ", "reasoning_content": "<think>a</think> b", "tool_calls": [{"function": {"name": "f", "arguments": "{\\"q\\": '), n, F.lit('}"}}, {"function": {"name": "g", "arguments": "{bad"}}]}}]}'))
    text = F.when(e % 4 == 0, own).when(e % 4 == 1, timed).when(e % 4 == 2, counts).otherwise("{}")
    return X.table(spark, sf_dir, "events").select("event_id", J.parse(text).alias("v"))


@entry("""WITH q AS (SELECT event_id, event_id % 4 AS m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN m < 2 THEN event_id ELSE 0 END AS completion_tokens, CASE m WHEN 0 THEN k WHEN 1 THEN greatest(0, k - 10) WHEN 2 THEN CASE WHEN k > 0 THEN k END END AS prompt_tokens, CASE m WHEN 0 THEN 3 WHEN 1 THEN 10 WHEN 2 THEN CASE WHEN k > 0 THEN CAST(0 AS BIGINT) END END AS cached,
CASE m WHEN 0 THEN CAST(0.25 AS DOUBLE) WHEN 1 THEN 0.5 WHEN 2 THEN CASE WHEN k > 0 THEN 0 END END AS prefill, CASE m WHEN 0 THEN 'llamacpp' WHEN 1 THEN 'omlx' WHEN 2 THEN CASE WHEN k > 0 THEN 'usage' END END AS source,
m = 2 AS capped, CASE WHEN m = 2 THEN 'b' ELSE '' END AS text, CASE WHEN m = 2 THEN 'f:{"q":' || CAST(event_id AS VARCHAR) || '},g:{}' ELSE '' END AS calls FROM q""")
def x20_responses(spark, sf_dir):
    v = F.col("v")
    r = responses(spark, sf_dir).withColumn("t", S.call_timings(v))
    calls = F.array_join(F.transform(S.tool_calls(v), lambda c: F.concat(c["name"], F.lit(":"), c["arguments"])), ",")
    return r.select(
        "event_id", S.completion_tokens(v).alias("completion_tokens"), F.col("t.prompt_tokens").alias("prompt_tokens"), F.col("t.cached_prompt_tokens").alias("cached"), F.col("t.prefill_seconds").alias("prefill"),
        F.col("t.source").alias("source"), S.hit_length_cap(v).alias("capped"), S.message_text(v).alias("text"), calls.alias("calls"),
    )


@entry(f"WITH {X.RUNS_SQL} SELECT model, CASE WHEN temperature IS NULL THEN 'server-default' WHEN temperature = 0 THEN 'temperature=0' ELSE 'temperature=0.7' END || ', ' || CASE WHEN model_no % 2 = 0 THEN 'no seed sent' ELSE 'seed=' || CAST(model_no AS VARCHAR) || '+trial' END AS sampling FROM runs")
def x25_sampling(spark, sf_dir):
    r = X.runs(spark, sf_dir)
    seed = F.when(F.col("model_no") % 2 == 1, F.col("model_no"))
    return r.select("model", S.sampling_description(F.col("temperature"), seed).alias("sampling"))


@entry(f"""WITH {X.TRIALS_SQL}, {X.TASKS_SQL} SELECT model, task_id, round({X.pass_k_sql("passes", "n", 4)}, 6) AS p4, n <= greatest(2 * passes, passes + 3) OR passes <= 0 AS budget FROM tasks""")
def sql_functions(spark, sf_dir):
    from ..functions import sqlfuncs
    from ..operators.aggregates import by_task

    sqlfuncs.register(spark)
    tasks = by_task(X.trials(spark, sf_dir))
    return rounded(spark.sql("SELECT model, task_id, pass_hat_k(passes, n, 4) AS p4, within_budget(n, passes) AS budget FROM {tasks}", tasks=tasks))


# Tool episodes: an order's line items are its calls.

WANTED = [{"tool_name": "RF", "required_args": {"k": 10}}, {"tool_name": "AF", "required_args": {"k": 20}}, {"tool_name": "NO", "required_args": {"k": 30}}, {"tool_name": "NF", "required_args": {"k": 40}}]


def orders(spark, sf_dir):
    """trial_id, calls and results (JSON texts) of every order, and its last argument for each name."""
    c = X.calls(spark, sf_dir)
    call = F.to_json(F.struct("name", F.struct(F.col("argument").alias("k")).alias("arguments")))
    result = F.when(F.col("failed"), '{"error": "down"}').otherwise('{"ok": true}')
    own = c.groupBy(F.col("episode").alias("trial_id")).agg(F.array_sort(F.collect_list(F.struct("pos", call.alias("call"), result.alias("result")))).alias("x"))
    last = c.groupBy("episode", "name").agg(F.max_by("argument", "pos").alias("v")).groupBy(F.col("episode").alias("e")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "v")))).alias("final_state"))
    met = own.join(last, F.col("trial_id") == F.col("e"))
    joined = F.concat(F.lit("["), F.array_join(F.col("x.call"), ","), F.lit("]"))
    return met.select("trial_id", joined.alias("calls"), F.to_json("x.result").alias("results"), "final_state", F.size("x").alias("n_calls"))


def fold_sql(n: int) -> str:
    """The n-th wanted call takes the best call that those before it left; ties go to the first."""
    w = WANTED[n]
    mark = f"0.34 * CAST(name = '{w['tool_name']}' AS INT) + 0.33 + 0.33 * CAST(argument = {w['required_args']['k']} AS INT)"
    gone = "".join(f" AND NOT EXISTS (SELECT 1 FROM s{i} WHERE s{i}.episode = c.episode AND s{i}.pos = c.pos)" for i in range(n))
    return f"s{n} AS (SELECT episode, arg_max(pos, (m, -pos)) AS pos, max(m) AS m FROM (SELECT episode, pos, CAST({mark} AS DOUBLE) AS m FROM calls c WHERE episode % 3 + 2 > {n}{gone}) GROUP BY episode)"


@entry(f"""WITH {X.CALLS_SQL}, {", ".join(fold_sql(n) for n in range(4))}, n AS (SELECT episode, count(*) AS made, episode % 3 + 2 AS wanted FROM calls GROUP BY episode),
g AS (SELECT episode, (coalesce(s0.m, 0) + coalesce(s1.m, 0) + coalesce(s2.m, 0) + coalesce(s3.m, 0)) / wanted AS covered, greatest(0, made - wanted) AS extra FROM n
  LEFT JOIN s0 USING (episode) LEFT JOIN s1 USING (episode) LEFT JOIN s2 USING (episode) LEFT JOIN s3 USING (episode))
SELECT episode AS trial_id, round(greatest(0, covered - least(CAST(0.3 AS DOUBLE), 0.1 * extra)), 4) AS score, covered >= 0.999 AND extra = 0 AS passed FROM g""")
def r13_parallel(spark, sf_dir):
    """Two to four wanted calls for each order, which take the best of its calls in turn."""
    o = orders(spark, sf_dir)
    wanted = F.lit(None).cast("string")
    for n in (2, 3, 4):
        wanted = F.when(F.col("trial_id") % 3 + 2 == n, json.dumps(WANTED[:n])).otherwise(wanted)
    return K.tool_scores(o.select("trial_id", F.lit("{}").alias("expected"), wanted.alias("parallel"), "calls", "results", F.lit("").alias("answer")))


@entry("""SELECT event_id AS trial_id, CAST(event_id % 3 <> 0 AND event_id % 5 <> 0 AS INT) * CAST(1 AS DOUBLE) AS score, event_id % 3 <> 0 AND event_id % 5 <> 0 AS passed FROM events""")
def r12_no_call(spark, sf_dir):
    """A third of the events make a call although none is wanted, a fifth say nothing."""
    e = X.table(spark, sf_dir, "events")
    calls = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}]"))).otherwise("[]")
    rows = e.select(F.col("event_id").alias("trial_id"), F.lit('{"no_call": true}').alias("expected"), calls.alias("calls"), F.lit(None).cast("string").alias("results"), F.when(F.col("event_id") % 5 == 0, " \n").otherwise(F.col("event_type")).alias("answer"))
    return K.tool_scores(rows)


EPISODES = [
    ("t0", {"goal_tool": "RF", "goal_args": {"k": 17}, "optimal_turns": 3, "min_calls": 2}),
    ("t1", {"goal_tool": "NO", "goal_args": {"k": 5}, "goal_args_exact": ["k"], "goal_must_be_last": True, "forbidden_tools": ["AF"], "forbidden_unless": {"AF": {"k": 20}}}),
    ("t2", {"expected_state": {"AF": 20, "RF": 30}, "accept_state": {"RF": [10, 40]}, "unchanged": ["NO"], "optimal_turns": 2}),
]
BEFORE = {"AF": 5, "NO": 1, "RF": 30}
CLIP = "least(CAST(1 AS DOUBLE), CAST({} AS DOUBLE) / made)"


@entry(f"""WITH {X.CALLS_SQL}, l AS (SELECT *, lag(name) OVER o = name AND lag(argument) OVER o = argument AND NOT lag(failed) OVER o AS same, count(*) OVER (PARTITION BY episode) AS made FROM calls WINDOW o AS (PARTITION BY episode ORDER BY pos)),
m AS (SELECT episode, episode % 3 AS k, any_value(made) AS made, coalesce(bool_or(same), false) AS loops, bool_or(name = 'RF' AND argument = 17 AND NOT failed) AS g0, bool_or(name = 'NO' AND argument = 5 AND NOT failed AND pos = made) AS g1_last,
  min(CASE WHEN name = 'NO' AND argument = 5 AND NOT failed THEN pos END) AS g1_first, bool_or(name = 'AF' AND argument <> 20) AS bad,
  arg_max(argument, pos) FILTER (name = 'AF') AS af, arg_max(argument, pos) FILTER (name = 'RF') AS rf, arg_max(argument, pos) FILTER (name = 'NO') AS no FROM l GROUP BY episode),
p AS (SELECT *, CASE k WHEN 0 THEN g0 WHEN 1 THEN g1_first IS NOT NULL AND g1_first = made AND NOT bad END AS goal, CASE WHEN k = 0 THEN made < 2 ELSE false END AS early, k = 1 AND bad AS forbidden,
  (CAST(coalesce(af = 20, false) AS INT) + CAST(coalesce(rf IN (10, 30, 40), false) AS INT)) / CAST(2 AS DOUBLE) AS done, CAST(coalesce(no = 1, false) AS INT) AS side, CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS optimal FROM m)
SELECT episode AS trial_id, CASE WHEN k = 2 THEN round(done * 0.6 + side * 0.2 + {CLIP.format("optimal")} * 0.1 + CASE WHEN loops THEN 0 ELSE 0.1 END, 4) WHEN forbidden THEN 0
  ELSE round(CAST(goal AS INT) * CAST(0.4 AS DOUBLE) + CASE WHEN goal THEN {CLIP.format("optimal")} ELSE 0 END * 0.3 + CASE WHEN loops THEN 0 ELSE 0.2 END + CASE WHEN early THEN 0 ELSE 0.1 END, 4) END AS score,
  CASE WHEN k = 2 THEN done >= 0.999 AND side = 1 ELSE goal AND NOT forbidden AND NOT loops AND NOT early END AND made <= greatest(2 * optimal, optimal + 3) AS passed FROM p""")
def r14_episodes(spark, sf_dir):
    """Orders as tool episodes: two kinds of loops and one of states, from calls and results to score and verdict."""
    o = orders(spark, sf_dir).withColumn("task_id", F.concat(F.lit("t"), (F.col("trial_id") % 3).cast("string")))
    final = F.to_json(F.map_concat(F.from_json(F.lit(json.dumps({"spare": 0})), "map<string,long>"), F.from_json("final_state", "map<string,long>")))
    answers = o.select("trial_id", "task_id", F.lit(None).cast("string").alias("text"), F.lit(False).alias("truncated"), F.lit("").alias("truncation_class"), "calls", "results", final.alias("final_state"))
    rows = [(t, "tools", None, None, [], json.dumps(e), json.dumps(BEFORE)) for t, e in EPISODES]
    return G.grade(answers, spark.createDataFrame(rows, "task_id string, module string, answer_type string, answer string, constraints array<string>, expected string, initial_state string")).select("trial_id", "score", "passed")


# One graded table with rows of every kind: events, six kinds in turn.

RULES = [{"constraints": [{"id": "a", "type": "contains", "any": ["alpha"]}]}, {"constraints": [{"type": "not_contains", "value": "beta"}]}, {"revokes": ["a"]}]
ATTACK = ['{"type": "contains", "all": ["view"]}', '{"type": "not_contains", "value": "maybe"}']
#: module, answer type, answer, checks, what is expected, dialogue.
KINDS = [
    ("knowledge", "multiple_choice", "B", [], {}, None), ("data_extract", None, None, [], {"extracted": {"kind": 1, "n.k": 30}}, None),
    ("tools", None, None, [], {"tool_name": "click", "required_args": {"k": 30}}, None), ("tools", None, None, [], {"no_call": True}, None),
    ("adversarial", "constraint", None, ATTACK, {}, None), ("multi_turn_if", None, None, [], {}, json.dumps(RULES)),
]


@entry("""WITH e AS (SELECT event_id AS i, CASE WHEN event_id % 24 < 12 THEN 0 ELSE 1 END AS half, user_id AS u, event_type AS t, value AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
q AS (SELECT *, CAST(half = 0 AS INT) AS c0, (CAST(half = 0 AS INT) + CAST(v <= 20 AS INT)) / CAST(2 AS DOUBLE) AS c1, CAST(u % 3 <> 0 AND u % 5 <> 0 AS INT) AS c2 FROM e),
s AS (SELECT *, CASE i % 6 WHEN 0 THEN CAST(u % 4 = 1 AS INT) WHEN 1 THEN (CAST(t = 'view' AS INT) + CAST(k = 30 AS INT)) / CAST(2 AS DOUBLE)
  WHEN 2 THEN CASE WHEN half = 0 THEN 0.15 + CASE WHEN t = 'click' THEN 0.25 ELSE 0 END + 0.35 + CASE WHEN k = 30 THEN 0.25 ELSE 0 END ELSE 0 END
  WHEN 3 THEN CAST(half = 1 AND u % 5 <> 0 AS INT) WHEN 4 THEN CASE WHEN u % 7 = 0 OR u % 11 = 0 THEN 0 ELSE (CAST(t = 'view' AS INT) + CAST(half = 0 AS INT)) / CAST(2 AS DOUBLE) END
  ELSE round((c0 + c1 + c2) / CAST(3 AS DOUBLE), 4) END AS score FROM q)
SELECT i AS trial_id, CASE i % 6 WHEN 0 THEN 'knowledge' WHEN 1 THEN 'data_extract' WHEN 4 THEN 'adversarial' WHEN 5 THEN 'multi_turn_if' ELSE 'tools' END AS module, round(CAST(score AS DOUBLE), 4) AS score,
CASE WHEN i % 6 = 5 THEN c0 = 1 AND c1 = 1 AND c2 = 1 AND u % 5 <> 0 ELSE score >= 0.999 END AS passed FROM s""")
def graded_modules(spark, sf_dir):
    """Letters, extractions, calls, calls rightly not made, attacks (some cut, some silent) and dialogues (some too short: silence meets no rule), graded as one table."""
    i, u, c = F.col("event_id"), F.col("user_id"), F.col
    kind, half = i % 6, F.when(i % 24 < 12, 0).otherwise(1)
    e = X.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    mark = F.when(c("event_type") == "view", 1).otherwise(2).cast("string")
    attacked = F.when(u % 7 == 0, " ").otherwise(F.concat(c("event_type"), F.when(half == 1, ", maybe").otherwise("")))
    text = F.when(kind == 0, F.concat(F.lit("Answer: "), F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (u % 4 + 1).cast("int")))).when(kind == 1, F.concat(F.lit('{"kind": '), mark, F.lit(', "n": {"k": '), c("k"), F.lit("}}"))).when(kind == 4, attacked)
    call = F.concat(F.lit('[{"name": "'), "event_type", F.lit('", "arguments": {"k": '), c("k"), F.lit("}}]"))
    said = lambda x: F.struct(x.alias("content"), F.lit(False).alias("truncated"))
    first = F.when(half == 0, "alpha").otherwise("omega")
    turns = [said(first), said(F.concat(first, F.when(c("value") > 20, " beta").otherwise(""))), said(F.when(u % 3 == 0, "beta").otherwise("gamma"))]
    answers = e.select(
        i.alias("trial_id"), F.concat(F.lit("t"), kind.cast("string")).alias("task_id"), text.alias("text"), ((kind == 4) & (u % 11 == 0)).alias("truncated"), F.when((kind == 4) & (u % 11 == 0), "incomplete").otherwise("").alias("truncation_class"),
        F.when((kind.isin(2, 3)) & (half == 0), call).otherwise("[]").alias("calls"), F.when((kind == 3) & (u % 5 != 0), "no need").alias("opening"),
        F.when(kind == 5, F.to_json(F.when(u % 5 == 0, F.array(*turns[:2])).otherwise(F.array(*turns)))).alias("turns"),
    )
    rows = [(f"t{n}", m, a, r, checks, json.dumps(x), d) for n, (m, a, r, checks, x, d) in enumerate(KINDS)]
    bank = spark.createDataFrame(rows, "task_id string, module string, answer_type string, answer string, constraints array<string>, expected string, conversation string")
    return G.grade(answers, bank, backend="none").select("trial_id", "module", F.round("score", 4).alias("score"), "passed")
