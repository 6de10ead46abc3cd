"""Queries over dialogues, episodes, scorers, maintenance and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema
from ..functions import fuzzy as Z
from ..operators import aggregates as A
from ..operators import board as B
from ..operators import calls as K
from ..operators import dialogues as D
from ..operators import filters as P
from ..operators import judging as J
from ..operators import maintain as M
from ..operators import scorers as R
from ..operators import toolworld as W
from ..sources import files as S
from ..sources import haystacks as H
from ..sources.scratch import place
from . import fixtures as X
from .registry import entry, rounded

C = f"WITH {X.CALLS_SQL}"
T = f"WITH {X.TRIALS_SQL}"


@entry(f"""{C}, w AS (SELECT *, coalesce(lag(name) OVER o = name AND lag(argument) OVER o = argument AND NOT lag(failed) OVER o, false) AS same FROM calls WINDOW o AS (PARTITION BY episode ORDER BY pos))
SELECT episode, bool_or(same) AS repeats, count(*) AS n_calls FROM w GROUP BY episode""")
def w9_consecutive_repeats(spark, sf_dir):
    return D.consecutive_repeats(X.calls(spark, sf_dir))


@entry(f"{C} SELECT episode, max(n) AS most FROM (SELECT episode, name, argument, count(*) AS n FROM calls GROUP BY ALL) GROUP BY episode")
def x5_same_calls(spark, sf_dir):
    return D.repeated_calls(X.calls(spark, sf_dir))


@entry(f"{C} SELECT episode, pos, name FROM calls WHERE name IN ('RF')")
def r16_forbidden_calls(spark, sf_dir):
    tools = spark.createDataFrame([("RF",)], "name string")
    return D.forbidden(X.calls(spark, sf_dir), tools).select("episode", "pos", "name")


RULES = """r AS (SELECT conv_id, turn AS intro, 'r' || CAST(turn AS VARCHAR) AS rule, CASE WHEN turn % 3 = 0 THEN turn + 2 END AS revoked FROM conversations),
ac AS (SELECT c.conv_id, c.turn, r.rule, contains(c.text, 'e' || CAST(r.intro % 2 AS VARCHAR)) OR length(c.text) > 100 * r.intro AS ok FROM conversations c JOIN r ON r.conv_id = c.conv_id AND r.intro <= c.turn AND (revoked IS NULL OR c.turn < revoked)),
fr AS (SELECT conv_id, turn, CAST(sum(CAST(ok AS INT)) AS DOUBLE) / count(*) AS fraction, count(*) AS n_rules FROM ac GROUP BY conv_id, turn)"""


def fractions(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations")
    rules = c.select("conv_id", F.col("turn").alias("intro"), F.concat(F.lit("r"), F.col("turn").cast("string")).alias("rule"), F.when(F.col("turn") % 3 == 0, F.col("turn") + 2).alias("revoked"))
    active = D.active_rules(rules, c.select("conv_id", "turn", "text"))
    ok = F.contains("text", F.concat(F.lit("e"), (F.col("intro") % 2).cast("string"))) | (F.length("text") > 100 * F.col("intro"))
    return D.turn_fractions(active.withColumn("ok", ok))


@entry(f"WITH {RULES} SELECT conv_id, turn, round(fraction, 6) AS fraction, n_rules FROM fr")
def w10_active_rules(spark, sf_dir):
    return rounded(fractions(spark, sf_dir))


@entry(f"WITH {RULES} SELECT conv_id, round(avg(fraction), 6) AS score, min(fraction) >= 0.999 AS passed FROM fr GROUP BY conv_id")
def r10_multi_turn(spark, sf_dir):
    turns = X.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return rounded(D.instruction_scores(fractions(spark, sf_dir), turns))


@entry(f"WITH {RULES} SELECT conv_id, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE arg_min(fraction, turn) - arg_max(fraction, turn) END, 6) AS forgetting FROM fr GROUP BY conv_id")
def w12_forgetting(spark, sf_dir):
    from ..operators.stats import forgetting

    return rounded(forgetting(fractions(spark, sf_dir)))


@entry("SELECT conv_id, arg_max(text, turn) AS answer, count(*) AS n_answers FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def x28_final_answers(spark, sf_dir):
    return D.final_answers(X.table(spark, sf_dir, "conversations"))


@entry(f"""{C}, p AS (SELECT *, CASE WHEN pos % 2 = 0 THEN name || '(' || argument || ') ' ELSE '' END || name || '(' || argument + 1 || ')' AS made FROM calls)
SELECT episode, CASE WHEN episode % 4 = 3 THEN string_agg(made, ' ' ORDER BY pos) || ' end()' ELSE string_agg(made, ' ' ORDER BY pos) END AS calls, string_agg(CASE WHEN failed THEN '-' ELSE CAST(argument AS VARCHAR) END, ' ' ORDER BY pos) AS results,
CASE WHEN episode % 9 = 0 OR episode % 4 IN (0, 3) THEN '' WHEN episode % 4 = 1 THEN 'done ' || count(*) ELSE 'all done' END AS answer FROM p GROUP BY episode""")
def x28_turns(spark, sf_dir):
    """Episodes as nested turns, a turn with one or two calls and a tool's for each line: the calls in order, the tools' answers, the last words."""
    call = lambda name, arguments: F.struct(name.alias("name"), arguments.cast("string").alias("arguments"))
    turn = lambda role, content, calls=None: F.struct(F.lit(role).alias("role"), content.alias("content"), (F.lit(None) if calls is None else calls).cast(f"array<{schema.CALL}>").alias("tool_calls"))
    made = lambda x: F.when(x["pos"] % 2 == 0, F.array(call(x["name"], x["argument"]), call(x["name"], x["argument"] + 1))).otherwise(F.array(call(x["name"], x["argument"] + 1)))
    pair = lambda x: F.array(turn("assistant", F.lit("a step"), made(x)), turn("tool", F.when(~x["failed"], x["argument"].cast("string"))))
    lines = F.array_sort(F.collect_list(F.struct("pos", "name", "argument", "failed")))  # an order's lines: seven at most
    kind = F.col("episode") % 4
    words = F.when(kind == 0, "  ").when(kind == 1, F.concat(F.lit("<think>so</think>done "), F.size("lines").cast("string"))).otherwise("all done")
    ends = F.when(kind == 3, F.array(call(F.lit("end"), F.lit(""))))
    turns = F.concat(F.flatten(F.transform("lines", pair)), F.array(turn("assistant", words, ends)))
    e = X.calls(spark, sf_dir).groupBy("episode").agg(lines.alias("lines")).select("episode", turns.alias("turns"))
    shown = F.transform(D.flat_calls(F.col("turns")), lambda c: F.concat(c["name"], F.lit("("), c["arguments"], F.lit(")")))
    answers = F.transform(D.tool_results(F.col("turns")), lambda r: F.coalesce(r, F.lit("-")))
    return e.select("episode", F.array_join(shown, " ").alias("calls"), F.array_join(answers, " ").alias("results"), D.closing_answer(F.col("turns"), F.col("episode") % 9 == 0).alias("answer"))


@entry("SELECT conv_id, max(turn) AS last_cut, arg_max(text, turn) AS text, count(*) AS cuts FROM conversations WHERE length(text) > 900 GROUP BY conv_id")
def w14_cut_evidence(spark, sf_dir):
    return D.cut_evidence(X.table(spark, sf_dir, "conversations").withColumn("truncated", F.length("text") > 900))


# Tool world.


@entry(f"{C} SELECT episode, name AS key, arg_max(argument, pos) AS value FROM calls GROUP BY episode, name")
def tools_kv_state(spark, sf_dir):
    return W.kv_state(X.calls(spark, sf_dir).select("episode", "pos", F.col("name").alias("key"), F.col("argument").alias("value")))


@entry(f"{C} SELECT episode, CAST(1000 - sum(CASE WHEN argument * 2 <= 50 OR pos % 2 = 0 THEN argument * 2 ELSE 0 END) AS BIGINT) AS balance, CAST(sum(CASE WHEN argument * 2 <= 50 OR pos % 2 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS refused FROM calls GROUP BY episode")
def tools_refund_state(spark, sf_dir):
    c = X.calls(spark, sf_dir).select("episode", (F.col("argument") * 2).alias("amount"), F.when(F.col("pos") % 2 == 0, W.MANAGER).alias("code"))
    return W.refund_state(c, 1000)


@entry(f"{C} SELECT episode, argument % 5 AS order_id, arg_max(name, pos) AS status FROM calls GROUP BY episode, argument % 5")
def tools_order_state(spark, sf_dir):
    return W.order_state(X.calls(spark, sf_dir).select("episode", "pos", (F.col("argument") % 5).alias("order_id"), F.col("name").alias("status")))


@entry(f"{C} SELECT episode, string_agg(name || CAST(argument AS VARCHAR), ',' ORDER BY pos) AS memory FROM calls GROUP BY episode")
def tools_memory_state(spark, sf_dir):
    m = W.memory_state(X.calls(spark, sf_dir).select("episode", "pos", F.concat("name", F.col("argument").cast("string")).alias("fact")))
    return m.select("episode", F.array_join("memory", ",").alias("memory"))


@entry("SELECT * FROM (VALUES (CAST(101 AS BIGINT), 'Alice', CAST(240 AS BIGINT), 'shipped'), (103, 'Carol', 415, 'shipped')) t(id, customer, total, status)")
def tools_db_query(spark, sf_dir):
    return W.db_query(W.world_tables(spark, "orders"), {"status": "shipped"}, "total")


@entry(f"""WITH {X.CALLS_SQL}, kv AS (SELECT episode, string_agg(name || '=' || CAST(v AS VARCHAR), ',' ORDER BY name) AS kv FROM (SELECT episode, name, arg_max(argument, pos) AS v FROM calls WHERE pos % 3 <> 0 GROUP BY episode, name) GROUP BY episode),
pay AS (SELECT episode, -CAST(sum(CASE WHEN pos % 3 = 0 AND argument <= 40 THEN argument ELSE 0 END) AS BIGINT) AS balance, CAST(sum(CAST(pos % 3 = 0 AND argument <= 40 AS INT)) AS BIGINT) AS refunds,
CAST(sum(CAST(pos % 3 = 0 AND argument > 40 AS INT)) AS BIGINT) AS failed FROM calls GROUP BY episode) SELECT episode, failed, balance, refunds, coalesce(kv, '') AS kv FROM pay LEFT JOIN kv USING (episode)""")
def tools_episodes(spark, sf_dir):
    """Episodes in order, each call writing its argument under its tool's name or asking for a refund."""
    c = X.calls(spark, sf_dir)
    put = F.concat(F.lit('{"key": "'), "name", F.lit('", "value": '), F.col("argument").cast("string"), F.lit("}"))
    pay = F.concat(F.lit('{"order_id": 1, "amount": '), F.when(F.col("argument") > 40, F.col("argument") + 20).otherwise(F.col("argument")).cast("string"), F.lit("}"))
    kind = F.when(F.col("pos") % 3 == 0, "issue_refund").otherwise("kv_set")
    played = W.episodes(c.select("episode", "pos", kind.alias("name"), F.when(F.col("pos") % 3 == 0, pay).otherwise(put).alias("arguments")))
    state = F.from_json("final_state", "balance long, refunds array<struct<amount:long>>, kv map<string,long>")
    pairs = F.array_sort(F.transform(F.map_entries("s.kv"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))))
    return played.withColumn("s", state).select(
        "episode", "failed", F.coalesce("s.balance", F.lit(0)).alias("balance"), F.coalesce(F.size("s.refunds"), F.lit(0)).cast("long").alias("refunds"), F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("kv")
    )


# Scorers.


@entry("""WITH w AS (SELECT event_id, event_id % 2 = 0 AS called, event_type = 'click' AS named, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, round(CAST(CASE WHEN called THEN 0.15 + CASE WHEN named THEN 0.25 ELSE 0 END + 0.35 + 0.25 * CASE WHEN k = 30 THEN 1 ELSE 0 END ELSE 0 END AS DOUBLE), 4) AS score, called AND named AND k = 30 AS passed FROM w""")
def r11_tool_simple(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    call = F.concat(F.lit('[{"name": "'), "event_type", F.lit('", "arguments": {"k": '), F.get_json_object("props", "$.k"), F.lit("}}]"))
    rows = e.select("event_id", F.lit('{"tool_name": "click", "required_args": {"k": 30}}').alias("expected"), F.when(F.col("event_id") % 2 == 0, call).otherwise("[]").alias("calls"), F.lit("").alias("answer"))
    rows = rows.withColumnRenamed("event_id", "trial_id").withColumn("results", F.lit(None).cast("string"))
    return rounded(K.tool_scores(rows).withColumnRenamed("trial_id", "event_id"))


@entry("""WITH w AS (SELECT event_id, event_type = 'view' AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) = 30 AS b FROM events)
SELECT event_id, round((CAST(a AS INT) + CAST(b AS INT)) / CAST(2 AS DOUBLE), 4) AS score, a AND b AS passed FROM w""")
def r9_data_extract(spark, sf_dir):
    """Kinds are told apart by a mark, so that none is like another."""
    e = X.table(spark, sf_dir, "events")
    mark = F.create_map(*[F.lit(v) for t, n in (("view", 1), ("click", 2), ("error", 3), ("purchase", 4), ("signup", 5)) for v in (t, n)])
    answer = F.concat(F.lit('{"kind": '), mark[F.col("event_type")].cast("string"), F.lit(', "n": {"k": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    rows = e.select("event_id", F.lit('{"extracted": {"kind": 1, "n.k": 30}}').alias("expected"), answer.alias("response"))
    return rounded(K.extract_scores(rows.withColumnRenamed("event_id", "trial_id")).withColumnRenamed("trial_id", "event_id"))


@entry(r"""WITH a AS (SELECT doc_id, chr(65 + CAST(doc_id % 12 AS INT)) AS l, doc_id % 3 AS m FROM documents)
SELECT doc_id, CASE WHEN m = 0 AND l <= 'J' THEN l WHEN m = 0 THEN 'J' WHEN m = 1 AND l <= 'J' THEN l WHEN m = 1 THEN 'C' END AS chosen FROM a""")
def r5_multiple_choice(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    letter, m = F.char(65 + F.col("doc_id") % 12), F.col("doc_id") % 3
    text = F.when(m == 0, F.concat(F.lit("I like J best.\nThe answer: ("), letter, F.lit(")"))).when(m == 1, F.concat(F.lit("c or "), letter, F.lit("?"))).otherwise("none of them")
    return d.select("doc_id", R.multiple_choice(text).alias("chosen"))


MEASURES = "SELECT event_id, (event_id % 11) / CAST(10 AS DOUBLE) AS goal, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 1.0 END AS side, event_id % 9 AS made, 1 + event_id % 3 AS optimal, event_id % 7 = 0 AS loops, event_id % 5 = 0 AS early, event_id % 13 = 0 AS forbidden FROM events"


def measures(spark, sf_dir):
    e = F.col("event_id")
    return X.table(spark, sf_dir, "events").select(
        "event_id", ((e % 11) / 10.0).alias("goal"), F.when(e % 4 == 0, 0.5).otherwise(1.0).alias("side"), (e % 9).alias("made"), (1 + e % 3).alias("optimal"),
        (e % 7 == 0).alias("loops"), (e % 5 == 0).alias("early"), (e % 13 == 0).alias("forbidden"),
    )


BUDGET = "(made = 0 OR optimal <= 0 OR made <= greatest(2 * optimal, optimal + 3))"


@entry(f"""WITH m AS ({MEASURES}) SELECT event_id, round(goal * 0.60 + side * 0.20 + CASE WHEN made > 0 THEN least(1, CAST(optimal AS DOUBLE) / made) ELSE 1 END * 0.10 + CASE WHEN loops THEN 0 ELSE 0.1 END, 4) AS score,
goal >= 0.999 AND side >= 0.999 AND {BUDGET} AS passed FROM m""")
def r17_state_tail(spark, sf_dir):
    c = F.col
    score, passed = R.state_tail(c("goal"), c("side"), c("made"), c("optimal"), c("loops"))
    return rounded(measures(spark, sf_dir).select("event_id", score.alias("score"), passed.alias("passed")), 4)


@entry(f"""WITH m AS ({MEASURES}), q AS (SELECT *, goal >= 0.5 AS g FROM m) SELECT event_id, CASE WHEN forbidden THEN 0 ELSE round(CASE WHEN g THEN 0.4 ELSE 0 END + 0.3 * CASE WHEN g AND made > 0 THEN least(1, CAST(optimal AS DOUBLE) / made) ELSE 0 END
+ CASE WHEN loops THEN 0 ELSE 0.2 END + CASE WHEN early THEN 0 ELSE 0.1 END, 4) END AS score, g AND NOT early AND NOT loops AND {BUDGET} AND NOT forbidden AS passed,
CASE WHEN forbidden AND g THEN 'compromised' WHEN forbidden OR NOT g THEN 'incompetent' ELSE 'resisted' END AS attack FROM q""")
def r14_loop_tail(spark, sf_dir):
    c = F.col
    goal = c("goal") >= 0.5
    score, passed = R.loop_tail(goal, c("made"), c("optimal"), c("loops"), c("early"), c("forbidden"))
    return rounded(measures(spark, sf_dir).select("event_id", score.alias("score"), passed.alias("passed"), R.attacked_outcome(c("forbidden"), goal).alias("attack")), 4)


@entry("""WITH m AS (SELECT event_id, event_id % 7 AS passed, event_id % 7 + event_id % 3 AS total, event_id % 4 AS attempts FROM events)
SELECT event_id, CASE WHEN total > 0 AND passed = total THEN CASE WHEN attempts <= 1 THEN 1 WHEN attempts = 2 THEN 0.85 ELSE 0.7 END WHEN total > 0 THEN round(least(0.5, CAST(passed AS DOUBLE) / total), 4) ELSE 0 END AS score FROM m""".replace("least(0.5, CAST", "least(CAST(0.5 AS DOUBLE), CAST"))
def r19_code_score(spark, sf_dir):
    e = F.col("event_id")
    return X.table(spark, sf_dir, "events").select("event_id", R.code_score(e % 7, e % 7 + e % 3, e % 4).alias("score"))


@entry("SELECT event_id, CASE WHEN b >= 0.999 THEN g ELSE round(greatest(0, (g - b) / (1 - b)), 6) END AS credit FROM (SELECT event_id, (event_id % 11) / CAST(10 AS DOUBLE) AS g, (event_id % 6) / CAST(5 AS DOUBLE) AS b FROM events)")
def r18_delta_credit(spark, sf_dir):
    e = F.col("event_id")
    return rounded(X.table(spark, sf_dir, "events").select("event_id", R.delta_credit((e % 11) / 10.0, (e % 6) / 5.0).alias("credit")))


def capitals(text):
    """Each character's capital where that is one character, as SQL has it: Spark's upper() makes SS of an ß, which in small letters is another text."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(F.translate(text, "ß", "ẞ"), ""), one), "")


#: Benchmark items as answers to themselves: whole, without most letters e, or without most vowels; and in capitals, to the letter.
NEEDLE = "CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '([a-z])e', '\\1', 'g') WHEN 2 THEN regexp_replace(text, '([a-z])[aeiou]', '\\1', 'g') ELSE upper(text) END"


@entry(f"""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark), n AS (SELECT item_id, text, {NEEDLE} AS needle, item_id % 8 = 3 AS exact FROM b),
h AS (SELECT *, CASE WHEN exact THEN contains(text, needle) ELSE contains(lower(text), lower(needle)) END AS held, len(text) AS t, len(needle) AS k FROM n)
SELECT item_id, held, CASE WHEN NOT held AND NOT exact THEN round(CAST(2 * k AS DOUBLE) / (k + t), 6) END AS ratio, CAST(held OR (NOT exact AND CAST(2 * k AS DOUBLE) / (k + t) >= 0.85) AS INT)::DOUBLE AS score FROM h""")
def r3_factual(spark, sf_dir):
    """What is left after letters are taken out is a subsequence, so its ratio to the whole text is known from lengths alone."""
    i, text = F.col("item_id") % 4, F.trim(F.regexp_replace("text", r"\s+", " "))
    needle = F.when(i == 0, text).when(i == 1, F.regexp_replace(text, "([a-z])e", "$1")).when(i == 2, F.regexp_replace(text, "([a-z])[aeiou]", "$1")).otherwise(capitals(text))
    rows = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("trial_id"), text.alias("text"), F.array(needle).alias("candidates"), (F.col("item_id") % 8 == 3).alias("exact"))
    return rounded(R.factual_rows(rows)).withColumnRenamed("trial_id", "item_id")


# Maintenance.

STORED = "st AS (SELECT *, CASE WHEN task_no = 3 THEN 'old' ELSE 'h' || CAST(task_no AS VARCHAR) END AS task_hash FROM trials), bank AS (SELECT DISTINCT model, module, task_id, 'h' || CAST(task_no AS VARCHAR) AS task_hash FROM trials WHERE module <> 'signup')"


def stored(spark, sf_dir):
    t = X.trials(spark, sf_dir)
    number = F.concat(F.lit("h"), F.col("task_no").cast("string"))
    return t.withColumn("task_hash", F.when(F.col("task_no") == 3, "old").otherwise(number)), t.filter("module <> 'signup'").select("model", "module", "task_id", number.alias("task_hash")).distinct()


KEEP = "kp AS (SELECT * FROM (SELECT st.*, row_number() OVER (PARTITION BY st.model, st.task_id ORDER BY trial_seq) AS i FROM st JOIN bank USING (model, module, task_id, task_hash) WHERE NOT infra_error) WHERE i <= 20)"


@entry(f"{T}, {STORED}, {KEEP} SELECT event_id FROM kp")
def plan_reusable(spark, sf_dir):
    trials, bank = stored(spark, sf_dir)
    return M.reusable(trials, bank, 20).select("event_id")


@entry(f"{T}, {STORED}, {KEEP}, h AS (SELECT model, module, task_id, count(*) AS have FROM kp GROUP BY ALL), q AS (SELECT model, module, task_id, coalesce(have, 0) AS have FROM bank LEFT JOIN h USING (model, module, task_id)) SELECT model, module, task_id, unnest(range(have, 20)) AS ordinal, unnest(range(have, 20)) + 7 AS seed FROM q")
def plan_work(spark, sf_dir):
    trials, bank = stored(spark, sf_dir)
    return M.work(trials, bank, 20, 7)


@entry(f"{T} SELECT event_id FROM trials WHERE module = 'signup'")
def plan_passthrough(spark, sf_dir):
    trials, bank = stored(spark, sf_dir)
    return M.passthrough(trials, bank).select("event_id")


@entry(f"{T}, {STORED} SELECT event_id, CASE WHEN module = 'signup' THEN 'unknown' WHEN error IS NOT NULL AND event_id % 2 = 0 THEN 'error_no_turns' WHEN task_no = 3 AND event_id % 3 = 0 THEN 'drifted' ELSE 'rescored' END AS status FROM st")
def rescore_status(spark, sf_dir):
    trials, bank = stored(spark, sf_dir)
    t = trials.withColumn("n_turns", F.col("event_id") % 2).withColumn("prompt", F.when(F.col("event_id") % 3 == 0, "before").otherwise("now"))
    return M.rescore_status(t, bank.drop("model").distinct().withColumn("prompt", F.lit("now"))).select("event_id", "status")


@entry(f"{T} SELECT event_id FROM trials WHERE event_id % 6 = 0 AND abs(det_score - det_score * 0.5) > 1e-9")
def rescore_diff(spark, sf_dir):
    t = X.trials(spark, sf_dir).select("event_id", "det_score", "success")
    new = t.withColumn("det_score", F.when(F.col("event_id") % 6 == 0, F.col("det_score") * 0.5).otherwise(F.col("det_score")))
    return M.diff(t, new, ["event_id"]).select("event_id")


@entry(f"{T} SELECT event_id, CASE WHEN module IN ('view', 'click') THEN 'tools' ELSE module END AS module, module IN ('view', 'click') AS relabelled, CASE WHEN task_no % 2 = 0 THEN 'none' ELSE axis END AS axis FROM trials WHERE module <> 'error'")
def migrate(spark, sf_dir):
    t = X.trials(spark, sf_dir)
    old = F.when(F.col("module") == "view", "tool_loop").when(F.col("module") == "click", "tool_state").otherwise(F.col("module"))
    bank = t.filter("module <> 'error'").select("task_id", F.when(F.col("module").isin("view", "click"), "tools").otherwise(F.col("module")).alias("module"), F.when(F.col("task_no") % 2 == 0, "none").alias("axis"), F.lit("h").alias("task_hash")).distinct()
    return M.migrate(t.withColumn("module", old), bank).select("event_id", "module", "relabelled", "axis")


@entry(f"{T}, k AS (SELECT DISTINCT module || ':' || task_id || ':h' || CAST(task_no AS VARCHAR) AS k, model FROM trials) SELECT model, substr(sha256(string_agg(k, chr(10) ORDER BY k)), 1, 16) AS task_set_hash FROM k GROUP BY model")
def task_set_hash(spark, sf_dir):
    from ..functions.text import set_hash

    key = F.concat_ws(":", "module", "task_id", F.concat(F.lit("h"), F.col("task_no").cast("string")))
    return X.trials(spark, sf_dir).groupBy("model").agg(set_hash(key).alias("task_set_hash"))


# Sources.


@entry(f"{T}, f AS (SELECT DISTINCT model || CASE WHEN event_id % 2 = 0 AND model_no % 3 <> 0 THEN '_judged.json' ELSE '.json' END AS file FROM trials), s AS (SELECT file, ends_with(file, '_judged.json') AS judged, regexp_replace(file, '(_judged)?\\.json$', '') AS stem FROM f) SELECT stem, arg_max(file, judged) AS file, bool_or(judged) AS judged FROM s GROUP BY stem")
def s4_prefer_judged(spark, sf_dir):
    t = X.trials(spark, sf_dir)
    judged = (F.col("event_id") % 2 == 0) & (F.col("model_no") % 3 != 0)
    return B.prefer_judged(t.select(F.concat("model", F.when(judged, "_judged.json").otherwise(".json")).alias("file")).distinct())


@entry("""WITH l AS (SELECT user_id % 12 AS f, event_id, row_number() OVER (PARTITION BY user_id % 12 ORDER BY event_id) AS line_no, event_id % 997 = 996 AS torn FROM events),
g AS (SELECT *, bool_or(torn) OVER (PARTITION BY f ORDER BY line_no) AS cut FROM l) SELECT 'f' || CAST(f AS VARCHAR) AS file, line_no, event_id AS n FROM g WHERE NOT cut AND f <> 5""")
def s8_checkpoint_log(spark, sf_dir):
    from pyspark.sql import Window

    e = X.table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("f"), "event_id")
    no = F.row_number().over(Window.partitionBy("f").orderBy("event_id")).cast("long")
    line = F.when(F.col("event_id") % 997 == 996, '{"n": 1').otherwise(F.concat(F.lit('{"n": '), F.col("event_id").cast("string"), F.lit("}")))
    body = e.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), no.alias("line_no"), line.alias("value"))
    head = e.select("f").distinct().select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), F.lit(0).cast("long").alias("line_no"), F.when(F.col("f") == 5, '{"model": "other"}').otherwise('{"model": "m"}').alias("value"))
    return S.log_rows(head.unionByName(body), {"model": "m"}, "n long")


@entry("""WITH l AS (SELECT user_id % 12 AS f, event_id, event_type, value, row_number() OVER (PARTITION BY user_id % 12 ORDER BY event_id) AS line_no, event_id % 997 = 996 AND user_id % 3 = 0 AS torn FROM events),
g AS (SELECT *, bool_or(torn) OVER (PARTITION BY f ORDER BY line_no) AS cut FROM l) SELECT f AS run, line_no, event_id AS n, event_type AS kind, value FROM g WHERE NOT cut AND f <> 5""")
def s8_log_files(spark, sf_dir):
    """Events written as logs of twelve runs and read back in splits; a header that is another's, and torn lines in a third of the runs."""
    e = X.table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("f"), "event_id", "event_type", "value", (F.col("user_id") % 3 == 0).alias("may"))
    line = F.to_json(F.struct(F.col("event_id").alias("n"), F.col("f").alias("run"), F.col("event_type").alias("kind"), "value"))
    torn = (F.col("event_id") % 997 == 996) & F.col("may")
    body = e.select("f", F.col("event_id").alias("pos"), F.when(torn, F.substr(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value"))
    head = e.select("f").distinct().select("f", F.lit(-1).cast("long").alias("pos"), F.when(F.col("f") == 5, '{"model": "other"}').otherwise('{"model": "m"}').alias("value"))
    path = place(spark, "logs")
    head.unionByName(body).repartition("f").sortWithinPartitions("f", "pos").select("f", "value").write.partitionBy("f").text(path)
    return S.read_log(spark, path, {"model": "m"}, "n long, run long, kind string, value double").select("run", "line_no", "n", "kind", "value")


@entry("SELECT count(*) AS cycles FROM events WHERE event_type = 'click' AND event_id % 4 <> 0 AND event_id % 9 <> 0")
def s10_probe_cycles(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_id") % 4 == 0, "INVALID").otherwise("ACCEPT")
    line = F.concat(F.lit('{"task_id": "'), "event_type", F.lit('", "verdict": "'), verdict, F.lit('"}'))
    return S.cycles_for(e.select(F.when(F.col("event_id") % 9 == 0, "torn {").otherwise(line).alias("value")), "click")


@entry("SELECT i - 1 AS pos, 'Log entry ' || CAST(i + 100 AS VARCHAR) || ': routine system check completed for node ' || CAST((i + 100) * 7 % 1000 AS VARCHAR) || ' with nominal status and no anomalies recorded across all monitored subsystems.' AS line FROM range(1, 742) t(i)")
def haystack_filler(spark, sf_dir):
    return H.filler(spark, 20_000, 100)


@entry(r"""WITH r AS (SELECT user_id % 12 AS batch_id, event_id, 'e' || CAST(event_id % 20 AS VARCHAR) AS id, (event_id % 13) / CAST(10 AS DOUBLE) AS s, event_id % 6 = 0 AS bad FROM events)
SELECT batch_id, id, round(least(1, greatest(0, arg_max(s, event_id))), 6) AS score FROM r WHERE NOT bad GROUP BY batch_id, id""")
def judge_parse(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"id": "e'), (F.col("event_id") % 20).cast("string"), F.lit('", "score": '), ((F.col("event_id") % 13) / 10.0).cast("string"), F.when(F.col("event_id") % 6 == 0, '"}').otherwise("}"))
    reply = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("t")))), lambda x: x["t"]), ",\n")
    batches = e.groupBy((F.col("user_id") % 12).alias("batch_id")).agg(F.concat(F.lit("Here:\n["), reply, F.lit(",")).alias("reply"))
    return rounded(J.parse_entries(batches).select("batch_id", "id", "score"))


@entry("""SELECT event_id, CASE WHEN s = 500 AND event_id % 5 = 0 THEN 'malformed_tool_call' WHEN event_id % 5 = 1 THEN 'context_overflow' WHEN s IN (401, 403, 404) THEN 'config' WHEN s IN (429, 500, 502, 503, 504) OR event_id % 5 = 3 THEN 'transient' ELSE 'other' END AS error
FROM (SELECT event_id, CAST(400 + event_id % 105 AS INT) AS s FROM events)""")
def f10_error_class(spark, sf_dir):
    e, m = F.col("event_id"), F.col("event_id") % 5
    body = F.when(m == 0, "Failed to parse tool call").when(m == 1, "the request exceeds the available context size").otherwise("busy")
    return X.table(spark, sf_dir, "events").select("event_id", P.error_class((400 + e % 105).cast("int"), body, F.when(m == 3, "timeout").otherwise("http")).alias("error"))


@entry("SELECT module, id, need FROM (SELECT event_type AS module, event_type || CAST(event_id AS VARCHAR) AS id, CAST(floor(value * 100) AS BIGINT) + 512 AS need FROM events) WHERE need > 16384")
def f5_oversized(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("module"), F.concat("event_type", F.col("event_id").cast("string")).alias("id"), F.floor(F.col("value") * 100).cast("long").alias("filler_tokens"), F.lit(512).cast("long").alias("max_tokens"))
    return P.oversized(e, 16384).select("module", "id", "need")


@entry("SELECT event_id, event_id % 7 <> 0 AND (event_id % 5 = 0 OR (event_id % 3 <> 0 AND event_id % 2 = 0)) AS dead FROM events")
def f4_dead_trials(spark, sf_dir):
    e = F.col("event_id")
    dead = P.is_dead(e % 7 == 0, F.when(e % 5 == 0, "boom"), e % 3 == 0, F.when(e % 2 == 0, "  ").otherwise("text"))
    return X.table(spark, sf_dir, "events").select("event_id", dead.alias("dead"))


@entry(f"WITH {X.MODELS_SQL}, z AS (SELECT CASE WHEN params_b >= 24 THEN 'xl' WHEN params_b >= 7 THEN 'l' WHEN params_b >= 3 THEN 'm' ELSE 's' END AS bucket, active_b IS NOT NULL AS sp FROM models), b(pos, bucket) AS (VALUES (CAST(0 AS BIGINT), 'xl'), (1, 'l'), (2, 'm'), (3, 's')) SELECT pos, b.bucket, count(*) FILTER (WHERE NOT sp) AS dense, count(*) FILTER (WHERE sp) AS sparse FROM b LEFT JOIN z ON z.bucket = b.bucket GROUP BY pos, b.bucket")
def a26_bucket_counts(spark, sf_dir):
    return B.bucket_counts(X.models(spark))


@entry(f"{T}, w AS (SELECT model, module, task_id, 'w' || CAST(task_no % 3 AS VARCHAR) AS h FROM trials WHERE task_no % 4 <> 0) SELECT DISTINCT module, task_id FROM w WHERE h <> 'w1'")
def f7_stale_worlds(spark, sf_dir):
    t = X.trials(spark, sf_dir)
    own = t.withColumn("world_hash", F.when(F.col("task_no") % 4 == 0, "").otherwise(F.concat(F.lit("w"), (F.col("task_no") % 3).cast("string"))))
    tasks = t.select("module", F.col("task_id").alias("id"), F.lit("w1").alias("world_hash")).distinct()
    return P.stale_worlds(own, tasks)


@entry(f"WITH {X.TRIALS_SQL}, {X.TASKS_SQL} SELECT model, count(*) AS n FROM tasks WHERE model IN ({', '.join(repr(m) for m in X.COHORT)}) GROUP BY model")
def f12_cohort(spark, sf_dir):
    return P.keep_cohort(A.by_task(X.trials(spark, sf_dir)), list(X.COHORT)).groupBy("model").agg(F.count("*").alias("n"))
