"""Reports over whole sets of runs, tool answers and bookkeeping, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judging as J
from ..operators import reports as R
from ..operators import stats as N
from ..operators import toolworld as W
from . import analytics as Q
from . import fixtures as X
from .analytics import TT, K, P3, T, tasks_of, total
from .registry import entry, rounded

SKIPS = ("view",)
P1 = X.pass_k_sql("passes", "n", 1)
POS_SQL = "weights(pos, module, w) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{m}', CAST({w} AS DOUBLE))" for i, (m, w) in enumerate(X.WEIGHTS.items())) + ")"


def weights(spark):
    return spark.createDataFrame([(i, m, w) for i, (m, w) in enumerate(X.WEIGHTS.items())], "pos long, module string, w double")


MEANS = """mm AS (SELECT model, module, avg(det_score) AS det, avg(llm_score) AS llm, count(*) AS n,
  CAST(CASE WHEN count(llm_score) > 0 THEN count(*) - count(llm_score) ELSE 0 END AS BIGINT) AS omitted FROM trials WHERE NOT infra_error GROUP BY model, module)"""
SEEN = """cv AS (SELECT model, module, count(llm_score) AS j, count(*) AS t FROM trials WHERE NOT infra_error AND module NOT IN ('view') GROUP BY model, module),
sn AS (SELECT model, sum(j) > 0 AS has, CAST(sum(j) AS DOUBLE) / sum(t) AS coverage, string_agg(CASE WHEN j = 0 THEN module END, ',' ORDER BY module) AS un,
  string_agg(CASE WHEN j > 0 AND j < t THEN module END, ',' ORDER BY module) AS pa FROM cv GROUP BY model)"""


@entry(f"""{TT}, {POS_SQL}, {MEANS}, {SEEN}, su AS (SELECT model, module, avg(CAST(passes AS DOUBLE) / n) AS js, avg(CAST(det_passes AS DOUBLE) / n) AS ds FROM tasks GROUP BY model, module)
SELECT model, module, round(det, 6) AS det, round(CASE WHEN has THEN ds ELSE js END, 6) AS pass, round(CASE WHEN has AND j < t THEN CAST(j AS DOUBLE) / t END, 6) AS judge_coverage, round(llm, 6) AS llm,
round(llm - det, 6) AS delta, round(CASE WHEN has AND llm IS NOT NULL THEN js END, 6) AS judge_pass
FROM mm JOIN weights USING (module) JOIN su USING (model, module) LEFT JOIN cv USING (model, module) LEFT JOIN sn USING (model)""")
def board_module_cells(spark, sf_dir):
    return rounded(R.module_cells(X.trials(spark, sf_dir), weights(spark), SKIPS))


TIER = "CASE " + " ".join(f"WHEN {{0}} >= {floor} THEN '{letter}'" for letter, floor in Q.B.TIERS) + " END"


@entry(f"""{TT}, {POS_SQL}, {MEANS}, {SEEN},
hj AS (SELECT model, sum(s * w) / sum(w) AS jp, sum(d * w) / sum(w) AS dp FROM (SELECT model, module, coalesce(avg({P3}), 0) AS s, coalesce(avg({P3.replace("passes", "det_passes")}), 0) AS d FROM tasks GROUP BY model, module) JOIN weights USING (module) GROUP BY model),
om AS (SELECT model, sum(det * w) / sum(w) AS od, sum(coalesce(llm, det) * w) / sum(w) AS ol FROM mm JOIN weights USING (module) GROUP BY model),
tm AS (SELECT model, sum(prompt_tokens) / sum(prefill_seconds) AS pr, sum(completion_tokens) / sum(generation_seconds) AS gr FROM trials WHERE error IS NULL GROUP BY model),
sp AS (SELECT model, sum(completion_tokens) / sum(duration_seconds) AS ts FROM trials WHERE error IS NULL AND duration_seconds > 0 AND completion_tokens > 0 GROUP BY model),
re AS (SELECT model, avg(CAST(attempts_used = 1 AS INT)) AS ft FROM trials WHERE module = 'error' AND det_success GROUP BY model),
ab AS (SELECT model, {total("n >= 3")} AS n_tasks, count(*) AS known FROM tasks GROUP BY model), du AS (SELECT model, round(sum(duration_seconds) / 60, 1) AS mi FROM trials GROUP BY model)
SELECT model, round(jp, 6) AS headline, has AS headline_judged, {TIER.format("round(jp, 6)")} AS tier, round(CASE WHEN has THEN dp ELSE jp END, 6) AS overall_pass, round(CASE WHEN has THEN jp END, 6) AS overall_judge_pass,
round(od, 6) AS overall_det, round(CASE WHEN has THEN ol END, 6) AS overall_llm, round(CASE WHEN has THEN coverage END, 6) AS judge_coverage, CASE WHEN has THEN coverage >= 1 END AS judge_complete,
CASE WHEN has THEN coalesce(un, '') END AS unjudged_modules, CASE WHEN has THEN coalesce(pa, '') END AS partial_modules, round(ft, 6) AS first_try_rate, round(ts, 6) AS tokens_per_second,
round(pr, 6) AS prefill_tok_s, round(gr, 6) AS gen_tok_s, n_tasks, known - n_tasks AS tasks_excluded, mi AS trial_minutes
FROM hj JOIN om USING (model) LEFT JOIN sn USING (model) LEFT JOIN tm USING (model) LEFT JOIN sp USING (model) LEFT JOIN re USING (model) LEFT JOIN ab USING (model) LEFT JOIN du USING (model)""")
def board_rows(spark, sf_dir):
    return rounded(R.board_rows(X.trials(spark, sf_dir), weights(spark), K, "error", SKIPS))


@entry(f"""{TT}, {POS_SQL}, {MEANS}, gs AS (SELECT model, module, count(*) AS n_tasks, coalesce(avg({P3}), 0) AS pass_k, coalesce(avg({P1}), 0) AS pass_1 FROM tasks GROUP BY model, module),
ow AS (SELECT gs.model, pos, module, n_tasks, pass_k, pass_1, det, llm, n, omitted, w FROM gs JOIN mm USING (model, module) JOIN weights USING (module))
SELECT model, pos, module, n_tasks, round(pass_k, 6) AS pass_k, round(pass_1, 6) AS pass_1, round(det, 6) AS det, round(llm, 6) AS llm, n, omitted FROM ow
UNION ALL SELECT model, NULL, 'overall', CAST(sum(n_tasks) AS BIGINT), round(sum(pass_k * w) / sum(w), 6), round(sum(pass_1 * w) / sum(w), 6), round(sum(det * w) / sum(w), 6),
round(sum(coalesce(llm, det) * w) / sum(w), 6), CAST(sum(n) AS BIGINT), CAST(sum(omitted) AS BIGINT) FROM ow GROUP BY model""")
def scorecard(spark, sf_dir):
    return rounded(R.scorecard(X.trials(spark, sf_dir), weights(spark), K))


def pivot_sql(value: str, names: tuple[str, ...] = X.COHORT) -> str:
    return ", ".join(f"max(CASE WHEN model = '{m}' THEN {value} END) AS {m}" for m in names)


@entry(f"""{TT}, {POS_SQL}, {MEANS}, h AS (SELECT model, sum(s * w) / sum(w) AS v FROM (SELECT model, module, coalesce(avg({P3}), 0) AS s FROM tasks GROUP BY model, module) JOIN weights USING (module) GROUP BY model)
SELECT pos, module, {pivot_sql("round(det, 6)")} FROM mm JOIN weights USING (module) GROUP BY pos, module UNION ALL SELECT NULL, 'overall', {pivot_sql("round(v, 6)")} FROM h""")
def compare_scores(spark, sf_dir):
    return rounded(R.comparison(X.trials(spark, sf_dir), weights(spark), K, list(X.COHORT)))


RATE = """rt AS (SELECT model, CASE WHEN grouping(module) = 1 THEN '__global__' ELSE module END AS module, CASE WHEN sum(prefill_seconds) > 0 THEN sum(prompt_tokens) / sum(prefill_seconds) END AS pp,
CASE WHEN sum(generation_seconds) > 0 THEN sum(completion_tokens) / sum(generation_seconds) END AS tg FROM trials WHERE error IS NULL GROUP BY GROUPING SETS ((model, module), (model))),
lg AS (SELECT model, module, 'pp' AS metric, pp AS v FROM rt UNION ALL SELECT model, module, 'tg', tg FROM rt), wd AS (SELECT module, metric, """ + pivot_sql("v") + """ FROM lg WHERE model IN ('""" + "', '".join(X.COHORT) + """') GROUP BY module, metric)"""
CHANGES = ", ".join(f"round(({m} - {X.COHORT[0]}) / {X.COHORT[0]} * 100, 6) AS {m}_change" for m in X.COHORT[1:])


@entry(f"{T}, {RATE} SELECT module, metric, {', '.join(f'round({m}, 6) AS {m}' for m in X.COHORT)}, {CHANGES} FROM wd")
def compare_speed(spark, sf_dir):
    return rounded(R.speed_comparison(X.trials(spark, sf_dir), list(X.COHORT)))


@entry(f"""{TT}, sd AS (SELECT task_id, round(CASE WHEN count(mean_det) >= 2 THEN stddev_pop(mean_det) ELSE 0 END, 4) AS soft_spread FROM tasks GROUP BY task_id),
co AS (SELECT task_id, round(avg(duration_seconds), 2) AS mean_duration, round(avg(completion_tokens), 1) AS mean_completion_tokens FROM trials WHERE NOT infra_error GROUP BY task_id),
it AS (SELECT task_id, round(avg(CAST(passes AS DOUBLE) / n), 4) AS pass_rate, count(*) AS n_models FROM tasks GROUP BY task_id)
SELECT task_id, pass_rate, n_models, soft_spread, mean_duration, mean_completion_tokens FROM it JOIN sd USING (task_id) JOIN co USING (task_id)""")
def items_columns(spark, sf_dir):
    rows = R.item_report(X.trials(spark, sf_dir), list(X.COHORT), K)
    return rows.select("task_id", "pass_rate", "n_models", "soft_spread", "mean_duration", "mean_completion_tokens")


RANKS = f"""md AS (SELECT model, row_number() OVER (ORDER BY round(avg(s), 9) DESC, model) AS r, count(*) OVER () AS m FROM (SELECT model, module, coalesce(avg({P3}), 0) AS s FROM tasks GROUP BY model, module) GROUP BY model),
th AS (SELECT model, r <= greatest(1, m // 3) AS top, r > m - greatest(1, m // 3) AS bot FROM md)"""


@entry(f"""{TT}, {RANKS}, di AS (SELECT task_id, round(coalesce(avg(CASE WHEN top THEN CAST(passes AS DOUBLE) / n END), 0) - coalesce(avg(CASE WHEN bot THEN CAST(passes AS DOUBLE) / n END), 0), 4) AS discrimination
FROM tasks JOIN th USING (model) GROUP BY task_id) SELECT row_number() OVER (ORDER BY discrimination DESC, task_id) AS position, task_id, discrimination FROM di""")
def items_order(spark, sf_dir):
    return R.item_report(X.trials(spark, sf_dir), list(X.COHORT), K).select("position", "task_id", "discrimination")


@entry(f"""{TT}, {X.WEIGHTS_SQL}, hd AS (SELECT model, round(sum(s * w) / sum(w), 6) AS headline, round(sum(d * w) / sum(w), 6) AS det_headline FROM (SELECT model, module, coalesce(avg({P3}), 0) AS s, coalesce(avg({P3.replace("passes", "det_passes")}), 0) AS d
  FROM tasks GROUP BY model, module) JOIN weights USING (module) GROUP BY model),
st AS (SELECT model, {total("n >= 3")} AS n_tasks, {total("n >= 3 AND passes >= 3")} AS tasks_passed, {total("n >= 3 AND det_passes >= 3")} AS det_tasks_passed FROM tasks GROUP BY model),
so AS (SELECT model, round(avg(det_score), 4) AS mean_soft FROM trials WHERE NOT infra_error GROUP BY model)
SELECT row_number() OVER (ORDER BY headline DESC, model) AS position, model, headline, det_headline, n_tasks, tasks_passed, det_tasks_passed, round(CASE WHEN n_tasks > 0 THEN CAST(tasks_passed AS DOUBLE) / n_tasks ELSE 0 END, 4) AS pass_rate, mean_soft
FROM hd JOIN st USING (model) JOIN so USING (model)""")
def model_report(spark, sf_dir):
    rows = R.model_report(X.trials(spark, sf_dir), X.weights(spark), K)
    return rows.select("position", "model", "headline", "det_headline", "n_tasks", "tasks_passed", "det_tasks_passed", "pass_rate", "mean_soft")


@entry(f"""{TT}, {Q.PAIRS}, pz AS (SELECT model_a, model_b, rb = ra + 1 AS adjacent, round(padj, 4) AS p_adjusted FROM hm)
SELECT row_number() OVER (ORDER BY adjacent DESC, p_adjusted, model_a, model_b) AS position, * FROM pz""")
def pairs_order(spark, sf_dir):
    pairs = N.pairs(tasks_of(spark, sf_dir), K).withColumn("p_adjusted", F.round("p_adjusted", 4))
    return R.pair_report(pairs).select("position", "model_a", "model_b", "adjacent", "p_adjusted")


@entry(f"""{TT}, {Q.PAIRS} SELECT {total("d > 0 AND padj < 0.05")} AS separable_pairs, count(*) AS total_pairs FROM hm""")
def separable_count(spark, sf_dir):
    return R.separable_count(N.pairs(tasks_of(spark, sf_dir), K))


@entry(f"""{TT}, g AS (SELECT model, module, coalesce(avg({P1}), 0) AS s FROM tasks GROUP BY model, module), iv AS (SELECT a.module, a.model AS smaller, b.model AS larger, round(a.s - b.s, 9) AS delta
FROM g a JOIN g b ON a.module = b.module AND a.model < b.model WHERE a.s - b.s > 0), nm AS (SELECT *, row_number() OVER (ORDER BY delta DESC, module, smaller, larger) AS position FROM iv) SELECT * FROM nm WHERE position <= 12""")
def inversions_shown(spark, sf_dir):
    fleet = X.runs(spark, sf_dir).select("model", F.col("model_no").alias("pos"))
    return R.inversions(N.fleet_monotonicity(tasks_of(spark, sf_dir), fleet, 0).withColumn("delta", F.round("delta", 9)))


@entry(f"""WITH {X.RUNS_SQL}, {X.MODELS_SQL} SELECT row_number() OVER (ORDER BY coalesce(active_b, params_b), model) - 1 AS pos, model, coalesce(active_b, params_b) AS size_b FROM models SEMI JOIN runs USING (model)
WHERE coalesce(active_b, params_b) IS NOT NULL""")
def fleet_order(spark, sf_dir):
    return R.fleet_order(X.models(spark), X.runs(spark, sf_dir))


CUT = "SELECT model, task_id, count(*) AS cut FROM trials WHERE truncation_class <> '' GROUP BY model, task_id"


@entry(f"{T}, c AS ({CUT}), n AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY cut DESC, task_id) AS position FROM c) SELECT * FROM n WHERE position <= 6")
def cut_evidence(spark, sf_dir):
    cut = X.trials(spark, sf_dir).filter("truncation_class <> ''").groupBy("model", "task_id").agg(F.count("*").alias("cut"))
    return R.cut_evidence(cut)


@entry(f"""{T}, a AS (SELECT model, module, event_id, (row_number() OVER (PARTITION BY model, module ORDER BY event_id) - 1) // 8 AS batch FROM trials WHERE NOT infra_error AND module NOT IN ('view') AND llm_score IS NULL)
SELECT model, module, CAST(batch AS BIGINT) AS batch, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS trial_ids FROM a GROUP BY model, module, batch""")
def judge_batches(spark, sf_dir):
    rows = R.verdict_batches(X.trials(spark, sf_dir).withColumn("trial_id", F.col("event_id")), 8, SKIPS)
    return rows.withColumn("trial_ids", F.array_join(F.col("trial_ids").cast("array<string>"), ","))


GOT = "llm_score IS NOT NULL AND NOT (model_no % 4 = 1 AND module = 'click') AND NOT (model_no % 4 = 2 AND module = 'error')"


@entry(f"""{T}, a AS (SELECT *, count(*) FILTER ({GOT}) OVER (PARTITION BY model, module) AS got FROM trials WHERE module NOT IN ('view') AND task_no <> 5) SELECT model, module, event_id FROM a WHERE got = 0""")
def judge_second_pass(spark, sf_dir):
    """Some modules of some models got no verdict at all: all their trials are asked about again, tasks that weren't asked about aside."""
    trials = X.trials(spark, sf_dir).withColumn("uid", F.col("event_id"))
    verdicts = trials.select("model", "uid", F.when(F.expr(GOT), F.col("llm_score")).alias("score"))
    only = trials.filter("task_no <> 5").select("module", "task_id").distinct()
    return J.second_pass(J.asked(trials, SKIPS, only), verdicts).select("model", "module", "event_id")


@entry(f"""{T} SELECT model, module, count(*) AS n, {total("success AND NOT det_success")} AS rescued, {total("det_success AND NOT success")} AS demoted FROM trials WHERE NOT infra_error GROUP BY model, module""")
def judge_diverged(spark, sf_dir):
    return R.diverged(X.trials(spark, sf_dir))


@entry(f"WITH {X.RUNS_SQL} SELECT model, trials, trials + 2 AS target FROM runs")
def add_trials_target(spark, sf_dir):
    return R.trials_target(X.runs(spark, sf_dir).select("model", "trials"), 2)


@entry(f"""{T}, old AS (SELECT model, task_id, trial_seq, 'previous' AS origin FROM trials WHERE event_id % 3 <> 0), new AS (SELECT model, task_id, trial_seq, 'recovered' AS origin FROM trials WHERE event_id % 2 = 0)
SELECT origin, count(*) AS n FROM (SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (model, task_id, trial_seq)) GROUP BY origin""")
def recovered_union(spark, sf_dir):
    t = X.trials(spark, sf_dir).select("event_id", "model", "task_id", "trial_seq")
    old, new = (t.filter(c).withColumn("origin", F.lit(name)).drop("event_id") for c, name in (("event_id % 3 <> 0", "previous"), ("event_id % 2 = 0", "recovered")))
    return R.recovered_union(old, new).groupBy("origin").agg(F.count("*").alias("n"))


TIERS = """CASE WHEN event_id % 9 = 0 THEN 'hard' WHEN module IN ('format', 'knowledge') THEN 'baseline' WHEN module = 'tools' THEN CASE WHEN axis = 'call' THEN 'baseline' ELSE 'hard' END
WHEN module = 'code' THEN CASE WHEN event_id % 2 = 0 THEN 'hard' ELSE 'baseline' END ELSE 'hard' END"""
MODULES = ("format", "knowledge", "tools", "code", "long_context")


@entry(f"""WITH e AS (SELECT event_id, [{", ".join(f"'{m}'" for m in MODULES)}][CAST(event_id % 5 AS INT) + 1] AS module, CASE user_id % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'loop' END AS axis FROM events)
SELECT module, axis, {TIERS} AS tier, count(*) AS n FROM e GROUP BY ALL""")
def x22_infer_tier(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    module = F.element_at(F.array(*map(F.lit, MODULES)), (F.col("event_id") % 5).cast("int") + 1)
    axis = F.when(F.col("user_id") % 3 == 0, "call").when(F.col("user_id") % 3 == 1, "loop")
    rows = e.select("event_id", module.alias("module"), axis.alias("axis"))
    tier = R.infer_tier(F.col("module"), F.when(F.col("event_id") % 9 == 0, "hard"), F.col("axis"), F.col("event_id") % 2 == 0)
    return rows.groupBy("module", "axis", tier.alias("tier")).agg(F.count("*").alias("n"))


@entry("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS stamp, CASE WHEN event_id % 7 = 0 THEN '—' ELSE printf('%.3f', value) END AS cell, printf('%+.2f%%', value) AS change FROM events")
def x25_cells(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return e.select("event_id", R.utc_stamp(F.col("ts")).alias("stamp"), R.shown(value).alias("cell"), R.shown(F.col("value"), 2, percent=True, signed=True).alias("change"))


CITIES = ("Tokyo", "lisbon", "London", "BERLIN", "Paris", "Oslo")


@entry(f"""WITH w(c, t, s, h) AS (VALUES ('tokyo', 22.0, 'sunny', 60), ('lisbon', 24.0, 'sunny', 55), ('london', 14.0, 'rainy', 80), ('berlin', 18.0, 'cloudy', 65), ('paris', 19.0, 'partly cloudy', 62)),
q AS (SELECT c_custkey, [{", ".join(f"'{c}'" for c in CITIES)}][CAST(c_custkey % 6 AS INT) + 1] AS city, c_custkey % 2 = 0 AS f FROM customer)
SELECT c_custkey, city, CAST(round(CASE WHEN f THEN coalesce(t, 20.0) * 9 / 5 + 32 ELSE coalesce(t, 20.0) END, 1) AS DOUBLE) AS temperature, coalesce(s, 'clear') AS condition, CAST(coalesce(h, 50) AS BIGINT) AS humidity FROM q LEFT JOIN w ON lower(city) = c""")
def tools_weather(spark, sf_dir):
    city = F.element_at(F.array(*map(F.lit, CITIES)), (F.col("c_custkey") % 6).cast("int") + 1)
    units = F.when(F.col("c_custkey") % 2 == 0, "fahrenheit").otherwise("celsius")
    calls = X.table(spark, sf_dir, "customer").select("c_custkey", city.alias("city"), F.lit("get_weather").alias("name"), F.to_json(F.struct(city.alias("city"), units.alias("units"))).alias("arguments"))
    got = F.from_json("answer", "temperature double, condition string, humidity long")
    return W.answers(calls).select("c_custkey", "city", got.alias("a")).select("c_custkey", "city", "a.*")


@entry("""SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'sent' WHEN 1 THEN 'posted' WHEN 2 THEN 'open' WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'validated' ELSE 'queued' END WHEN 4 THEN 'ok' WHEN 5 THEN 'asked' ELSE 'created' END AS status,
CASE c_custkey % 7 WHEN 0 THEN c_name WHEN 1 THEN CAST(length(c_name || '!') AS VARCHAR) WHEN 2 THEN c_name WHEN 3 THEN c_name WHEN 4 THEN 'run ' || c_name WHEN 5 THEN c_name || '?' ELSE c_name END AS echo FROM customer""")
def tools_echoes(spark, sf_dir):
    """Seven tools that say back what they were given."""
    c, name = F.col("c_custkey"), F.col("c_name")
    kinds = {
        0: ("send_message", {"recipient": name, "message": F.lit("m")}, "recipient"), 1: ("post_update", {"channel": F.lit("#ops"), "content": F.concat(name, F.lit("!"))}, "chars"),
        2: ("create_ticket", {"title": name}, "title"), 3: ("run_deploy", {"service": name, "env": F.lit("prod"), "dry_run": c % 2 == 0}, "service"),
        4: ("run_command", {"command": F.concat(F.lit("run "), name)}, "ran"), 5: ("ask_user", {"question": F.concat(name, F.lit("?"))}, "question"),
        6: ("create_event", {"title": name, "date": F.lit("2026-06-08"), "time": F.lit("09:00")}, "title"),
    }
    tool, arguments, field = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (own, args, key) in kinds.items():
        given = F.to_json(F.struct(*[v.alias(k) for k, v in args.items()]))
        tool, arguments, field = (F.when(c % 7 == i, x).otherwise(y) for x, y in ((F.lit(own), tool), (given, arguments), (F.lit(key), field)))
    said = W.answers(X.table(spark, sf_dir, "customer").select("c_custkey", tool.alias("name"), arguments.alias("arguments"), field.alias("field")))
    answer = F.from_json("answer", "map<string,string>")
    return said.select("c_custkey", answer["status"].alias("status"), F.try_element_at(answer, F.col("field")).alias("echo"))


@entry("""WITH t AS (SELECT o_orderkey AS task_id, list_transform(range(o_orderkey % 4), lambda x: ['get_weather', 'read_file', 'kv_set'][CAST(x AS INT) + 1]) AS names FROM orders)
SELECT task_id, CAST(len(names) AS BIGINT) AS n, CASE WHEN len(names) = 0 THEN '' ELSE array_to_string(names, ',') END AS offered, CAST(CASE WHEN len(names) >= 2 THEN 1 ELSE 0 END AS BIGINT) AS stateful_file FROM t""")
def tools_offered(spark, sf_dir):
    names = F.slice(F.array(F.lit("get_weather"), F.lit("read_file"), F.lit("kv_set")), 1, (F.col("o_orderkey") % 4).cast("int"))
    got = W.offered(X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), names.alias("tools")))
    found = F.from_json("payload", "array<struct<type:string,function:struct<name:string,description:string>>>")
    wide = got.select("task_id", found.alias("p"))
    full = F.exists("p", lambda x: F.contains(x["function"]["description"], F.lit("full contents")))
    return wide.select("task_id", F.size("p").cast("long").alias("n"), F.array_join(F.col("p.function.name"), ",").alias("offered"), full.cast("long").alias("stateful_file"))
