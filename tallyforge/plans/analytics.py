"""Queries over trials with their SQL: aggregates, statistics, windows, board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sqlfuncs
from ..operators import aggregates as A
from ..operators import board as B
from ..operators import filters as P
from ..operators import judging as J
from ..operators import stats as N
from . import fixtures as X
from .registry import entry, rounded

K = 3
T = f"WITH {X.TRIALS_SQL}"
TT = f"WITH {X.TRIALS_SQL}, {X.TASKS_SQL}"
P3, P1 = X.pass_k_sql("passes", "n", 3), X.pass_k_sql("passes", "n", 1)


def tasks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_task(X.trials(spark, sf_dir))


@entry(f"{TT} SELECT model, task_id, module, tier, band, n, passes, det_passes, round(mean_det, 6) AS mean_det FROM tasks")
def a1_by_task(spark, sf_dir):
    return rounded(tasks_of(spark, sf_dir))


def group_sql(by: str) -> str:
    return f"{TT} SELECT model, {by}, count(*) AS n_tasks, round(coalesce(avg({P3}), 0), 6) AS pass_k, round(coalesce(avg({P1}), 0), 6) AS pass_1 FROM tasks GROUP BY model, {by}"


@entry(group_sql("module"))
def a3_module_scores(spark, sf_dir):
    return rounded(A.group_scores(tasks_of(spark, sf_dir), "module", K))


NAMED = "CASE module WHEN 'click' THEN 'format' WHEN 'view' THEN 'tools' WHEN 'error' THEN 'adversarial' WHEN 'purchase' THEN 'code' ELSE module END"
PLACES = "CASE " + " ".join(f"WHEN module = '{m}' THEN {i}" for i, m in enumerate(A.MODULES)) + f" ELSE {len(A.MODULES)} END"


@entry(f"""{TT}, r AS (SELECT model, {NAMED} AS module, passes, n FROM tasks), s AS (SELECT model, module, round(coalesce(avg({P3}), 0), 1) AS score FROM r GROUP BY model, module)
SELECT model, module, score, row_number() OVER (PARTITION BY model ORDER BY score DESC, {PLACES}, module) AS position FROM s""")
def modules_in_order(spark, sf_dir):
    """A model's modules from its best; equal scores in the modules' own order."""
    tasks = tasks_of(spark, sf_dir).withColumn("module", F.expr(NAMED))
    scores = A.group_scores(tasks, "module", K).select("model", "module", F.round("pass_k", 1).alias("score"))
    order = Window.partitionBy("model").orderBy(F.desc("score"), A.module_place(F.col("module")), "module")
    return scores.withColumn("position", F.row_number().over(order).cast("long"))


@entry(group_sql("band"))
def a4_band_scores(spark, sf_dir):
    return rounded(A.group_scores(tasks_of(spark, sf_dir), "band", K))


@entry(group_sql("tier"))
def a5_tier_scores(spark, sf_dir):
    return rounded(A.group_scores(tasks_of(spark, sf_dir), "tier", K))


def pass_k_case(k: int) -> str:
    return f"round(coalesce(avg({X.pass_k_sql('passes', 'n', k)}), 0), 6)"


@entry(f"{TT} SELECT model, {pass_k_case(1)} AS k1, {pass_k_case(2)} AS k2, {pass_k_case(3)} AS k3, {pass_k_case(5)} AS k5 FROM tasks GROUP BY model")
def a2_pass_hat_k(spark, sf_dir):
    of = lambda k: F.coalesce(F.avg(A.pass_hat_k("passes", "n", k)), F.lit(0.0)).alias(f"k{k}")
    return rounded(tasks_of(spark, sf_dir).groupBy("model").agg(of(1), of(2), of(3), of(5)))


@entry(f"{TT} SELECT model, tier, {pass_k_case(1)} AS k1, {pass_k_case(3)} AS k3, {pass_k_case(5)} AS k5, round(coalesce(avg({X.pass_k_sql('passes', 'n', 2)}) FILTER (WHERE n >= 2), 0), 6) AS k2 FROM tasks GROUP BY model, tier")
def a2_pass_k_aggregate(spark, sf_dir):
    """The same as an aggregate of SQL, per model and tier."""
    sqlfuncs.register(spark)
    of = ", ".join(f"mean_pass_hat_k(passes, n, {k}) AS k{k}" for k in (1, 2, 3, 5))
    return rounded(spark.sql(f"SELECT model, tier, {of} FROM {{tasks}} GROUP BY model, tier", tasks=tasks_of(spark, sf_dir)))


HEAD = f"SELECT model, module, coalesce(avg({P3}), 0) AS s FROM tasks GROUP BY model, module"


@entry(f"""{TT}, {X.WEIGHTS_SQL}, m AS ({HEAD}), h AS (SELECT model, round(sum(s * w) / sum(w), 6) AS headline FROM m JOIN weights USING (module) GROUP BY model)
SELECT row_number() OVER (ORDER BY headline DESC, model) AS rank, model, headline FROM h""")
def headline_pass_k(spark, sf_dir):
    h = rounded(A.headline(X.trials(spark, sf_dir), X.weights(spark), K))
    return h.select(F.row_number().over(Window.orderBy(F.desc("headline"), "model")).cast("long").alias("rank"), "model", "headline")


@entry(f"""{TT}, {X.WEIGHTS_SQL}, m AS ({HEAD.replace("passes", "det_passes")}) SELECT model, round(sum(s * w) / sum(w), 6) AS headline FROM m JOIN weights USING (module) GROUP BY model""")
def a6_headline_deterministic(spark, sf_dir):
    return rounded(A.headline(X.trials(spark, sf_dir), X.weights(spark), K, judged=False))


@entry(f"""{TT}, b AS (SELECT model, band, coalesce(avg({P3}), 0) AS s, CASE band WHEN 'anchor' THEN 0.1 WHEN 'mid' THEN 0.3 WHEN 'hard' THEN 0.4 ELSE 0.2 END AS w FROM tasks GROUP BY model, band)
SELECT model, round(CAST(sum(s * w) / sum(w) AS DOUBLE), 6) AS headline FROM b GROUP BY model""")
def a8_headline_bands(spark, sf_dir):
    return rounded(A.headline(X.trials(spark, sf_dir), X.weights(spark), K, "band"))


@entry(f"""{TT}, b AS (SELECT model, tier, coalesce(avg({P3}), 0) AS s FROM tasks GROUP BY model, tier),
p AS (SELECT model, max(CASE WHEN tier = 'baseline' THEN s END) AS b, max(CASE WHEN tier = 'hard' THEN s END) AS h FROM b GROUP BY model)
SELECT model, round(CAST(coalesce((1 - 0.66) * b + 0.66 * h, h, b, 0) AS DOUBLE), 6) AS headline FROM p""")
def a9_headline_tiers(spark, sf_dir):
    return rounded(A.headline(X.trials(spark, sf_dir), X.weights(spark), K, "legacy"))


@entry(f"""{T}, {X.WEIGHTS_SQL}, m AS (SELECT model, module, coalesce(avg(llm_score), avg(det_score)) AS s FROM trials WHERE NOT infra_error GROUP BY model, module)
SELECT model, round(sum(s * w) / sum(w), 6) AS overall FROM m JOIN weights USING (module) GROUP BY model""")
def a10_overall_score(spark, sf_dir):
    return rounded(A.overall(X.trials(spark, sf_dir), X.weights(spark)))


@entry(f"""{T} SELECT model, module, round(avg(det_score), 6) AS det, round(avg(llm_score), 6) AS llm, count(*) AS n,
CAST(CASE WHEN count(llm_score) > 0 THEN count(*) - count(llm_score) ELSE 0 END AS BIGINT) AS omitted FROM trials WHERE NOT infra_error GROUP BY model, module""")
def a11_module_means(spark, sf_dir):
    return rounded(A.module_means(X.trials(spark, sf_dir)))


@entry(f"{TT} SELECT model, module, round(avg(CAST(passes AS DOUBLE) / n), 6) AS success FROM tasks GROUP BY model, module")
def a12_module_success(spark, sf_dir):
    return rounded(A.module_success(tasks_of(spark, sf_dir)))


@entry(f"""{T}, a AS (SELECT model, task_id, arg_max(module, trial_seq) AS module, arg_max(axis, trial_seq) FILTER (WHERE axis IS NOT NULL) AS axis,
  avg(CAST(success AS INT)) AS rate, sum(det_score) AS det, count(*) AS n FROM trials WHERE NOT infra_error GROUP BY model, task_id)
SELECT model, module || '/' || axis AS axis, round(avg(rate), 6) AS pass_rate, round(sum(det) / sum(n), 6) AS mean_det, count(*) AS n_tasks FROM a WHERE axis IS NOT NULL GROUP BY model, module || '/' || axis""")
def a13_axis_breakdown(spark, sf_dir):
    return rounded(A.axis_breakdown(X.trials(spark, sf_dir)))


@entry(f"""{T}, d AS (SELECT model, task_id, arg_max(difficulty, trial_seq) AS difficulty, avg(det_score) AS det FROM trials WHERE NOT infra_error GROUP BY model, task_id)
SELECT model, difficulty, count(*) AS n_tasks, round(avg(det), 6) AS mean_det FROM d GROUP BY model, difficulty""")
def a14_difficulty_scores(spark, sf_dir):
    return rounded(A.difficulty_scores(X.trials(spark, sf_dir)))


@entry(f"""{T} SELECT model, CASE WHEN grouping(module) = 1 THEN '__global__' ELSE module END AS module, CAST(sum(completion_tokens) AS BIGINT) AS tokens,
round(sum(completion_tokens) / sum(duration_seconds), 6) AS tokens_per_second FROM trials WHERE error IS NULL AND duration_seconds > 0 AND completion_tokens > 0
GROUP BY GROUPING SETS ((model, module), (model))""")
def a15_speed(spark, sf_dir):
    return rounded(A.speed(X.trials(spark, sf_dir)))


@entry(f"""{T} SELECT model, CASE WHEN grouping(module) = 1 THEN '__global__' ELSE module END AS module,
round(CASE WHEN sum(prefill_seconds) > 0 THEN sum(prompt_tokens) / sum(prefill_seconds) END, 6) AS prefill_rate,
round(CASE WHEN sum(generation_seconds) > 0 THEN sum(completion_tokens) / sum(generation_seconds) END, 6) AS decode_rate, round(sum(prefill_seconds), 6) AS prefill_seconds,
CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(cached_prompt_tokens) AS BIGINT) AS cached_tokens,
CASE WHEN count(DISTINCT nullif(timing_source, '')) > 1 THEN 'mixed' ELSE coalesce(max(nullif(timing_source, '')), '') END AS source,
round(CAST(sum(cached_prompt_tokens) AS DOUBLE) / (sum(prompt_tokens) + sum(cached_prompt_tokens)), 6) AS cache_share
FROM trials WHERE error IS NULL GROUP BY GROUPING SETS ((model, module), (model))""")
def a16_timings(spark, sf_dir):
    return rounded(A.timings(X.trials(spark, sf_dir)))


@entry(f"""{T} SELECT model, count(*) AS solved, CAST(sum(CAST(attempts_used = 1 AS INT)) AS BIGINT) AS one_shot, CAST(sum(CAST(attempts_used > 1 AS INT)) AS BIGINT) AS recovered
FROM trials WHERE module = 'error' AND det_success GROUP BY model""")
def a17_recovery(spark, sf_dir):
    return A.recovery(X.trials(spark, sf_dir), "error")


@entry(f"{T} SELECT model, CAST(sum(CAST(tool_mechanism AS INT)) AS BIGINT) AS structured, count(*) AS total FROM trials WHERE tool_mechanism IS NOT NULL GROUP BY model")
def a18_structured_calls(spark, sf_dir):
    return A.structured_call_rate(X.trials(spark, sf_dir))


def total(condition: str) -> str:
    return f"CAST(sum(CAST({condition} AS INT)) AS BIGINT)"


@entry(f"""{T} SELECT model, module, count(*) AS n_trials, {total("infra_error")} AS infra, {total("truncation_class = 'incomplete'")} AS incomplete,
{total("truncation_class = 'incomplete' AND NOT success")} AS incomplete_failed, {total("truncation_class = 'degenerate'")} AS degenerate FROM trials GROUP BY model, module""")
def a19_coverage(spark, sf_dir):
    return A.coverage(X.trials(spark, sf_dir))


@entry(f"""{T}, k AS (SELECT model, task_id, {total("NOT infra_error")} AS kept FROM trials GROUP BY model, task_id)
SELECT model, count(*) AS tasks, {total("kept = 0")} AS excluded, {total("kept > 0 AND kept < 20")} AS short FROM k GROUP BY model""")
def a19_task_coverage(spark, sf_dir):
    return A.task_coverage(X.trials(spark, sf_dir), 20)


COVER = "SELECT model, module, count(llm_score) AS judged, count(*) AS total FROM trials WHERE NOT infra_error AND module NOT IN ('view') GROUP BY model, module"


@entry(f"{T} SELECT *, round(CAST(judged AS DOUBLE) / total, 6) AS coverage FROM ({COVER})")
def a20_judge_coverage(spark, sf_dir):
    return rounded(A.judge_coverage(X.trials(spark, sf_dir), ("view",)))


@entry(f"""{T} SELECT model, CAST(sum(judged) AS BIGINT) AS judged, CAST(sum(total) AS BIGINT) AS total, coalesce(string_agg(CASE WHEN judged = 0 THEN module END, ',' ORDER BY module), '') AS unjudged,
coalesce(string_agg(CASE WHEN judged > 0 AND judged < total THEN module END, ',' ORDER BY module), '') AS partial FROM ({COVER}) GROUP BY model""")
def a20_judge_gaps(spark, sf_dir):
    return A.judge_gaps(X.trials(spark, sf_dir), ("view",))


@entry(f"""WITH {X.RUNS_SQL} SELECT a.model AS model_a, b.model AS model_b, round(CASE WHEN a.max_tokens <> 0 AND b.max_tokens <> 0 THEN CAST(b.max_tokens - a.max_tokens AS DOUBLE) / a.max_tokens END, 6) AS delta
FROM runs a JOIN runs b ON b.model_no = a.model_no + 1""")
def a22_relative_change(spark, sf_dir):
    r = X.runs(spark, sf_dir)
    a, b = (r.select(F.col("model").alias(f"model_{s}"), F.col("model_no").alias(f"no_{s}"), F.col("max_tokens").alias(f"t_{s}")) for s in "ab")
    met = a.join(b, F.col("no_b") == F.col("no_a") + 1)
    change = F.when((F.col("t_a") != 0) & (F.col("t_b") != 0), (F.col("t_b") - F.col("t_a")) / F.col("t_a"))
    return rounded(met.select("model_a", "model_b", change.alias("delta")))


@entry(f"""{T}, p AS (SELECT model, module, task_id, count(*) AS n FROM trials GROUP BY ALL), q AS (SELECT model, n, count(*) AS c FROM p GROUP BY ALL),
r AS (SELECT model, n, row_number() OVER (PARTITION BY model ORDER BY c DESC, n DESC) AS i FROM q) SELECT model, CAST(greatest(1, least(1000, n)) AS BIGINT) AS trials FROM r WHERE i = 1""")
def a23_observed_trials(spark, sf_dir):
    return A.observed_trials(X.trials(spark, sf_dir), 1000)


@entry(f"WITH {X.RUNS_SQL} SELECT CAST(max(trials) AS BIGINT) AS k FROM runs")
def a24_fleet_k(spark, sf_dir):
    return B.fleet_k(X.runs(spark, sf_dir))


FIELDS = ["trials", "bench_version", "max_tokens", "profile"]
LONG = " UNION ALL ".join(f"SELECT model, {i} AS i, '{f}' AS field, coalesce(CAST({f} AS VARCHAR), 'None') AS v FROM runs" for i, f in enumerate(FIELDS))
MODAL = f"l AS ({LONG}), c AS (SELECT field, v, count(*) AS n FROM l GROUP BY field, v), m AS (SELECT field, v AS modal, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, v DESC) AS i FROM c)"


@entry(f"WITH {X.RUNS_SQL}, {MODAL} SELECT field, modal FROM m WHERE i = 1")
def a25_modal_settings(spark, sf_dir):
    return A.modal_settings(X.runs(spark, sf_dir), FIELDS).select("field", "modal")


@entry(f"WITH {X.RUNS_SQL}, {MODAL} SELECT model, coalesce(string_agg(CASE WHEN v <> modal THEN l.field END, ',' ORDER BY l.i), '') AS mismatch FROM l JOIN m ON l.field = m.field AND m.i = 1 GROUP BY model")
def board_comparability(spark, sf_dir):
    return A.comparability(X.runs(spark, sf_dir), FIELDS)


@entry(f"""{T}, p AS (SELECT task_id, model, avg(duration_seconds) AS s, avg(completion_tokens) AS t, avg(det_score) AS d FROM trials WHERE NOT infra_error GROUP BY task_id, model)
SELECT task_id, round(avg(s), 6) AS seconds, round(avg(t), 6) AS tokens, round(CASE WHEN count(*) >= 2 THEN stddev_pop(d) ELSE 0 END, 6) AS soft_spread FROM p GROUP BY task_id""")
def a28_task_cost(spark, sf_dir):
    return rounded(A.cost(X.trials(spark, sf_dir)))


@entry(f"{T} SELECT model, round(sum(duration_seconds) / 60, 6) AS minutes, round(avg(CASE WHEN NOT infra_error THEN det_score END), 6) AS mean_soft FROM trials GROUP BY model")
def a31_minutes(spark, sf_dir):
    return rounded(A.minutes(X.trials(spark, sf_dir)))


@entry(f"{T} SELECT model, count(DISTINCT module || ':' || task_id) AS n_tasks FROM trials GROUP BY model")
def a30_distinct_tasks(spark, sf_dir):
    return A.distinct_tasks(X.trials(spark, sf_dir))


@entry(TT + ", s AS (SELECT model, module, avg(CAST(passes AS DOUBLE) / n) AS x FROM tasks GROUP BY model, module) SELECT module, " + ", ".join(f"round(max(CASE WHEN model = '{m}' THEN x END), 6) AS {m}" for m in X.COHORT) + " FROM s GROUP BY module")
def compare_models(spark, sf_dir):
    return rounded(A.pivot_modules(X.trials(spark, sf_dir), list(X.COHORT)))


CURVE = " UNION ALL ".join(f"SELECT model, band, CAST({k} AS BIGINT) AS k, round(coalesce(avg({X.pass_k_sql('passes', 'n', k)}), 0), 6) AS pass_k FROM tasks GROUP BY model, band" for k in range(1, 5))


@entry(f"{TT} {CURVE}")
def pass_k_curve(spark, sf_dir):
    return rounded(A.k_curve(X.trials(spark, sf_dir), "band", 4))


# Statistics.


def wilson_sql(p: str, n: str) -> str:
    f, z = f"(CAST({p} AS DOUBLE) / nullif({n}, 0))", "(CAST(1.96 AS DOUBLE) * 1.96)"
    d, m = f"(1 + {z} / nullif({n}, 0))", f"CAST(1.96 AS DOUBLE) * sqrt({f} * (1 - {f}) / nullif({n}, 0) + {z} / (4 * CAST({n} AS DOUBLE) * nullif({n}, 0)))"
    low, high = (f"({f} + {z} / (2 * nullif({n}, 0)) {s} {m}) / {d}" for s in "-+")
    return f"CASE WHEN {n} > 0 THEN round(greatest(0, {low}), 4) ELSE 0 END AS low, CASE WHEN {n} > 0 THEN round(least(1, {high}), 4) ELSE 0 END AS high"


@entry(f"{TT}, m AS (SELECT model, module, CAST(sum(passes) AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS n FROM tasks GROUP BY model, module) SELECT model, module, p, n, {wilson_sql('p', 'n')} FROM m")
def n1_wilson(spark, sf_dir):
    sums = tasks_of(spark, sf_dir).groupBy("model", "module").agg(F.sum("passes").alias("p"), F.sum("n").alias("n"))
    low, high = N.wilson(F.col("p"), F.col("n"))
    return sums.select("model", "module", "p", "n", low.alias("low"), high.alias("high"))


RANK = f"""g AS (SELECT model, module, coalesce(avg({P3}), 0) AS s FROM tasks GROUP BY model, module), me AS (SELECT model, round(avg(s), 9) AS mean FROM g GROUP BY model),
rk AS (SELECT model, mean, row_number() OVER (ORDER BY mean DESC, model) AS rank FROM me)"""
#: The binomial tail by Pascal's rule in logs is not needed: n stays below the number of tasks.
PAIRS = f"""{RANK}, a AS (SELECT t.*, rank, mean FROM tasks t JOIN rk USING (model)),
pr AS (SELECT x.model AS model_a, y.model AS model_b, any_value(x.rank) AS ra, any_value(y.rank) AS rb, any_value(x.mean) - any_value(y.mean) AS gap, count(*) AS shared,
  {total("x.passes * y.n > y.passes * x.n")} AS wins, {total("x.passes * y.n < y.passes * x.n")} AS losses FROM a x JOIN a y ON x.task_id = y.task_id AND x.rank < y.rank GROUP BY x.model, y.model),
pp AS (SELECT *, wins + losses AS d, CASE WHEN wins + losses = 0 THEN CAST(1 AS DOUBLE) ELSE least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1),
  lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1)) * pow(CAST(0.5 AS DOUBLE), wins + losses)))) END AS p0 FROM pr),
pq AS (SELECT *, round(p0, 4) AS p FROM pp),
hm AS (SELECT *, max(least(1, (m - i + 1) * p)) OVER (ORDER BY p, ra, rb ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS padj
  FROM (SELECT *, row_number() OVER (ORDER BY p, ra, rb) AS i, count(*) OVER () AS m FROM pq))"""


@entry("""WITH c AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) FILTER (l_quantity > 25) AS wins, count(*) FILTER (l_quantity < 25) AS losses FROM lineitem
  GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_linenumber), (l_returnflag, l_linestatus), (l_returnflag), ()))
SELECT l_returnflag, l_linestatus, l_linenumber, wins, losses, round(CASE WHEN wins = losses THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1),
  lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(CAST(2 AS DOUBLE)))))) END, 6) AS p FROM c""")
def n2_sign_test(spark, sf_dir):
    """Line items over 25 pieces against those under, by flag, status and line number, and in all: from hundreds to all rows."""
    own = X.table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus", "l_linenumber")
    counts = own.agg(F.count_if(F.col("l_quantity") > 25).alias("wins"), F.count_if(F.col("l_quantity") < 25).alias("losses"))
    return counts.withColumn("p", F.round(N.sign_test_p(F.col("wins"), F.col("losses")), 6))


@entry(f"""{TT}, {PAIRS}, w AS (SELECT model_b AS model, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses FROM hm GROUP BY model_b), z AS (SELECT *, wins + losses AS n FROM w)
SELECT model, wins, losses, round(CASE WHEN wins = losses THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1),
  lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(CAST(2 AS DOUBLE)))))) END, 6) AS p, {wilson_sql("losses", "n")} FROM z""")
def sql_statistics(spark, sf_dir):
    """The sign test and the interval as functions of SQL: each model against all that are ranked above it."""
    sqlfuncs.register(spark)
    query = "SELECT model, wins, losses, round(sign_test_p(wins, losses), 6) AS p, wilson_low(losses, wins + losses) AS low, wilson_high(losses, wins + losses) AS high"
    return spark.sql(f"{query} FROM (SELECT model_b AS model, sum(wins) AS wins, sum(losses) AS losses FROM {{pairs}} GROUP BY model_b)", pairs=N.pairs(tasks_of(spark, sf_dir), K))


@entry(f"""{TT}, {PAIRS} SELECT model_a, model_b, wins, losses, shared, d AS discordant, round(gap, 6) AS gap, p, round(padj, 4) AS p_adjusted, d > 0 AND padj < 0.05 AS separable, rb = ra + 1 AS adjacent,
CASE WHEN gap > 0 THEN CAST(ceil(pow(1.959964 + 0.841621, 2) * (CAST(d AS DOUBLE) / shared) / (gap * gap)) AS BIGINT) END AS tasks_needed FROM hm""")
def n4_pairs(spark, sf_dir):
    out = N.pairs(tasks_of(spark, sf_dir), K)
    return rounded(out.withColumn("p_adjusted", F.round("p_adjusted", 4)))


@entry(f"""{TT}, m AS (SELECT model, avg(CAST(passes AS DOUBLE) / n) AS p FROM tasks GROUP BY model)
SELECT model, CAST(ceil(2 * pow(1.959964 + 0.841621, 2) * p * (1 - p) / (0.05 * 0.05)) AS BIGINT) AS independent, CAST(ceil(pow(1.959964 + 0.841621, 2) * p / (0.05 * 0.05)) AS BIGINT) AS paired FROM m""")
def n5_sample_sizes(spark, sf_dir):
    rate = tasks_of(spark, sf_dir).groupBy("model").agg(F.avg(F.col("passes") / F.col("n")).alias("p"))
    return rate.select("model", N.sample_size_independent(F.col("p"), F.lit(0.05)).alias("independent"), N.sample_size_paired(F.col("p"), F.lit(0.05)).alias("paired"))


COHORT = list(X.COHORT)
WIDE = ", ".join(f"max(CASE WHEN model = '{m}' THEN CAST(passes AS DOUBLE) / n END) AS f{i}" for i, m in enumerate(COHORT))
LEGS = [f"round(f{i + 1} - f{i}, 4)" for i in range(len(COHORT) - 1)]
LEG_SQL = f"""lg AS (SELECT task_id, {", ".join(f"{x} AS leg{i}" for i, x in enumerate(LEGS))}, round(f3 - f0, 4) AS band_discrimination,
  coalesce(f0, 1) = 1 AND coalesce(f1, 1) = 1 AND coalesce(f2, 1) = 1 AND coalesce(f3, 1) = 1 AND coalesce(f0, f1, f2, f3) IS NOT NULL AS all_pass FROM (SELECT task_id, {WIDE} FROM tasks GROUP BY task_id))"""
MONO = "CASE WHEN leg0 IS NULL OR leg1 IS NULL OR leg2 IS NULL THEN NULL ELSE leg0 >= 0 AND leg1 >= 0 AND leg2 >= 0 END"


@entry(f"{TT}, {LEG_SQL} SELECT task_id, leg0, leg1, leg2, band_discrimination, all_pass, {MONO} AS monotonic FROM lg")
def w3_band_legs(spark, sf_dir):
    legs = N.band_legs(tasks_of(spark, sf_dir), COHORT)
    return legs.select("task_id", *[F.get("legs", F.lit(i)).alias(f"leg{i}") for i in range(3)], "band_discrimination", "all_pass", "monotonic")


@entry(f"""{TT}, {RANK}, th AS (SELECT model, rank <= greatest(1, m // 3) AS top, rank > m - greatest(1, m // 3) AS bottom FROM (SELECT *, count(*) OVER () AS m FROM rk)), {LEG_SQL},
st AS (SELECT task_id, max(module) AS module, arg_max(band, model) AS band, avg(f) AS pass_rate, coalesce(avg(CASE WHEN top THEN f END), 0) - coalesce(avg(CASE WHEN bottom THEN f END), 0) AS discrimination,
  {total("f > 0 AND f < 1")} AS flaky_models, count(*) AS n_models FROM (SELECT *, CAST(passes AS DOUBLE) / n AS f FROM tasks JOIN th USING (model)) GROUP BY task_id)
SELECT task_id, module, band, round(pass_rate, 6) AS pass_rate, round(discrimination, 6) AS discrimination, flaky_models, n_models, band_discrimination,
CASE WHEN n_models >= 3 AND flaky_models = 0 AND pass_rate >= 1 THEN CASE WHEN band = 'anchor' THEN 'anchor' ELSE 'dead_easy' END WHEN n_models >= 3 AND flaky_models = 0 AND pass_rate <= 0 THEN 'dead_hard'
WHEN band_discrimination <= 0 AND band <> 'anchor' AND all_pass THEN 'floor_only' WHEN discrimination >= 0.35 THEN CASE WHEN coalesce(NOT ({MONO}), false) THEN 'inverted_leg' ELSE 'discriminating' END
WHEN flaky_models >= n_models / 2 THEN 'flaky' ELSE 'weak' END AS class FROM st JOIN lg USING (task_id)""")
def n7_items(spark, sf_dir):
    out = N.items(tasks_of(spark, sf_dir), COHORT, K)
    return rounded(out.select("task_id", "module", "band", "pass_rate", "discrimination", "flaky_models", "n_models", "band_discrimination", "class"))


@entry(f"""{TT}, {RANK}, th AS (SELECT model, rank <= greatest(1, m // 3) AS top, rank > m - greatest(1, m // 3) AS bottom FROM (SELECT *, count(*) OVER () AS m FROM rk))
SELECT task_id, max(module) AS module, arg_max(band, model) AS band, round(avg(f), 6) AS pass_rate, round(coalesce(avg(CASE WHEN top THEN f END), 0) - coalesce(avg(CASE WHEN bottom THEN f END), 0), 6) AS discrimination,
  {total("f > 0 AND f < 1")} AS flaky_models, count(*) AS n_models FROM (SELECT *, CAST(passes AS DOUBLE) / n AS f FROM tasks JOIN th USING (model)) GROUP BY task_id""")
def n7_items_table(spark, sf_dir):
    """Items as a table function of SQL, over a partition for each task."""
    sqlfuncs.register(spark)
    tasks = tasks_of(spark, sf_dir)
    rows = tasks.join(F.broadcast(N.thirds(tasks, K)), "model")  # a row for each model
    return rounded(spark.sql("SELECT * FROM item_stats(TABLE(SELECT * FROM {rows}) PARTITION BY task_id ORDER BY model)", rows=rows))


@entry(f"""{TT}, ev2 AS (SELECT model, count(DISTINCT task_id) AS every, avg(CASE WHEN NOT infra_error THEN det_score END) AS mean_soft FROM trials GROUP BY model),
ab AS (SELECT model, count(*) AS n_tasks, {total("passes >= 15")} AS passed FROM tasks WHERE n >= 15 GROUP BY model),
me AS (SELECT model, coalesce(n_tasks, 0) AS n_tasks, coalesce(passed, 0) AS passed, mean_soft, every FROM ev2 LEFT JOIN ab USING (model))
SELECT model, n_tasks, passed, {wilson_sql("passed", "n_tasks")}, round(mean_soft, 6) AS mean_soft, every - n_tasks AS excluded FROM me""")
def n9_model_stats(spark, sf_dir):
    return rounded(N.model_stats(X.trials(spark, sf_dir), 15))


@entry(f"""{TT}, g AS (SELECT model, module, coalesce(avg({P1}), 0) AS s FROM tasks GROUP BY model, module) SELECT a.module, a.model AS smaller, b.model AS larger, round(a.s - b.s, 6) AS delta
FROM g a JOIN g b ON a.module = b.module AND a.model < b.model WHERE a.s - b.s > 0.01""")
def n10_fleet_monotonicity(spark, sf_dir):
    tasks = tasks_of(spark, sf_dir)
    fleet = X.runs(spark, sf_dir).select("model", F.col("model_no").alias("pos"))
    return rounded(N.fleet_monotonicity(tasks, fleet, 0.01))


PROBE = "CASE WHEN infra > 0 THEN 'INVALID' WHEN w > s THEN 'REJECT:inverted' WHEN s < CAST(2 AS DOUBLE) / 3 - 1e-9 THEN 'REJECT:broken' WHEN w > m OR m > s THEN 'REJECT:inverted' WHEN w >= 1 THEN 'REJECT:saturated' WHEN s - w <= 0 THEN 'REJECT:no_signal' WHEN s - w >= 0.4 - 1e-9 AND w <= 0.6 + 1e-9 THEN 'ACCEPT' ELSE 'REPROBE' END"


@entry(f"""{T}, f AS (SELECT task_id, avg(CASE WHEN model = 'm01' THEN CAST(success AS INT) END) AS w, avg(CASE WHEN model = 'm06' THEN CAST(success AS INT) END) AS m, avg(CASE WHEN model = 'm11' THEN CAST(success AS INT) END) AS s,
{total("infra_error AND event_id % 3 = 0 AND model IN ('m01', 'm06', 'm11')")} AS infra FROM trials GROUP BY task_id) SELECT task_id, {PROBE} AS verdict FROM f""")
def n11_probe_verdict(spark, sf_dir):
    trio = ["m01", "m06", "m11"]
    t = X.trials(spark, sf_dir)
    rate = lambda m: F.avg(F.when(F.col("model") == m, F.col("success").cast("int")))
    f = t.groupBy("task_id").agg(
        rate("m01").alias("w"), rate("m06").alias("m"), rate("m11").alias("s"),
        A.whole(F.col("infra_error") & (F.col("event_id") % 3 == 0) & F.col("model").isin(*trio)).alias("infra"),
    )
    return f.select("task_id", N.probe_verdict(F.col("w"), F.col("m"), F.col("s"), F.lit(5), F.col("infra") > 0, F.lit(False)).alias("verdict"))


@entry(f"{T}, c AS (SELECT *, row_number() OVER (PARTITION BY model, task_id ORDER BY trial_seq) - 1 AS ordinal FROM trials WHERE NOT infra_error) SELECT event_id, task_id || '#' || CAST(ordinal AS VARCHAR) AS uid FROM c")
def w7_trial_uids(spark, sf_dir):
    c = A.counted(X.trials(spark, sf_dir)).withColumn("ordinal", F.row_number().over(Window.partitionBy("model", "task_id").orderBy("trial_seq")) - 1)
    return c.select("event_id", F.concat("task_id", F.lit("#"), F.col("ordinal").cast("string")).alias("uid"))


# Judge.

GATE = "CASE WHEN event_id % 17 = 0 THEN 'used_forbidden_tool' WHEN truncation_class = 'degenerate' THEN 'degenerate' END"
STALE = "coalesce(abs((det_score + CASE WHEN event_id % 19 = 0 THEN 0.1 ELSE 0 END) - det_score) > 1e-9, false)"
RESCUE = "(NOT det_success AND llm_score >= 0.85 AND llm_score >= 0.95 AND (llm_score > det_score + 1e-6 OR llm_score >= 1.0))"


@entry(f"""{T}, g AS (SELECT *, {GATE} AS gate, {STALE} AS stale FROM trials), b AS (SELECT *, CASE WHEN {RESCUE} AND gate IS NOT NULL THEN gate WHEN {RESCUE} AND stale THEN 'stale_anchor' END AS blocked FROM g)
SELECT event_id, CASE WHEN llm_score IS NULL THEN det_success WHEN det_success THEN NOT (llm_score < 0.85 AND llm_score < det_score - 0.02) OR stale ELSE {RESCUE} AND blocked IS NULL END AS judged_success,
CASE WHEN llm_score IS NOT NULL THEN blocked END AS judge_blocked_by FROM b""")
def judge_apply(spark, sf_dir):
    t = X.trials(spark, sf_dir)
    gate = J.hard_gate(F.col("event_id") % 17 == 0, F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.col("truncation_class"))
    anchor = F.col("det_score") + F.when(F.col("event_id") % 19 == 0, 0.1).otherwise(0.0)
    return J.apply_verdicts(t, gate, anchor).select("event_id", "judged_success", "judge_blocked_by")


@entry(f"""{T} SELECT event_id, CASE WHEN error IS NOT NULL THEN CASE WHEN contains(split_part(error, ':', 1), 'Timeout') THEN 'timed_out' ELSE 'failed' END
WHEN det_score = 1.0 THEN 'passed' WHEN det_score >= 0.7 THEN 'partial' ELSE 'failed' END AS outcome FROM trials""")
def f11_outcome(spark, sf_dir):
    return X.trials(spark, sf_dir).select("event_id", P.outcome(F.col("error"), F.col("det_score")).alias("outcome"))


@entry(f"{T} SELECT model, count(*) AS n, {total('infra_error')} AS infra FROM trials WHERE NOT infra_error GROUP BY model")
def f1_counted(spark, sf_dir):
    c = A.counted(X.trials(spark, sf_dir))
    return c.groupBy("model").agg(F.count("*").alias("n"), A.whole(F.col("infra_error")).alias("infra"))


@entry(f"WITH {X.RUNS_SQL} SELECT model FROM runs WHERE temperature IS NOT NULL AND abs(temperature - 0.7) < 1e-9 AND thinking AND max_tokens <= 4096")
def f6_config_matches(spark, sf_dir):
    runs = X.runs(spark, sf_dir).withColumn("max_tokens_override", F.lit(False))
    own = runs.withColumn("name", F.col("model")).withColumn("model", F.lit("any"))
    return own.filter(P.config_matches("any", True, 0.7, 4096)).select(F.col("name").alias("model"))


# Board.


@entry(f"WITH {X.MODELS_SQL} SELECT model, coalesce(active_b, params_b) AS sort_b, active_b IS NOT NULL AS sparse, CASE WHEN params_b >= 24 THEN 'xl' WHEN params_b >= 7 THEN 'l' WHEN params_b >= 3 THEN 'm' WHEN params_b IS NOT NULL THEN 's' END AS bucket FROM models")
def x24_size_cells(spark, sf_dir):
    return B.size_cells(X.models(spark)).select("model", "sort_b", "sparse", "bucket")


TIER = "CASE WHEN {0} >= 0.9 THEN 'S' WHEN {0} >= 0.8 THEN 'A' WHEN {0} >= 0.7 THEN 'B' WHEN {0} >= 0.6 THEN 'C' WHEN {0} >= 0.45 THEN 'D' WHEN {0} >= 0.3 THEN 'E' ELSE 'F' END"
BOARD = f"""{X.WEIGHTS_SQL}, {X.MODELS_SQL}, {PAIRS}, hd AS (SELECT model, round(sum(s * w) / sum(w), 6) AS headline FROM g JOIN weights USING (module) GROUP BY model),
gd AS (SELECT model, module, coalesce(avg({P3.replace("passes", "det_passes")}), 0) AS s FROM tasks GROUP BY model, module), dh AS (SELECT model, round(sum(s * w) / sum(w), 6) AS det_headline FROM gd JOIN weights USING (module) GROUP BY model),
sp AS (SELECT model, round(sum(completion_tokens) / sum(duration_seconds), 4) AS tokens_per_second FROM trials WHERE error IS NULL AND duration_seconds > 0 AND completion_tokens > 0 GROUP BY model),
kc AS (SELECT model, task_id, {total("NOT infra_error")} AS kept FROM trials GROUP BY model, task_id), lo AS (SELECT model, {total("kept = 0")} AS excluded, {total("kept > 0 AND kept < 3")} AS short FROM kc GROUP BY model),
ti AS (SELECT model_b AS model, NOT (d > 0 AND padj < 0.05) AS tied FROM hm WHERE rb = ra + 1)"""


@entry(f"""{TT}, {BOARD} SELECT row_number() OVER (ORDER BY headline DESC, model) AS rank, model, headline, det_headline, {TIER.format("headline")} AS tier,
CASE WHEN params_b >= 24 THEN 'xl' WHEN params_b >= 7 THEN 'l' WHEN params_b >= 3 THEN 'm' WHEN params_b IS NOT NULL THEN 's' END AS bucket, tokens_per_second, excluded, short, coalesce(tied, false) AS tied_with_above
FROM hd JOIN dh USING (model) LEFT JOIN sp USING (model) LEFT JOIN lo USING (model) LEFT JOIN models USING (model) LEFT JOIN ti USING (model)""")
def leaderboard(spark, sf_dir):
    return B.board(X.trials(spark, sf_dir), X.weights(spark), X.models(spark), K).drop("size")


@entry(f"""{TT}, {BOARD}, ts(pos, tier) AS (VALUES {", ".join(f"(CAST({i} AS BIGINT), '{t}')" for i, (t, _) in enumerate(B.TIERS))})
SELECT pos, ts.tier, count(model) AS n FROM ts LEFT JOIN (SELECT model, {TIER.format("headline")} AS tier FROM hd) q ON q.tier = ts.tier GROUP BY pos, ts.tier""")
def a26_tier_counts(spark, sf_dir):
    return B.tier_counts(B.board(X.trials(spark, sf_dir), X.weights(spark), X.models(spark), K))


@entry(f"{TT} SELECT module, model, pass_k, rank() OVER (PARTITION BY module ORDER BY pass_k DESC) AS rank FROM (SELECT module, model, round(coalesce(avg({P3}), 0), 6) AS pass_k FROM tasks GROUP BY module, model)")
def board_module_ranks(spark, sf_dir):
    return B.module_ranks(tasks_of(spark, sf_dir), K)
