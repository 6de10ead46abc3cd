"""What boards read off the ledger is what the trials themselves give, rows with nulls, lost trials and tasks of two modules included."""

import random

import pytest
from pyspark.sql import functions as F
from tallyforge.operators import aggregates as A
from tallyforge.operators import ledger as L

DDL = (
    "model string, module string, task_id string, trial_seq long, tier string, band string, infra_error boolean, error string, success boolean, det_success boolean, det_score double, llm_score double, "
    "duration_seconds double, completion_tokens long, prompt_tokens long, cached_prompt_tokens long, prefill_seconds double, generation_seconds double, timing_source string, attempts_used int"
)


@pytest.fixture(scope="module")
def trials(spark):
    rnd, rows = random.Random(3), []
    for i in range(600):
        ok = rnd.random() < 0.6
        task = rnd.randrange(9)
        module = "xyz"[task % 3] if rnd.random() < 0.97 else "y"
        rows.append((
            f"m{rnd.randrange(4)}", module, f"t{task}", i, rnd.choice(["baseline", "hard", None]), rnd.choice(["mid", None]), rnd.random() < (0.2 if task else 1.1), rnd.choice([None, None, "boom"]), ok and rnd.random() < 0.9, ok,
            rnd.choice([None, 0.25, 1.0]), rnd.choice([None, 0.5]) if module != "x" else None, rnd.choice([0.0, 1.5, 2.0]), rnd.choice([0, 10, 30]), 5, 1, rnd.choice([0.0, 0.5]), 1.0, "usage", rnd.choice([1, 2]),
        ))
    return spark.createDataFrame(rows, DDL)


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_tasks_and_speed(trials):
    sums = L.ledger(trials)
    tasks, want = L.by_task(sums), A.by_task(trials)
    assert tasks.columns == want.columns and rows(tasks) == rows(want)
    speed = A.speed(trials).filter("module = '__global__'").select("model", "tokens_per_second")
    assert rows(sums.groupBy("model").agg(L.speed())) == rows(speed)
    assert rows(L.lost(sums, 12)) == rows(A.task_coverage(trials, 12).select("model", "excluded", "short"))


def test_modules_and_headlines(spark, trials):
    weights = spark.createDataFrame([("x", 0.5), ("y", 0.3), ("w", 0.9)], "module string, w double")
    sums, skips = L.ledger(trials, detailed=True), ("y",)
    own = L.modules(sums, skips)
    assert rows(own.select("model", "module", "det", "llm", "n")) == rows(A.module_means(trials).select("model", "module", "det", "llm", "n"))
    assert rows(own.filter("total > 0").select("model", "module", "judged", "total")) == rows(A.judge_coverage(trials, skips).select("model", "module", "judged", "total"))
    tasks = A.by_task(trials)
    both = [A.weighted(A.group_scores(tasks, "module", 3, c), weights).withColumnRenamed("headline", c) for c in ("passes", "det_passes")]
    assert rows(L.headlines(L.by_task(sums), weights, 3)) == rows(both[0].join(both[1], "model"))
    once = sums.filter("module = 'z'").groupBy("model").agg(F.sum("solved").alias("solved"), F.sum("one_shot").alias("one_shot"))
    assert rows(once) == rows(A.recovery(trials, "z").select("model", "solved", "one_shot"))


def test_no_trials(trials):
    sums = L.ledger(trials.limit(0), detailed=True)
    assert sums.count() == L.by_task(sums).count() == L.modules(sums, ()).count() == 0


def test_trials_are_read_once(spark, trials, tmp_path):
    from tallyforge.operators import board, reports

    trials.write.parquet(str(tmp_path / "t"))
    lake = spark.read.parquet(str(tmp_path / "t"))
    weights = spark.createDataFrame([("x", 0.5)], "module string, w double")
    models = spark.createDataFrame([("m0", 1.0, None)], "model string, params_b double, active_b double")
    for made in (board.board(lake, weights, models, 3), reports.board_rows(lake, weights, 3, "z")):
        assert str(tmp_path / "t") not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 4
