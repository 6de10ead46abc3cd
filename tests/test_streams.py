"""Streams that fail and go on: the log's commits, the lake's buckets, the gate's order, calls and their results."""

import json
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tallyforge.plans.streams import ROCKS, setting
from tallyforge.sources import lake as L
from tallyforge.streaming import log, topup, trials


def feed(spark, path, rows, ddl, file):
    """One file of a stream's folder."""
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{path}/{file}")


def stream(spark, path, ddl, each=1):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", each).parquet(f"{path}/*")


class LostBefore(log.LogWriter):
    """Ends once before its first commit, as a killed driver does."""

    def commit(self, messages, batchId):
        mark = f"{self.path}-lost-before"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost before the commit")
        super().commit(messages, batchId)


class LostAfter(log.LogWriter):
    """Ends once right after a commit, before Spark knows of it."""

    def commit(self, messages, batchId):
        super().commit(messages, batchId)
        mark = f"{self.path}-lost-after"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost after the commit")


class Before(log.TrialLog):
    def streamWriter(self, schema, overwrite):
        return LostBefore(self.options["path"])


class After(log.TrialLog):
    def streamWriter(self, schema, overwrite):
        return LostAfter(self.options["path"])


@pytest.mark.parametrize("source", [Before, After])
def test_each_trial_stands_once_whatever_is_lost(spark, tmp_path, source):
    data, path, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    for f in range(3):
        feed(spark, data, [(f * 10 + i, f"t{i}") for i in range(10)], "k long, t string", f"f{f}")
    for attempt in range(2):
        try:
            log.write_log(stream(spark, data, "k long, t string"), path, state, source)
        except Exception as e:
            assert attempt == 0 and "lost" in str(e)
    rows = log.read_log(spark, path, stream(spark, data, "k long, t string").schema)
    assert sorted(r["k"] for r in rows.collect()) == list(range(30))
    feed(spark, data, [(30, "late")], "k long, t string", "f3")
    log.write_log(stream(spark, data, "k long, t string"), path, state, source)
    rows = log.read_log(spark, path, rows.schema)
    assert sorted(r["k"] for r in rows.collect()) == list(range(31))
    epochs = log.commits(spark, path).collect()
    assert sorted(r["epoch"] for r in epochs) == list(range(len(epochs))) and sum(r["rows"] for r in epochs) == 31


def test_a_writer_aborts_its_files(tmp_path):
    import pyarrow as pa

    w = log.LogWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"a": [1, 2]})
    kept, dropped, nothing = w.write(iter([batch])), w.write(iter([batch])), w.write(iter([]))
    assert nothing.file is None and nothing.rows == 0 and kept.rows == 2
    w.abort([dropped, None, nothing], 1)
    w.commit([kept, nothing, None], 0)
    again = w.write(iter([batch]))
    w.commit([again], 0)  # the epoch is there already
    assert len(os.listdir(tmp_path / "data")) == 1 and json.loads((tmp_path / "commits" / "000000000000.json").read_text()) == {"epoch": 0, "files": [kept.file], "rows": 2}


DDL = "uid string, v long"


def test_new_uids_read_no_data_and_known_ones_their_buckets(spark, tmp_path):
    lake = str(tmp_path / "lake")
    df = lambda rows: spark.createDataFrame(rows, DDL)
    one = topup.add_new(df([(f"a{i}", i) for i in range(300)] + [("a1", 99)]), lake, "uid", 8)
    two = topup.add_new(df([(f"b{i}", i) for i in range(300)]), lake, "uid", 8)
    assert one["read"] == two["read"] == [] and two["version"] == 2  # not one data file
    same = topup.add_new(df([("a7", 1), ("b7", 1), ("c7", 1)]), lake, "uid", 8)
    code = lambda u: spark.createDataFrame([(u,)], "uid string").select(topup.bucket("uid", 8)).first()[0]
    assert set(same["read"]) == {code("a7"), code("b7")} and same["version"] == 3
    assert topup.add_new(df([("a7", 1)]), lake, "uid", 8)["version"] == 3  # run again: nothing new
    found = L.read(spark, lake).collect()
    assert sorted(r["uid"] for r in found) == sorted([f"a{i}" for i in range(300)] + [f"b{i}" for i in range(300)] + ["c7"])
    assert topup.add_new(df([(None, 1)]), lake, "uid", 8)["version"] == 4 and topup.add_new(df([(None, 2), (None, 3)]), lake, "uid", 8)["version"] == 4
    with pytest.raises(ValueError, match="buckets"):
        topup.add_new(df([("x", 1)]), lake, "uid", 9)


def test_buckets_grow_by_filters(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    import pyarrow as pa

    monkeypatch.setattr(topup, "PER_FILTER", 1000)
    keys = lambda n: pa.table({"_part": ["x"] * n, "h1": rng.integers(-(2**63), 2**63 - 1, n), "h2": rng.integers(-(2**63), 2**63 - 1, n)})
    none = pa.Table.from_pylist([], pa.schema([("_part", pa.string()), ("seq", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())]))
    first, more, others = keys(2500), keys(700), keys(5000)
    own = topup.grown(more, topup.grown(first, none))
    assert own["n"].to_pylist() == [1000, 1000, 1000, 200] and own["seq"].to_pylist() == [0, 1, 2, 3]
    assert topup.suspects(first, own).num_rows == 2500 and topup.suspects(more, own).num_rows == 700 and topup.suspects(others, own).num_rows <= 2
    assert topup.suspects(others, none).num_rows == 0


def test_a_stream_goes_on_after_a_lost_batch(spark, tmp_path, monkeypatch):
    data, lake, state = (str(tmp_path / n) for n in ("in", "lake", "state"))
    for f in range(3):
        feed(spark, data, [(f"u{(f * 5 + i) % 12}", f) for i in range(7)], DDL, f"f{f}")
    commit, calls = L.commit, []

    def lost(*a):
        calls.append(1)
        commit(*a)
        if len(calls) == 2:
            raise OSError("lost after the commit")

    monkeypatch.setattr(L, "commit", lost)
    with pytest.raises(Exception, match="lost"):
        topup.top_up(stream(spark, data, DDL), lake, "uid", state, 4)
    topup.top_up(stream(spark, data, DDL), lake, "uid", state, 4)
    topup.top_up(stream(spark, data, DDL), lake, "uid", f"{state}-other", 4)  # another run over the same rows
    assert sorted(r["uid"] for r in L.read(spark, lake).collect()) == sorted({f"u{(f * 5 + i) % 12}" for f in range(3) for i in range(7)})


START = datetime(2024, 1, 1)


def verdicts(spark, tmp_path, rows, name, each, delay="2 days", need=3):
    data = str(tmp_path / name)
    ddl = "model string, ts timestamp, uid long, dead boolean"
    for f in range(0, len(rows), each):
        feed(spark, data, rows[f : f + each], ddl, f"f{f:04d}")
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        trials.run_to_end(trials.dead_gate_in_order(stream(spark, data, ddl), need, delay), f"gate_{name}", str(tmp_path / f"{name}-state"), "append")
    return sorted(tuple(r) for r in spark.table(f"gate_{name}").collect())


def test_the_gate_counts_in_order_of_finish(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"m{i % 5}", START + timedelta(hours=rng.randrange(40)), i, (i // 5) % 4 < 3 - i % 3) for i in range(60)]
    rows += [("few", START, 900, True), ("clock", START + timedelta(days=9), 901, True)]
    want = []
    for m in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == m and r[1] < START + timedelta(days=7)), key=lambda r: (r[1], r[2]))[:3]
        if len(own) == 3:
            want.append((m, all(r[3] for r in own)))
    body, clock = rows[:-1], rows[-1:]
    in_order = sorted(body, key=lambda r: (r[1], r[2]))
    assert verdicts(spark, tmp_path, in_order + clock, "ordered", 70) == want
    rng.shuffle(body)
    assert verdicts(spark, tmp_path, body + clock, "shuffled", 20) == want


def test_late_trials_do_not_count(spark, tmp_path):
    h = lambda n: START + timedelta(hours=n)
    rows = [("a", h(10), 1, True), ("a", h(11), 2, True), ("x", h(90), 3, True), ("a", h(1), 4, False), ("x", h(200), 5, True)]
    # One file each: when the fourth comes, the watermark (88 h) has passed it and the verdict of "a" is given.
    assert ("a", True) in verdicts(spark, tmp_path, rows, "late", 1, "2 hours", 2)


def test_calls_meet_their_results(spark, tmp_path):
    h = lambda n: START + timedelta(hours=n)
    calls = [(1, h(0)), (2, h(1)), (3, h(2)), (4, h(3)), (5, h(500))]
    results = [(1, h(5), "ok"), (2, h(30), "too late"), (4, h(2), "before its call"), (9, h(4), "no call"), (3, h(2), "at once"), (8, h(500), "clock")]
    feed(spark, str(tmp_path / "c"), calls, "k long, called timestamp", "f")
    feed(spark, str(tmp_path / "r"), results, "k long, answered timestamp, result string", "f")
    paired = trials.pair_results(stream(spark, str(tmp_path / "c"), "k long, called timestamp"), stream(spark, str(tmp_path / "r"), "k long, answered timestamp, result string"), ["k"])
    trials.run_to_end(paired, "paired", str(tmp_path / "state"), "append")
    assert sorted((r["k"], r["result"]) for r in spark.table("paired").collect()) == [(1, "ok"), (2, None), (3, "at once"), (4, None)]
