"""Monitored runs and merged shards across batches, repetitions and restarts."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timedelta

import duckdb
import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewloom.plans import registry
from reviewloom.streaming import merging
from reviewloom.streaming import monitor as N

POLL = "run_id string, poll_id long, polled_at timestamp, status string, output string"
T0 = datetime(2024, 1, 1)


def polls(seed=1, n=200):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        status = draw.choice(["validating", "in_progress", "completed", "failed"])
        out.append((f"r{draw.randrange(25)}", k, T0 + timedelta(minutes=draw.randrange(500)), status, draw.choice(["", None, f"out{k}"])))
    return out


def plain(rows):
    out = {}
    for run in {r[0] for r in rows}:
        own = sorted((r[2], r[1], r[3], r[4]) for r in rows if r[0] == run and r[2])
        ready = [o for o in own if o[2] == "completed" and o[3]]
        out[run] = (len(own), own[-1][0], own[-1][2], ready[0][0] if ready else None, ready[0][3] if ready else None, bool(ready), bool(ready), bool(ready))
    return out


def states(report):
    return {r.run_id: (r.n_polls, r.polled_at, r.status, r.ready_at, r.output, r.downloaded, r.assembled, r.benchmarked) for r in report.collect()}


def test_states_are_the_same_however_polls_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "COMPACT", 2)
    rows = polls()
    rows.sort(key=lambda r: json.dumps(r[:2]))
    for k, cuts in enumerate(([0, 200], [0, 70, 71, 130, 200])):
        m = N.Monitor(spark, f"file://{tmp_path}/{k}")
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = spark.createDataFrame(rows[a:b], POLL)
            m.take(part, number)
            m.take(part, number)  # a repeated batch
        assert states(m.report()) == plain(rows)
        taken = m.latches().groupBy("run_id", "step").count().collect()
        assert all(r["count"] == 1 for r in taken) and len(taken) == 3 * sum(p[5] for p in plain(rows).values())


def test_a_crash_between_any_two_steps_repeats_none(spark, tmp_path):
    rows = [("a", 1, T0, "completed", "x"), ("b", 2, T0, "in_progress", None)]
    calls = []

    def act(name, broken):
        def run(due):
            calls.append((name, sorted(r.run_id for r in due.collect())))
            if broken:
                raise RuntimeError("lost driver")
            return due.select("run_id", F.lit(name).alias("made"))

        return run

    def steps(broken):
        return [N.Step(n, after=after, act=act(n, n == broken)) for n, after in (("downloaded", None), ("assembled", "downloaded"), ("benchmarked", "assembled"))]

    for k, broken in enumerate(["downloaded", "assembled", "benchmarked"]):
        calls.clear()
        root = f"file://{tmp_path}/{k}"
        with pytest.raises(RuntimeError):
            N.Monitor(spark, root, steps(broken)).take(spark.createDataFrame(rows, POLL), 0)
        m = N.Monitor(spark, root, steps(None))  # another driver
        m.take(spark.createDataFrame(rows, POLL), 0)
        assert states(m.report())["a"][5:] == (True, True, True) and states(m.report())["b"][5:] == (False, False, False)
        assert [c for c, _ in calls] == sorted(["downloaded", "assembled", "benchmarked", broken], key=["downloaded", "assembled", "benchmarked"].index)
        for n in ("downloaded", "assembled", "benchmarked"):
            assert [r.run_id for r in spark.read.parquet(f"{root}/rows/{n}/batch=0").collect()] == ["a"]
        m.take(spark.createDataFrame([("b", 3, T0 + timedelta(hours=1), "completed", "y")], POLL), 1)
        assert states(m.report())["b"][4:] == ("y", True, True, True) and m.latches().count() == 6


def test_the_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = polls(2, 90)
    src = tmp_path / "in"
    src.mkdir()
    write = lambda k, part: (src / f"{k}.json").write_text("".join(json.dumps(dict(run_id=a, poll_id=b, polled_at=c.isoformat(), status=d, output=e)) + "\n" for a, b, c, d, e in part))
    stream = lambda: spark.readStream.schema(POLL).option("maxFilesPerTrigger", 1).json(str(src))
    write(0, rows[:30]), write(1, rows[30:60])
    assert states(N.Monitor(spark, f"file://{tmp_path}/m").run(stream())) == plain(rows[:60])
    write(2, rows[60:])
    assert states(N.Monitor(spark, f"file://{tmp_path}/m").run(stream())) == plain(rows)
    assert states(N.Monitor(spark, f"file://{tmp_path}/m").run(stream())) == plain(rows)


def test_empty_batches_and_nulls(spark, tmp_path):
    m = N.Monitor(spark, f"file://{tmp_path}/m")
    m.take(spark.createDataFrame([], POLL), 0)
    assert m.report().count() == 0 and m.latches().count() == 0
    m.take(spark.createDataFrame([(None, 1, T0, "completed", "x"), ("a", None, None, None, None)], POLL), 1)
    assert [(r.run_id, r.n_polls, r.status) for r in m.report().collect()] == [("a", 1, None)]


SHARD = "run_id string, shard long, n_shards long, path string, n_rows long, at timestamp"


def test_shards_merge_once_in_order(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    day = lambda d: (T0 + timedelta(days=d)).isoformat()
    files = [
        [("a", 2, 3, "a2", 20, day(0)), ("b", 1, 2, "b1", 5, day(0)), (None, 1, 1, "n", 1, day(0))],
        [("a", 1, 3, "a1", 10, day(1)), ("a", 2, 3, "again", 99, day(1))],
        [("a", 3, 3, "a3", 30, day(1)), ("c", 1, 1, "c1", 7, day(1))],
        [("a", 3, 3, "late", 1, day(2)), ("d", 1, 2, "d1", 1, day(9))],
        [("d", 2, 2, "d2", 4, day(9))],
        [("b", 2, 2, "b2", 6, day(9))],
    ]
    names = SHARD.replace("timestamp", "").split(", ")

    def put(k):
        (src / f"{k}.json").write_text("".join(json.dumps({n.split()[0]: v for n, v in zip(names, row)}) + "\n" for row in files[k]))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by age

    def run():
        stream = spark.readStream.schema(SHARD).option("maxFilesPerTrigger", 1).json(str(src))
        plans = merging.merge_plans(stream, "1 day", 2 * 86_400_000)
        q = plans.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for k in range(3):
        put(k)
    want = [("a", 1, "a1", 10, 0, "merged"), ("a", 2, "a2", 20, 10, "merged"), ("a", 3, "a3", 30, 30, "merged"), ("c", 1, "c1", 7, 0, "merged")]
    assert run() == want
    for k in range(3, 6):  # after a restart: a late shard, the watermark far ahead, a run that waited too long
        put(k)
    assert run() == sorted([*want, ("b", 1, "b1", 5, None, "timeout"), ("d", 1, "d1", 1, 0, "merged"), ("d", 2, "d2", 4, 1, "merged")], key=str)
    rows = spark.createDataFrame([("a", s, q, f"{s}.{q}") for s in (1, 2, 3) for q in range(10 * s)] + [("b", 1, 0, "x")], "run_id string, shard long, seq long, line string")
    got = sorted((r.row_number, r.line) for r in merging.merged(rows, spark.read.parquet(str(tmp_path / "out"))).collect())
    assert got == list(enumerate(f"{s}.{q}" for s in (1, 2, 3) for q in range(10 * s)))


def test_a_run_that_is_whole_at_once_sets_no_timer():
    class Handle:  # counts what would be messages to the JVM
        calls: list = []

        def getValueState(self, *_):
            calls = self.calls

            class State:
                get = lambda self: calls.append("get")
                update = lambda self, value: calls.append(value)

            return State()

        registerTimer = calls.append

    plans = merging.MergePlans(1000)
    plans.init(Handle())
    rows = pd.DataFrame({"shard": [1, 0], "n_shards": [2, 2], "path": ["b", "a"], "n_rows": [3, 4], "at": pd.to_datetime(["2024-01-02", "2024-01-01"])})
    (plan,) = plans.handleInputRows(("r",), iter([rows]), None)
    assert plan[["shard", "first_row", "state"]].values.tolist() == [[0, 0, "merged"], [1, 4, "merged"]]
    assert Handle.calls == ["get", (2, True, -1, [])]


def test_runs_judged_by_batches_merge_once_in_order(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    day = lambda d: (T0 + timedelta(days=d)).isoformat()
    files = [
        [("a", 2, 3, "a2", 20, day(0)), ("b", 1, 2, "b1", 5, day(0)), (None, 1, 1, "n", 1, day(0))],
        [("a", 1, 3, "a1", 10, day(1)), ("a", 2, 3, "again", 99, day(0))],
        [("a", 3, 3, "a3", 30, day(1)), ("c", 1, 1, "c1", 7, day(1)), ("c", 1, 1, "c1 late", 8, day(2)), ("e", 1, 1, "e1", None, None)],
        [("a", 3, 3, "late", 1, day(2)), ("d", 1, 2, "d1", 1, day(9))],
        [("d", 2, 2, "d2", 4, day(9))],
        [("b", 2, 2, "b2", 6, day(9))],
    ]
    names = [c.split()[0] for c in SHARD.split(", ")]
    stream = lambda: spark.readStream.schema(SHARD).option("maxFilesPerTrigger", 1).json(str(src))

    def run(name):  # another driver each time
        return sorted((tuple(r) for r in merging.Merges(spark, f"file://{tmp_path}/{name}", late_ms=86_400_000).run(stream()).collect()), key=str)

    def put(k):
        (src / f"{k}.json").write_text("".join(json.dumps(dict(zip(names, row))) + "\n" for row in files[k]))
        os.utime(src / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by age

    whole = [("a", 1, "a1", 10, 0, "merged"), ("a", 2, "a2", 20, 10, "merged"), ("a", 3, "a3", 30, 30, "merged"), ("c", 1, "c1", 7, 0, "merged"), ("e", 1, "e1", None, 0, "merged")]
    put(0)
    assert run("each") == []
    put(1), put(2)
    assert run("each") == whole
    put(3)
    assert run("each") == sorted([*whole, ("b", 1, "b1", 5, None, "timeout")], key=str)
    put(4), put(5)  # b's other shard comes after its timeout
    d = [("d", 1, "d1", 1, 0, "merged"), ("d", 2, "d2", 4, 1, "merged")]
    assert run("each") == run("each") == sorted([*whole, *d, ("b", 1, "b1", 5, None, "timeout")], key=str)
    b = [("b", 1, "b1", 5, 0, "merged"), ("b", 2, "b2", 6, 5, "merged")]  # within one backlog it doesn't
    assert run("once") == sorted([*whole, *d, *b], key=str)


def test_a_crash_while_a_batch_is_judged_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", 1, 2, "a1", 3, T0), ("b", 1, 1, "b1", 4, T0)], SHARD)
    more = spark.createDataFrame([("a", 2, 2, "a2", 5, T0 + timedelta(days=9)), ("b", 1, 1, "again", 6, T0)], SHARD)
    m = merging.Merges(spark, f"file://{tmp_path}/m")
    m.take(rows, 0), m.take(rows, 0)
    with monkeypatch.context() as broken:
        broken.setattr(merging, "_judged", lambda df: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            m.take(more, 1)
    m.take(more, 1), m.take(rows, 0)
    m.expire(), m.expire()
    assert sorted(tuple(r) for r in m.plans().collect()) == [("a", 1, "a1", 3, 0, "merged"), ("a", 2, "a2", 5, 3, "merged"), ("b", 1, "b1", 4, 0, "merged")]
    assert [tuple(r)[:2] for r in m.plans(1).collect()] == [("b", 1)]


def test_runs_are_judged_without_python(spark):
    plan = merging._judged(spark.createDataFrame([], SHARD).withColumn("again", F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange") == 1 and plan.count("Sort ") == 1


@pytest.mark.parametrize("odd", ["130 files", "nulls", "large ids", "no events"])
def test_merged_shards_equal_the_sql_on_odd_events(spark, tmp_path, odd):
    """130 files are three micro-batches, and each file spans all the time."""
    made = {
        "130 files": spark.range(0, 130 * 21, 1, 130).selectExpr("id AS event_id", "id % 50 + 0.5D AS value", "timestamp'2024-01-01' + make_dt_interval(int(id % 21)) AS ts"),
        "nulls": spark.range(0, 700, 1, 1).selectExpr("if(id = 650, NULL, id) AS event_id", "if(id % 5 = 0, NULL, id % 50 + 0.5D) AS value", "if(id % 3 = 0 OR id < 21, NULL, timestamp'2024-01-01' + make_dt_interval(int(id div 20))) AS ts"),
        "large ids": spark.range(1 << 60, (1 << 60) + 700, 1, 1).selectExpr("id AS event_id", "id % 50 + 0.5D AS value", "timestamp'2024-01-01' + make_dt_interval(int(id % 21)) AS ts"),
        "no events": spark.range(0, 0, 1, 1).selectExpr("id AS event_id", "1D AS value", "timestamp'2024-01-01' AS ts"),
    }
    made[odd].write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT event_id, value, CAST(ts AS TIMESTAMP) AS ts FROM '{tmp_path}/events.parquet/*.parquet'")
    name = "q_merged_shards"
    got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert oracle.rows(got) == oracle.rows(want) and (len(want) > 500) == (odd != "no events")
