"""Stage logs, packages by content, and snapshots of progress."""

from __future__ import annotations

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reviewloom.operators.stages import StageLog
from reviewloom.sources.packages import Packages
from reviewloom.streaming.snapshots import Snapshots


def test_stage_log_counts_what_is_written_in_one_pass(spark, tmp_path):
    passed = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def touched(x):
        passed.add(1)
        return x

    log = StageLog(spark, str(tmp_path), "r1")
    out = log.run("even", lambda: spark.range(0, 1000, numPartitions=5).select(touched("id").alias("id")), {"total": F.sum("id"), "least": F.min("id")})
    assert passed.value == 1000 and out.count() == 1000
    done = log.status().collect()
    assert [(r.run_id, r.stage, r.place, r.state, r.metrics) for r in done] == [("r1", "even", 1, "done", {"rows": "1000", "total": "499500", "least": "0"})]
    assert sorted(r.state for r in log.log().collect()) == ["done", "running"]


def test_stage_log_of_no_rows(spark, tmp_path):
    log = StageLog(spark, str(tmp_path))
    assert log.run("none", lambda: spark.range(10).where("id > 99"), {"total": F.sum("id")}).count() == 0
    assert log.run("empty", lambda: spark.createDataFrame([], "id long"), {"total": F.sum("id")}).count() == 0
    assert [r.metrics for r in log.status().collect()] == [{"rows": "0", "total": None}] * 2


def test_stage_log_resumes_after_a_failure(spark, tmp_path):
    made = []

    def job(fail):
        log = StageLog(spark, str(tmp_path), "r")
        one = log.run("one", lambda: made.append(1) or spark.range(10))
        return log, log.run("two", lambda: one.where(F.assert_true(F.lit(not fail)).isNull()))

    with pytest.raises(Exception, match="false|assert|ASSERT"):
        job(True)
    assert {(r.stage, r.state) for r in StageLog(spark, str(tmp_path), "r").status().collect()} == {("one", "done"), ("two", "failed")}
    log, out = job(False)
    assert out.count() == 10 and made == [1]
    assert {(r.stage, r.place, r.state) for r in log.status().collect()} == {("one", 1, "done"), ("two", 2, "done")}
    assert log.log().where("stage = 'two'").count() == 4


FILES = "name string, content string"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def test_packages_equal_content_equal_digest(spark, tmp_path):
    kept = Packages(spark, str(tmp_path / "p"))
    rows = [(f"f{k}", ["same", "other", "", None][k % 4]) for k in range(60)]
    first = kept.write(files(spark, rows))
    again = kept.write(files(spark, rows[::-1] + rows[:5]).repartition(7))
    assert first == again and len(first) == 64
    assert {(r.name, bytes(r.content).decode(), r.bytes) for r in kept.read(first).collect()} == {(n, c or "", len(c or "")) for n, c in rows}
    assert kept.objects().count() == 3
    other = kept.write(files(spark, [*rows[1:], ("f0", "new")]))
    assert other != first and kept.objects().count() == 4
    assert kept.damaged(first).count() == kept.damaged(other).count() == 0
    swapped = kept.write(files(spark, [("a", "1"), ("b", "2")]))
    assert swapped != kept.write(files(spark, [("a", "2"), ("b", "1")]))


def test_packages_torn_writes_are_never_read(spark, tmp_path):
    kept = Packages(spark, str(tmp_path / "p"))
    digest = kept.write(files(spark, [("a", "1"), ("b", "2")]))
    os.remove(tmp_path / "p" / "manifests" / digest / "_SUCCESS")  # as if the writer had been lost before its commit
    with pytest.raises(FileNotFoundError):
        kept.read(digest)
    assert kept.write(files(spark, [("b", "2"), ("a", "1")])) == digest
    assert kept.read(digest).count() == 2 and kept.objects().count() == 2
    with pytest.raises(FileNotFoundError):
        kept.read("../objects")
    for f in glob.glob(str(tmp_path / "p" / "objects" / "*" / "part=*" / "*.parquet"))[:1]:
        os.remove(f)
    assert kept.damaged(digest).count() == 1


def test_packages_refuse_ambiguous_names(spark, tmp_path):
    kept = Packages(spark, str(tmp_path / "p"))
    for rows in ([("a", "1"), ("a", "2")], [(None, "1")]):
        with pytest.raises(ValueError):
            kept.write(files(spark, rows))
    empty = kept.write(files(spark, []).limit(0))
    assert kept.read(empty).count() == 0


POLL = "run_id string, poll_id long, polled_at timestamp, status string, output string"
T0 = datetime(2024, 1, 1)


def polls(seed, n):
    draw = random.Random(seed)
    return [(draw.choice([*[f"r{k}" for k in range(25)], None]), seed * 1000 + k, T0 + timedelta(minutes=draw.randrange(9000)), draw.choice(["validating", "in_progress", "completed", None]), draw.choice(["", None, f"out{k}"])) for k in range(n)]


def plain(rows, late):
    runs = {}
    for r in rows:
        if r[0]:
            runs.setdefault(r[0], []).append(r)
    watermark = max(r[2] for own in runs.values() for r in own) - late
    out = {}
    for own in runs.values():
        last = max(own, key=lambda r: (r[2], r[1]))
        ready = any(r[3] == "completed" and r[4] for r in own)
        s = out.setdefault(last[3], [0, 0, 0, 0])
        s[0] += 1
        s[1] += ready
        s[2] += not ready and last[2] <= watermark
        s[3] += len(own)
    return {k: tuple(v) for k, v in out.items()}


def shown(rows):
    return {r.status: (r.n_runs, r.n_ready, r.n_stalled, r.n_polls) for r in rows}


def stream(spark, folder):
    return spark.readStream.schema(POLL).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_snapshots_for_each_trigger_over_a_restart(spark, tmp_path):
    late, folder, root = timedelta(hours=30), tmp_path / "in", str(tmp_path / "out")
    parts = [polls(k, 40) for k in range(1, 5)]
    put = lambda k: spark.createDataFrame(parts[k], POLL).coalesce(1).write.mode("append").parquet(str(folder))
    put(0)
    Snapshots(spark, root, late).start(stream(spark, folder)).awaitTermination()
    put(1)
    put(2)
    kept = Snapshots(spark, root, late)  # another driver
    kept.start(stream(spark, folder)).awaitTermination()
    for n in range(3):
        assert shown(kept.snapshots().where(F.col("batch") == n).collect()) == plain(sum(parts[: n + 1], []), late)
    before = sorted(map(repr, kept.snapshots().collect()))
    kept.take(spark.createDataFrame(parts[2], POLL), 2)  # repeated after a crash
    assert sorted(map(repr, kept.snapshots().collect())) == before
    query = kept.start(stream(spark, folder), every="1 second")
    put(3)
    query.processAllAvailable()
    query.stop()
    assert shown(kept.latest().collect()) == plain(sum(parts, []), late)
    assert kept.snapshots().agg(F.max("batch")).first()[0] == 3


def test_snapshots_of_nothing(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path / "out"))
    assert kept.snapshots().count() == 0
    kept.take(spark.createDataFrame([], POLL), 0)
    kept.take(spark.createDataFrame([("r", 1, None, "completed", "o")], POLL), 1)
    assert shown(kept.latest().collect()) == {"completed": (1, 0, 0, 1)}  # a poll without a time makes no run ready
