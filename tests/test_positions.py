"""Running totals, file positions and shards against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from reviewloom.operators import metrics as M
from reviewloom.operators import positions as P
from reviewloom.operators import review
from reviewloom.staging import stage


def test_running_totals_equal_a_loop(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(50), k, draw.choice([None, 1, 5])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, score int, id int, v int").repartition(7)
    got = P.cumulative(df, [F.desc("score"), "id"], {"total": F.col("v"), "place": F.lit(1)}, ["g"])
    assert got.columns == ["g", "score", "id", "v", "total", "place"]
    run, want = defaultdict(lambda: (0, 0)), {}
    for g, score, i, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        run[g] = run[g][0] + (v or 0), run[g][1] + 1
        want[i] = run[g]
    assert {r.id: (r.total, r.place) for r in got.collect()} == want
    assert P.cumulative(df.where("false"), ["id"], {"n": F.lit(1)}).count() == 0


def test_many_or_equal_scores_are_spread_over_tasks(spark, monkeypatch):
    largest = []
    monkeypatch.setattr(P, "stage", lambda df, name: largest.append([r["count"] for r in df.groupBy("range").count().collect()]) or stage(df, name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are read by one task
    try:
        for score, order in ((F.col("id") * 1.0, range(3999, -1, -1)), (F.lit(0.5), range(4000))):
            df = spark.range(4000).select("id", score.alias("score"))
            got = {r.id: (r["rank"], r.quarter) for r in review.quartiles(df, "score", "id").collect()}
            assert got == {i: (k + 1, k * 4 // 4000 + 1) for k, i in enumerate(order)}
            fact = df.select(F.lit("g").alias("g"), F.col("score").alias("prob"), (F.col("id") % 2).alias("y_true"))
            assert M.ranking(fact, "g").first().auroc is not None
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    quarters_far, ranks_far, quarters_equal, ranks_equal = largest
    assert all(len(x) == 4 and max(x) < 2000 for x in (quarters_far, ranks_far, quarters_equal)) and ranks_equal == [1]


def test_ranking_equals_a_loop(spark):
    draw = random.Random(4)
    rows = [(g, draw.randrange(20) / 20 if g == "t" else draw.random(), draw.randrange(2)) for g in "dt" for _ in range(300)] + [("one", 0.5, 1)] * 5
    got = {r.g: (r.average_precision, r.auroc) for r in M.ranking(spark.createDataFrame(rows, "g string, prob double, y_true int"), "g").collect()}
    assert set(got) == {"d", "t"}
    for g in "dt":
        own = [(p, y) for h, p, y in rows if h == g]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        auroc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
        ap = sum(sum(y for q, y in own if q >= p) / sum(q >= p for q, _ in own) for p in pos) / len(pos)
        assert abs(got[g][0] - ap) < 1e-9 and abs(got[g][1] - auroc) < 1e-9


def test_numbers_equal_line_numbers_over_many_partitions(spark, tmp_path):
    lines = [f"line {k} {'x' * (k % 97)}" for k in range(5000)]
    for part in range(3):
        (tmp_path / f"f{part}.txt").write_text("\n".join(lines[part * 1700 : part * 1700 + (1700 if part < 2 else 1600)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        scan = spark.read.text(str(tmp_path))
        assert scan.rdd.getNumPartitions() > 10
        got = sorted((r.position, r.value) for r in P.numbered(scan).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(lines))


def plain_shards(sizes, most_bytes, most, span):
    out, shard, held, count, block, upto, n = [], -1, 0, 0, None, 0, 0
    for size in sizes:
        if size > most_bytes:
            out.append(None)
            continue
        own = upto // (span * most_bytes) + n // (span * most)
        upto, n = upto + size, n + 1
        if own != block or held + size > most_bytes or count >= most:
            shard, held, count = shard + 1, 0, 0
        block, held, count = own, held + size, count + 1
        out.append(shard)
    return out


def test_shards_keep_order_and_limits(spark):
    draw = random.Random(5)
    for most_bytes, most, span in ((100, 7, 2), (1000, 3, 4), (60, 100, 1)):
        sizes = [draw.randrange(0, 70) for _ in range(500)]
        df = spark.createDataFrame(list(enumerate(sizes)), "id int, s int").repartition(6)
        rows = sorted((r.id, r.shard, r["size"]) for r in P.shards(df, ["id"], F.col("s"), most_bytes, most, span).collect())
        assert [r[1] for r in rows] == plain_shards(sizes, most_bytes, most, span)
        held = defaultdict(list)
        for _, shard, size in rows:
            if shard is not None:
                held[shard].append(size)
        assert sorted(held) == list(range(len(held))) and all(sum(v) <= most_bytes and len(v) <= most for v in held.values())
    assert P.shards(df.where("false"), ["id"], F.col("s"), 10, 10).count() == 0


def test_submission_goes_on_where_it_stopped(spark):
    df = spark.range(100).withColumn("s", F.lit(10))
    sharded = lambda n: P.shard_manifest(P.shards(df.where(F.col("id") < n), ["id"], F.col("s"), 100, 100), "id")
    first = sharded(45)
    left = P.unsubmitted(sharded(100), first).select("shard").collect()
    assert sorted(r.shard for r in left) == [4, 5, 6, 7, 8, 9]  # the half-full fifth shard changed
