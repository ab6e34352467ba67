"""The jointly trained model: what it learns, how it stops, and that it resumes."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from reviewloom.operators import joint as J

SMALL = J.Training(buckets=1 << 10, hidden=4, epochs=5, rows_per_task=60)
SCHEMA = "review_id long, text string, y_fun int, y_hard int, s_fun double"


def rows(n, seed=1):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        fun, hard = draw.random() < 0.5, draw.random() < 0.3
        words = [draw.choice("lorem ipsum dolor sit amet".split()) for _ in range(12)] + ["joy"] * fun + ["exam"] * hard + (["great"] if fun and k % 2 else ["awful"] if fun else [])
        draw.shuffle(words)
        out.append((k, " ".join(words), None if k % 11 == 5 else int(fun), int(hard), (1.0 if k % 2 else -1.0) if fun else None))
    return out


def test_it_learns_detection_and_sentiment(spark, tmp_path):
    parts = [spark.createDataFrame(rows(n, s), SCHEMA) for n, s in ((240, 1), (60, 2), (120, 3))]
    fact = J.joint(*parts, ["fun", "hard"], f"file://{tmp_path}/c", replace(SMALL, epochs=12))
    got = fact.collect()
    assert len(got) == 240 and fact.columns[:3] == ["aspect", "review_id", "y_true"]
    known = [r for r in got if r.y_true is not None]
    assert np.mean([r.y_pred == r.y_true for r in known]) > 0.9
    felt = [r for r in got if r.sent_true is not None]
    assert np.mean([(r.sent_pred > 0) == (r.sent_true > 0) for r in felt]) > 0.9
    assert all(-1 <= r.sent_pred <= 1 and 0 <= r.prob <= 1 for r in got)


def test_a_killed_run_resumes_to_the_same_weights(spark, tmp_path):
    train, held = spark.createDataFrame(rows(200), SCHEMA).repartition(3), spark.createDataFrame(rows(50, 2), SCHEMA)
    one, idf, best = J.fit(train, held, ["fun", "hard"], f"file://{tmp_path}/one", SMALL)
    J.fit(train, held, ["fun", "hard"], f"file://{tmp_path}/two", replace(SMALL, epochs=2))  # killed after two epochs
    two, idf_two, best_two = J.fit(train.repartition(2), held, ["fun", "hard"], f"file://{tmp_path}/two", SMALL)
    assert best == best_two and np.array_equal(idf, idf_two) and all(np.array_equal(one[k], two[k]) for k in one)
    again, _, _ = J.fit(train, held, ["fun", "hard"], f"file://{tmp_path}/two", SMALL)  # finished: nothing is trained
    assert all(np.array_equal(one[k], again[k]) for k in one)


def test_the_rate_halves_and_training_stops(spark, tmp_path, monkeypatch):
    scores = iter([0.5, 0.4, 0.4, 0.4, 0.4, 0.9])
    monkeypatch.setattr(J, "held_score", lambda fact: next(scores))
    monkeypatch.setattr(J, "epoch", lambda dealt, w, *a: {k: v + 1 for k, v in w.items()})
    train = spark.createDataFrame(rows(30), SCHEMA)
    w, _, best = J.fit(train, train, ["fun", "hard"], f"file://{tmp_path}/c", replace(SMALL, epochs=50, patience=4, plateau=2, rate=0.8))
    last = J.Checkpoints(spark, f"file://{tmp_path}/c").last()
    assert (best, last.epoch, last.rate, last.waited, last.best) == (1, 5, 0.2, 4, 0.5)
    assert np.array_equal(w["detect"], J.start(2, SMALL)["detect"] + 1)


def test_empty_null_and_unlabelled_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    w, _, best = J.fit(none, none, ["fun", "hard"], f"file://{tmp_path}/a", SMALL)
    assert best == 0 and np.array_equal(w["words"], J.start(2, SMALL)["words"])
    odd = spark.createDataFrame([(None, None, None, 1, None), (1, "", 1, 0, 0.5), (1, "", 1, 0, 0.5)], SCHEMA)
    fact = J.joint(odd, odd, odd, ["fun", "hard"], f"file://{tmp_path}/b", SMALL)
    assert fact.count() == 6 and fact.where(F.isnan("prob") | F.col("prob").isNull()).count() == 0
