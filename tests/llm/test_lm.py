from __future__ import annotations

import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

from reviewloom.llm import lm  # noqa: E402


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def test_class_distribution_is_normalised():
    draw = np.random.default_rng(1)
    codes = draw.integers(0, lm.CLASSES, 500) + (lm.CLASSES + 1) * draw.integers(0, lm.CLASSES + 1, 500) + (lm.CLASSES + 1) ** 2 * draw.integers(0, lm.CLASSES + 1, 500)
    model = trained(np.unique(codes), np.ones(len(np.unique(codes)), int), lm.Training())
    for far, near in ((3, 5), (lm.BEGIN, lm.BEGIN), (lm.END, 0)):
        far, near = np.array([far]), np.array([near])
        logits = model.context(far, near) @ model.after.T + model.bias - model.normalisers(far, near)
        assert np.exp(logits.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def trained(codes, counts, how):
    model = lm.LogBilinear(how, np.bincount(codes % (lm.CLASSES + 1), counts, minlength=lm.CLASSES) + 0.5)
    lm.train_nce(model, codes, counts, how, 0)
    return model


def test_training_learns_a_dependence():
    m = lm.CLASSES + 1
    codes = np.array([(1 * m + 2) * m + 3, (1 * m + 4) * m + 5])
    model = trained(codes, np.array([20000, 20000]), lm.Training(weight=1.0))

    def p(w, near):
        far, near = np.array([1]), np.array([near])
        return math.exp(float((model.context(far, near) @ model.after[w])[0] + model.bias[w] - model.normalisers(far, near)[0]))

    assert p(3, 2) > 0.8 and p(5, 4) > 0.8 and p(3, 4) < 0.2


def test_parameters_survive_packing():
    model = trained(np.array([5, 9]), np.array([3, 4]), lm.Training())
    other = lm.LogBilinear(lm.Training(seed=1), np.ones(lm.CLASSES))
    other.unpack(model.packed())
    assert all((getattr(model, k) == getattr(other, k)).all() and (model.squares[k] == other.squares[k]).all() for k in model.NAMES)


def test_every_trigram_trains_and_averages_are_weighted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(60))) for i in range(200)], "doc_id long, text string")
    events = lm.class_events(docs, [f"w{i}" for i in range(90)])
    assert events.agg({"n": "sum"}).first()[0] == 200 * 61
    seen = []
    averaged = lm._averaged

    def spy(models):
        rows = models.collect()
        seen.append((len(rows), sum(r.weight for r in rows)))
        return averaged(models)

    monkeypatch.setattr(lm, "_averaged", spy)
    monkeypatch.setattr(lm, "_AVERAGED", 3)  # more tasks than are averaged at once
    how = lm.Training(share=50, rounds=2)
    a = lm.fit_classes(events, np.ones(lm.CLASSES), how)
    assert len(seen) == 2 and seen[0][0] > 9 and sum(n for _, n in seen) == 200 * 61
    b = lm.fit_classes(events.repartition(5), np.ones(lm.CLASSES), how)
    assert np.allclose(a.after, b.after, atol=1e-5)


def test_long_texts_and_long_words_score_as_they_would_whole(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(90)) + (" " + "y" * 200) * (i % 3) + " \n") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "_RUN_BYTES", 50)
    monkeypatch.setattr(lm, "_SCORED_TOKENS", 30)
    monkeypatch.setattr(lm, "HOT_BYTES", 1000)  # then the long word is hot
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    for i, r in want.items():
        assert tuple(r)[:5] == tuple(got[i])[:5] and got[i].base_score == pytest.approx(r.base_score, abs=1e-9)
    assert list(lm.word_runs(b" A b  c" * 40)) != [[b"a"]] and [w for run in lm.word_runs(b" A b  c" * 40) for w in run] == [b"a", b"b", b"c"] * 40


@pytest.mark.parametrize("hot", [200_000, 60])
def test_documents_against_plain_counts(spark, sf, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)  # with few, most words meet their counts in the join
    got = {r.doc_id: r for r in lm.op6_lm_scores(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter()
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in docs.items():
        w, r = tokens(t), got[i]
        base = math.fsum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, abs=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_of_a_bucket_share_its_mass(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 300}x{k % 7}" for k in range(40))) for i in range(400)], "doc_id long, text string")
    model, counts = lm.fit(docs)
    inside = {}
    for r in counts.collect():
        if r.word and r.word not in model.words:
            inside[lm.bucket(r.word)] = inside.get(lm.bucket(r.word), 0.5) + r.n + 0.5
    for k in range(lm.BUCKETS):
        assert model.bucket_mass[k] == pytest.approx(inside.get(lm.WORDS + k, 0.5))


def test_edge_cases(spark):
    got = lm.score_documents(edge.table(spark)).collect()
    assert len(got) == len(edge.rows()) and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score_documents(edge.empty(spark)).count() == 0
    only = edge.table(spark).where("doc_id = 1")  # whether or not it is learned from
    assert lm.score_documents(only).count() == 1
