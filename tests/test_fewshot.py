"""Prompts with examples and the evaluation of replies, on small fixtures."""

from __future__ import annotations

import json
import math

import pytest

from reviewloom.operators import evaluation, fewshot, retrieval

POOL = "doc_id long, text string, aspects array<struct<aspect:string,sentiment:string>>"


def _pool(spark):
    some = lambda n: [(f"a{i}", "neutral") for i in range(n)]
    return spark.createDataFrame([(1, "red blue", some(1)), (2, "red", some(2)), (3, "red", some(2)), (4, None, None), (5, "green", some(3)), (6, "grey", [])], POOL)


def test_drawn_examples(spark):
    pool = _pool(spark)
    for seed in range(5):
        ids = [[e.doc_id for e in fewshot.drawn(p, 5, seed, True).first().examples] for p in (pool, pool.repartition(5))]
        assert ids[0] == ids[1] and len(ids[0]) <= 5
        sizes = {1: 1, 2: 2, 3: 2, 5: 3}
        assert [sizes[d] for d in ids[0][:3]] == [1, 2, 3]
    got = fewshot.drawn(pool, 10, 1).first().examples
    assert sorted(e.text for e in got) == ["", "green", "grey", "red", "red blue"]  # each text once
    assert fewshot.drawn(pool.limit(0), 3, 1, True).first().examples == []
    assert fewshot.drawn(pool, 0, 1).first().examples == []


def test_retrieved_examples_have_k_rows(spark):
    reviews = spark.createDataFrame([("x", "Red, BLUE"), ("y", None), ("z", "nothing shared")], "custom_id string, text string")
    got = {r.custom_id: [e.doc_id for e in r.examples] for r in fewshot.retrieved(reviews, _pool(spark), 2, 3).collect()}
    assert set(got) == {"x", "y", "z"} and all(len(v) == 2 for v in got.values())
    assert fewshot.requests(reviews, _pool(spark).limit(0), ["a0"], "retrieval-few-shot", 1).count() == 3


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_least_overlap(spark, limit):
    queries = spark.createDataFrame([(1, "red blue"), (2, None)], "query_id long, text string")
    rows = lambda least: [tuple(r) for r in retrieval.token_overlap(queries, _pool(spark), 4, limit, least).orderBy("query_id", "place").collect()]
    assert rows(2) == [(1, 1, 2, 1)]
    assert rows(1) == [(1, 1, 2, 1), (1, 2, 1, 2), (1, 3, 1, 3)]
    assert rows(0) == [(1, 1, 2, 1), (1, 2, 1, 2), (1, 3, 1, 3), (1, 4, 0, 4), (2, 1, 0, 1), (2, 2, 0, 2), (2, 3, 0, 3), (2, 4, 0, 4)]


def test_prompts(spark):
    reviews = spark.createDataFrame([("x", "the text"), ("y", None)], "custom_id string, text string")
    made = {r.custom_id: r for r in fewshot.requests(reviews, _pool(spark), ["a0", "a1"], "few-shot", 1).collect()}
    assert made["x"].prompt.endswith("Review:\nthe text") and made["y"].prompt.endswith("Review:\n")
    for i, e in enumerate(made["x"].examples, 1):
        reply = made["x"].prompt.split(f"Example {i}\n{e.text}\nReply: ")[1].split("\n")[0]
        assert json.loads(reply) == {"aspects": [{"aspect": a.aspect, "sentiment": a.sentiment} for a in e.aspects or []]}
    bare = fewshot.requests(reviews, _pool(spark), ["a0", "a1"], "zero-shot-glossary", 1, glossary={"a0": "what it is"}).first()
    assert bare.examples == [] and "a0: what it is\na1: \n" in bare.prompt and "Example" not in bare.prompt
    with pytest.raises(ValueError):
        fewshot.requests(reviews, _pool(spark), [], "other", 1)


def test_replies_to_metrics(spark):
    label = "array<struct<aspect:string,sentiment:string>>"
    manifest = spark.createDataFrame(
        [("1", "m", [("a", "positive"), ("b", "negative")]), ("2", "m", [("a", "neutral")]), ("3", "m", None), ("4", "m", [("b", "positive")]), ("5", "n", [("zzz", "positive")])],
        f"custom_id string, approach string, gold {label}",
    )
    results = spark.createDataFrame(
        [("1", 1, "no"), ("1", 2, 'So: {"aspects": {"a": "Negative", "zzz": "positive"}}'), ("2", 1, '{"aspects": [{"aspect": "a", "sentiment": "neutral"}, {"aspect": "b", "sentiment": "odd"}]}'), ("3", 1, "{broken}"), ("9", 1, "{}"), ("5", 1, "{}")],
        "custom_id string, pos int, text string",
    )
    said, summary, per = evaluation.evaluate(manifest, results, ["a", "b"])
    assert {r.custom_id: (r.ok, [tuple(p) for p in r.predicted]) for r in said.collect()} == {"1": (1, [("a", "negative")]), "2": (1, [("a", "neutral")]), "3": (0, []), "4": (0, []), "5": (1, [])}
    m, n = (summary.where(f"approach = '{a}'").first() for a in "mn")
    assert (m.n_examples, m.parse_success_rate, m.tp, m.fp, m.fn) == (4, 0.5, 2, 0, 2)
    assert math.isclose(m.label_accuracy, 6 / 8) and m.subset_accuracy == 0.5 and m.sentiment_mse == 2.0 and math.isclose(m.micro_f1, 2 / 3)
    assert math.isclose(m.samples_f1, (2 / 3 + 1) / 4) and math.isclose(m.samples_jaccard, 1.5 / 4) and n.sentiment_mse is None and n.label_accuracy == 1.0
    assert {(r.approach, r.aspect): (r.tp, r.tn, r.fp, r.fn) for r in per.collect()} == {("m", "a"): (2, 2, 0, 0), ("m", "b"): (0, 2, 0, 2), ("n", "a"): (0, 1, 0, 0), ("n", "b"): (0, 1, 0, 0)}
    assert evaluation.evaluate(manifest.limit(0), results, ["a", "b"])[1].count() == 0


def test_live_evaluation(spark):
    manifest = spark.createDataFrame([("1", "m", [("a", "positive")])], "custom_id string, approach string, gold array<struct<aspect:string,sentiment:string>>")
    requests = spark.createDataFrame([("1", "about a")], "custom_id string, prompt string")
    summary = evaluation.evaluate_live(requests, manifest, ["a"], lambda: lambda prompt: '{"aspects": {"a": "positive"}}')[1].first()
    assert (summary.micro_f1, summary.sentiment_mse, summary.parse_success_rate) == (1.0, 0.0, 1.0)
