"""Annotation spans to labels, prompting stages, retrieval by scan and reports on small fixtures."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import Observation
from pyspark.sql import functions as F

from reviewloom.functions import text
from reviewloom.operators import models, prompting, retrieval, samples, summaries, terms, transfer
from reviewloom.sources import writers

KINDS = "file string, kind string, begin int, end int, aspect_raw string, opinion_raw string"


def test_annotations_become_labels(spark):
    words = "Good  lecturer, hard\nexams. Second review here."
    rows = [
        ("f", "text", 0, 0, words, ""),
        ("f", "span", 0, 27, "", ""),
        ("f", "span", 27, len(words), "", ""),
        ("f", "span", 0, 0, "", ""),  # no text
        ("f", "mark", 0, 4, "Lecturer#X_1", "Positive"),
        ("f", "mark", 1, 5, "Lecturer#X_2_Impli", "Negative"),  # one each: neutral
        ("f", "mark", 16, 20, "End_Exam#X_x", "odd"),  # an unknown opinion: the nearest free one
        ("f", "mark", 18, 22, "", "Negative"),
        ("f", "mark", 2, 3, "Course#X_9", "Positive"),  # no such aspect
        ("f", "mark", 20, 40, "CA#X_x", "Positive"),  # crosses the spans
        ("f", "mark", 30, 35, "Subject_Material#X_1a_Impli", "Positive"),  # not among the codes
        ("f", "mark", 28, 33, " CA#X_x ", "Neutral#Sug"),
    ]
    got = {(r.span, r.text, r.aspect, r.polarity) for r in transfer.labelled(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == {
        ("0-27", "Good lecturer, hard exams.", "lecturer_quality", "neutral"),
        ("0-27", "Good lecturer, hard exams.", "exam_fairness", "negative"),
        (f"27-{len(words)}", "Second review here.", "assessment_design", "neutral"),
    }
    assert transfer.labelled(spark.createDataFrame([], KINDS)).count() == 0


def test_overlap_and_its_stricter_form(spark):
    rows = [(1, "a", "positive"), (1, "b", "negative"), (2, "a", "neutral"), (2, "c", "positive"), (3, "b", "negative"), (3, "a", "positive"), (4, "b", "positive")]
    labels = spark.createDataFrame(rows, "review_id long, aspect string, polarity string")
    assert [tuple(r) for r in transfer.overlap(labels).orderBy("place").collect()] == [(1, "a", 3, 2, 1, 0), (2, "b", 3, 1, 0, 2), (3, "c", 1, 1, 0, 0)]
    assert {tuple(r) for r in transfer.strict_overlap(labels, 3, 2, "review_id").collect()} == {r for r in rows if r[0] in (1, 3)}
    reviews = spark.createDataFrame([(k, f"t{k}") for k in range(1, 6)], "review_id long, text string")
    assert {tuple(r) for r in transfer.wide(reviews, labels, ["a", "c"]).collect()} == {(1, "t1", 1, 0, 1.0, None), (2, "t2", 1, 1, 0.0, 1.0), (3, "t3", 1, 0, 1.0, None)}


def test_transfer_tries_every_real_review(spark):
    words = [("good clear talk", 1, 0), ("long hard exam", 0, 1), ("good hard mix", 1, 1)]
    synthetic = spark.createDataFrame([(i, words[i % 3][0], *words[i % 3][1:]) for i in range(60)], "review_id long, text string, y_a int, y_b int")
    real = spark.createDataFrame([(1, "good clear talk", 1, 0), (2, "long hard exam", 0, 1)], synthetic.schema)
    fact = transfer.transfer(synthetic, real, ["a", "b"]).collect()
    assert len(fact) == 4 and all(r.y_pred == r.y_true for r in fact)


def test_models_score_after_something_was_observed(spark):
    seen = Observation()
    spark.range(5).observe(seen, F.count("*").alias("n")).count()
    assert seen.get == {"n": 5}
    rows = spark.createDataFrame([(i, ("good clear talk", "long hard exam")[i % 2], 1 - i % 2) for i in range(40)], "review_id long, text string, y_a int")
    features = models.tfidf().fit(rows).transform(rows)
    assert all((r.prob > 0.5) == bool(r.y_a) for r in models.detector(features, "y_a")(features).collect())


def test_titles(spark):
    cases = ["A. Who. 2020.  On Things . In Proc . 3", "no year here", "1875. Old. Not spaced", "", None]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(text.inferred_title(F.col("t"))).collect()] == ["On Things", "no year here", "1875. Old. Not spaced", "", None]


def test_scan_and_join_give_the_same_best(spark):
    words = ["a b c", "a b", "c d e f", "zz", "", None, "a a a", "B C A", "f e d"]
    pool = spark.createDataFrame([(i, words[i % 9] if i % 9 != 2 else f"c d e f w{i}") for i in range(90)], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "a b c d"), (2, "e f"), (3, "nothing"), (4, None), (5, "")], "query_id long, text string")
    tokens = lambda t: set(re.findall("[a-z0-9_]+", (t or "").lower()))
    docs = pool.collect()
    want = set()
    for q in queries.collect():
        hits = sorted((-len(tokens(q.text) & tokens(d.text)), d.doc_id) for d in docs if tokens(q.text) & tokens(d.text))[:4]
        want |= {(q.query_id, d, -n, p) for p, (n, d) in enumerate(hits, 1)}
    for limit in (retrieval.QUERY_BYTES, 0):
        got = retrieval.token_overlap(queries, pool, 4, limit)
        assert {(r.query_id, r.doc_id, r.overlap, r.place) for r in got.collect()} == want
    assert retrieval.token_overlap(queries.limit(0), pool, 4).count() == 0


def test_coverage_takes_the_rarest_label_first(spark):
    cells = [(i, a) for i in range(40) for a, step in (("x", 1), ("y", 4), ("z", 13)) if i % step == 0]
    df = spark.createDataFrame(cells, "item long, label string")
    order = [r.item for r in df.select("item").distinct().orderBy(samples.hash_order(42, F.col("item")), "item").collect()]
    taken, want = set(), []
    for label in ("z", "y", "x"):
        mine = [i for i in order if (i, label) in cells and i not in taken][:4]
        taken |= set(mine)
        want += [(i, label) for i in mine]
    want += [(i, None) for i in order if i not in taken][: 12 - len(want)]
    assert [tuple(r) for r in samples.coverage(df, "item", "label", 12).collect()] == want and len(want) == 12
    assert samples.coverage(df, "item", "label", 100).count() == 40
    assert samples.coverage(df.limit(0), "item", "label", 5).count() == 0


def test_ranks_keep_null_strata_and_repeated_keys(spark):
    df = spark.createDataFrame([(i % 7, None if i % 2 else "s") for i in range(50)], "k long, s string")
    got = samples.per_stratum(df, "k", "s", 100)
    assert got.count() == 50 and sorted(r.place for r in got.where("s IS NULL").collect()) == list(range(1, 26))


def _client(replies):
    def make():
        def reply(prompt):
            return next(v for k, v in replies if all(part in prompt for part in k))

        return reply

    return make


def test_two_passes(spark):
    reviews = spark.createDataFrame([("r1", "one"), ("r2", "two"), ("r3", "three")], "custom_id string, text string")
    client = _client(
        [
            (("Which of", "one"), 'ok {"aspects": ["pace", "pace", "nonsense", "exam"]}'),
            (("Which of", "two"), '{"aspects": []}'),
            (("Which of", "three"), "no JSON"),
            (("pace, exam", "one"), '```{"aspects": [{"aspect": "pace", "sentiment": "Positive"}, {"aspect": "exam", "sentiment": "bad"}, {"aspect": "work", "sentiment": "neutral"}, {"aspect": "pace", "sentiment": " negative "}]}```'),
        ]
    )
    assert [tuple(r) for r in prompting.two_pass(reviews, ["pace", "exam", "work"], client).collect()] == [("r1", "pace", "negative")]


def test_one_aspect_at_a_time(spark):
    reviews = spark.createDataFrame([("r1", "one"), ("r2", "two")], "custom_id string, text string")
    client = _client([(("clearly discuss this", "pace", "one"), '{"present": true}'), (("clearly discuss this", "exam", "two"), '{"present": true}'), (("clearly discuss this",), '{"present": false}'), (("say about this", "pace"), '{"sentiment": "Neutral"}'), (("say about this", "exam"), '{"sentiment": "odd"}')])
    assert [tuple(r) for r in prompting.aspect_by_aspect(reviews, ["pace", "exam"], client).collect()] == [("r1", "pace", "neutral")]


def test_judge_fills_and_repairs(spark):
    pairs = spark.createDataFrame([(f"p{k}", f"pair {k}.", f"left {k}", f"right {k}") for k in range(4)], "custom_id string, prompt string, a_text string, b_text string")
    both = json.dumps({"review_a_label": " Real ", "review_b": {"predicted_label": "synthetic", "confidence": "80", "justification": "why", "cues": "Flat Tone; lists"}})
    client = _client(
        [
            (("pair 0",), both),
            (("pair 1",), json.dumps({"review_a": {"label": "real", "confidence": 70}})),
            (("Is this review", "right 1"), json.dumps({"predicted_label": "Synthetic", "reason": "r", "cue_tags": ["Too neat"]})),
            (("pair 2", "Your last reply"), both),
            (("pair 2",), "nothing"),
            (("pair 3",), "{}"),
        ]
    )
    got = {r.custom_id: r for r in prompting.judge(pairs, client).collect()}
    assert (got["p0"].review_a.label, got["p0"].review_b.label, got["p0"].attempts) == ("real", "synthetic", 1)
    assert (got["p0"].review_a.confidence, got["p0"].review_b.confidence, got["p0"].review_b.reason, got["p0"].review_b.justification) == (50, 80, "why", "why")
    assert got["p0"].review_b.cue_tags == ["flat_tone", "lists"] and got["p0"].review_a.cue_tags == []
    assert (got["p1"].review_a.label, got["p1"].review_a.confidence, got["p1"].review_b.label, got["p1"].review_b.cue_tags, got["p1"].attempts) == ("real", 70, "synthetic", ["too_neat"], 1)
    assert got["p2"].attempts == 2 and (got["p3"].attempts, got["p3"].review_a, got["p3"].review_b) == (0, None, None)


def test_damped_counts(spark):
    df = spark.createDataFrame([("red red red blue",), ("red green",)], "text string")
    features = lambda damped: [sorted(r.features.toArray().tolist()) for r in models.tfidf(sublinear=damped).fit(df).transform(df).collect()]
    plain, damped = features(False), features(True)
    assert plain[1] == damped[1]  # every count is 1
    two, once = (1 + math.log(2)) / math.hypot(1 + math.log(2), 1, 1), 1 / math.hypot(1 + math.log(2), 1, 1)  # "red red", and "red blue" and "blue"; "red" is in all rows
    assert damped[0][-3:] == pytest.approx([once, once, two]) and plain[0][-1] == pytest.approx(2 / math.sqrt(6))


def test_reports_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, None), ("a", 2, 2), ("c", 0, 3)], "row string, x int, y int")
    assert [(r.row, r.total) for r in summaries.by_total(df, "row", ["x", "y"]).orderBy("place").collect()] == [("a", 4), ("c", 3), ("b", 1)]
    assert [r.total for r in summaries.by_total(df, "row", ["x", "y"], mean=True).orderBy("place").collect()] == [2.0, 1.5, 0.5]
    page = writers.html_table(spark.createDataFrame([("<b>\nx", None)], "t string, n int"), "A & B")
    assert "<td><pre>&lt;b&gt;\nx</pre></td><td><pre></pre></td>" in page and "<h2>A &amp; B</h2>" in page
    report = writers.sections(spark.createDataFrame([("g", 1), ("g", 3), ("g", 2), (None, 5)], "grp string, v int"), "Report", "grp", ["v"], top=2)
    assert report.count("\n## ") == 2 and "| 1 |\n| 2 |" in report and "| 3 |" not in report and "| 5 |" in report
    for value, suffix in (({"k": "ü"}, "json"), ("plain", "txt")):
        path = writers.write_artifact(spark, value, str(tmp_path / "artifact"))
        assert path.endswith(suffix)
        line = spark.read.text(path).first()[0]
        assert line == value if suffix == "txt" else json.loads(line) == value
    assert spark.read.option("header", True).csv(writers.write_artifact(spark, df, str(tmp_path / "frame"))).count() == 3
    assert len({writers.RunStore.fresh_id("run") for _ in range(5)}) == 5


def test_terms_weigh_as_the_pipeline_of_pyspark_does(spark):
    words = ["red", "Blue", "a", "green_2", "straße", "İx", "été", "𠀀", "42", "red,blue", "x-y zz"]
    rows = [(i, " ".join(words[(i * k + k // 3) % len(words)] for k in range(i % 9))) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "review_id long, text string")
    filled = df.fillna({"text": ""})
    for sublinear, min_df in ((False, 1.0), (True, 3.0), (False, 0.2)):
        want = {r.review_id: sorted(x for x in r.features.toArray() if x) for r in models.tfidf(5000, min_df, sublinear).fit(filled).transform(filled).collect()}
        got = {r.review_id: sorted(x for x in r.features.toArray() if x) for r in terms.fit(df, 5000, min_df, sublinear)(df).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    most = spark.createDataFrame([("b b b a1 a1 c c",)], "text string")
    assert {(r.tf, r.df) for r in terms.counts(most.withColumn("text", F.regexp_replace("text", r"\b([bc])\b", "$1$1")), 2).collect()} == {(3, 1), (2, 1), (1, 1)}
    few = terms.fit(filled, 3)(filled).where("review_id = 8").first().features
    assert few.size == 3
    assert terms.fit(df.limit(0))(df).count() == 62


def test_two_step_cuts_no_text_in_the_jvm(spark, monkeypatch):
    monkeypatch.setattr(models, "tfidf", lambda *a, **k: pytest.fail("texts were tokenised once for each step of a pyspark pipeline"))
    rows = [(i, ("good clear talk", "long hard exam")[i % 2], 1 - i % 2, 0.5 * (i % 4) if i % 2 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "review_id long, text string, y_a int, s_a double")
    fact = models.two_step(df, df, df, ["a"]).collect()
    assert len(fact) == 60 and all(r.y_pred == r.y_true for r in fact)


def test_a_full_table_of_terms_is_sent_on(spark):
    draw = random.Random(3)
    df = spark.createDataFrame([(" ".join(f"w{draw.randrange(400)}" for _ in range(200)),) for _ in range(1500)], "text string").coalesce(1)
    want = Counter(t for r in df.collect() for w in [r.text.split()] for t in [*w, *zip(w, w[1:])])
    full, terms.TABLE = terms.TABLE, 1 << 12  # read in tasks, so it is put into what is sent there
    try:
        cloudpickle.register_pickle_by_value(terms)
        got = terms.counts(df, 3).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(terms)
        terms.TABLE = full
    assert sorted(r.tf for r in got) == sorted(want.values()) and sum(r.df for r in got) < sum(r.tf for r in got)
