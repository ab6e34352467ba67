"""Operators on small fixtures: cases that the tables don't hold."""

from __future__ import annotations

import json
import math
import os
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import scores, text
from reviewloom.operators import agreement, batch, errors, generation, metrics, models, normalize, retrieval, samples, summaries
from reviewloom.sources import readers, writers


def one(df):
    return df.collect()[0]


def values(df, column):
    return [r[column] for r in df.collect()]


def fact(spark, rows):
    """rows: (review_id, aspect, y_true, y_pred, prob)"""
    return spark.createDataFrame([("a", *r) for r in rows], "approach string, review_id long, aspect string, y_true int, y_pred int, prob double").withColumn("idx", F.lit(0))


def test_rates_of_nothing_are_zero(spark):
    r = one(metrics.rates(metrics.confusion(fact(spark, [(1, "x", 0, 0, 0.1)]), "aspect")))
    assert (r.precision, r.recall, r.f1, r.mcc, r.accuracy) == (0, 0, 0, 0, 1)
    assert one(metrics.samples_metrics(fact(spark, [(1, "x", 0, 0, 0.1)]), "approach")).samples_f1 == 0


def test_thresholds_match_a_plain_scan(spark):
    rows = [(i, "x", int(i % 3 == 0), 0, (i * 37 % 100) / 100) for i in range(60)]
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in metrics.at_thresholds(fact(spark, rows), metrics.GRID, "aspect").collect()}
    for t in metrics.GRID:
        hit = [(y, p >= t) for _, _, y, _, p in rows]
        assert got[t] == tuple(sum(1 for y, h in hit if (y, h) == k) for k in ((1, True), (0, True), (1, False), (0, False)))
    nothing = one(metrics.calibrate(fact(spark, [(1, "x", 0, 0, 0.9)]), "aspect"))
    assert (nothing.threshold, nothing.f1) == (0.5, 0.0)


def test_ranking_groups_ties(spark):
    rows = [(1, "x", 1, 0, 0.9), (2, "x", 0, 0, 0.5), (3, "x", 1, 0, 0.5), (4, "x", 0, 0, 0.1), (5, "y", 1, 0, 0.3)]
    got = metrics.ranking(fact(spark, rows), "aspect").collect()
    assert [r.aspect for r in got] == ["x"]  # y has one class
    assert got[0].auroc == pytest.approx((2 + 1.5) / 4)
    assert got[0].average_precision == pytest.approx((1 + 2 / 3) / 2)


def test_polarities(spark):
    df = spark.createDataFrame([(-1.0,), (-0.5,), (0.5,), (0.51,), (0.2,), (None,)], "s double")
    got = df.select(scores.nearest_polarity(F.col("s")).alias("n"), scores.banded_polarity(F.col("s")).alias("b"), scores.exact_polarity(F.col("s")).alias("e")).collect()
    assert [r.n for r in got] == ["negative", "negative", "neutral", "positive", "neutral", None]
    assert [r.b for r in got] == ["negative", "negative", "positive", "positive", "neutral", None]
    assert [r.e for r in got] == ["negative", "neutral", "neutral", "neutral", "neutral", None]


def test_kappa_edge_cases(spark):
    same = spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string")
    assert one(agreement.cohen_kappa(same, "x", "y")).kappa == 1.0
    none = spark.createDataFrame([(None, "a")], "x string, y string")
    assert agreement.cohen_kappa(none, "x", "y").collect() == [] or one(agreement.cohen_kappa(none, "x", "y")).kappa is None
    mixed = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert one(agreement.cohen_kappa(mixed, "x", "y")).kappa == pytest.approx((0.75 - 0.5) / 0.5)


def test_majorities_and_missing_answers(spark):
    v = spark.createDataFrame([("A", 1, "yes"), ("B", 1, "no"), ("C", 1, "unclear"), ("A", 2, "yes"), ("B", 2, "yes")], "rater string, item_id long, answer string")
    got = {r.item_id: r.answer for r in agreement.majority(v, "answer", "item_id").collect()}
    assert got == {1: "no", 2: "yes"}
    assert {r.item_id: r.answer for r in agreement.majority(v, "answer", "item_id", tie="tie").collect()} == {1: "tie", 2: "yes"}
    assert {r.item_id: r.answers for r in agreement.disagreements(v, "answer", "item_id").collect()} == {1: 3, 2: 2}
    assert set(values(agreement.common_items(v, "item_id"), "item_id")) == {1}


def test_answers_and_buckets(spark):
    df = spark.createDataFrame([(" TRUE ", "match"), ("0", "1"), ("Partial", "yes"), ("yes", "not_supported"), ("?", "yes"), ("yes", "odd"), (None, "no"), ("not_supported", "yes"), ("ambiguous", "no"), ("1", "uncertain")], "s string, m string")
    a = df.select(agreement.normalized_answer(F.col("s")).alias("s"), agreement.normalized_answer(F.col("m")).alias("m"))
    assert values(a.select(agreement.outcome_bucket(F.col("s"), F.col("m")).alias("b")), "b") == ["A", "C", "D", "B", "D", "D", "D", "C", "D", "D"]


def test_exact_binomial_against_rationals(spark):
    cases = [(k, n) for n in (0, 1, 2, 7, 20, 64, 199) for k in {0, n // 3, n // 2, n}]
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(cases)], "id int, k long, n long")
    got = {r.id: r.p_value for r in summaries.binomial_exact(df, "id").collect()}
    for i, (k, n) in enumerate(cases):
        pmf = [Fraction(math.comb(n, j), 2**n) for j in range(n + 1)]
        assert got[i] == pytest.approx(float(sum(p for p in pmf if p <= pmf[k])), abs=1e-9)


def test_wilson_without_trials(spark):
    low, high = scores.wilson(F.lit(0), F.lit(0))
    r = one(spark.range(1).select(low.alias("l"), high.alias("h"), summaries.recommended_n(F.lit(0.1)).alias("n")))
    assert (r.l, r.h, r.n) == (0.0, 1.0, 97)


def test_label_cells(spark):
    cells = ['{"clarity":"Positive","x":"great"}', '[{"name":"workload","polarity":"negative"},{"name":"workload","value":"POSITIVE"}]', "clarity: positive | workload: neutral | odd", "nothing", None]
    got = values(spark.createDataFrame([(c,) for c in cells], "c string").select(normalize.targets(F.col("c")).alias("m")), "m")
    assert got[:4] == [{"clarity": "positive"}, {"workload": "positive"}, {"clarity": "positive", "workload": "neutral"}, {}]
    got = values(spark.createDataFrame([(c,) for c in ('["a","b"]', '{"k":"v"}', "plain", "")], "c string").select(normalize.nuances(F.col("c")).alias("m")), "m")
    assert got == [{"item_0": "a", "item_1": "b"}, {"k": "v"}, {"value": "plain"}, {}]
    odd = ('["a",null," ","b "]', '{"k":null," k2 ":" v ","":"x","e":" "}', " a : b | c : ", None)
    got = values(spark.createDataFrame([(c,) for c in odd], "c string").select(normalize.nuances(F.col("c")).alias("m")), "m")
    assert got == [{"item_0": "a", "item_1": "None", "item_3": "b"}, {"k2": "v"}, {"a": "b"}, {}]


def test_normalised_reviews_use_alias_priority(spark):
    df = spark.createDataFrame([("c", " r ", "clarity: negative", "T", None), ("c", "", "clarity: negative", "T", "G")], "content string, Review string, labels string, course_title string, grade string")
    r = normalize.normalized(df).collect()
    assert len(r) == 1 and (r[0].text, r[0].aspects, r[0].course_name, r[0].grade) == ("r", {"clarity": "negative"}, "T", "")


def test_map_override(spark):
    df = spark.createDataFrame([({"a": 0.1, "b": 0.2}, {"b": 0.9})], "x map<string,double>, y map<string,double>")
    assert one(df.select(normalize.overridden(F.col("x"), F.col("y")).alias("m"))).m == {"a": 0.1, "b": 0.9}


def test_text_functions(spark):
    long = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([("  a \n b ", "```json\n{\"a\":1}\n```", f"{long} {long}", "b; a,A / c|", 'so {"a":{"b":"}"}} x')], "s string, f string, r string, t string, j string")
    r = one(df.select(text.collapse_space(F.col("s")).alias("s"), text.unfence(F.col("f")).alias("f"), text.collapse_repeats(F.col("r")).alias("r"), text.cue_tags(F.col("t")).alias("t"), text.json_block(F.col("j")).alias("j"), text.first_words(F.col("r"), 2).alias("w")))
    assert (r.s, r.f, r.r, r.t, r.w) == ("a b", '{"a":1}', long, ["a", "b", "c"], "w0 w1")
    assert r.j == '{"a":{"b":"}"}'  # braces in strings count too


def test_split_has_exact_counts_and_is_stable(spark):
    df = spark.range(95).withColumnRenamed("id", "k")
    a = {r.k: r.part for r in samples.split(df, "k").collect()}
    b = {r.k: r.part for r in samples.split(df.repartition(7), "k").collect()}
    assert a == b and sorted(a.values()).count("test") == 9 and sorted(a.values()).count("calibration") == 9
    with pytest.raises(ValueError, match="three"):
        samples.split(df.limit(2), "k")


def test_stratified_tops_up(spark):
    df = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(20)], "k long, s string")
    got = samples.stratified(df, "k", "s", 10).collect()
    assert len(got) == 10 and sum(r.s == "a" for r in got) == 2


def test_nearest_opinions_against_a_plain_walk(spark):
    import random

    draw = random.Random(5)
    marks = []
    for f in range(40):
        for _ in range(draw.randrange(1, 9)):
            b = draw.randrange(0, 300)
            kind = draw.randrange(3)
            marks.append((f, 0, b, b + draw.randrange(1, 20), "" if kind == 2 else f"x{draw.randrange(9)}", "" if kind == 1 else f"o{draw.randrange(9)}"))
    want = []
    for f in range(40):
        rows = sorted((m for m in marks if m[0] == f), key=lambda m: m[2:])
        used = set()
        for m in rows:
            if m[4] and m[5]:
                want.append((f, m[4], m[5]))
            elif m[4]:
                best = None
                for i, o in enumerate(rows):
                    if o[4] or i in used:
                        continue
                    d = min(abs(m[2] - o[2]), abs(m[3] - o[3]))
                    if best is None or d < best[0]:
                        best = (d, i)
                if best and best[0] <= 80:
                    used.add(best[1])
                    want.append((f, m[4], rows[best[1]][5]))
    df = spark.createDataFrame(marks, "file long, span_begin long, begin long, end long, aspect_raw string, opinion_raw string")
    got = [(r.file, r.aspect_raw, r.opinion_raw) for r in retrieval.nearest_opinions(df, known=tuple(f"o{k}" for k in range(9))).collect()]
    assert sorted(got) == sorted(want)


def test_batch_joins_and_strictness(spark):
    m = spark.createDataFrame([("a",), ("b",)], "custom_id string")
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("z", 1, "x")], "custom_id string, n int, text string")
    last = batch.last_by_key(log, "custom_id", "n")
    assert {r.custom_id: r.text for r in batch.answered(m, last).collect()} == {"a": "new", "b": None}
    assert values(batch.unanswered(m, last), "custom_id") == ["b"]
    assert values(batch.known_results(m, last), "text") == ["new"]
    with pytest.raises(KeyError):
        batch.strict(m, last)


def test_summary_of_no_rows(spark):
    empty = spark.createDataFrame([], "status string, text string, length long")
    r = one(batch.batch_summary(empty))
    assert (r.n_rows, r.completion_rate, r.duplicate_rate, r.mean_length) == (0, 0.0, 0.0, None)


def test_round_restart(spark):
    df = spark.createDataFrame([("r", 1, "completed"), ("r", 2, "failed"), ("r", 3, "running"), ("s", 1, "running")], "round_id string, n int, status string")
    assert sorted((r.round_id, r.n, r.status) for r in batch.restarted(df, "n").collect()) == [("r", 1, "completed"), ("r", 2, "failed"), ("r", 3, "skipped"), ("s", 1, "pending")]
    done = spark.createDataFrame([("k1", "old"), ("k2", "now")], "key string, signature string")
    assert values(batch.pending_work(spark.createDataFrame([("k1",), ("k2",)], "key string"), done, "now"), "key") == ["k1"]


def test_requests_and_prompt(spark):
    m, v = spark.createDataFrame([("m",)], "model string"), spark.createDataFrame([("zero",)], "variant string")
    items = spark.createDataFrame([(7, "t")], "item_id long, text string")
    r = one(batch.requests(m, v, items).withColumn("p", batch.prompt(F.lit("Label."), F.col("text"))))
    assert r.custom_id == "m__zero__row_000007" and r.p == "Label.\nReview: t\nLabels:"


def test_ask_retries_and_records(spark):
    def client():
        seen = {}

        def reply(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "bad" or (prompt == "flaky" and seen[prompt] < 3):
                raise OSError("no")
            return prompt.upper()

        return reply

    got = {r.custom_id: (r.text, r.error) for r in models.ask(spark.createDataFrame([("1", "ok"), ("2", "flaky"), ("3", "bad")], "custom_id string, prompt string").coalesce(1), client).collect()}
    assert got == {"1": ("OK", None), "2": ("FLAKY", None), "3": (None, "OSError: no")}


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    tolerant = readers.read_jsonl(spark, str(p), "a int", strict=False).collect()
    assert [r.a for r in tolerant if r[readers.CORRUPT] is None] == [1, 2] and len(tolerant) == 3
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.read_jsonl(spark, str(p), "a int").collect()
    assert readers.read_jsonl_if_any(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_raters_by_file_name(spark, tmp_path):
    (tmp_path / "rater_A_complete.csv").write_text("item_id,discussed_x,polarity_x\n1,yes,positive\n2,,\n")
    (tmp_path / "rater_B.csv").write_text("item_id,discussed_x,polarity_x\n1,no,\n")
    got = readers.long_votes(readers.read_raters(spark, f"{tmp_path}/rater_*.csv"), ["x"]).collect()
    assert sorted((r.rater, r.item_id, r.discussed) for r in got if r.discussed) == [("A", "1", "yes"), ("B", "1", "no")]


def test_latest_file_wins(spark, tmp_path):
    for k, name in enumerate(("old", "new")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"approach": "a", "v": name}) + "\n")
        os.utime(tmp_path / f"{name}.json", (1000 + k, 1000 + k))
    df = spark.read.json(str(tmp_path)).select("*", "_metadata")
    assert values(readers.latest_by(df, "approach"), "v") == ["new"]


def test_annotation_xml(spark, tmp_path):
    (tmp_path / "a.xmi").write_text(
        '<x:XMI xmlns:x="urn:x" xmlns:custom="urn:c" xmlns:cas="urn:s"><cas:Sofa sofaString="Good notes"/><custom:Document_levelopinion begin="0" end="10" Document_levelopinion="Positive"/>'
        '<custom:AspectTag begin="5" end="10" Aspect="CA#X_x" Opinion="Positive"/><custom:AspectTag begin="5" Aspect="lost"/></x:XMI>'
    )
    got = sorted((r.kind, r.begin, r.end, r.aspect_raw, r.opinion_raw) for r in readers.read_annotations(spark, str(tmp_path)).collect())
    assert got == [("mark", 5, 10, "CA#X_x", "Positive"), ("span", 0, 10, "", "Positive"), ("text", 0, 0, "Good notes", "")]


def test_html_cards_and_lists(spark):
    words = " ".join(f"w{i}" for i in range(30))
    page = f'<div class="card"><div class="card-header">Fall 2020</div><div class="card-body"><p class="card-text"><p>{words}</p></p></div></div><div class="card"><div class="card-header">x</div><p class="card-text">short</p></div>'
    df = spark.createDataFrame([(1, page), (2, page), (3, None)], "page_id long, html string")
    assert [(r.page_id, r.header) for r in readers.html_cards(df).collect()] == [(1, "Fall 2020")]
    card = lambda head, n: f'<div class="card"><div class="card-header">{head}</div><p class="card-text">{words} x{n}</p></div>'
    heads = ["<b>A</b><script>document.write(get_semester_name('20231'))</script>", "<span data-s=\"get_semester_name('2022F')\">B</span>", "Fall <i>2021</i>"]
    df = spark.createDataFrame([(1, "".join(card(h, n) for n, h in enumerate(heads)) + "<p class='card-header'>get_semester_name('no')</p>")], "page_id long, html string")
    assert [(r.header, r.semester) for r in readers.html_cards(df).orderBy("ord").collect()] == [("A", "20231"), ("B", "2022F"), ("Fall 2021", "Fall 2021")]
    refs = spark.createDataFrame([('<ol class="refs"><li><a href="u">A  b</a></li><li>c</li></ol>',)], "h string")
    assert [tuple(x) for x in one(refs.select(readers.reference_list(F.col("h")).alias("r"))).r] == [("u", "A b"), ("", "c")]


def test_notebook_and_log(spark, tmp_path):
    p = tmp_path / "n.json"
    p.write_text(json.dumps({"cells": [{"outputs": [{"text": ["F1 old\n"]}]}, {"outputs": [{"text": ["F1 ", "new\n"]}]}, {"outputs": []}]}))
    assert values(readers.notebook_outputs(spark, str(p), "F1"), "text") == ["F1 new\n"]
    outs = [{"text": "begin: [x]\n"}, {"data": {"text/plain": ["F1 ", "0.5"], "image/png": "zz"}}, {"data": {"image/png": "zz"}}, {"text": ["end"]}]
    p.write_text(json.dumps({"cells": [{"cell_type": "code", "outputs": outs}, {"cell_type": "markdown", "source": ["F1"]}, {"cell_type": "raw", "outputs": [{"text": "F1"}]}]}))
    assert [tuple(r) for r in readers.notebook_outputs(spark, str(p), "F1").collect()] == [(0, "begin: [x]\n\nF1 0.5\nend")]
    assert readers.notebook_outputs(spark, str(p), "absent").count() == 0
    lines = spark.createDataFrame([("  exam_fairness   0.9810  0.50 0.4 0.25 0.35   12 400 3  9",), ("clarity : threshold=0.45  (F1=0.812)",), ("noise 1 2",)], "value string")
    assert [tuple(r) for r in readers.log_metrics(lines).collect()] == [("exam_fairness", 0.981, 0.5, 0.4, 0.25, 0.35, 12, 400, 3, 9)]
    assert [tuple(r) for r in readers.log_thresholds(lines).collect()] == [("clarity", 0.45, 0.812)]


def test_generation_settings(spark):
    from reviewloom.operators import generation

    rows = [("Very short comment", 1, "gpt-5.2-x"), ("very short comment", 2, "gpt-5-nano"), (" mid-length reflective review", 2, "GPT-5.1"), ("mid-length reflective review", 3, "claudia"), ("anything", 2, "gpt-5-mini"), ("detailed review with one dominant complaint", 3, "gpt-5")]
    df = spark.createDataFrame(rows, "band string, n int, model string")
    words, tokens = generation.length_settings(F.col("band"), F.col("n"))
    got = df.select(words.alias("w"), tokens.alias("t"), generation.effort(F.col("model")).alias("e")).collect()
    assert [(r.t, r.e) for r in got] == [(90, "none"), (110, "minimal"), (210, "low"), (230, "minimal"), (160, "minimal"), (330, "low")]
    assert "20-40 words" in got[0].w and "55-95 words" in got[4].w


def test_unknown_opinion_codes_look_for_the_nearest(spark):
    rows = [("f", 0, 0, 5, "CA#X_x", "Odd"), ("f", 0, 10, 15, "", "Positive"), ("f", 0, 12, 14, "", "Odd"), ("f", 0, 40, 45, "Course#X_x", "Negative"), ("f", 0, 50, 55, "Lecturer#X_1", "")]
    df = spark.createDataFrame(rows, "file string, span_begin long, begin long, end long, aspect_raw string, opinion_raw string")
    assert sorted((r.aspect_raw, r.opinion_raw) for r in retrieval.nearest_opinions(df).collect()) == [("CA#X_x", "Positive"), ("Course#X_x", "Negative")]


def test_canary_gate_needs_all_five(spark):
    good = {"text_success_rate": 0.95, "completion_rate": 0.95, "duplicate_rate": 0.1, "band_match_rate": 0.7, "loader_ok": True}
    worse = [{}, {"text_success_rate": 0.94}, {"completion_rate": 0.94}, {"duplicate_rate": 0.11}, {"band_match_rate": 0.69}, {"loader_ok": False}, {"loader_ok": None}]
    df = spark.createDataFrame([tuple({**good, **w}.values()) for w in worse], "text_success_rate double, completion_rate double, duplicate_rate double, band_match_rate double, loader_ok boolean")
    assert values(batch.canary_gate(df), "accepted") == [True] + [False] * 6


def test_cue_tags_join_words(spark):
    df = spark.createDataFrame([(" Too  Formal ; odd\tword/too formal,,",)], "s string")
    assert one(df.select(text.cue_tags(F.col("s")).alias("t"))).t == ["odd_word", "too_formal"]


def test_run_store(spark, tmp_path):
    store = writers.RunStore(spark, str(tmp_path / "runs"))
    for run in ("r1", "r2"):
        store.write(run, "metrics", spark.createDataFrame([(run,)], "v string"))
        store.register(run, {"seed": "1"})
    store.write("r1", "metrics", spark.createDataFrame([("again",)], "v string"))
    assert values(store.read("metrics"), "v") == ["r2"] and values(store.read("metrics", "r1"), "v") == ["again"]
    assert "| v |" in writers.markdown(store.read("metrics", "r1").select("v"))


def test_packets_differ_by_rater(spark):
    got = writers.rater_packets(spark.range(30).withColumnRenamed("id", "item_id"), ["A", "B"], "item_id", 1).collect()
    order = {r: [x.item_id for x in sorted(got, key=lambda x: x.position) if x.rater == r] for r in "AB"}
    assert sorted(order["A"]) == sorted(order["B"]) == list(range(30)) and order["A"] != order["B"]


def test_lineage_and_backfill(spark):
    a, b = spark.createDataFrame([("p", 1)], "path string, x int"), spark.createDataFrame([("q", 1)], "path string, x int")
    with pytest.raises(ValueError, match="path"):
        summaries.common_lineage([a, b], "path")
    rows = spark.createDataFrame([("k", None)], "key string, x int")
    other = spark.createDataFrame([("k", 5, "n")], "key string, x int, y string")
    assert tuple(one(summaries.backfill(rows, other, "key"))) == ("k", 5, "n")


def test_constant_models(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "review_id long, y int")
    assert values(models.detector(df, "y")(df), "prob") == [0.0, 0.0]
    assert values(models.scorer(df.withColumn("s", F.lit(0.5)), "s")(df), "sent_pred") == [0.5, 0.5]


def test_stream_emits_finished_runs_once(spark, tmp_path):
    from reviewloom.streaming.status import finished_runs

    src = tmp_path / "in"
    src.mkdir()
    for k, rows in enumerate(([("r", 1, 2)], [("r", 2, 2)], [("r", 2, 2)])):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "shard", "n_shards"), r))) for r in rows) + "\n")
    s = spark.readStream.schema("run_id string, shard long, n_shards long").option("maxFilesPerTrigger", 1).json(str(src))
    q = finished_runs(s).writeStream.format("memory").queryName("finished").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.run_id, r.n_shards) for r in spark.table("finished").collect()] == [("r", 2)]


def test_confusion_pairs_are_products_within_rows(spark):
    f = fact(spark, [(1, "a", 1, 0, 0.0), (1, "b", 0, 1, 0.0), (1, "c", 0, 1, 0.0), (2, "a", 1, 1, 0.0)])
    assert sorted((r.missed, r.extra, r.n) for r in errors.confusion_pairs(f, "approach").collect()) == [("a", "b", 1), ("a", "c", 1)]


def test_schema_files_and_templates(spark, tmp_path):
    schema = {"schema": {"g": {"a": ["1", "2"], "b": ["3"], "none": []}, "h": {"c": ["4"], "d": ["5"]}}, "nuance_sampling_policy": {"g": {"required": ["b", "z"], "sample_size": 1}}, "polarity_mode": "binary"}
    path = tmp_path / "schema.json"
    path.write_text(json.dumps(schema, indent=2))
    got = generation.load_schema(spark, str(path))
    assert sorted((r.group, r.sample_size, r.attribute, r.required, r["values"]) for r in got.collect()) == [("g", 1, "a", False, ["1", "2"]), ("g", 1, "b", True, ["3"]), ("h", 2, "c", False, ["4"]), ("h", 2, "d", False, ["5"])]
    drawn = generation.attributes_by_group(spark.range(50), "id", got)
    assert {(r.group, r.attribute, r.value) for r in drawn.collect()} == {("g", "b", "3"), ("h", "c", "4"), ("h", "d", "5")} and drawn.count() == 150
    path.write_text(json.dumps({"schema": schema["schema"]}))
    assert {r.sample_size for r in generation.load_schema(spark, str(path)).collect()} == {3, 2}
    path.write_text("{}")
    with pytest.raises(ValueError, match="no schema"):
        generation.load_schema(spark, str(path))
    with pytest.raises(ValueError, match="bytes"):
        generation.load_document(spark, str(path), most=1)
    df = spark.createDataFrame([([("x", "1"), ("y", "2")], None)], "l array<struct<key:string,value:string>>, n string")
    text = df.select(generation.filled("{{a}} {l}|{n}{{", l=generation.listing(F.col("l")), n=F.col("n")).alias("t")).first().t
    assert text == "{a} - x: 1\n- y: 2|{"
    with pytest.raises(ValueError, match="no block"):
        generation.filled("{other}", l=F.col("l"))
