"""Cleaning, noise and constrained draws of generated reviews."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import cleaning, noise, text
from reviewloom.functions.cleaning import clean_generated
from reviewloom.operators import constraints as C

#: Generated texts and what is left of them, by the rules in the docstring.
CLEANED = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("The exams were fair.", "The exams were fair"),
    ('Sure, here it is:\n"The exams were fair and clear"', "The exams were fair and clear"),
    ("She said 'ok' and left the room", "She said 'ok' and left the room"),
    ('It was "hard" but "fair"', "hard"),
    ("Here is your review\nI liked the labs\nStyle: casual", "I liked the labs"),
    ("HERE you go\nokay then\nGood pace overall", "Good pace overall"),
    ("Casual version: I liked the labs", "I liked the labs"),
    ("This sentence is more than forty characters long: so it stays", "This sentence is more than forty characters long: so it stays"),
    ("I liked the labs and the projects a great deal (Note: I kept it short)", "I liked the labs and the projects a great deal"),
    ("I liked the labs (just a draft, really)", "I liked the labs"),
    ("I liked (note: this) the labs", "this) the labs"),
    ("Solid course overall. let me know if you need more. Feel free to ask", "Solid course overall"),
    ("I liked the labs and that the", "I liked the labs"),
    ("I liked the labs because they didn", "I liked the labs"),
    ("and the of", ""),
    ("good x y z", "good"),
    ("m tired of this course", "I'm tired of this course"),
    ("'s hard work", "It's hard work"),
    ("re boring lectures", "They're boring lectures"),
    ("t know anything", "Didn't know anything"),
    ("d know anything", "Didn't know anything"),
    ('- "Good pace", -', "Good pace"),
    ("Great   talks\tby Prof.", "Great talks by"),
    ("Ask Dr", "Ask"),
    ("Ärger über die Übung und, so", "Ärger über die Übung und"),
]


def test_cleaning(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CLEANED)], "k int, s string")
    got = {r.k: r.c for r in rows.select("k", clean_generated(F.col("s")).alias("c")).collect()}
    assert [got[k] for k in range(len(CLEANED))] == [c for _, c in CLEANED]


def test_cleaning_of_long_texts(spark):
    rows = spark.createDataFrame([("word " + "a " * 100_000,), ("x" * 50 + ": y " * 20_000,)], "s string")
    assert [r.n for r in rows.select(F.length(clean_generated(F.col("s"))).alias("n")).collect()][0] == 4


def plain_unrepeated(words):
    """By comparing whole slices."""
    for n in range(len(words) // 2, 24, -1):
        if words[:n] == words[n : 2 * n]:
            return words[:n]
    half = len(words) // 2
    if len(words) >= 80 and " ".join(words[:half])[:200] == " ".join(words[half:])[:200]:
        return words[:half]
    return words


def test_repeats_equal_whole_comparison():
    draw = random.Random(8)
    for _ in range(400):
        base = [draw.choice("abc") for _ in range(draw.randrange(1, 60))]
        words = base * draw.randrange(1, 4) + [draw.choice("abc") for _ in range(draw.choice([0, 0, 1, 5]))]
        assert text._unrepeated(" ".join(words)) == " ".join(plain_unrepeated(words))
    assert text._unrepeated(None) is None and text._unrepeated("") == ""
    long = " ".join(f"w{i % 997}" for i in range(200_000))
    assert len(text._unrepeated(long)) < len(long)  # ends at once


def test_noise_meets_its_rate_and_ignores_partitions(spark):
    rows = spark.createDataFrame([(k, "abcdefghij" * 200) for k in range(50)] + [(90, None), (91, ""), (92, "1234 \U0001f600 5"), (None, "abcd" * 99)], "k long, s string")
    out = lambda df: {r.k: r.c for r in df.select("k", noise.edited(F.col("s"), F.col("k"), 0.06).alias("c")).collect()}
    got = out(rows)
    assert got == out(rows.repartition(7)) and (got[90], got[91], got[92]) == (None, "", "1234 \U0001f600 5")
    assert got[0] != got[1] and got[None] != "abcd" * 99
    changed = [got[k] for k in range(50)]
    dropped_and_doubled = sum(abs(len(c) - 2000) for c in changed)
    assert all(c != "abcdefghij" * 200 for c in changed) and dropped_and_doubled < 50 * 120
    none = rows.select(noise.edited(F.col("s"), F.col("k"), 0.0).alias("c"), "s").where("c <> s").count()
    assert none == 0


def test_noise_edits_are_counted(spark):
    rows = spark.range(200).select("id", F.lit("ab" * 500).alias("s"))
    got = [r.c for r in rows.select(noise.edited(F.col("s"), F.col("id"), 0.05).alias("c")).collect()]
    doubled = sum(c.count("aa") + c.count("bb") for c in got)
    assert 0.02 * 200_000 < doubled < 0.06 * 200_000  # doubles, and neighbours of drops and swaps


def test_casual_and_slips(spark):
    s = "The homework for you and the people. Really good, because of people."
    rows = spark.range(300).select("id", F.lit(s).alias("s"))
    c = rows.select(noise.casual(F.col("s"), F.lit("Casual, short"), F.col("id")).alias("c"), noise.casual(F.col("s"), F.lit("Formal"), F.col("id")).alias("f"), noise.casual(F.lit(None).cast("string"), F.lit("Rant"), F.col("id")).alias("n")).collect()
    assert {r.f for r in c} == {s} and {r.n for r in c} == {None}
    assert not any(r.c.endswith(".") for r in c) and 0.6 < sum(r.c.islower() for r in c) / 300 < 0.8
    assert 0.5 < sum(r.c.split()[1] == "hw" for r in c) / 300 < 0.7 and len({len(r.c.split()) for r in c}) == 1
    slips = [r.c for r in rows.select(noise.slipped(F.col("s"), F.col("id")).alias("c")).collect()]
    assert 0.25 < sum(x != s for x in slips) / 300 < 0.5 and all(len(s) - len(x) in (0, 1) for x in slips) and all(x[0] == "T" for x in slips)
    assert s.replace(". R", ".R") in slips
    short = spark.range(50).select(noise.slipped(F.lit("Too short."), F.col("id")).alias("c")).distinct().collect()
    assert [r.c for r in short] == ["Too short."]


def rules(grade, state, polarity):
    return not (grade in "DF" and polarity == "positive") and not (grade == "A" and polarity == "negative") and not (grade == "F" and state == "past")


def test_constrained_draws_keep_rules_and_shares(spark):
    shares = [{"A": 34, "B": 33, "C": 23, "D": 5, "F": 5}, {"now": 0.5, "past": 0.5}, {"negative": 0.4, "neutral": 0.2, "positive": 0.4}]
    cells = C.fit(shares, rules)
    assert all(rules(*c) for c in cells) and abs(sum(cells.values()) - 1) < 1e-9
    for k, share in enumerate(shares):
        for v, w in share.items():
            assert abs(sum(p for c, p in cells.items() if c[k] == v) - w / sum(share.values())) < 1e-9
    rows = C.drawn(spark.range(40_000).withColumn("own", F.lit(1)), F.col("id"), cells, ["grade", "state", "polarity"])
    assert rows.columns == ["id", "own", "grade", "state", "polarity"]
    n = {tuple(r)[:3]: r[3] for r in rows.groupBy("grade", "state", "polarity").count().collect()}
    assert all(rules(*c) for c in n) and all(abs(n.get(c, 0) / 40_000 - p) < 0.01 for c, p in cells.items())
    again = C.drawn(rows.select("id", "grade").repartition(5), F.col("id"), cells, ["state", "polarity"], ["grade"], "7")
    assert again.where("state IS NULL").count() == 0
    m = {tuple(r)[:3]: r[3] for r in again.groupBy("grade", "state", "polarity").count().collect()}
    assert all(rules(*c) for c in m) and all(abs(m.get(c, 0) / 40_000 - p) < 0.01 for c, p in cells.items())
    odd = C.drawn(spark.createDataFrame([(1, "Z"), (2, None)], "id long, grade string"), F.col("id"), cells, ["state", "polarity"], ["grade"])
    assert {(r.state, r.polarity) for r in odd.collect()} == {(None, None)}


def test_impossible_shares_are_refused():
    with pytest.raises(ValueError, match="no place"):
        C.fit([{"a": 1.0, "b": 1.0}, {"x": 1.0}], lambda one, other: one == "a")
    with pytest.raises(ValueError, match="marginals"):
        C.fit([{"a": 0.5, "b": 0.5}, {"x": 0.1, "y": 0.9}], lambda one, other: (one, other) != ("a", "y"), rounds=200)


def test_noise_draws_all_places_of_a_text_at_once(spark):
    rows = spark.createDataFrame([(1, "some text")], "k long, s string").select(noise.edited(F.col("s"), F.col("k")).alias("c"))
    assert "lambda" not in rows._jdf.queryExecution().toString()  # none that is interpreted for each character


def test_white_space_is_what_the_unicode_class_matches(spark):
    marks = [chr(c) for c in (*range(1, 0x3100), 0xFEFF, 0x1F600)]
    df = spark.createDataFrame([(m, f"{m}word{m} {m}next{m}{m}") for m in marks], "m string, t string")
    old = F.array_join(F.filter(F.split("t", r"(?U)\s+"), lambda w: w != ""), "|")
    stripped = F.regexp_replace("t", r"(?U)\A\s+|\s+\z", "")
    wrong = df.where((F.array_join(cleaning._words(F.col("t")), "|") != old) | (cleaning._stripped(F.col("t")) != stripped))
    assert wrong.count() == 0
    whole = str(spark.range(1).select(clean_generated(F.lit("x")).alias("s"))._jdf.queryExecution().logical())
    assert r"\s+\z" not in whole and r"(?U)\s+" not in whole  # tried at every character, in each of 13 steps
