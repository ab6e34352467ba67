"""Queries of generated texts: cleaning, typing noise, constrained draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.dims import ASPECTS, dim_aspect
from reviewloom.functions.cleaning import CLOSERS, CUT_STARTS, LOOSE_ENDS, PREAMBLES, REMARKS, clean_generated
from reviewloom.functions.noise import edited
from reviewloom.operators import constraints as C
from reviewloom.operators import generation as G
from reviewloom.plans.binding import REVIEWS_SQL, reviews
from reviewloom.plans.core import query
from reviewloom.plans.generation import _SIZES, _U
from reviewloom.staging import table

#: What a generator puts around the documents' texts: before and after, by doc_id % 6.
_WRAPS = [('Sure, here is one:\n"', '"'), ("", " Let me know if it fits."), ("Casual version: ", " (Note: kept short)"), ("t ", " and the"), ("Here it is\n", "\nStyle: plain"), ("", " (wrote it twice)")]
_RAW = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN '{a}' || text || '{b}'" for k, (a, b) in enumerate(_WRAPS)) + " END"
_S = r"regexp_replace({}, '\A\s+|\s+\z', '', 'g')".format


def _cleaning_sql() -> str:
    steps = [f"SELECT doc_id, {_S(_RAW)} AS s FROM documents"]
    put = lambda expression: steps.append(f"SELECT doc_id, {expression} AS s FROM c{len(steps) - 1}")
    put(r"""regexp_replace(s, '\A[^"'']*["'']\s*([^"''\s][^"'']{2,}[^"''\s])\s*["''].*\z', '\1', 's')""")
    put(_S(rf"array_to_string(list_filter(string_split(s, chr(10)), lambda l: NOT regexp_matches(l, '(?i)\A\s*(?:{'|'.join(PREAMBLES)})')), ' ')"))
    put(_S(r"regexp_replace(s, '\A[^:]{0,39}:', '')"))
    put(_S(r"regexp_replace(s, '(?is)\(Note:.*\)\z', '')"))
    put(_S(rf"regexp_replace(s, '(?is)\((?:{'|'.join(REMARKS)}).*\)\z', '')"))
    for closer in CLOSERS:
        put(_S(rf"regexp_replace(s, '(?is){closer}.*\z', '')"))
    steps.append(rf"SELECT doc_id, list_filter(string_split_regex(s, '\s+'), lambda x: x <> '') AS w FROM c{len(steps) - 1}")
    ends = ", ".join(f"'{x}'" for x in LOOSE_ENDS)
    put(f"array_to_string(w[1:coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: NOT (lower(w[i]) IN ({ends}) OR length(w[i]) < 2))), 0)], ' ')")
    for start, whole in CUT_STARTS:
        put(_S(rf"regexp_replace(s, '\A''?{start}\s', '{whole.replace(chr(39), chr(39) * 2)} ')"))
    put(r"regexp_replace(s, '\Ad ', 'Didn''t ')")
    put(r"""regexp_replace(s, '\A["'' ,.\-]+|["'' ,.\-]+\z', '', 'g')""")
    put(_S(r"regexp_replace(array_to_string(list_filter(string_split_regex(s, '\s+'), lambda x: x <> ''), ' '), '\b(?:Dr|Prof)\.?\z', '')"))
    named = ", ".join(f"c{k} AS ({step})" for k, step in enumerate(steps))
    return f"WITH {named} SELECT doc_id, length(s) AS n_chars, md5(s) AS clean_md5 FROM c{len(steps) - 1}"


@query("q_clean_generated", _cleaning_sql())
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a generator might have wrapped it, cleaned."""
    around = [F.when(F.col("doc_id") % 6 == k, F.concat(F.lit(a), F.col("text"), F.lit(b))) for k, (a, b) in enumerate(_WRAPS)]
    s = table(spark, sf_dir, "documents").select("doc_id", clean_generated(F.coalesce(*around)).alias("s"))
    return s.select("doc_id", F.char_length("s").cast("long").alias("n_chars"), F.md5(F.col("s").cast("binary")).alias("clean_md5"))


_P = 2_147_483_647


@query("q_typing_noise", rf"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS chars, CAST('0x' || left(md5('noise:' || doc_id), 8) AS BIGINT) % {_P} AS start FROM documents WHERE text <> ''),
c AS (SELECT doc_id, start, unnest(chars) AS c, generate_subscripts(chars, 1) - 1 AS i FROM d),
n AS (SELECT doc_id, c, i, (((start + i * 7919) % {_P}) * ((start + i * 7919) % {_P}) + i) % {_P} AS x, regexp_matches(c, '^\pL$') AS letter FROM c),
f AS (SELECT doc_id, c, i, x % 10000 < 200 AND letter AS edit, x // 10000 % 3 AS kind, lead(c) OVER w AS after, coalesce(lead(letter) OVER w, false) AS letter_after FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, i % 2 = 0 AND edit AND kind = 2 AND letter_after AS swaps FROM f),
o AS (SELECT doc_id, i, CASE WHEN swaps THEN after || c WHEN i % 2 = 1 AND lag(swaps) OVER (PARTITION BY doc_id ORDER BY i) THEN '' WHEN edit AND kind = 0 THEN '' WHEN edit AND kind = 1 THEN c || c ELSE c END AS c FROM s)
SELECT doc_id, CAST(sum(length(c)) AS BIGINT) AS n_chars, md5(string_agg(c, '' ORDER BY i)) AS noisy_md5 FROM o GROUP BY doc_id""")
def typing_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", edited(F.col("text"), F.col("doc_id")).alias("s"))
    return s.select("doc_id", F.char_length("s").cast("long").alias("n_chars"), F.md5(F.col("s").cast("binary")).alias("noisy_md5"))


# Grades, states of a course, and the aspects that a grade bears on.
GRADES = {"A (Excellent)": 34, "B (Good)": 33, "C (Average)": 23, "D (Barely passed)": 5, "F (Failed)": 5}
STATES = {"Currently taking": 1, "Completed recently": 1, "Took it a while ago": 1}
GRADED = ["overall_experience", "difficulty", "exam_fairness"]
_POLARITIES = {"negative": 1, "neutral": 1, "positive": 1}


def _fits(kind: str, grade: str, polarity: str) -> bool:
    """Who barely passed or failed isn't positive of what the grade bears on; who excelled isn't negative overall."""
    if grade[0] in "DF" and kind != "other":
        return polarity != "positive"
    return not (grade[0] == "A" and kind == "overall" and polarity == "negative")


#: No one fails a course that is still going on.
WRITERS = C.fit([GRADES, STATES], lambda grade, state: (grade[0], state) != ("F", "Currently taking"))
TONES = {(kind, *cell): p for kind in ("graded", "other", "overall") for cell, p in C.fit([GRADES, _POLARITIES], lambda grade, polarity, kind=kind: _fits(kind, grade, polarity)).items()}


def _intervals(cells: dict[C.Cell, float], given: int) -> str:
    rows = [(*g, *v, held[k - 1][1] if k else 0.0, u) for g, held in C.steps(cells, given).items() for k, (v, u) in enumerate(held)]
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" for x in row) + ")" for row in rows)


@query("q_constrained_draws", f"""WITH {REVIEWS_SQL}, dim(idx, aspect) AS (VALUES {", ".join(f"({i}, '{a}')" for i, (a, _, _) in enumerate(ASPECTS))}),
writers(grade, state, low, high) AS (VALUES {_intervals(WRITERS, 0)}), tones(kind, grade, polarity, low, high) AS (VALUES {_intervals(TONES, 2)}),
n AS (SELECT review_id, CASE WHEN {_U("42n", "review_id")} < 0.5 THEN 1 WHEN {_U("42n", "review_id")} < 0.8 THEN 2 ELSE 3 END AS n, {_U("42w", "review_id")} AS u FROM reviews),
p AS (SELECT review_id, idx, aspect, n, u, row_number() OVER (PARTITION BY review_id ORDER BY md5('42:' || review_id || ':' || idx), idx) AS place FROM n, dim),
k AS (SELECT *, CASE aspect WHEN 'overall_experience' THEN 'overall' WHEN 'difficulty' THEN 'graded' WHEN 'exam_fairness' THEN 'graded' ELSE 'other' END AS kind, {_U("42t", "review_id || ':' || idx")} AS v FROM p WHERE place <= n)
SELECT review_id, idx, aspect, w.grade AS grade, state, t.polarity AS polarity FROM k JOIN writers w ON u >= w.low AND u < w.high JOIN tones t ON t.kind = k.kind AND t.grade = w.grade AND v >= t.low AND v < t.high""")
def constrained_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three aspects a review, with grade, state and polarities that fit each other."""
    rows = G.targets(reviews(spark, sf_dir).select("review_id"), "review_id", dim_aspect(spark), _SIZES, list(_POLARITIES)).drop("polarity")
    rows = C.drawn(rows, F.col("review_id"), WRITERS, ["grade", "state"], seed="42w")
    kind = F.when(F.col("aspect") == GRADED[0], "overall").when(F.col("aspect").isin(GRADED[1:]), "graded").otherwise("other")
    rows = C.drawn(rows.withColumn("kind", kind), F.concat_ws(":", "review_id", "idx"), TONES, ["polarity"], ["kind", "grade"], seed="42t")
    return rows.drop("kind")
