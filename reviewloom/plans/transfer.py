"""Queries of the transfer corpus: annotation spans to mapped labels, its overlap, replies of models as labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.dims import ASPECT_CODES, ASPECTS, OPINION_CODES
from reviewloom.functions.text import inferred_title
from reviewloom.operators import prompting as P
from reviewloom.operators import samples as S
from reviewloom.operators import summaries as U
from reviewloom.operators import transfer as X
from reviewloom.plans.binding import CELLS_SQL, cells, reviews
from reviewloom.plans.core import query
from reviewloom.staging import table

#: Known codes and one without an aspect; known opinions and none.
_CODES = [*ASPECT_CODES, "Course_Structure#X_9"]
_OPINIONS = [*OPINION_CODES, ""]


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as files with one span, and two marks for each of their labels, in the XML reader's columns."""
    c, r, i = cells(spark, sf_dir).where("y_true = 1"), F.col("review_id"), F.col("idx")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    file = r.cast("string").alias("file")
    begin = i * 31 + r % 17
    marks = c.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(file, F.lit("mark").alias("kind"), begin.cast("int").alias("begin"), (begin + 5 + i).cast("int").alias("end"), pick(_CODES, r * 5 + i * 3 + F.col("k") * 2).alias("aspect_raw"), pick(_OPINIONS, r + i + F.col("k") * r).alias("opinion_raw"))
    text = reviews(spark, sf_dir).select("review_id", F.coalesce("text", F.lit("")).alias("text"))
    nothing = F.lit("")
    spans = text.select(file, F.lit("span").alias("kind"), F.lit(0).alias("begin"), F.length("text").alias("end"), nothing.alias("aspect_raw"), nothing.alias("opinion_raw"))
    whole = text.select(file, F.lit("text").alias("kind"), F.lit(0).alias("begin"), F.lit(0).alias("end"), F.col("text").alias("aspect_raw"), nothing.alias("opinion_raw"))
    return marks.unionByName(spans).unionByName(whole)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_LABELS = f"""WITH {CELLS_SQL}, codes(aspect_raw, named) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in ASPECT_CODES.items())}), opinions(opinion_raw, polarity) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in OPINION_CODES.items())}),
marks AS (SELECT review_id, {_list(_CODES)}[(review_id * 5 + idx * 3 + k * 2) % {len(_CODES)} + 1] AS aspect_raw, {_list(_OPINIONS)}[(review_id + idx + k * review_id) % {len(_OPINIONS)} + 1] AS opinion_raw FROM cells JOIN reviews USING (review_id), range(2) t(k) WHERE y_true = 1 AND idx * 31 + review_id % 17 + 5 + idx <= length(reviews.text)),
n AS (SELECT review_id, named AS aspect, polarity, count(*) AS n FROM marks JOIN codes USING (aspect_raw) JOIN opinions USING (opinion_raw) GROUP BY ALL),
labelled AS (SELECT review_id::VARCHAR AS file, '0-' || length(any_value(text)) AS span, md5(trim(regexp_replace(any_value(text), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS text_md5, aspect, CASE WHEN count(*) FILTER (n = top) > 1 THEN 'neutral' ELSE max(polarity) FILTER (n = top) END AS polarity
    FROM (SELECT *, max(n) OVER (PARTITION BY review_id, aspect) AS top FROM n) JOIN reviews USING (review_id) WHERE regexp_matches(text, '[^ \\t\\n\\x0b\\f\\r]') GROUP BY review_id, aspect)"""


@query("q_transfer_mapped", f"{_LABELS} SELECT * FROM labelled")
def transfer_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.labelled(_annotations(spark, sf_dir)).select("file", "span", F.md5("text").alias("text_md5"), "aspect", "polarity")


@query("q_transfer_overlap", f"""{_LABELS}, o AS (SELECT aspect, count(*) AS review_count, count(*) FILTER (polarity = 'positive') AS positive, count(*) FILTER (polarity = 'neutral') AS neutral, count(*) FILTER (polarity = 'negative') AS negative FROM labelled GROUP BY 1)
SELECT row_number() OVER (ORDER BY review_count DESC, aspect) AS place, * FROM o""")
def transfer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.overlap(X.labelled(_annotations(spark, sf_dir)))


@query("q_strict_overlap", f"""{_LABELS}, s AS (SELECT * FROM labelled WHERE aspect IN (SELECT aspect FROM labelled GROUP BY 1 HAVING count(*) >= 40))
SELECT file, span, aspect, polarity FROM s WHERE file IN (SELECT file FROM s GROUP BY 1 HAVING count(*) >= 2)""")
def strict_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.strict_overlap(X.labelled(_annotations(spark, sf_dir)).select("file", "span", "aspect", "polarity"), 40, 2, "file", "span")


@query("q_labels_by_total", f"""WITH {CELLS_SQL}, t AS (SELECT aspect, count(*) FILTER (pol_true = 'negative') AS negative, count(*) FILTER (pol_true = 'neutral') AS neutral, count(*) FILTER (pol_true = 'positive') AS positive, count(*) AS total FROM cells WHERE y_true = 1 GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY total DESC, aspect) AS place FROM t""")
def labels_by_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["negative", "neutral", "positive"]
    return U.by_total(U.crosstab(cells(spark, sf_dir).where("y_true = 1"), "aspect", "pol_true", names), "aspect", names)


@query("q_inferred_titles", """SELECT page_id, url AS title FROM pages""")
def inferred_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose title is the page's url, with authors and year before it and a place after it."""
    entry = F.concat(F.lit("A. Writer and B. Reader. 2021.  "), "url", F.lit(" . In Proceedings . "))
    return table(spark, sf_dir, "pages").select("page_id", inferred_title(entry).alias("title"))


@query("q_reply_labels", f"""WITH {CELLS_SQL} SELECT 'r' || review_id AS custom_id, aspect, pol_true AS sentiment FROM cells WHERE y_true = 1 AND idx < 18""")
def reply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-pass replies, as an object or as records by the id, read back; two of the 20 aspects weren't asked for."""
    per = cells(spark, sf_dir).where("y_true = 1").groupBy("review_id").agg(F.collect_list(F.struct("aspect", F.upper("pol_true").alias("sentiment"))).alias("l"))
    as_map = F.to_json(F.struct(F.map_from_entries("l").alias("aspects")))
    reply = F.concat(F.lit("Sure:\n"), F.when(F.col("review_id") % 2 == 0, as_map).otherwise(F.to_json(F.struct(F.col("l").alias("aspects")))))
    key = F.concat(F.lit("r"), "review_id").alias("custom_id")
    asked = F.array(*[F.lit(a) for a, _, _ in ASPECTS[:18]]).alias("detected")
    return P.labels_of(per.select(key, asked), per.select(key, reply.alias("text")))


@query("q_coverage_greedy")
def coverage_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's turn depends on those before: no SQL; held against a plain walk in the tests."""
    return S.coverage(cells(spark, sf_dir).where("y_true = 1").select("review_id", "aspect"), "review_id", "aspect", 100)
