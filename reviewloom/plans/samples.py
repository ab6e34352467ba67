"""Queries of samples, splits, retrieval and positional joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.text import length_band, word_count
from reviewloom.operators import retrieval as R
from reviewloom.operators import samples as S
from reviewloom.plans.binding import CELLS_SQL, REVIEWS_SQL, cells, reviews
from reviewloom.plans.core import query
from reviewloom.staging import table

_ORDER = "md5('42:' || review_id)"


@query("q_hash_split", f"""WITH {REVIEWS_SQL}, r AS (SELECT review_id, style, row_number() OVER (ORDER BY {_ORDER}, review_id) AS place, count(*) OVER () AS n FROM reviews)
SELECT review_id, style, CASE WHEN place <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'test' WHEN place <= 2 * greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'calibration' ELSE 'train' END AS part FROM r""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split(reviews(spark, sf_dir).select("review_id", "style"), "review_id")


_BAND = "CASE WHEN w < 30 THEN 'short' WHEN w < 80 THEN 'mid' WHEN w < 180 THEN 'long' ELSE 'very_long' END"
_WORDS = "len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> ''))"
_BANDED = f"banded AS (SELECT review_id, style, {_BAND} AS band FROM (SELECT *, {_WORDS} AS w FROM reviews))"


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    return r.select("review_id", "style", length_band(word_count(F.col("text")), "packet").alias("band"))


@query("q_stratified_sample", f"""WITH {REVIEWS_SQL}, {_BANDED}, p AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {_ORDER}, review_id) AS place FROM banded)
SELECT review_id, style, band FROM p ORDER BY place > 100 // (SELECT count(DISTINCT band) FROM banded), {_ORDER}, review_id LIMIT 100""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified(_banded(spark, sf_dir), "review_id", "band", 100)


@query("q_round_robin_sample", f"""WITH {REVIEWS_SQL}, {_BANDED}, p AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {_ORDER}, review_id) AS place FROM banded)
SELECT review_id, style, band, place FROM p ORDER BY place, band LIMIT 50""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.round_robin(_banded(spark, sf_dir), "review_id", "band", 50)


@query("q_per_course_sample", f"""WITH {REVIEWS_SQL}, p AS (SELECT course_name, review_id, row_number() OVER (PARTITION BY course_name ORDER BY {_ORDER}, review_id) AS place FROM reviews)
SELECT * FROM p WHERE place <= 8""")
def per_course_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.per_stratum(reviews(spark, sf_dir).select("course_name", "review_id"), "review_id", "course_name", 8).select("course_name", "review_id", "place")


@query("q_coverage_sample", f"""WITH {CELLS_SQL}, g AS (SELECT review_id, aspect, count(*) OVER (PARTITION BY aspect) AS n FROM cells WHERE y_true = 1),
f AS (SELECT review_id, arg_min(aspect, (n, aspect)) AS aspect FROM g GROUP BY review_id), p AS (SELECT *, row_number() OVER (PARTITION BY aspect ORDER BY {_ORDER}, review_id) AS place FROM f) SELECT * FROM p WHERE place <= 5""")
def coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rarest_first(cells(spark, sf_dir).where("y_true = 1").select("review_id", "aspect"), "review_id", "aspect", 5)


@query("q_fewshot_diverse", f"""WITH {CELLS_SQL}, n AS (SELECT review_id, sum(y_true)::BIGINT AS n_aspects FROM cells GROUP BY 1), o AS (SELECT review_id, n_aspects, row_number() OVER (PARTITION BY md5(text) ORDER BY review_id) AS copy FROM reviews JOIN n USING (review_id)),
t AS (SELECT review_id, n_aspects, row_number() OVER (PARTITION BY n_aspects ORDER BY md5(review_id::VARCHAR), review_id) AS turn FROM o WHERE copy = 1) SELECT * FROM t ORDER BY turn, n_aspects LIMIT 9""")
def fewshot_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cells(spark, sf_dir).groupBy("review_id").agg(F.sum("y_true").alias("n_aspects"))
    pool = reviews(spark, sf_dir).select("review_id", "text").join(n, "review_id")
    return R.demonstrations(pool, "review_id", "n_aspects", 9).select("review_id", "n_aspects", "turn")


@query("q_token_overlap_topk", """WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents), h AS (SELECT query_id, doc_id, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY ALL)
SELECT query_id, doc_id, overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS place FROM h) WHERE place <= 5""")
def token_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.token_overlap(queries, table(spark, sf_dir, "documents").select("doc_id", "text"), 5)


_MARKS = f"""WITH {CELLS_SQL}, spans AS (SELECT DISTINCT review_id AS file, k * 200 AS span_begin, k * 200 + 150 + review_id % 60 AS span_end FROM cells, range(3) t(k)),
marks AS (SELECT review_id AS file, idx * 31 + review_id % 17 AS "begin", idx * 31 + review_id % 17 + 5 + idx AS "end", aspect FROM cells WHERE y_true = 1)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).select(F.col("review_id").alias("file"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    return r.select("file", (F.col("k") * 200).cast("long").alias("span_begin"), F.col("k") * 200 + 150 + F.col("file") % 60).toDF("file", "span_begin", "span_end")


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = F.col("idx") * 31 + F.col("review_id") % 17
    return cells(spark, sf_dir).where("y_true = 1").select(F.col("review_id").alias("file"), begin.alias("begin"), (begin + 5 + F.col("idx")).alias("end"), "aspect", "idx", "pol_true")


@query("q_span_containment", f'{_MARKS} SELECT file, span_begin, span_end, "begin", "end", aspect FROM spans JOIN marks USING (file) WHERE "begin" >= span_begin AND "end" <= span_end')
def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contained(_spans(spark, sf_dir), _marks(spark, sf_dir).drop("idx", "pol_true")).select("file", "span_begin", "span_end", "begin", "end", "aspect")


@query("q_nearest_opinion")
def nearest_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy pairing is sequential; the query has no SQL and is held against a plain version in the tests."""
    m = _marks(spark, sf_dir)
    kind = (F.col("file") + F.col("idx")) % 3
    marks = m.select("file", "begin", "end", F.when(kind < 2, F.col("aspect")).otherwise("").alias("aspect_raw"), F.when(kind > 0, F.col("pol_true")).otherwise("").alias("opinion_raw"))
    return R.nearest_opinions(R.contained(_spans(spark, sf_dir), marks), known=("negative", "neutral", "positive"))


@query("q_overlay_answers", f"WITH {REVIEWS_SQL} SELECT review_id AS item_id, CASE WHEN review_id % 4 = 0 THEN 'yes' ELSE 'no' END AS discussed, CASE WHEN review_id % 8 = 0 THEN 'seen' ELSE style END AS notes FROM reviews")
def overlay_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packet = reviews(spark, sf_dir).select(F.col("review_id").alias("item_id"), F.lit("no").alias("discussed"), F.col("style").alias("notes"))
    answers = packet.where("item_id % 4 = 0").select("item_id", F.lit("yes").alias("discussed"), F.when(F.col("item_id") % 8 == 0, "seen").alias("notes"))
    return R.overlay(packet, answers, "item_id", ["discussed", "notes"])


@query("q_weighted_draws", f"""WITH {REVIEWS_SQL}, u AS (SELECT review_id, CAST('0x' || left(md5('7:' || review_id), 8) AS BIGINT) / 4294967296::DOUBLE AS u FROM reviews) SELECT review_id, CASE WHEN u < 0.5 THEN 'one' WHEN u < 0.75 THEN 'two' ELSE 'three' END AS n_aspects FROM u""")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("review_id", S.draw([("one", 2), ("two", 1), ("three", 1)], F.col("review_id"), 7).alias("n_aspects"))
