"""How the review operators meet the tables at hand.

There is no review corpus among the tables, so reviews are ``documents`` and
labels follow from integer arithmetic on ids, alike in Spark and in SQL.  SQL
holds the same definitions as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.dims import ASPECTS, dim_aspect
from reviewloom.staging import table

#: Approaches and the modulus that flips their predictions.
APPROACHES = [("bow", 17), ("joint", 13), ("llm", 7)]
RATERS = [("A", 3), ("B", 4), ("C", 7)]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("review_id"), "text", F.col("lang").alias("style"), F.col("source").alias("course_name"), F.char(65 + F.col("doc_id") % 5).alias("grade"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (review, aspect): gold flag and polarities; the 20 aspects are broadcast."""
    ids = reviews(spark, sf_dir).select("review_id", "style", "grade", "course_name")
    x = ids.crossJoin(F.broadcast(dim_aspect(spark)))  # 20 rows to a review, by definition of the dense table
    names = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    pick = lambda k: F.element_at(names, (k % 3 + 1).cast("int"))
    r, i = F.col("review_id"), F.col("idx")
    return x.select("*", ((r * 7 + i * 3) % 20 < 1 + r % 3).cast("int").alias("y_true"), pick(r + i).alias("pol_true"), pick(r + 2 * i).alias("pol_pred"))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long fact table: one row per approach, review and aspect."""
    ways = spark.createDataFrame(APPROACHES, "approach string, flip int")
    r, i = F.col("review_id"), F.col("idx")
    f = cells(spark, sf_dir).crossJoin(F.broadcast(ways))  # three rows
    pred = F.when((r * 11 + i * 13) % F.col("flip") == 0, 1 - F.col("y_true")).otherwise(F.col("y_true"))
    prob = (35000 * F.col("y_true") + 65 * ((r * 31 + i * 17) % 1000)) / 100000.0
    score = lambda p: F.when(F.col(p) == "negative", -1).when(F.col(p) == "neutral", 0).otherwise(1)
    return f.select("approach", "review_id", "style", "grade", "course_name", "idx", "aspect", "identity", "pedagogical", "confusion", "y_true", pred.alias("y_pred"), prob.alias("prob"), "pol_true", "pol_pred", score("pol_true").alias("sent_true"), (score("pol_pred") / 2.0).alias("sent_pred"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rater, item_id, aspect, answer, polarity): three raters' answers on all aspects."""
    raters = spark.createDataFrame(RATERS, "rater string, k int")
    r, i = F.col("review_id"), F.col("idx")
    v = cells(spark, sf_dir).crossJoin(F.broadcast(raters))
    way = (r * F.col("k") + i + F.floor(r / 7)) % 5
    answer = F.when(way < 3, "yes").when(way == 3, "no").otherwise("unclear")
    names = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    polarity = F.element_at(names, ((r * F.col("k") + F.floor(r / 3)) % 3 + 1).cast("int"))
    return v.select("rater", F.col("review_id").alias("item_id"), "idx", "aspect", "y_true", "pol_true", answer.alias("answer"), F.when(answer == "yes", polarity).alias("polarity"), ((r * F.col("k")) % 11 * 10).alias("conf"))


_DIM = ", ".join(f"({i}, '{a}', '{a}', '{p}', '{c}')" for i, (a, p, c) in enumerate(ASPECTS))
_WAYS = ", ".join(f"('{a}', {m})" for a, m in APPROACHES)
_RATERS = ", ".join(f"('{a}', {k})" for a, k in RATERS)

REVIEWS_SQL = """reviews AS (SELECT doc_id AS review_id, text, lang AS style, source AS course_name, chr(CAST(65 + doc_id % 5 AS INT)) AS grade FROM documents)"""
CELLS_SQL = f"""{REVIEWS_SQL},
dim(idx, aspect, identity, pedagogical, confusion) AS (VALUES {_DIM}),
cells AS (SELECT review_id, style, grade, course_name, dim.*, CAST((review_id * 7 + idx * 3) % 20 < 1 + review_id % 3 AS INT) AS y_true,
    ['negative', 'neutral', 'positive'][(review_id + idx) % 3 + 1] AS pol_true, ['negative', 'neutral', 'positive'][(review_id + 2 * idx) % 3 + 1] AS pol_pred FROM reviews, dim)"""
FACT_SQL = f"""{CELLS_SQL},
ways(approach, flip) AS (VALUES {_WAYS}),
fact AS (SELECT approach, review_id, style, grade, course_name, idx, aspect, identity, pedagogical, confusion, y_true,
    CASE WHEN (review_id * 11 + idx * 13) % flip = 0 THEN 1 - y_true ELSE y_true END AS y_pred,
    (35000 * y_true + 65 * ((review_id * 31 + idx * 17) % 1000)) / 100000::DOUBLE AS prob, pol_true, pol_pred,
    CASE pol_true WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END AS sent_true,
    CASE pol_pred WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE 1 END / 2::DOUBLE AS sent_pred FROM cells, ways)"""
VOTES_SQL = f"""{CELLS_SQL},
raters(rater, k) AS (VALUES {_RATERS}),
votes AS (SELECT rater, review_id AS item_id, idx, aspect, y_true, pol_true, answer, CASE WHEN answer = 'yes' THEN ['negative', 'neutral', 'positive'][(review_id * k + review_id // 3) % 3 + 1] END AS polarity, (review_id * k) % 11 * 10 AS conf
    FROM (SELECT *, CASE WHEN (review_id * k + idx + review_id // 7) % 5 < 3 THEN 'yes' WHEN (review_id * k + idx + review_id // 7) % 5 = 3 THEN 'no' ELSE 'unclear' END AS answer FROM cells, raters))"""
COUNTS_SQL = "count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn"
