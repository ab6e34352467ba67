"""Queries of judge statistics, cycle reports and ranked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import cue_tags, length_band, word_count
from reviewloom.operators import metrics as M
from reviewloom.operators import summaries as U
from reviewloom.plans.binding import COUNTS_SQL, FACT_SQL, REVIEWS_SQL, fact, reviews
from reviewloom.plans.core import query
from reviewloom.plans.samples import _WORDS
from reviewloom.staging import table

_JUDGED = """j AS (SELECT doc_id AS pair_id, source AS course, CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS a_truth, CASE WHEN doc_id % 2 = 0 THEN 'synthetic' ELSE 'real' END AS b_truth,
    CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'synthetic' END AS a_label, CASE WHEN doc_id % 5 < 2 THEN 'synthetic' ELSE 'real' END AS b_label, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE doc_id * 7 % 101 END AS a_conf, doc_id * 3 % 121 AS b_conf FROM documents),
sides AS (SELECT pair_id, course, a_truth AS truth, a_label AS label, a_conf AS conf FROM j UNION ALL SELECT pair_id, course, b_truth, b_label, b_conf FROM j),
judged AS (SELECT *, (label = truth)::INT AS correct, least(greatest(coalesce(conf, 50), 0), 100)::DOUBLE AS stated FROM sides)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    i = F.col("doc_id")
    side = lambda c: F.when(c, "real").otherwise("synthetic")
    conf_a = F.when(i % 29 == 0, "high").otherwise((i * 7 % 101).cast("string"))
    return d.select(i.alias("pair_id"), side(i % 2 == 0).alias("a_truth"), side(i % 2 != 0).alias("b_truth"), side(i % 3 == 0).alias("a_label"), side(i % 5 >= 2).alias("b_label"), conf_a.alias("a_conf"), (i * 3 % 121).cast("string").alias("b_conf"), F.col("source").alias("a_course"), F.col("source").alias("b_course"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.judged(U.stack_sides(_pairs(spark, sf_dir), "pair_id", ["course", "truth", "label", "conf"]))


_H = lambda p: f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN 0 ELSE -({p} * log2({p}) + (1 - {p}) * log2(1 - {p})) END"


@query("q_judge_stacked", f"""WITH {_JUDGED} SELECT truth, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(stated), 9) AS mean_confidence, round(avg(CASE WHEN correct = 1 THEN 1 - stated / 100 ELSE 1 END), 9) AS mean_confusion,
round(avg({_H('greatest(stated / 100, 0.5::DOUBLE)')}), 9) AS mean_entropy FROM judged GROUP BY truth""")
def judge_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _judged(spark, sf_dir).groupBy("truth").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("stated").alias("mean_confidence"), F.avg("confusion").alias("mean_confusion"), F.avg("entropy").alias("mean_entropy"))
    return M.rounded(sums)


@query("q_judge_entropy", f"""WITH {_JUDGED}, s AS (SELECT course, count(*) AS n, count(*) FILTER (label = 'synthetic') / count(*)::DOUBLE AS p FROM judged GROUP BY course) SELECT course, n, round(p, 9) AS synthetic_rate, round({_H('p')}, 9) AS entropy_bits FROM s""")
def judge_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(U.label_entropy(_judged(spark, sf_dir), "course"))


@query("q_synthetic_rate_by_band", f"""WITH {REVIEWS_SQL}, b AS (SELECT CASE WHEN w < 80 THEN 'short' WHEN w < 150 THEN 'medium' ELSE 'long' END AS band, toxic FROM (SELECT review_id, {_WORDS} AS w FROM reviews) JOIN labels ON doc_id = review_id)
SELECT coalesce(band, '__all__') AS band, count(*) AS n, round(avg(toxic), 9) AS rate FROM b GROUP BY ROLLUP (band)""")
def synthetic_rate_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).select(F.col("review_id").alias("doc_id"), length_band(word_count(F.col("text")), "generation").alias("band"))
    sums = r.join(table(spark, sf_dir, "labels"), "doc_id").rollup("band").agg(F.count("*").alias("n"), F.avg("toxic").alias("rate"))
    return M.rounded(sums.withColumn("band", F.coalesce("band", F.lit("__all__"))))


@query("q_cue_histogram", """WITH c AS (SELECT event_id, list_distinct(list_filter(list_transform(string_split_regex(lower(event_type || ' ,' || CASE WHEN value > 50 THEN 'High' ELSE 'low/LOW' END), '[,;/|]'), lambda x: trim(x)), lambda x: x <> '')) AS tags FROM events)
SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM c) GROUP BY tag""")
def cue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("event_type", F.lit(" ,"), F.when(F.col("value") > 50, "High").otherwise("low/LOW"))
    tags = table(spark, sf_dir, "events").select(F.explode(cue_tags(raw)).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


_Z2 = "3.841458820694124::DOUBLE"
_M = "(1.959963984540054::DOUBLE / (1 + 3.841458820694124::DOUBLE / n) * sqrt(p * (1 - p) / n + 3.841458820694124::DOUBLE / (4 * n * n::DOUBLE)))"
_C = "((p + 3.841458820694124::DOUBLE / (2 * n)) / (1 + 3.841458820694124::DOUBLE / n))"


@query("q_wilson_equivalence", f"""WITH {_JUDGED}, s AS (SELECT course, sum(correct)::BIGINT AS k, count(*) AS n, sum(correct) / count(*)::DOUBLE AS p FROM judged GROUP BY course), w AS (SELECT course, k, n, p, greatest(0, {_C} - {_M}) AS low, least(1, {_C} + {_M}) AS high FROM s)
SELECT course, k, n, round(p, 9) AS accuracy, round(low, 9) AS low, round(high, 9) AS high, round(100 * greatest(0, 1 - abs(p - 0.5) / 0.5), 9) AS chance_confusion, low >= 0.5 - 0.1 AND high <= 0.5 + 0.1 AS equivalent FROM w""")
def wilson_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _judged(spark, sf_dir).groupBy("course").agg(F.sum("correct").alias("k"), F.count("*").alias("n"))
    return M.rounded(U.equivalence(counts))


@query("q_binomial_exact", f"""WITH {_JUDGED}, s AS (SELECT course, sum(correct)::BIGINT AS k, count(*) AS n FROM judged GROUP BY course),
o AS (SELECT course, k, n, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5::DOUBLE) AS lp FROM (SELECT course, k, n, unnest(range(0, n + 1)) AS i FROM s)), b AS (SELECT course, max(lp) FILTER (i = k) AS observed FROM o GROUP BY course)
SELECT course, k, n, round(least(1, sum(exp(lp)) FILTER (lp <= observed + 1e-9)), 7) AS p_value FROM o JOIN b USING (course) GROUP BY ALL""")
def binomial_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _judged(spark, sf_dir).groupBy("course").agg(F.sum("correct").alias("k"), F.count("*").alias("n"))
    return M.rounded(U.binomial_exact(counts, "course"), 7)


@query("q_cycle_deltas", """WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1)
SELECT day, n, users, total, n - lag(n) OVER w AS n_delta, users - lag(users) OVER w AS users_delta, round(total - lag(total) OVER w, 4) AS total_delta FROM d WINDOW w AS (ORDER BY day)""")
def cycle_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
    return U.deltas(days, "day", ["n", "users", "total"]).withColumn("total_delta", F.round("total_delta", 4))


_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END"


@query("q_ranked_report", f"""WITH {FACT_SQL}, c AS (SELECT approach, aspect, {COUNTS_SQL} FROM fact GROUP BY ALL), s AS (SELECT approach, aspect, round({_F1}, 9) AS f1 FROM c)
SELECT approach, aspect, row_number() OVER (PARTITION BY approach ORDER BY f1 DESC, aspect) AS rank, printf('%.4f', f1) AS shown FROM s""")
def ranked_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = M.rounded(M.rates(M.confusion(fact(spark, sf_dir), "approach", "aspect"))).select("approach", "aspect", "f1")
    rank = F.row_number().over(Window.partitionBy("approach").orderBy(F.desc("f1"), "aspect"))
    return per.select("approach", "aspect", rank.alias("rank"), M.shown(F.col("f1")).alias("shown"))


@query("q_review_histogram", f"WITH {REVIEWS_SQL}, w AS (SELECT {_WORDS} AS w FROM reviews) SELECT least(w // 25, 40) AS bin, count(*) AS n FROM w GROUP BY 1")
def review_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = word_count(F.col("text"))
    return reviews(spark, sf_dir).groupBy(F.least(F.floor(w / 25), F.lit(40)).alias("bin")).agg(F.count("*").alias("n"))
