"""Queries of corpus summaries and label counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.dims import OVERLAP
from reviewloom.functions import scores
from reviewloom.operators import metrics as M
from reviewloom.operators import summaries as U
from reviewloom.plans.binding import CELLS_SQL, COUNTS_SQL, FACT_SQL, REVIEWS_SQL, cells, fact, reviews
from reviewloom.plans.core import query
from reviewloom.plans.samples import _WORDS
from reviewloom.staging import table


@query("q_dataset_summary", f"""WITH {CELLS_SQL}, w AS (SELECT *, {_WORDS} AS w FROM reviews)
SELECT count(*) AS n_reviews, round(avg(w), 9) AS mean_words, round(median(w), 9) AS median_words, count(DISTINCT course_name) AS n_courses, count(DISTINCT style) AS n_styles,
(SELECT sum(y_true)::BIGINT FROM cells) AS n_labels, (SELECT string_agg(aspect, ',' ORDER BY aspect) FROM (SELECT DISTINCT aspect FROM cells WHERE y_true = 1)) AS inventory,
(SELECT count(*) - count(DISTINCT text) FROM reviews) AS n_duplicates, round((SELECT sum(y_true) FROM cells) / count(*)::DOUBLE, 9) AS mean_labels FROM w""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(U.corpus(reviews(spark, sf_dir), cells(spark, sf_dir)))


@query("q_dataset_diagnostics", """WITH f AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1) SELECT doc_id, first FROM documents JOIN f USING (text) WHERE doc_id <> first""")
def dataset_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.duplicates(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("q_value_counts", f"WITH {REVIEWS_SQL} SELECT 'style' AS field, style AS value, count(*) AS n FROM reviews GROUP BY 2 UNION ALL SELECT 'grade', grade, count(*) FROM reviews GROUP BY 2 UNION ALL SELECT 'course_name', course_name, count(*) FROM reviews GROUP BY 2")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.value_counts(reviews(spark, sf_dir), "style", "grade", "course_name")


@query("q_crosstab", f"WITH {REVIEWS_SQL} SELECT grade, " + ", ".join(f"count(*) FILTER (style = '{s}') AS {s}" for s in ("de", "en", "es", "fr")) + " FROM reviews GROUP BY grade")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.crosstab(reviews(spark, sf_dir), "grade", "style", ["de", "en", "es", "fr"])


@query("q_aspect_sentiment_counts", f"WITH {CELLS_SQL} SELECT aspect, p AS polarity, count(*) FILTER (y_true = 1 AND pol_true = p) AS n FROM cells, (VALUES ('negative'), ('neutral'), ('positive')) t(p) GROUP BY ALL")
def aspect_sentiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = cells(spark, sf_dir).groupBy("aspect").agg(*[F.count(F.when((F.col("y_true") == 1) & (F.col("pol_true") == p), 1)).alias(p) for p in ("negative", "neutral", "positive")])
    return sums.unpivot("aspect", ["negative", "neutral", "positive"], "polarity", "n")


@query("q_aspect_count_histogram", f"WITH {CELLS_SQL} SELECT k AS n_aspects, count(*) AS n FROM (SELECT sum(y_true)::BIGINT AS k FROM cells GROUP BY review_id) WHERE k BETWEEN 1 AND 3 GROUP BY k")
def aspect_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = cells(spark, sf_dir).groupBy("review_id").agg(F.sum("y_true").alias("n_aspects"))
    return per.where("n_aspects BETWEEN 1 AND 3").groupBy("n_aspects").agg(F.count("*").alias("n"))


@query("q_cooccurrence", f"WITH {CELLS_SQL}, g AS (SELECT review_id, aspect FROM cells WHERE y_true = 1) SELECT a.aspect AS a, b.aspect AS b, count(*) AS n FROM g a JOIN g b USING (review_id) GROUP BY ALL")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.cooccurrence(cells(spark, sf_dir))


_OVER = ", ".join(f"'{a}'" for a in OVERLAP)


@query("q_overlap_summary", f"""WITH {CELLS_SQL}, o AS (SELECT aspect, pol_true FROM cells WHERE y_true = 1 AND aspect IN ({_OVER}))
SELECT coalesce(aspect, '__total__') AS aspect, count(*) FILTER (pol_true = 'negative') AS negative, count(*) FILTER (pol_true = 'neutral') AS neutral, count(*) FILTER (pol_true = 'positive') AS positive, count(*) AS total FROM o GROUP BY ROLLUP (aspect)""")
def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = cells(spark, sf_dir).where((F.col("y_true") == 1) & F.col("aspect").isin(OVERLAP))
    sums = o.rollup("aspect").agg(*[F.count(F.when(F.col("pol_true") == p, 1)).alias(p) for p in ("negative", "neutral", "positive")], F.count("*").alias("total"))
    return sums.withColumn("aspect", F.coalesce("aspect", F.lit("__total__")))


_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END"


@query("q_generalization_gap", f"""WITH {FACT_SQL}, c AS (SELECT approach, style = 'en' AS synthetic, {COUNTS_SQL} FROM fact WHERE aspect IN ({_OVER}) GROUP BY ALL), s AS (SELECT approach, max({_F1}) FILTER (synthetic) AS synthetic_f1, max({_F1}) FILTER (NOT synthetic) AS real_f1 FROM c GROUP BY approach)
SELECT approach, round(synthetic_f1, 9) AS synthetic_f1, round(real_f1, 9) AS real_f1, round(real_f1 - synthetic_f1, 9) AS gap FROM s""")
def generalization_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fact(spark, sf_dir).where(F.col("aspect").isin(OVERLAP)).withColumn("synthetic", F.col("style") == "en")
    per = M.confusion(f, "approach", "synthetic").select("approach", "synthetic", scores.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
    wide = per.groupBy("approach").agg(F.max(F.when(F.col("synthetic"), F.col("f1"))).alias("synthetic_f1"), F.max(F.when(~F.col("synthetic"), F.col("f1"))).alias("real_f1"))
    return M.rounded(wide.withColumn("gap", F.col("real_f1") - F.col("synthetic_f1")))


@query("q_polarity_modes", """WITH x AS (SELECT doc_id AS review_id, (doc_id % 41 - 20) / 20::DOUBLE AS score FROM documents)
SELECT review_id, CASE WHEN score <= -0.5 THEN 'negative' WHEN score <= 0.5 THEN 'neutral' ELSE 'positive' END AS nearest, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS banded,
CASE WHEN score = 1 THEN 'positive' WHEN score = -1 THEN 'negative' ELSE 'neutral' END AS exact, round(ln(greatest(least((score + 1) / 2, 0.999999::DOUBLE), 1e-6::DOUBLE) / (1 - greatest(least((score + 1) / 2, 0.999999::DOUBLE), 1e-6::DOUBLE))), 6) AS logit FROM x""")
def polarity_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), ((F.col("doc_id") % 41 - 20) / 20.0).alias("score"))
    s = F.col("score")
    return x.select("review_id", scores.nearest_polarity(s).alias("nearest"), scores.banded_polarity(s).alias("banded"), scores.exact_polarity(s).alias("exact"), F.round(scores.logit((s + 1) / 2), 6).alias("logit"))


@query("q_mixed_polarity", f"""WITH {CELLS_SQL} SELECT review_id, count(*) AS n_aspects, string_agg(aspect, ',' ORDER BY aspect) AS aspects FROM cells WHERE y_true = 1 GROUP BY review_id HAVING count(*) > 1 AND bool_or(pol_true = 'positive') AND bool_or(pol_true = 'negative')""")
def mixed_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = cells(spark, sf_dir).where("y_true = 1").groupBy("review_id").agg(F.count("*").alias("n_aspects"), F.array_join(F.array_sort(F.collect_list("aspect")), ",").alias("aspects"), F.bool_or(F.col("pol_true") == "positive").alias("p"), F.bool_or(F.col("pol_true") == "negative").alias("n"))
    return per.where("n_aspects > 1 AND p AND n").drop("p", "n")
