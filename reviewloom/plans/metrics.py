"""Queries over the fact table: multilabel, sentiment, ranking and calibration metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.dims import dim_aspect
from reviewloom.operators import metrics as M
from reviewloom.plans.binding import COUNTS_SQL, FACT_SQL, fact
from reviewloom.plans.core import query

_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END"
_R = lambda a, b: f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b})::DOUBLE END"
_RATES = f"""{_R('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_R('tp', 'tp + fp')} AS precision, {_R('tp', 'tp + fn')} AS recall, {_F1} AS f1, {_R('tn', 'tn + fp')} AS specificity,
    ({_R('tp', 'tp + fn')} + {_R('tn', 'tn + fp')}) / 2 AS balanced_accuracy,
    CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE) END AS mcc"""
_PER = f"per AS (SELECT *, {_RATES} FROM (SELECT approach, aspect, {COUNTS_SQL} FROM fact GROUP BY ALL))"
_MACRO = ", ".join(f"round(avg({c}), 9) AS macro_{c}" for c in ("precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc"))
_MICRO = "sum(tp)::BIGINT AS tp, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"


@query("q_confusion_per_aspect", f"WITH {FACT_SQL}, {_PER} SELECT approach, aspect, tp, tn, fp, fn, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc")) + " FROM per")
def confusion_per_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.rates(M.confusion(fact(spark, sf_dir), "approach", "aspect")))


@query("q_micro_macro_summary", f"WITH {FACT_SQL}, {_PER}, s AS (SELECT approach, {_MICRO}, {_MACRO} FROM per GROUP BY approach) SELECT *, round({_R('tp', 'tp + fp')}, 9) AS micro_precision, round({_R('tp', 'tp + fn')}, 9) AS micro_recall, round({_F1}, 9) AS micro_f1 FROM s")
def micro_macro_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.micro_macro(fact(spark, sf_dir), "approach"))


_SAMPLES = f"""SELECT approach, round(sum(tp + tn) / sum(tp + tn + fp + fn)::DOUBLE, 9) AS label_accuracy, round(avg((fp + fn = 0)::INT), 9) AS subset_accuracy, round(avg({_F1}), 9) AS samples_f1,
    round(avg({_R('tp', 'tp + fp + fn')}), 9) AS samples_jaccard, round(sum(fp + fn) / sum(tp + tn + fp + fn)::DOUBLE, 9) AS hamming_loss FROM r GROUP BY approach"""


@query("q_samples_metrics", f"WITH {FACT_SQL}, r AS (SELECT approach, review_id, {COUNTS_SQL} FROM fact GROUP BY ALL) {_SAMPLES}")
def samples_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.samples_metrics(fact(spark, sf_dir), "approach"))


_ERRORS = """count(*) FILTER (y_true = 1 AND y_pred = 1) AS n_eval, round(avg((sent_pred - sent_true) ** 2) FILTER (y_true = 1 AND y_pred = 1), 9) AS mse, round(avg(abs(sent_pred - sent_true)) FILTER (y_true = 1 AND y_pred = 1), 9) AS mae,
    round(avg((CASE WHEN sent_pred <= -0.5 THEN -1 WHEN sent_pred <= 0.5 THEN 0 ELSE 1 END = sent_true)::INT) FILTER (y_true = 1 AND y_pred = 1), 9) AS polarity_accuracy"""


@query("q_masked_mse", f"WITH {FACT_SQL} SELECT approach, {_ERRORS} FROM fact GROUP BY approach")
def masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.sentiment_errors(fact(spark, sf_dir), "approach"))


@query("q_mae_polarity_acc", f"WITH {FACT_SQL} SELECT approach, aspect, {_ERRORS} FROM fact GROUP BY approach, aspect")
def mae_polarity_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.sentiment_errors(fact(spark, sf_dir), "approach", "aspect"))


def _by(column: str):  # type: ignore[no-untyped-def]
    sql = f"WITH {FACT_SQL}, c AS (SELECT approach, {column}, count(DISTINCT review_id) AS n_reviews, {COUNTS_SQL} FROM fact GROUP BY ALL) SELECT approach, {column}, n_reviews, round({_R('tp', 'tp + fp')}, 9) AS micro_precision, round({_R('tp', 'tp + fn')}, 9) AS micro_recall, round({_F1}, 9) AS micro_f1 FROM c"

    @query(f"q_metrics_by_{column}", sql)
    def by(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = fact(spark, sf_dir)
        per = M.confusion(f, "approach", column, "review_id")
        sums = per.groupBy("approach", column).agg(F.count("*").alias("n_reviews"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        return M.rounded(sums.select("approach", column, "n_reviews", M.ratio(tp, tp + fp).alias("micro_precision"), M.ratio(tp, tp + fn).alias("micro_recall"), M.f1(tp, fp, fn).alias("micro_f1")))


for _c in ("style", "grade"):
    _by(_c)


def _grouped(scheme: str) -> None:
    sql = f"""WITH {FACT_SQL}, g AS (SELECT approach, review_id, {scheme} AS aspect, max(y_true) AS y_true, max(y_pred) AS y_pred FROM fact GROUP BY ALL),
    per AS (SELECT *, {_RATES} FROM (SELECT approach, aspect, {COUNTS_SQL} FROM g GROUP BY ALL)), s AS (SELECT approach, {_MICRO}, round(avg(f1), 9) AS macro_f1 FROM per GROUP BY approach),
    r AS (SELECT approach, review_id, {COUNTS_SQL} FROM g GROUP BY ALL), m AS ({_SAMPLES})
    SELECT approach, tp, fp, fn, round({_F1}, 9) AS micro_f1, macro_f1, subset_accuracy, samples_f1, samples_jaccard FROM s JOIN m USING (approach)"""

    @query(f"q_grouped_labels_{scheme}", sql)
    def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = M.collapse(fact(spark, sf_dir), scheme)
        total = M.micro_macro(g, "approach").select("approach", "tp", "fp", "fn", "micro_f1", "macro_f1")
        return M.rounded(total.join(M.samples_metrics(g, "approach").select("approach", "subset_accuracy", "samples_f1", "samples_jaccard"), "approach"))


for _s in ("identity", "pedagogical", "confusion"):
    _grouped(_s)


@query("q_group_rollup", f"WITH {FACT_SQL}, {_PER}, j AS (SELECT approach, pedagogical AS \"group\", count(*) AS n_aspects, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f1) AS f, avg(balanced_accuracy) AS b FROM per JOIN dim USING (aspect) GROUP BY ALL) SELECT approach, \"group\", n_aspects, round({_F1}, 9) AS micro_f1, round(f, 9) AS macro_f1, round(b, 9) AS macro_balanced_accuracy FROM j")
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = M.rates(M.confusion(fact(spark, sf_dir), "approach", "aspect"))
    return M.rounded(M.group_rollup(per, dim_aspect(spark).select("aspect", F.col("pedagogical").alias("group")), "approach"))


_GRID = ", ".join(f"({t}::DOUBLE)" for t in M.GRID)
_CURVE = ", ".join(f"({t}::DOUBLE)" for t in M.CURVE)


@query("q_threshold_calibration", f"""WITH {FACT_SQL}, grid(threshold) AS (VALUES {_GRID}), cut AS (SELECT approach, aspect, threshold, count(*) FILTER (y_true = 1 AND prob >= threshold) AS tp, count(*) FILTER (y_true = 0 AND prob >= threshold) AS fp, count(*) FILTER (y_true = 1 AND prob < threshold) AS fn FROM fact, grid GROUP BY ALL),
    s AS (SELECT approach, aspect, threshold, {_F1} AS f1 FROM cut) SELECT approach, aspect, CASE WHEN max(f1) > 0 THEN arg_min(threshold, (-f1, threshold)) ELSE 0.5 END AS threshold, round(max(f1), 9) AS f1 FROM s GROUP BY approach, aspect""")
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.calibrate(fact(spark, sf_dir), "approach", "aspect"))


@query("q_calibration_curve", f"WITH {FACT_SQL}, grid(threshold) AS (VALUES {_CURVE}) SELECT approach, threshold, count(*) AS n, round(avg(y_true), 9) AS precision FROM fact, grid WHERE prob >= threshold GROUP BY ALL")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.precision_curve(fact(spark, sf_dir)))


@query("q_pos_weight", f"WITH {FACT_SQL} SELECT aspect, sum(y_true)::BIGINT AS pos, count(*) AS n, round(least(greatest((count(*) - sum(y_true)) / greatest(sum(y_true), 1)::DOUBLE, 1), 50), 9) AS weight FROM fact WHERE approach = 'bow' GROUP BY aspect")
def pos_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.positive_weights(fact(spark, sf_dir).where("approach = 'bow'"), "aspect"))


_RANK = """steps AS (SELECT approach, aspect, prob, sum(y_true) AS pos, count(*) AS n FROM fact GROUP BY ALL),
    run AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY approach, aspect) AS all_pos, sum(n) OVER (PARTITION BY approach, aspect) AS all_n FROM steps WINDOW w AS (PARTITION BY approach, aspect ORDER BY prob DESC)),
    ranked AS (SELECT approach, aspect, sum(pos * tp / seen::DOUBLE) / max(all_pos) AS average_precision, sum((n - pos) * (tp - pos / 2::DOUBLE)) / (max(all_pos) * (max(all_n) - max(all_pos)))::DOUBLE AS auroc FROM run WHERE all_pos > 0 AND all_pos < all_n GROUP BY ALL)"""


@query("q_average_precision", f"WITH {FACT_SQL}, {_RANK} SELECT approach, aspect, round(average_precision, 9) AS average_precision, round(auroc, 9) AS auroc FROM ranked")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.ranking(fact(spark, sf_dir), "approach", "aspect"))


@query("q_auroc", f"WITH {FACT_SQL}, {_RANK} SELECT approach, count(*) AS n_aspects, round(avg(average_precision), 9) AS map, round(avg(auroc), 9) AS macro_auroc FROM ranked GROUP BY approach")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = M.ranking(fact(spark, sf_dir), "approach", "aspect")
    return M.rounded(per.groupBy("approach").agg(F.count("*").alias("n_aspects"), F.avg("average_precision").alias("map"), F.avg("auroc").alias("macro_auroc")))


@query("q_prevalence_separation", f"WITH {FACT_SQL} SELECT approach, aspect, round(avg(y_true), 9) AS prevalence, round(avg(y_pred) - avg(y_true), 9) AS prevalence_shift, round(avg(prob) FILTER (y_true = 1) - avg(prob) FILTER (y_true = 0), 9) AS score_separation FROM fact GROUP BY ALL")
def prevalence_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.separation(fact(spark, sf_dir), "approach", "aspect"))


@query("q_oracle_k", f"""WITH {FACT_SQL}, p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY approach, review_id ORDER BY prob DESC, idx) <= sum(y_true) OVER (PARTITION BY approach, review_id) THEN 1 ELSE 0 END AS k FROM fact),
    c AS (SELECT approach, review_id, count(*) FILTER (y_true = 1 AND k = 1) AS tp, count(*) FILTER (y_true = 0 AND k = 1) AS fp, count(*) FILTER (y_true = 1 AND k = 0) AS fn FROM p GROUP BY ALL)
    SELECT approach, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn))::DOUBLE, 9) AS micro_f1, round(avg({_F1}), 9) AS samples_f1 FROM c GROUP BY approach""")
def oracle_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.oracle_k(fact(spark, sf_dir)))


@query("q_brier_ece", f"""WITH {FACT_SQL}, b AS (SELECT approach, least(CAST(floor(prob * 10) AS INT), 9) AS bin, count(*) AS n, sum(prob) AS sp, sum(y_true) AS sy, sum((prob - y_true) * (prob - y_true)) AS se FROM fact GROUP BY ALL)
    SELECT approach, round(sum(se) / sum(n), 9) AS brier, round(sum(abs(sp - sy)) / sum(n), 9) AS ece FROM b GROUP BY approach""")
def brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(M.calibration_error(fact(spark, sf_dir)))


@query("q_weakest_aspects", f"WITH {FACT_SQL}, {_PER} SELECT aspect, round(f1, 9) AS f1, tp, fp, fn FROM per WHERE approach = 'bow' ORDER BY round(f1, 9), aspect LIMIT 8")
def weakest_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = M.rounded(M.rates(M.confusion(fact(spark, sf_dir).where("approach = 'bow'"), "aspect")))
    return per.orderBy("f1", "aspect").limit(8).select("aspect", "f1", "tp", "fp", "fn")


@query("q_aspect_extremes", f"WITH {FACT_SQL}, {_PER}, s AS (SELECT aspect, round(f1, 9) AS f1 FROM per WHERE approach = 'joint') SELECT * FROM (SELECT *, 'top' AS \"end\" FROM s ORDER BY f1 DESC, aspect LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'bottom' FROM s ORDER BY f1, aspect LIMIT 5)")
def aspect_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = M.rounded(M.rates(M.confusion(fact(spark, sf_dir).where("approach = 'joint'"), "aspect"))).select("aspect", "f1")
    return M.extremes(per, "aspect", "f1", 5)


_SEEDS = f"""WITH {FACT_SQL}, runs AS (SELECT approach, aspect, review_id % 3 AS seed, {COUNTS_SQL} FROM fact GROUP BY ALL), s AS (SELECT *, {_F1} AS f1 FROM runs)"""


@query("q_seed_stability_pop", f"{_SEEDS}, m AS (SELECT approach, seed, avg(f1) AS f1 FROM s GROUP BY ALL) SELECT approach, round(avg(f1), 9) AS f1_mean, round(stddev_pop(f1), 9) AS f1_std_pop, round(stddev_samp(f1), 9) AS f1_std_samp FROM m GROUP BY approach")
def seed_stability_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = M.rates(M.confusion(fact(spark, sf_dir).withColumn("seed", F.col("review_id") % 3), "approach", "aspect", "seed"))
    return M.rounded(M.seed_spread(runs.groupBy("approach", "seed").agg(F.avg("f1").alias("f1")), ["f1"], "approach"))


@query("q_seed_stability_samp", f"{_SEEDS} SELECT approach, aspect, round(avg(f1), 9) AS f1_mean, round(stddev_pop(f1), 9) AS f1_std_pop, round(stddev_samp(f1), 9) AS f1_std_samp FROM s GROUP BY ALL")
def seed_stability_samp(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = M.rates(M.confusion(fact(spark, sf_dir).withColumn("seed", F.col("review_id") % 3), "approach", "aspect", "seed"))
    return M.rounded(M.seed_spread(runs, ["f1"], "approach", "aspect"))
