"""Queries of the error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.dims import BROAD
from reviewloom.operators import errors as E
from reviewloom.operators.metrics import rounded
from reviewloom.plans.binding import FACT_SQL, fact
from reviewloom.plans.core import query

_BROAD = ", ".join(f"'{b}'" for b in BROAD)
_PAIRS = f"""WITH {FACT_SQL}, p AS (SELECT m.approach, m.aspect AS missed, e.aspect AS extra FROM fact m JOIN fact e USING (approach, review_id) WHERE m.y_true = 1 AND m.y_pred = 0 AND e.y_true = 0 AND e.y_pred = 1)
SELECT approach, missed, extra, count(*) AS n FROM p"""


@query("q_error_taxonomy", f"""WITH {FACT_SQL}, r AS (SELECT approach, review_id, count(*) FILTER (y_true = 1 AND y_pred = 0) AS missed, count(*) FILTER (y_true = 0 AND y_pred = 1) AS extra FROM fact GROUP BY ALL)
SELECT approach, CASE WHEN missed = 0 AND extra = 0 THEN 'exact' WHEN extra = 0 THEN 'miss_only' WHEN missed = 0 THEN 'extra_only' ELSE 'both' END AS kind, count(*) AS n, sum(missed)::BIGINT AS missed, sum(extra)::BIGINT AS extra FROM r GROUP BY 1, 2""")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.taxonomy(fact(spark, sf_dir), "approach")


@query("q_confusion_pairs", f"{_PAIRS} GROUP BY ALL")
def confusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion_pairs(fact(spark, sf_dir), "approach")


@query("q_broad_replacements", f"{_PAIRS} WHERE extra IN ({_BROAD}) AND missed NOT IN ({_BROAD}) GROUP BY ALL")
def broad_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.broad_replacements(fact(spark, sf_dir), BROAD, "approach")


@query("q_llm_run_summary", f"""WITH {FACT_SQL}, r AS (SELECT approach, review_id, sum(y_true) AS gold, sum(y_pred) AS pred, (review_id % 19 <> 0)::INT AS ok FROM fact GROUP BY ALL)
SELECT approach, count(*) AS n_rows, round(avg(ok), 9) AS parse_success_rate, round(avg((pred > 0)::INT), 9) AS nonempty_rate, round(avg(gold), 9) AS mean_gold, round(avg(pred), 9) AS mean_predicted FROM r GROUP BY approach""")
def llm_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fact(spark, sf_dir)
    parsed = f.where("idx = 0").select("approach", "review_id", (F.col("review_id") % 19 != 0).cast("int").alias("ok"))
    return rounded(E.run_summary(f, parsed))


_HIT = "y_true = 1 AND y_pred = 1"


@query("q_llm_per_aspect", f"""WITH {FACT_SQL}, s AS (SELECT approach, aspect, sum(y_true)::BIGINT AS support, sum(y_pred)::BIGINT AS predicted, count(*) FILTER ({_HIT}) AS tp, count(*) FILTER ({_HIT} AND pol_true = pol_pred) AS matched FROM fact GROUP BY ALL)
SELECT *, round(CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END, 9) AS recall, round(CASE WHEN tp > 0 THEN matched / tp::DOUBLE END, 9) AS sentiment_match FROM s""")
def llm_per_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.per_aspect(fact(spark, sf_dir), "approach"))


def _recall(keys: str) -> str:
    return f"""WITH {FACT_SQL}, s AS (SELECT {keys}, pol_true AS polarity, count(*) AS support, count(*) FILTER (y_pred = 1) AS found, count(*) FILTER (y_pred = 1 AND pol_true = pol_pred) AS matched FROM fact WHERE y_true = 1 GROUP BY ALL),
l AS (SELECT {keys}, polarity, support, round(found / support::DOUBLE, 9) AS recall, round((support - found) / support::DOUBLE, 9) AS miss_rate, round(CASE WHEN found > 0 THEN matched / found::DOUBLE END, 9) AS match_rate FROM s)"""


_WIDE = ", ".join(f"max({m}) FILTER (polarity = '{v}') AS {v}_{m}" for v in ("negative", "neutral", "positive") for m in ("recall", "miss_rate", "match_rate"))


@query("q_polarity_recall_long", f"{_recall('approach, aspect')} SELECT * FROM l")
def polarity_recall_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.polarity_recall(fact(spark, sf_dir), "approach", "aspect"))


@query("q_polarity_recall_wide", f"{_recall('approach')} SELECT approach, {_WIDE} FROM l GROUP BY approach")
def polarity_recall_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = rounded(E.polarity_recall(fact(spark, sf_dir), "approach"))
    return E.widened(long, "approach", "polarity", ["negative", "neutral", "positive"], ["recall", "miss_rate", "match_rate"])


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fact(spark, sf_dir).where("approach = 'bow' AND y_true = 1")
    return f.select("review_id", "aspect", (F.col("y_pred") == 1).alias("supported"), ((F.col("y_pred") == 1) & (F.col("pol_true") == F.col("pol_pred"))).alias("matched"))


_AUDIT = f"WITH {FACT_SQL}, audit AS (SELECT review_id, aspect, y_pred AS supported, (y_pred = 1 AND pol_true = pol_pred)::INT AS matched FROM fact WHERE approach = 'bow' AND y_true = 1)"
_RATE = "count(*) AS n, round(avg(supported), 9) AS supported_rate, round(avg(matched), 9) AS match_rate"


@query("q_faithfulness_rates", f"""{_AUDIT} SELECT aspect, {_RATE} FROM audit GROUP BY aspect UNION ALL SELECT '__all__', {_RATE} FROM audit
UNION ALL SELECT '__reviews__', {_RATE} FROM (SELECT min(supported) AS supported, min(matched) AS matched FROM audit GROUP BY review_id)""")
def faithfulness_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.faithfulness(_audit(spark, sf_dir)))


@query("q_faithfulness_weakest", f"{_AUDIT} SELECT aspect, {_RATE} FROM audit GROUP BY aspect ORDER BY supported_rate, match_rate, aspect LIMIT 8")
def faithfulness_weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = rounded(E.faithfulness(_audit(spark, sf_dir))).where("aspect NOT LIKE '\\\\_\\\\_%'")
    return rates.orderBy("supported_rate", "match_rate", "aspect").limit(8)
