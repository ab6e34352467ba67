"""Queries of rater agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import agreement as A
from reviewloom.operators.metrics import rounded
from reviewloom.functions.scores import ratio
from reviewloom.plans.binding import VOTES_SQL, votes
from reviewloom.plans.core import query
from reviewloom.staging import table


def _kappa_sql(source: str, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""t AS (SELECT {k}a, b, count(*) AS n FROM ({source}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
m AS (SELECT {k}sum(n)::BIGINT AS n, sum(n) FILTER (a = b) AS same FROM t GROUP BY ALL),
c AS (SELECT {k}sum(na * coalesce(nb, 0)) AS cross_n FROM (SELECT {k}a AS v, sum(n) AS na FROM t GROUP BY ALL) LEFT JOIN (SELECT {k}b AS v, sum(n) AS nb FROM t GROUP BY ALL) USING ({k}v) GROUP BY ALL),
k AS (SELECT {k}n, coalesce(same, 0) / n::DOUBLE AS po, cross_n / (n::DOUBLE * n) AS pe FROM m JOIN c {using}),
kappas AS (SELECT {k}n, round(po, 9) AS observed, round(pe, 9) AS expected, round(CASE WHEN pe = 1 THEN (po = 1)::INT ELSE (po - pe) / (1 - pe) END, 9) AS kappa FROM k)"""


@query("q_cohen_kappa", f"WITH {_kappa_sql('SELECT quality AS a, toxic AS b FROM labels', '')} SELECT * FROM kappas")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


_PAIRS = "SELECT x.aspect AS aspect, x.rater || y.rater AS pair, x.answer AS a, y.answer AS b FROM votes x JOIN votes y ON x.item_id = y.item_id AND x.aspect = y.aspect AND x.rater < y.rater"


@query("q_kappa_per_aspect", f"WITH {VOTES_SQL}, {_kappa_sql(_PAIRS, 'aspect, pair')} SELECT * FROM kappas")
def kappa_per_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = A.rater_pairs(A.common_items(votes(spark, sf_dir), "item_id", "aspect"), "answer", "item_id", "aspect")
    return rounded(A.cohen_kappa(pairs.withColumn("pair", F.concat("a", "b")).drop("a", "b"), "value_a", "value_b", "aspect", "pair"))


_MAJ = lambda value, keys="item_id, aspect", where="true": f"(SELECT {keys}, arg_min({value}, (-n, {value})) AS {value}, max(n) AS votes FROM (SELECT {keys}, {value}, count(*) AS n FROM votes WHERE {value} IS NOT NULL AND {where} GROUP BY ALL) GROUP BY ALL)"


@query("q_majority_vote", f"WITH {VOTES_SQL} SELECT item_id, aspect, answer, votes AS n FROM {_MAJ('answer')}")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.majority(votes(spark, sf_dir), "answer", "item_id", "aspect")


_YES = "answer = 'yes'"
_GOLD = f"gold AS (SELECT item_id, aspect, answer, votes, CASE WHEN answer = 'yes' THEN p.polarity END AS polarity FROM {_MAJ('answer')} LEFT JOIN (SELECT item_id, aspect, polarity FROM {_MAJ('polarity', where=_YES)}) p USING (item_id, aspect))"


@query("q_gold_labels", f"WITH {VOTES_SQL}, {_GOLD} SELECT * FROM gold")
def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conditional_gold(votes(spark, sf_dir), "item_id", "aspect")


@query("q_vote_ties_neutral", f"""WITH {VOTES_SQL}, c AS (SELECT item_id, aspect, polarity, count(*) AS n FROM votes WHERE polarity IS NOT NULL GROUP BY ALL), m AS (SELECT item_id, aspect, max(n) AS n FROM c GROUP BY ALL)
SELECT item_id, aspect, CASE WHEN count(*) > 1 THEN 'neutral' ELSE min(polarity) END AS polarity, n FROM c JOIN m USING (item_id, aspect, n) GROUP BY ALL""")
def vote_ties_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.majority(votes(spark, sf_dir), "polarity", "item_id", "aspect", tie="neutral")


@query("q_rater_accuracy", f"""WITH {VOTES_SQL}, o AS (SELECT rater, ((answer = 'yes') = (y_true = 1))::INT AS ok, CASE WHEN item_id % 13 = 0 THEN 1 ELSE conf END::DOUBLE AS c FROM votes)
SELECT rater, count(*) AS n, round(avg(ok), 9) AS accuracy, round(sum(c * ok) / sum(c), 9) AS weighted_accuracy FROM o GROUP BY rater""")
def rater_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("item_id") % 13 == 0, "n/a").otherwise(F.col("conf").cast("string"))
    return rounded(A.rater_accuracy(votes(spark, sf_dir), (F.col("answer") == "yes") == (F.col("y_true") == 1), conf))


_KEPT = "(item_id + idx) % 9 <> 0 OR rater <> 'C'"


@query("q_disagreements", f"""WITH {VOTES_SQL}, d AS (SELECT item_id, aspect, list_sort(list(DISTINCT answer)) AS said, count(DISTINCT rater) AS seen FROM votes WHERE {_KEPT} GROUP BY ALL)
SELECT item_id, aspect, len(said) + (seen < 3)::INT AS answers, array_to_string(said, ',') AS said FROM d WHERE len(said) + (seen < 3)::INT > 1""")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.disagreements(votes(spark, sf_dir).where(_KEPT), "answer", "item_id", "aspect")


_BUCKET = "CASE WHEN answer = 'unclear' THEN 'D' WHEN answer = 'yes' AND polarity = pol_true THEN 'A' WHEN answer = 'yes' THEN 'B' ELSE 'C' END"


@query("q_agreement_by_bucket", f"""WITH {VOTES_SQL}, {_GOLD}, b AS (SELECT aspect, {_BUCKET} AS bucket, ((answer = 'yes') = (y_true = 1))::INT AS agreed FROM gold JOIN (SELECT DISTINCT item_id, aspect, y_true, pol_true FROM votes) USING (item_id, aspect))
SELECT bucket, aspect, count(*) AS n, round(avg(agreed), 9) AS agreement FROM b GROUP BY bucket, aspect UNION ALL SELECT bucket, '__all__', count(*), round(avg(agreed), 9) FROM b GROUP BY bucket""")
def agreement_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir)
    truth = v.groupBy("item_id", "aspect").agg(F.max("y_true").alias("y_true"), F.max("pol_true").alias("pol_true"))
    joined = A.conditional_gold(v, "item_id", "aspect").join(truth, ["item_id", "aspect"])
    matched = F.when(F.col("answer") == "unclear", "unclear").when(F.col("polarity") == F.col("pol_true"), "yes").otherwise("no")
    b = joined.select("aspect", A.outcome_bucket(F.col("answer"), matched).alias("bucket"), ((F.col("answer") == "yes") == (F.col("y_true") == 1)).cast("int").alias("agreed"))
    out = b.rollup("bucket", "aspect").agg(F.count("*").alias("n"), F.avg("agreed").alias("agreement"), F.grouping_id().alias("g")).where("g < 3")
    return rounded(out.select("bucket", F.when(F.col("g") == 1, "__all__").otherwise(F.col("aspect")).alias("aspect"), "n", "agreement"))


@query("q_mapping_vs_human", f"""WITH {VOTES_SQL}, {_GOLD}, j AS (SELECT aspect, y_true, answer, polarity, pol_true FROM gold JOIN (SELECT DISTINCT item_id, aspect, y_true, pol_true FROM votes) USING (item_id, aspect))
SELECT aspect, count(*) FILTER (y_true = 1) AS mapped, count(*) FILTER (answer = 'yes') AS human, count(*) FILTER (y_true = 1 AND answer = 'yes') AS both_n,
round(count(*) FILTER (y_true = 1 AND answer = 'yes') / nullif(count(*) FILTER (y_true = 1), 0)::DOUBLE, 9) AS precision, round(count(*) FILTER (y_true = 1 AND answer = 'yes') / nullif(count(*) FILTER (answer = 'yes'), 0)::DOUBLE, 9) AS recall,
round(count(*) FILTER (y_true = 1 AND answer = 'yes' AND polarity = pol_true) / nullif(count(*) FILTER (y_true = 1 AND answer = 'yes'), 0)::DOUBLE, 9) AS polarity_agreement FROM j GROUP BY aspect""")
def mapping_vs_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = votes(spark, sf_dir)
    truth = v.groupBy("item_id", "aspect").agg(F.max("y_true").alias("y_true"), F.max("pol_true").alias("pol_true"))
    j = A.conditional_gold(v, "item_id", "aspect").join(truth, ["item_id", "aspect"])
    mapped, human = F.col("y_true") == 1, F.col("answer") == "yes"
    sums = j.groupBy("aspect").agg(F.count(F.when(mapped, 1)).alias("mapped"), F.count(F.when(human, 1)).alias("human"), F.count(F.when(mapped & human, 1)).alias("both_n"), F.count(F.when(mapped & human & (F.col("polarity") == F.col("pol_true")), 1)).alias("same"))
    return rounded(sums.select("aspect", "mapped", "human", "both_n", ratio(F.col("both_n"), F.col("mapped"), None).alias("precision"), ratio(F.col("both_n"), F.col("human"), None).alias("recall"), ratio(F.col("same"), F.col("both_n"), None).alias("polarity_agreement")))
