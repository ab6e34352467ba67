"""Error analysis: gold against predicted labels, row by row and pair by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.scores import ratio



def _flags() -> tuple[Column, Column]:
    return F.col("y_true") == 1, F.col("y_pred") == 1


def taxonomy(fact: DataFrame, *keys: str) -> DataFrame:
    """Rows that are exact, miss only, add only, or do both; counts and shares by keys."""
    gold_, pred_ = _flags()
    per = fact.groupBy(*keys, "review_id").agg(F.count(F.when(gold_ & ~pred_, 1)).alias("missed"), F.count(F.when(~gold_ & pred_, 1)).alias("extra"))
    kind = F.when((F.col("missed") == 0) & (F.col("extra") == 0), "exact").when(F.col("extra") == 0, "miss_only").when(F.col("missed") == 0, "extra_only").otherwise("both")
    counts = per.groupBy(*keys, kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("missed").alias("missed"), F.sum("extra").alias("extra"))
    return counts


def confusion_pairs(fact: DataFrame, *keys: str) -> DataFrame:
    """How often a missed aspect stands beside an extra one in the same row.

    A row has at most a handful of either: they are collected per row from the
    20 cells and paired there, so nothing is joined.
    """
    gold_, pred_ = _flags()
    per = fact.where((gold_ & ~pred_) | (~gold_ & pred_)).groupBy(*keys, "review_id").agg(F.collect_list(F.when(gold_, F.col("aspect"))).alias("missed"), F.collect_list(F.when(~gold_, F.col("aspect"))).alias("extra"))
    pairs = per.select(*keys, "extra", F.explode("missed").alias("missed")).select(*keys, "missed", F.explode("extra").alias("extra"))
    return pairs.groupBy(*keys, "missed", "extra").agg(F.count("*").alias("n"))


def broad_replacements(fact: DataFrame, broad: list[str], *keys: str) -> DataFrame:
    """Confusion pairs in which a specific label gave way to a broad one."""
    return confusion_pairs(fact, *keys).where(F.col("extra").isin(broad) & ~F.col("missed").isin(broad))


def run_summary(fact: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per approach: rows, parse success, share of rows with any prediction, mean gold and predicted labels.

    ``parsed``: (approach, review_id, ok).
    """
    per = fact.groupBy("approach", "review_id").agg(F.sum("y_true").alias("gold"), F.sum("y_pred").alias("pred"))
    joined = per.join(parsed, ["approach", "review_id"], "left")
    return joined.groupBy("approach").agg(F.count("*").alias("n_rows"), F.avg(F.coalesce("ok", F.lit(0))).alias("parse_success_rate"), F.avg((F.col("pred") > 0).cast("int")).alias("nonempty_rate"), F.avg("gold").alias("mean_gold"), F.avg("pred").alias("mean_predicted"))


def per_aspect(fact: DataFrame, *keys: str) -> DataFrame:
    """Support, predictions and sentiment match given that the aspect was found."""
    gold_, pred_ = _flags()
    hit = gold_ & pred_
    sums = fact.groupBy(*keys, "aspect").agg(F.sum("y_true").alias("support"), F.sum("y_pred").alias("predicted"), F.count(F.when(hit, 1)).alias("tp"), F.count(F.when(hit & (F.col("pol_true") == F.col("pol_pred")), 1)).alias("matched"))
    return sums.select("*", ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(F.col("matched"), F.col("tp"), None).alias("sentiment_match"))


def polarity_recall(fact: DataFrame, *keys: str) -> DataFrame:
    """Recall, miss rate and sentiment match of gold labels by their polarity; null without support."""
    gold_, pred_ = _flags()
    gold = fact.where(gold_)
    sums = gold.groupBy(*keys, F.col("pol_true").alias("polarity")).agg(F.count("*").alias("support"), F.count(F.when(pred_, 1)).alias("found"), F.count(F.when(pred_ & (F.col("pol_true") == F.col("pol_pred")), 1)).alias("matched"))
    found, support = F.col("found"), F.col("support")
    return sums.select(*keys, "polarity", "support", ratio(found, support, None).alias("recall"), ratio(support - found, support, None).alias("miss_rate"), ratio(F.col("matched"), found, None).alias("match_rate"))


def widened(long: DataFrame, key: str, column: str, values: list[str], measures: list[str]) -> DataFrame:
    """One row per key with a column for each value and measure."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col(column) == v, F.col(m))).alias(f"{v}_{m}") for v in values for m in measures])


def faithfulness(audit: DataFrame) -> DataFrame:
    """Support and match rates by aspect, over all aspects, and of whole reviews, from one scan of (review_id, aspect, supported, matched)."""
    s, m = F.col("supported").cast("int"), F.col("matched").cast("int")
    grains = audit.cube("aspect").agg(F.count("*").alias("n"), F.avg(s).alias("supported_rate"), F.avg(m).alias("match_rate"), F.grouping("aspect").alias("g"))
    grains = grains.select(F.when(F.col("g") == 1, "__all__").otherwise(F.col("aspect")).alias("aspect"), "n", "supported_rate", "match_rate")
    reviews = audit.groupBy("review_id").agg(F.min(s).alias("s"), F.min(m).alias("m")).agg(F.count("*").alias("n"), F.avg("s").alias("supported_rate"), F.avg("m").alias("match_rate"))
    return grains.unionByName(reviews.select(F.lit("__reviews__").alias("aspect"), "n", "supported_rate", "match_rate"))
