"""Agreement of raters: kappa, majorities, accuracy, disagreements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.scores import kappa, ratio


def cohen_kappa(pairs: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """kappa of two nominal columns by keys, over rows where both are given; null without any.

    The contingency table is counted first; the marginals are sums of its few rows.
    """
    table = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    left = table.groupBy(*keys, F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    right = table.groupBy(*keys, F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    total = table.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    chance = left.join(right, [*keys, "v"], "left").groupBy(*keys).agg(F.sum(F.col("na") * F.coalesce("nb", F.lit(0))).alias("cross"))
    joined = total.join(chance, list(keys)) if keys else total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return joined.select(*keys, "n", po.alias("observed"), pe.alias("expected"), kappa(po, pe).alias("kappa"))


def rater_pairs(votes: DataFrame, value: str, *item: str) -> DataFrame:
    """(a, b, item..., value_a, value_b) for raters a < b on the same item."""
    x = votes.select(*item, F.col("rater").alias("a"), F.col(value).alias("value_a"))
    y = votes.select(*item, F.col("rater").alias("b"), F.col(value).alias("value_b"))
    return x.join(y, list(item)).where("a < b")


def common_items(votes: DataFrame, *item: str) -> DataFrame:
    """The votes on items that every rater of the table answered."""
    n = votes.agg(F.countDistinct("rater").alias("raters"))
    full = votes.groupBy(*item).agg(F.countDistinct("rater").alias("k")).crossJoin(F.broadcast(n)).where("k = raters").select(*item)  # n: one row
    return votes.join(full, list(item), "left_semi")


def majority(votes: DataFrame, value: str, *item: str, tie: str | None = None) -> DataFrame:
    """The most frequent value of an item; of equal ones the least, or ``tie`` if it is given."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(*item, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*item).orderBy(F.desc("n"), value)
    ranked = counts.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("n").over(order)).where("place = 1")
    chosen = F.col(value) if tie is None else F.when(F.col("n") == F.col("next"), tie).otherwise(F.col(value))
    return ranked.select(*item, chosen.alias(value), "n")


def conditional_gold(votes: DataFrame, *item: str) -> DataFrame:
    """Majority answer per item, and the majority polarity only where the majority says yes."""
    said = majority(votes, "answer", *item).withColumnRenamed("n", "votes")
    polarity = majority(votes.where("answer = 'yes'"), "polarity", *item).drop("n")
    joined = said.join(polarity, list(item), "left")
    return joined.select(*item, "answer", "votes", F.when(F.col("answer") == "yes", F.col("polarity")).alias("polarity"))


def rater_accuracy(votes: DataFrame, right: Column, conf: Column) -> DataFrame:
    """Plain and confidence-weighted accuracy of each rater; a confidence that is no number counts 1."""
    c = F.coalesce(conf.cast("string").try_cast("double"), F.lit(1.0))
    ok = right.cast("int")
    return votes.groupBy("rater").agg(F.count("*").alias("n"), ratio(F.sum(ok), F.count("*")).alias("accuracy"), ratio(F.sum(c * ok), F.sum(c)).alias("weighted_accuracy"))


def disagreements(votes: DataFrame, value: str, *item: str) -> DataFrame:
    """Items on which raters differ; an item that a rater left out counts as an answer of its own."""
    n = votes.agg(F.countDistinct("rater").alias("raters"))
    per = votes.groupBy(*item).agg(F.countDistinct(F.coalesce(F.col(value), F.lit(""))).alias("answers"), F.countDistinct("rater").alias("seen"), F.array_sort(F.collect_set(F.coalesce(F.col(value), F.lit("")))).alias("said"))
    blank = per.crossJoin(F.broadcast(n)).withColumn("answers", F.col("answers") + F.when((F.col("seen") < F.col("raters")) & ~F.array_contains("said", ""), 1).otherwise(0))  # n: one row
    return blank.where("answers > 1").select(*item, "answers", F.array_join("said", ",").alias("said"))


def normalized_answer(raw: Column) -> Column:
    """yes, no or unclear for the usual spellings; others pass through."""
    x = F.lower(F.trim(raw))
    # fixed values: the spellings of each answer; a null one stays empty
    known = {"yes": ("yes", "true", "1", "supported", "match"), "no": ("no", "false", "0", "not_supported", "mismatch"), "unclear": ("", "unclear", "ambiguous", "uncertain", "partial")}
    return F.when(raw.isNull(), "").when(x.isin(*known["yes"]), "yes").when(x.isin(*known["no"]), "no").when(x.isin(*known["unclear"]), "unclear").otherwise(x)


def outcome_bucket(supported: Column, matched: Column) -> Column:
    """A supported and matched, B supported only, C not supported, D for what is unclear in either or no known answer."""
    known = F.when((supported == "yes") & (matched == "yes"), "A").when((supported == "yes") & (matched == "no"), "B").when(supported == "no", "C")
    return F.when((supported == "unclear") | (matched == "unclear"), "D").otherwise(F.coalesce(known, F.lit("D")))
