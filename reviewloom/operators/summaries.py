"""Corpus summaries, counts and run-to-run comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.scores import chance_confusion, confidence, entropy_bits, entropy_of_confidence, item_confusion, ratio, wilson
from reviewloom.functions.text import word_count


def corpus(reviews: DataFrame, cells: DataFrame) -> DataFrame:
    """Size, word statistics, labels per row, inventory and duplicates of a corpus; one row."""
    w = word_count(F.col("text"))
    texts = reviews.groupBy(F.md5("text").alias("m")).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("n_duplicates"))
    size = reviews.agg(F.count("*").alias("n_reviews"), F.avg(w).alias("mean_words"), F.percentile(w, F.lit(0.5)).alias("median_words"), F.countDistinct("course_name").alias("n_courses"), F.countDistinct("style").alias("n_styles"))
    labels = cells.agg(F.sum("y_true").alias("n_labels"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("y_true") == 1, F.col("aspect")))), ",").alias("inventory"))
    return size.crossJoin(labels).crossJoin(texts).withColumn("mean_labels", ratio(F.col("n_labels"), F.col("n_reviews")))  # one row each


def duplicates(df: DataFrame, text: str, key: str) -> DataFrame:
    """Every row whose text occurred before, by ascending key, with the first one's key."""
    first = df.groupBy(F.md5(text).alias("m")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return df.select(key, F.md5(text).alias("m")).join(first, "m").where(F.col(key) != F.col("first")).select(key, "first")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) for each column, from one scan."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v")).select("v.*")
    return stacked.groupBy("field", "value").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column, zero where there are none; the columns are named, so no scan is spent on finding them."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def by_total(table: DataFrame, row: str, columns: list[str], mean: bool = False) -> DataFrame:
    """A pivoted table with its rows' sum (or mean) over ``columns`` and place, the greatest first, equal ones by name.

    Nulls count 0.  The table is a report of few rows, one per value of ``row``.
    """
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0)))
    totalled = table.withColumn("total", total / len(columns) if mean else total)
    return totalled.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), row)))


def cooccurrence(cells: DataFrame) -> DataFrame:
    """How often two labels stand in the same row, the diagonal included; pairs come from the row's own list of labels."""
    per = cells.where("y_true = 1").groupBy("review_id").agg(F.collect_list("aspect").alias("labels"))
    pairs = per.select("labels", F.explode("labels").alias("a")).select("a", F.explode("labels").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def deltas(rows: DataFrame, order: str, measures: list[str]) -> DataFrame:
    """Each measure beside its difference to the previous row's; rows are cycles, so there are few."""
    w = Window.orderBy(order)
    return rows.select("*", *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_delta") for m in measures])


def judged(sides: DataFrame) -> DataFrame:
    """Items of judged pairs: (pair_id, truth, label, conf) with correctness, confusion and entropy."""
    ok = F.col("label") == F.col("truth")
    return sides.select("*", ok.cast("int").alias("correct"), item_confusion(ok, F.col("conf")).alias("confusion"), entropy_of_confidence(F.col("conf")).alias("entropy"), confidence(F.col("conf")).alias("stated"))


def stack_sides(pairs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The two sides of each pair (a_field, b_field) as rows."""
    side = lambda s: F.struct(F.lit(s).alias("side"), *[F.col(f"{s}_{f}").alias(f) for f in fields])
    return pairs.select(key, F.explode(F.array(side("a"), side("b"))).alias("x")).select(key, "x.*")


def label_entropy(judged_rows: DataFrame, *keys: str) -> DataFrame:
    """Share of a label and its entropy in bits."""
    share = ratio(F.sum((F.col("label") == "synthetic").cast("int")), F.count("*"))
    return judged_rows.groupBy(*keys).agg(F.count("*").alias("n"), share.alias("synthetic_rate")).withColumn("entropy_bits", entropy_bits(F.col("synthetic_rate")))


def equivalence(counts: DataFrame, margin: float = 0.1) -> DataFrame:
    """(k, n) -> accuracy, Wilson bounds, chance confusion and whether the interval lies within the margin of one half."""
    low, high = wilson(F.col("k"), F.col("n"))
    accuracy = ratio(F.col("k"), F.col("n"))
    return counts.select("*", accuracy.alias("accuracy"), low.alias("low"), high.alias("high"), chance_confusion(accuracy).alias("chance_confusion"), ((low >= 0.5 - margin) & (high <= 0.5 + margin)).alias("equivalent"))


def recommended_n(margin: Column, z: float = 1.959963984540054) -> Column:
    return F.ceil(0.25 * z * z / (margin * margin)).cast("long")


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series, taken seven further on, where it is exact to twelve digits."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    below = x + 1.0
    for k in range(2, 8):
        below = below * (x + float(k))
    return series - F.log(below)


def binomial_exact(counts: DataFrame, key: str) -> DataFrame:
    """Two-sided exact p-value of k successes in n against chance, from (key, k, n); 1 without any trial.

    The outcomes no likelier than k are the two tails as far from n / 2.  Terms
    of a tail beyond 60 square roots of n are nothing beside its last, so a row
    costs that many terms and not n.
    """
    far = F.least(F.col("k"), F.col("n") - F.col("k"))
    first = F.greatest(F.lit(0), far - F.ceil(60 * F.sqrt(F.col("n").cast("double"))))
    terms = counts.select(key, "k", "n", far.alias("far"), F.explode(F.sequence(first.cast("long"), far.cast("long"))).alias("i"))
    n, i = F.col("n").cast("double"), F.col("i").cast("double")
    logs = log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * math.log(2)
    tail = terms.groupBy(key, "k", "n", "far").agg(F.sum(F.exp(logs)).alias("tail"))
    return tail.select(key, "k", "n", F.when(2 * F.col("far") == F.col("n"), 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("tail"))).alias("p_value"))


def common_lineage(frames: list[DataFrame], column: str) -> DataFrame:
    """The union of runs, refused if they come from different data."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    if whole.select(column).distinct().limit(2).count() > 1:
        raise ValueError(f"the runs differ in {column}")
    return whole


def backfill(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Columns that only ``other`` has, joined on; and its values where ours are null."""
    theirs = other.select(key, *[F.col(c).alias(f"{c}_other") for c in other.columns if c != key])
    joined = rows.join(theirs, key, "left")
    own = [F.coalesce(c, f"{c}_other").alias(c) if c in other.columns and c != key else F.col(c) for c in rows.columns]
    return joined.select(*own, *[F.col(f"{c}_other").alias(c) for c in other.columns if c not in rows.columns])
