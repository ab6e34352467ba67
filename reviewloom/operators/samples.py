"""Splits and samples that depend on ids and a seed alone.

Rows are ordered by a hash of (seed, id), so a split doesn't change with
partitioning or with the rows' order.  Exact counts need a rank over all rows;
it is taken in two steps, so that no task sees more than one slice of the
hash range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A global rank is counted by slices of the hash range: four hex digits, 65,536 slices, so 10^11 rows make slices of 1.5 million.
SLICE_HEX = 4


def hash_order(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def ranked(df: DataFrame, order: str, tie: str, *strata: str) -> DataFrame:
    """``df`` with place, from 1, by (order, tie) within strata; ``order`` is a hex hash.

    Each slice of the hash range is ranked by itself, and the counts of the
    slices before are added: one row per stratum and slice.
    """
    sliced = df.withColumn("slice_", F.left(order, F.lit(SLICE_HEX)))
    counts = sliced.groupBy(*strata, "slice_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy(*strata).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_")
    inside = F.row_number().over(Window.partitionBy(*strata, "slice_").orderBy(order, tie))
    base = base.withColumnsRenamed({c: f"{c}_base_" for c in (*strata, "slice_")})
    same = F.lit(True)
    for c in (*strata, "slice_"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_base_"))  # a null stratum is one of its own
    return sliced.withColumn("inside_", inside).join(base, same).withColumn("place", F.col("before_") + F.col("inside_")).drop("slice_", "before_", "inside_", *[f"{c}_base_" for c in (*strata, "slice_")])


def split(df: DataFrame, key: str, shares: tuple[float, float] = (0.1, 0.1), seed: int = 42) -> DataFrame:
    """``df`` with part: exact floor(n * share) test and calibration rows, one at least each, and the rest for training."""
    n = df.count()
    if n < 3:
        raise ValueError("a three-way split needs three rows")
    test, held = (max(1, int(n * s)) for s in shares)
    place = ranked(df.withColumn("order_", hash_order(seed, F.col(key))), "order_", key)
    return place.withColumn("part", F.when(F.col("place") <= test, "test").when(F.col("place") <= test + held, "calibration").otherwise("train")).drop("order_", "place")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement; all if there are fewer."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def per_stratum(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """The first n of each stratum in hash order, with their place."""
    return ranked(df.withColumn("order_", hash_order(seed, F.col(key))), "order_", key, stratum).where(F.col("place") <= n)


def stratified(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """n rows: an equal quota of each stratum, topped up by hash order from the rows that are left."""
    strata = df.agg(F.countDistinct(stratum).alias("k")).first()["k"]
    quota = n // max(strata, 1)
    placed = ranked(df.withColumn("order_", hash_order(seed, F.col(key))), "order_", key, stratum)
    return placed.withColumn("later", (F.col("place") > quota).cast("int")).orderBy("later", "order_", key).limit(n).drop("order_", "place", "later")


def round_robin(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, one of each stratum in turn."""
    placed = per_stratum(df, key, stratum, n, seed)
    return placed.orderBy("place", stratum).limit(n).drop("order_")


def rarest_first(cells: DataFrame, item: str, label: str, quota: int, seed: int = 42) -> DataFrame:
    """Rows to cover every label: each row counts for the rarest label it has, and each label keeps its quota in hash order.

    A row is used once.  Unlike a pass that takes labels one by one, a row
    whose rarest label is full isn't offered to its next label.
    """
    counts = cells.groupBy(label).agg(F.count("*").alias("n_"))
    own = cells.join(F.broadcast(counts), label)  # one row per label
    first = own.groupBy(item).agg(F.min(F.struct("n_", label)).alias("m")).select(item, F.col(f"m.{label}").alias(label))
    return per_stratum(first, item, label, quota, seed).select(item, label, "place")


def coverage(cells: DataFrame, item: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """(item, label): n items that cover the labels, the rarest label first.

    Labels take turns from the rarest (equal ones by name); each takes its
    share, n over the number of labels, of items in hash order that no label
    before has taken.  Too few are topped up from the other items, with label
    null.  A label's turn depends on those before it, so there is a job per
    label; the driver holds the chosen items, n at most.
    """
    sizes = cells.groupBy(label).agg(F.count("*").alias("n")).orderBy("n", label).collect()  # a row per label
    share = max(n // max(len(sizes), 1), 1)
    kinds = dict(cells.dtypes)
    schema = f"{item} {kinds[item]}, {label} {kinds[label]}"
    order = [hash_order(seed, F.col(item)), F.col(item)]
    taken: list[tuple] = []

    def open_(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(cells.sparkSession.createDataFrame(taken, schema).select(item)), item, "left_anti") if taken else rows

    for of in sizes:
        if len(taken) >= n:
            break
        rows = open_(cells.where(F.col(label) == of[label]).select(item)).distinct().orderBy(*order).limit(share)
        taken += [(r[item], of[label]) for r in rows.collect()]
    if len(taken) < n:
        taken += [(r[item], None) for r in open_(cells.select(item)).distinct().orderBy(*order).limit(n - len(taken)).collect()]
    return cells.sparkSession.createDataFrame(taken[:n], schema)


def draw(weights: list[tuple[str, float]], key: Column, seed: int | str) -> Column:
    """One value per row, by its hash against cumulative weights."""
    u = F.conv(F.left(hash_order(seed, key), F.lit(8)), 16, 10).cast("long") / float(1 << 32)
    total, upto, out = sum(w for _, w in weights), 0.0, None
    for value, w in weights:
        upto += w / total
        out = F.when(u < upto, value) if out is None else out.when(u < upto, value)
    return out.otherwise(weights[-1][0])
