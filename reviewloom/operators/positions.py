"""Running totals and numbers over a whole table in order, without one task that sees all of it.

Rows are dealt to ranges of the order; each range is summed, the sums before a
range are added to its rows' own.  What is gathered is a row for each range
and group, not the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.staging import fresh_name, stage


def cumulative(df: DataFrame, order: list[Column | str], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """``df`` with a running total for each of ``sums``, its own row included, by ``order`` within the groups ``by``.

    ``order`` should tell all rows of a group apart; rows that it doesn't are in
    one range and in any order.  Null groups are groups of their own; nulls in
    a sum count as nothing; totals before the first such value are 0.
    """
    by = by or []
    own = {name: fresh_name(df, f"{name}_own") for name in sums}
    at, base = fresh_name(df, "range"), {name: fresh_name(df, f"{name}_before") for name in sums}
    rows = df.withColumns({own[n]: F.coalesce(value, F.lit(0)) for n, value in sums.items()})
    rows = stage(rows.repartitionByRange(*by, *order).withColumn(at, F.spark_partition_id()), "ranges")  # ranges are drawn once
    totals = rows.groupBy(*by, at).agg(*[F.sum(own[n]).alias(base[n]) for n in sums])
    earlier = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    keys = {c: f"{c}_of_range" for c in (*by, at)}
    offsets = totals.withColumns({base[n]: F.coalesce(F.sum(base[n]).over(earlier), F.lit(0)) for n in sums}).withColumnsRenamed(keys)
    same = reduce(lambda x, y: x & y, [F.col(at) == F.col(keys[at]), *[F.col(c).eqNullSafe(F.col(keys[c])) for c in by]])
    inside = Window.partitionBy(*by, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.join(offsets, same).withColumns({n: F.col(base[n]) + F.sum(own[n]).over(inside) for n in sums})
    return running.select(*df.columns, *sums)


def numbered(scan: DataFrame, name: str = "position") -> DataFrame:
    """The rows of a file scan numbered from 0 in the order of the files' paths and of the rows in them.

    ``scan`` is what a reader returns (it needs ``_metadata``).  A first pass
    counts the rows of each block that a file is read in; the second adds the
    counts of the blocks before to a row's place in its own.  Rows aren't
    shuffled.  The window over blocks has one row for each, about 8 million for 1 PB.
    """
    block, seen = fresh_name(scan, "block"), fresh_name(scan, "seen")
    rows = scan.select(*scan.columns, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias(block), F.monotonically_increasing_id().alias(seen))
    blocks = rows.groupBy(F.col(block).alias("at")).agg(F.count("*").alias("n"), F.min(seen).alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("at", (before - F.col("first")).alias("shift"))
    return rows.join(offsets, F.col(block) == F.col("at")).select(*scan.columns, (F.col(seen) + F.col("shift")).alias(name))


def shards(requests: DataFrame, order: list[str], size: Column, most_bytes: int, most_requests: int, span: int = 16) -> DataFrame:
    """``requests`` with shard (from 0, in order) and size; no shard is above either limit.

    Requests go in order into a shard until one more would exceed a limit.  The
    walk starts anew every ``span`` limits of running size or count, so blocks
    are packed side by side and at most one shard in ``span`` is not full.  A
    request above ``most_bytes`` by itself gets a null shard and takes no room.
    ``order`` must tell requests apart; a null size is 0.
    """
    name, block, n, upto = "size", fresh_name(requests, "block"), fresh_name(requests, "n"), fresh_name(requests, "upto")
    rows = requests.withColumn(name, F.coalesce(size, F.lit(0)).cast("long"))
    fits = F.col(name) <= most_bytes
    rows = cumulative(rows, order, {upto: F.when(fits, F.col(name)), n: F.when(fits, F.lit(1))})
    of_size = F.floor((F.col(upto) - F.col(name)) / (span * most_bytes))
    of_count = F.floor((F.col(n) - 1) / (span * most_requests))
    rows = rows.withColumn(block, F.when(fits, of_size + of_count))

    def step(walk: Column, row: Column) -> Column:
        full = (walk["bytes"] + row["size"] > most_bytes) | (walk["count"] >= most_requests)
        room = F.struct(row["size"].alias("bytes"), F.lit(1).cast("long").alias("count"), F.concat(walk["starts"], F.array(row["n"])).alias("starts"))
        more = F.struct((walk["bytes"] + row["size"]).alias("bytes"), (walk["count"] + 1).alias("count"), walk["starts"].alias("starts"))
        return F.when(full, room).otherwise(more)

    empty = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(most_requests).cast("long").alias("count"), F.array().cast("array<long>").alias("starts"))
    walked = rows.where(fits).groupBy(block).agg(F.sort_array(F.collect_list(F.struct(F.col(n).alias("n"), F.col(name).alias("size")))).alias("rows"))  # sizes of one block: span limits at most
    starts = stage(walked.select(F.col(block).alias("of_block"), F.aggregate("rows", empty, step)["starts"].alias("starts")), "starts")
    before = F.coalesce(F.sum(F.size("starts")).over(Window.orderBy("of_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    starts = starts.withColumn("before", before)
    placed = rows.join(starts, F.col(block) == F.col("of_block"), "left")
    shard = F.col("before") + F.size(F.filter("starts", lambda s: s <= F.col(n))) - 1
    return placed.withColumn("shard_", shard.cast("long")).select(*requests.columns, name, F.col("shard_").alias("shard"))


def shard_manifest(sharded: DataFrame, key: str) -> DataFrame:
    """(shard, n, bytes, digest): the digest is of the shard's keys, so equal shards are known again when requests were added behind them."""
    return sharded.where("shard IS NOT NULL").groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.md5(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").cast("binary")).alias("digest"))


def unsubmitted(manifest: DataFrame, submitted: DataFrame) -> DataFrame:
    """Shards whose digest was not submitted yet."""
    return manifest.join(submitted.select("digest"), "digest", "left_anti")
