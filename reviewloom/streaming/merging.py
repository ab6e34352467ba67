"""Ordered merge of shards once all of a run's are there, as a stream.

When the last shard of a run comes its merge plan goes out: a row for each shard,
in the shards' order, with the number of rows before it.  The rows themselves are
numbered by a join with the plan.  What is kept of a run that waits is what is
known of its shards (number, place, rows), not their rows.

``Merges`` judges all runs of a micro-batch at once, for many runs.  ``merge_plans`` keeps
each run in a state of its own with an event-time timer, for plans that a
streaming sink takes: some milliseconds of Python a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reviewloom.streaming.monitor import Batches

PLAN = "run_id string, shard long, path string, n_rows long, first_row long, state string"
HELD = f"{PLAN}, n_shards long, at timestamp"  # the most shards named, and the first time of the run
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MergePlans(StatefulProcessor):
    """Of a shard that comes twice the first counts; after the plan, or the timeout, nothing more is said of a run."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as each call of a state is a message between Python and the JVM
        self.known = handle.getValueState("known", "n_shards long, told boolean, timer long, shards array<struct<shard:long,path:string,n_rows:long>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        total, told, timer, known = self.known.get() or (0, False, -1, [])
        if told:
            return
        columns = ["at", "path", "shard", "n_rows", "n_shards"]
        new = sorted((r for part in rows for r in zip(*(part[c].tolist() for c in columns))), key=lambda r: (r[0], r[1] is None, r[1] or ""))
        held = [(int(s), p, int(n)) for s, p, n in known]
        seen = {x[0] for x in held}
        for _, path, shard, n, _ in new:
            if int(shard) not in seen:
                seen.add(int(shard))
                held.append((int(shard), path, int(n)))
        total = max(int(total), *(int(r[4]) for r in new))
        done = len(seen) >= total
        if not done and timer < 0:  # a run that is whole at once never waits
            timer = int(new[0][0].timestamp() * 1000) + self.wait_ms
            self.handle.registerTimer(max(timer, timerValues.getCurrentWatermarkInMs() + 1))
        self.known.update((total, done, timer, [] if done else held))
        if done:
            yield self._plan(key[0], held, "merged")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        total, told, timer, known = self.known.get()
        if not told:
            self.known.update((total, True, timer, []))
            yield self._plan(key[0], [tuple(x) for x in known], "timeout")

    def _plan(self, run: str, held: list[tuple], state: str) -> pd.DataFrame:
        rows, before = [], 0
        for shard, path, n in sorted(held):
            rows.append((run, int(shard), path, int(n), before if state == "merged" else None, state))
            before += int(n)
        out = pd.DataFrame(rows, columns=["run_id", "shard", "path", "n_rows", "first_row", "state"])
        return out.astype({"first_row": "Int64"})

    def close(self) -> None:
        pass


def merge_plans(shards: DataFrame, wait: str = "2 days", wait_ms: int = 2 * 86_400_000) -> DataFrame:
    """Merge plans from a stream (run_id, shard, n_shards, path, n_rows, at).

    A run whose shards aren't all there ``wait_ms`` after its first, by event
    time, goes out once with state "timeout", null first rows and the shards
    that came; later ones are ignored.  Rows with a null run or shard are dropped.
    """
    spark = shards.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = shards.where("run_id IS NOT NULL AND shard IS NOT NULL").withWatermark("at", wait)
    return rows.groupBy("run_id").transformWithStateInPandas(MergePlans(wait_ms), PLAN, "Append", "EventTime")


class Merges(Batches):
    """The merge plans of a stream's runs, with what merge_plans says of them.

    A micro-batch writes its runs' shards once, those of whole runs as plans and
    the others as waiting; the next takes them up again with its own.  A run
    waits ``wait_ms`` from its first shard on, by times ``late_ms`` behind the
    latest of all.
    """

    def __init__(self, spark: SparkSession, root: str, wait_ms: int = 2 * 86_400_000, late_ms: int = 2 * 86_400_000):
        super().__init__(spark, root)
        self.wait_ms, self.late_ms = wait_ms, late_ms

    def take(self, shards: DataFrame, number: int) -> None:
        """A micro-batch of shards (run_id, shard, n_shards, path, n_rows, at); the same number again changes nothing."""
        path = f"{self.root}/batches/batch={number}"
        if self._done(path):
            return
        new = shards.where("run_id IS NOT NULL AND shard IS NOT NULL").withColumn("again", F.lit(1))
        before = [n for n in self._list("batches") if n < number]
        times = new.select("at")
        if before:
            times = times.unionByName(self._read("latest", "at timestamp", before[-1:]))
            held = self._read("batches", HELD, before[-1:]).where("state = 'waiting'").drop("state", "first_row").withColumn("again", F.lit(0))
            new = held.unionByName(new).join(self.plans(number).select("run_id"), "run_id", "left_anti")
        self._write(times.agg(F.max("at").alias("at")), f"{self.root}/latest/batch={number}")
        self._write(_judged(new), path)

    def expire(self) -> None:
        """Runs that have waited too long by what was taken go out with state "timeout"."""
        for number in self._list("batches")[-1:]:
            late = F.unix_millis("at") - F.lit(self.late_ms).cast("long")
            watermark = self._read("latest", "at timestamp", [number]).select(late.alias("t")).first().t
            over = F.unix_millis("at") + F.lit(self.wait_ms).cast("long") <= F.lit(watermark).cast("long")
            held = self._read("batches", HELD, [number]).where("state = 'waiting'")
            self._write(held.where(over).withColumn("state", F.lit("timeout")), f"{self.root}/timeouts/batch={number}")

    def plans(self, before: int | None = None) -> DataFrame:
        """(PLAN) of the runs that went out in the batches below ``before``, in all if it is None."""
        known = lambda what: [n for n in self._list(what) if before is None or n < before]
        whole = self._read("batches", HELD, known("batches")).where("state = 'merged'")
        return whole.unionByName(self._read("timeouts", HELD, known("timeouts"))).drop("n_shards", "at")

    def run(self, shards: DataFrame) -> DataFrame:
        """Take all shards that a stream has now and return the plans so far.

        Nothing times out before all are taken, so it is no matter how they are dealt to batches.
        """
        query = shards.writeStream.option("checkpointLocation", f"{self.root}/stream").trigger(availableNow=True).foreachBatch(self.take).start()
        query.awaitTermination()
        self.expire()
        return self.plans()


def _judged(rows: DataFrame) -> DataFrame:
    """(HELD) of shards (the columns of take, and again): the first of each, held ones before new ones, as a plan if the run's are all there.

    One shuffle by run and one sort serve both windows.
    """
    order = ["again", F.col("at").asc_nulls_last(), F.col("path").asc_nulls_last(), "n_rows"]
    copies = Window.partitionBy("run_id", "shard").orderBy(*order)
    copies_all = copies.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = Window.partitionBy("run_id").orderBy("shard")
    run_all = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = rows.repartition("run_id").select("run_id", "shard", "path", "n_rows", F.max("n_shards").over(copies_all).alias("n_shards"), F.min("at").over(copies_all).alias("at"), F.row_number().over(copies).alias("copy")).where("copy = 1")
    known = first.select("run_id", "shard", "path", "n_rows", F.coalesce(F.sum("n_rows").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.count("*").over(run_all).alias("n"), F.max("n_shards").over(run_all).alias("n_shards"), F.min("at").over(run_all).alias("at"))
    whole = F.col("n") >= F.col("n_shards")
    return known.select("run_id", "shard", "path", "n_rows", F.when(whole, F.col("before")).alias("first_row"), F.when(whole, "merged").otherwise("waiting").alias("state"), "n_shards", "at")


def merged(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows (run_id, shard, seq, ...) of merged runs with row_number, from 0, in the order of shards and of seq in them."""
    plan = plans.where("state = 'merged'").select("run_id", "shard", "first_row")
    place = F.row_number().over(Window.partitionBy("run_id", "shard").orderBy("seq")) - 1
    return rows.join(plan, ["run_id", "shard"]).withColumn("row_number", F.col("first_row") + place).drop("first_row")
