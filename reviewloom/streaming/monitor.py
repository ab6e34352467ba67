"""Monitored runs: polls come as a stream, steps follow a finished run, and each step runs once.

A micro-batch first folds its polls into the state of their runs, then takes
the steps one by one.  What a step did to which runs is latched by a file of
its own, written when the step's rows are, so a batch that is repeated after a
crash finds the steps that were done, and goes on with the next.  A step's
rows are written to a path of batch and step, which a repetition replaces.

Everything folded is a count, a least or a greatest, so the states are the
same however the polls are dealt to batches, and late polls are harmless.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "run_id string, n_polls long, polled_at timestamp, poll_id long, status string, ready_at timestamp, output string"
COMPACT = 16  # batches between two whole copies of the states


@dataclass(frozen=True)
class Step:
    """A step that a run takes once, when ``when`` holds of its state and the step ``after`` is latched.

    ``act`` makes the rows that the step produces of the due runs' states; it
    may be asked again for the same runs after a crash, before its rows were kept.
    """

    name: str
    when: str = "ready_at IS NOT NULL"
    after: str | None = None
    act: Callable[[DataFrame], DataFrame] | None = None


#: Results are fetched once a run is completed and names its output; then they are assembled, and then measured.
STEPS = [Step("downloaded"), Step("assembled", after="downloaded"), Step("benchmarked", after="assembled")]


class Batches:
    """Tables written by micro-batches below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _done(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _list(self, what: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{what}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        numbers = [int(s.getPath().getName().rpartition("=")[2]) for s in fs.listStatus(at)]
        return sorted(n for n in numbers if self._done(f"{self.root}/{what}/batch={n}"))

    def _write(self, df: DataFrame, path: str) -> None:
        if not self._done(path):
            df.write.mode("overwrite").parquet(path)

    def _read(self, what: str, schema: str, numbers: list[int]) -> DataFrame:
        paths = [f"{self.root}/{what}/batch={n}" for n in numbers]
        empty = self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths) if paths else empty


class Monitor(Batches):
    """The states and latches of runs."""

    def __init__(self, spark: SparkSession, root: str, steps: list[Step] = STEPS):
        super().__init__(spark, root)
        self.steps = steps

    def _rows(self, before: int | None = None) -> DataFrame:
        """The last whole copy of the states below ``before`` and what changed since."""
        known = lambda what: [n for n in self._list(what) if before is None or n < before]
        whole = known("whole")[-1:]
        return self._read("whole", STATE, whole).unionByName(self._read("changes", STATE, [n for n in known("changes") if not whole or n > whole[0]]))

    def states(self, before: int | None = None) -> DataFrame:
        """One row for each run as of the batches below ``before``, all if it is None."""
        return _folded(self._rows(before))

    def latches(self) -> DataFrame:
        """(run_id, step, batch) of all steps taken."""
        found = [self._read(f"steps/{s.name}", "run_id string", [n]).select("run_id", F.lit(s.name).alias("step"), F.lit(n).alias("batch")) for s in self.steps for n in self._list(f"steps/{s.name}")]
        return reduce(DataFrame.unionAll, found) if found else self.spark.createDataFrame([], "run_id string, step string, batch int")

    def _latched(self, step: str) -> DataFrame:
        return self._read(f"steps/{step}", "run_id string", self._list(f"steps/{step}")).distinct()

    def take(self, polls: DataFrame, number: int) -> None:
        """A micro-batch of polls (run_id, poll_id, polled_at, status, output); the same number again changes nothing."""
        ready = (F.col("status") == "completed") & (F.coalesce("output", F.lit("")) != "")
        latest = F.max_by("status", F.struct("polled_at", "poll_id"))
        seen = polls.where("run_id IS NOT NULL").dropDuplicates(["run_id", "poll_id"]).groupBy("run_id").agg(
            F.count("*").alias("n_polls"),
            F.max("polled_at").alias("polled_at"),
            F.max(F.struct("polled_at", "poll_id"))["poll_id"].alias("poll_id"),
            latest.alias("status"),
            F.min(F.when(ready, F.col("polled_at"))).alias("ready_at"),
            F.min_by(F.when(ready, F.col("output")), F.when(ready, F.struct("polled_at", "poll_id"))).alias("output"),
        )
        self._write(seen, f"{self.root}/changes/batch={number}")
        touched = self._read("changes", STATE, [number]).select("run_id")
        state = self.states(number + 1).join(touched, "run_id", "left_semi")
        for step in self.steps:
            path = f"{self.root}/steps/{step.name}/batch={number}"
            if self._done(path):
                continue
            due = state.where(step.when).join(self._latched(step.name), "run_id", "left_anti")
            if step.after:
                due = due.join(self._latched(step.after), "run_id", "left_semi")
            if step.act:
                step.act(due).write.mode("overwrite").parquet(f"{self.root}/rows/{step.name}/batch={number}")
            self._write(due.select("run_id"), path)  # the latch comes last
        if number % COMPACT == COMPACT - 1:
            self._write(self.states(number + 1), f"{self.root}/whole/batch={number}")

    def run(self, polls: DataFrame) -> DataFrame:
        """Take all polls that a stream has now and return the final states, with a flag for each step."""
        query = polls.writeStream.option("checkpointLocation", f"{self.root}/stream").trigger(availableNow=True).foreachBatch(self.take).start()
        query.awaitTermination()
        return self.report()

    def report(self) -> DataFrame:
        out = self.states()
        for step in self.steps:
            out = out.join(self._latched(step.name).withColumn(step.name, F.lit(True)), "run_id", "left").withColumn(step.name, F.coalesce(step.name, F.lit(False)))
        return out


def _folded(rows: DataFrame) -> DataFrame:
    at = F.struct("polled_at", "poll_id")
    return rows.groupBy("run_id").agg(F.sum("n_polls").alias("n_polls"), F.max("polled_at").alias("polled_at"), F.max(at)["poll_id"].alias("poll_id"), F.max_by("status", at).alias("status"), F.min("ready_at").alias("ready_at"), F.min_by("output", "ready_at").alias("output"))
