"""Snapshots of progress: one for each trigger, of all polls so far.

A snapshot is written to a path of its batch, after the batch's polls are
folded into the states of their runs.  A batch that is repeated after a crash
finds both done, so a restart neither repeats nor skips a snapshot.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.streaming.monitor import Monitor

SNAPSHOT = "status string, n_runs long, n_ready long, n_stalled long, n_polls long, last_polled_at timestamp, watermark timestamp"


class Snapshots(Monitor):
    """Snapshots below ``root``; a run stalls if its last poll lies ``late`` or more before the last poll of all."""

    def __init__(self, spark: SparkSession, root: str, late: timedelta = timedelta(days=2)):
        super().__init__(spark, root, [])
        self.late = late

    def take(self, polls: DataFrame, number: int) -> None:
        """A micro-batch of polls (run_id, poll_id, polled_at, status, output); the same number again changes nothing.

        A poll without a time is counted, but makes no run ready.
        """
        super().take(polls, number)
        path = f"{self.root}/snapshots/batch={number}"
        if self._done(path):
            return
        last = self._rows(number + 1).agg(F.max("polled_at").alias("t")).first().t
        watermark = F.lit(None if last is None else last - self.late).cast("timestamp")
        counted = self.states(number + 1).groupBy("status").agg(
            F.count("*").alias("n_runs"),
            F.count("ready_at").alias("n_ready"),
            F.count_if(F.col("ready_at").isNull() & (F.col("polled_at") <= watermark)).alias("n_stalled"),
            F.sum("n_polls").alias("n_polls"),
            F.max("polled_at").alias("last_polled_at"),
        )
        self._write(counted.withColumn("watermark", watermark), path)

    def start(self, polls: DataFrame, every: str | None = None) -> StreamingQuery:
        """Take the stream's polls ``every`` so often, until it is stopped; by default all that are there, then end."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return polls.writeStream.option("checkpointLocation", f"{self.root}/stream").trigger(**trigger).foreachBatch(self.take).start()

    def snapshots(self) -> DataFrame:
        """(batch and the columns of SNAPSHOT) of all snapshots."""
        done = self._list("snapshots")
        empty = self.spark.createDataFrame([], f"{SNAPSHOT}, batch int")
        return self.spark.read.option("basePath", f"{self.root}/snapshots").schema(f"{SNAPSHOT}, batch int").parquet(*[f"{self.root}/snapshots/batch={n}" for n in done]) if done else empty

    def latest(self) -> DataFrame:
        return self._read("snapshots", SNAPSHOT, self._list("snapshots")[-1:])
