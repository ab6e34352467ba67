"""Jobs of named stages with a log of what each did, measured while it runs.

Metrics are observed at the top of a stage's plan, in the tasks that write its
rows, so they cost no second pass, and a task that is run again counts once.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, stage string, place int, state string, metrics map<string,string>, note string, seconds double, at timestamp"


class StageLog:
    """A run's stages below ``root``, a folder that driver and executors share; the log is appended to, never rewritten."""

    def __init__(self, spark: SparkSession, root: str, run_id: str | None = None):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id or uuid.uuid4().hex
        self.place = 0

    def _append(self, stage: str, state: str, metrics: dict | None = None, note: str | None = None, seconds: float | None = None) -> None:
        row = (self.run_id, stage, self.place, state, {k: None if v is None else str(v) for k, v in (metrics or {}).items()}, note, seconds)
        one = self.spark.createDataFrame([row], LOG.rpartition(",")[0]).coalesce(1)
        one.withColumn("at", F.current_timestamp()).write.mode("append").option("ignoreNullFields", False).json(f"{self.root}/log")

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(f"{self.root}/log")

    def status(self) -> DataFrame:
        """The last entry of each stage of each run."""
        last = F.max_by(F.struct("place", "state", "metrics", "note", "seconds", "at"), F.struct("at", F.col("state") != "running"))
        return self.log().groupBy("run_id", "stage").agg(last.alias("l")).select("run_id", "stage", "l.*")

    def _kept(self, stage: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{self.run_id}/{stage}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def run(self, stage: str, make: Callable[[], DataFrame], metrics: dict[str, Column] | None = None) -> DataFrame:
        """Write the rows of ``make()`` and log how many there were, with further aggregates of them; the frame that reads them back.

        A stage whose rows this run has written is read, not made again.  A
        failure is logged and raised.  Metrics of no rows are null, and rows 0.
        """
        self.place += 1
        path = f"{self.root}/data/{self.run_id}/{stage}"
        if self._kept(stage):
            return self.spark.read.parquet(path)
        self._append(stage, "running")
        begun = time.monotonic()
        seen = Observation()
        wanted = {"rows": F.count(F.lit(1)), **(metrics or {})}
        try:
            df = make()
            df.observe(seen, *[c.alias(n) for n, c in wanted.items()]).write.mode("overwrite").parquet(path)
        except Exception as e:
            self._append(stage, "failed", note=f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", seconds=time.monotonic() - begun)
            raise
        got = seen.get
        self._append(stage, "done", {n: got.get(n, 0 if n == "rows" else None) for n in wanted}, seconds=time.monotonic() - begun)
        return self.spark.read.schema(df.schema).parquet(path)
