"""Status logs as streams: latest state per key, windowed counts, finished runs.

Sources are folders that files are dropped into.  A query handles what is
there and ends (``availableNow``); its checkpoint remembers what it has seen,
so the next run takes only what is new, also after a lost driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.staging import shared_dir


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_batch: int = 64) -> DataFrame:
    """The event files of a folder as a stream.  A path that is a folder of part files is read as one."""
    schema = spark.read.parquet(f"{folder}/{glob}").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{glob}*")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there and return what its sink holds in the end."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = f"{root}/out"

    def put(batch: DataFrame, number: int) -> None:  # a repeated batch overwrites its own files
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    found = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in stream.dtypes)}, batch int").parquet(out)
    if mode != "complete":
        return found.drop("batch")
    last = found.agg(F.max("batch").alias("batch"))
    return found.join(F.broadcast(last), "batch", "left_semi").drop("batch")  # one row


def latest_state(events: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The last state of each key and how many there were; events of one time are ordered by their ids."""
    by = F.struct(order, "event_id")
    return events.groupBy(key).agg(F.count("*").alias("n_events"), *[F.max_by(c, by).alias(c) for c in columns], F.max(order).alias(order))


def status_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _run(latest_state(event_stream(spark, folder), "user_id", "ts", "event_type", "value"), "complete", "snapshot")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of tumbling windows by type; state older than the watermark goes unless the sink keeps complete results."""
    w = F.window("ts", width)
    sums = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _run(windowed_counts(event_stream(spark, folder)), "complete", "windows")


def finished_runs(shards: DataFrame) -> DataFrame:
    """Runs whose shards are all there, from a stream (run_id, shard, n_shards): emitted once, when the last one comes."""

    def count(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        seen, told = state.get if state.exists else ("", False)
        have = set(filter(None, seen.split(",")))
        total = 0
        for part in parts:
            have |= {str(x) for x in part["shard"]}
            total = max(total, int(part["n_shards"].max()))
        done = len(have) >= total and not told
        state.update((",".join(sorted(have)), told or done))
        yield pd.DataFrame({"run_id": [key[0]], "n_shards": [len(have)]}) if done else pd.DataFrame({"run_id": [], "n_shards": []})

    return shards.groupBy("run_id").applyInPandasWithState(count, "run_id string, n_shards long", "seen string, told boolean", "append", "NoTimeout")
