"""Tables written between the steps of a job, in the folder all executors share.

A step that several later steps read, or that an iteration builds on, is
written once as Parquet and read again.  The lineage ends there, so a lost
executor costs the tasks it ran and no more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # of local applications without a shared folder, by application id


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own on a local master only.

    On a cluster without that setting this raises: a folder on one machine
    would not be seen by the others.  The setting is read, never written: it is
    fixed once a session runs.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="reviewloom-")
    return _own[app]


def stage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name
