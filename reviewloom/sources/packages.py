"""Packages of files by content: a manifest, committed last, names what it holds by digest.

Contents are rows of one table, kept once however many packages name them.
A package is a manifest in a folder named by the package's own digest, and it
exists from the moment that folder's ``_SUCCESS`` does.  A writer that is lost
before leaves contents that no manifest names, and nothing that is read.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.staging import stage

MANIFEST = "name string, digest string, bytes long"
_OBJECT = "digest string, content binary, part string"


class Packages:
    """Packages below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def write(self, files: DataFrame) -> str:
        """Keep files (name, content as string or binary; null: empty) and return the package's digest.

        Equal files give an equal digest, in whatever order and however often a
        row comes.  A name that is null, or that has two contents, is refused.
        """
        content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
        found = files.select("name", content.alias("content")).withColumn("digest", F.sha2("content", 256))
        fresh = stage(found.dropDuplicates(["name", "digest"]), "package")
        manifest = fresh.select("name", "digest", F.octet_length("content").cast("long").alias("bytes"))
        wrong = manifest.groupBy("name").count().where("name IS NULL OR count > 1").limit(1).collect()
        if wrong:
            raise ValueError(f"name without one content: {wrong[0].name}")
        package = package_digest(manifest)
        if not self._there(f"{self.root}/manifests/{package}/_SUCCESS"):
            lacking = fresh.select("digest", "content", F.substring("digest", 1, 2).alias("part")).dropDuplicates(["digest"])
            lacking.join(self.objects().select("digest"), "digest", "left_anti").write.partitionBy("part").parquet(f"{self.root}/objects/by={uuid.uuid4().hex}")  # writers at one time don't share a folder
            manifest.write.mode("overwrite").parquet(f"{self.root}/manifests/{package}")  # the commit
        return package

    def objects(self) -> DataFrame:
        """All contents; what two writers kept at one time may be there twice."""
        path = f"{self.root}/objects"
        return self.spark.read.schema(_OBJECT).parquet(path).select("digest", "content", "part") if self._there(path) else self.spark.createDataFrame([], _OBJECT)

    def manifest(self, package: str) -> DataFrame:
        path = f"{self.root}/manifests/{package}"
        if not re.fullmatch("[0-9a-f]{64}", package) or not self._there(f"{path}/_SUCCESS"):
            raise FileNotFoundError(f"no package {package}")
        return self.spark.read.schema(MANIFEST).parquet(path)

    def read(self, package: str) -> DataFrame:
        """(name, digest, bytes, content) of a package."""
        named = self.manifest(package).withColumn("part", F.substring("digest", 1, 2))
        return named.join(self.objects().dropDuplicates(["digest"]), ["digest", "part"]).select("name", "digest", "bytes", "content")

    def damaged(self, package: str) -> DataFrame:
        """Files of a package whose content is not there or is another than its digest says."""
        kept = self.objects().select("digest", (F.sha2("content", 256) == F.col("digest")).alias("sound")).groupBy("digest").agg(F.every("sound").alias("sound"))
        return self.manifest(package).join(kept, "digest", "left").where(~F.coalesce("sound", F.lit(False))).select("name", "digest", "bytes")


def package_digest(manifest: DataFrame) -> str:
    """A digest of the set of (name, digest): of sorted lines in each of 4,096 parts, then of the parts in order."""
    line = F.sha2(F.concat_ws(":", "digest", "name").cast("binary"), 256)
    parts = manifest.select(line.alias("line")).groupBy(F.substring("line", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256).alias("d"))
    whole = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "d"))), "\n").cast("binary"), 256)
    return parts.agg(whole.alias("d")).first().d
