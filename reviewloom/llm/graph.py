"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.staging import stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node that can be reached."""
    both = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).union(edges.select(F.col(b), F.col(a))), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("other"))
        met = labels.join(heard, labels.node == heard.a).select("node", F.least("root", "other").alias("near"), F.col("root").alias("old"))
        up = labels.select(F.col("node").alias("at"), F.col("root").alias("above"))
        after = stage(met.join(up, F.col("near") == F.col("at")).select("node", F.least("near", "above").alias("root"), "old"), "labels")
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
