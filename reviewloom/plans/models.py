"""Queries of the trained text models: the labelled documents, with two aspects.  SQL can't express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import joint as J
from reviewloom.operators import metrics as M
from reviewloom.operators import models as L
from reviewloom.operators import transfer as X
from reviewloom.operators.samples import split
from reviewloom.plans.core import query
from reviewloom.staging import shared_dir, stage, table

ASPECTS = ["quality", "toxic"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    sentiment = (F.col("quality") - F.col("toxic")).cast("double")
    rows = d.select(F.col("doc_id").alias("review_id"), "text", F.col("lang").alias("style"), F.col("quality").alias("y_quality"), F.col("toxic").alias("y_toxic"), F.when(F.col("quality") == 1, sentiment).alias("s_quality"))
    return stage(split(rows, "review_id"), "split")


def _parts(rows: DataFrame) -> list[DataFrame]:
    return [rows.where(F.col("part") == p) for p in ("train", "calibration", "test")]


@query("q_tfidf_two_step")
def tfidf_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = stage(L.two_step(*_parts(_rows(spark, sf_dir)), ASPECTS).withColumn("approach", F.lit("tfidf_two_step")), "fact")
    per = M.rates(M.confusion(fact, "approach", "aspect"))
    return M.rounded(per.join(M.sentiment_errors(fact, "approach", "aspect").drop("approach"), "aspect"))


@query("q_joint_model")
def joint_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two aspects and their sentiment by one jointly trained model, on the rows that q_tfidf_two_step tests."""
    root = f"{shared_dir(spark)}/joint-{uuid.uuid4().hex}"
    fact = stage(J.joint(*_parts(_rows(spark, sf_dir)), ASPECTS, root), "fact").withColumn("approach", F.lit("joint"))
    per = M.rates(M.confusion(fact, "approach", "aspect"))
    return M.rounded(per.join(M.sentiment_errors(fact, "approach", "aspect").drop("approach"), "aspect"))


@query("q_learning_curve")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(L.learning_curve(*_parts(_rows(spark, sf_dir)), ASPECTS, [0.25, 0.5, 0.75, 1.0]))


@query("q_style_holdout")
def style_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held, test = _parts(_rows(spark, sf_dir))
    return M.rounded(L.leave_one_out(train.unionByName(test), held, ASPECTS, "style", ["de", "en", "es", "fr"]))


@query("q_transfer_metrics")
def transfer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the documents of one half of the sources, tried on all of the other half."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "text", (F.crc32(F.col("source").cast("binary")) % 2).alias("side"))
    given = F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"), F.explode(F.array_compact(given)).alias("aspect"), F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("polarity"))
    rows = stage(X.wide(d, labels, ASPECTS).join(d.select("review_id", "side"), "review_id"), "wide")
    fact = stage(X.transfer(rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side"), ASPECTS), "fact")
    return M.rounded(M.rates(M.confusion(fact, "aspect")).join(M.sentiment_errors(fact, "aspect"), "aspect"))
