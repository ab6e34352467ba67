"""Classical text models with pyspark.ml: TF-IDF, a classifier per aspect, a ridge regression per polarity."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.scores import clip
from reviewloom.operators import metrics as M
from reviewloom.operators import terms
from reviewloom.operators.samples import hash_order, ranked
from reviewloom.staging import shared_dir, stage


class LogCounts(Transformer):
    """1 + ln(count) in place of the counts in column tf.

    pyspark.ml has no such step, so this is a Python function of a row's few stored counts.
    """

    def _transform(self, dataset: DataFrame) -> DataFrame:
        damped = F.udf(lambda v: SparseVector(v.size, v.indices, 1.0 + np.log(v.values)), VectorUDT())
        return dataset.withColumn("tf", damped("tf"))


def tfidf(vocabulary: int = 5000, min_df: float = 1.0, sublinear: bool = False) -> Pipeline:
    """Words and pairs of words, counted, weighted and normalised, in column features; ``sublinear`` damps the counts."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
            NGram(n=2, inputCol="w1", outputCol="w2"),
            SQLTransformer(statement="SELECT *, concat(w1, w2) AS grams FROM __THIS__"),
            CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary, minDF=min_df),
            *([LogCounts()] if sublinear else []),
            IDF(inputCol="tf", outputCol="weighted"),
            Normalizer(inputCol="weighted", outputCol="features"),
            SQLTransformer(statement="SELECT * EXCEPT (w1, w2, grams, tf, weighted) FROM __THIS__"),
        ]
    )


def detector(train: DataFrame, label: str, rounds: int = 20) -> Callable[[DataFrame], DataFrame]:
    """A scorer that adds prob: balanced logistic regression, or the constant if only one class was seen.

    The model is written and read back, without the summary of its training: that holds the session, which can't be sent
    to tasks any more once something was observed in it.
    """
    of = train.agg(F.count(label).alias("n"), F.sum(label).alias("pos")).first()
    n, pos = of.n, of.pos or 0
    if not 0 < pos < n:
        return lambda df: df.withColumn("prob", F.lit(float(pos > 0)))
    weight = F.when(F.col(label) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    fitted = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / n, maxIter=rounds).fit(train.where(F.col(label).isNotNull()).withColumn("weight", weight))
    path = f"{shared_dir(train.sparkSession)}/detector-{uuid.uuid4().hex}"
    fitted.save(path)
    fitted = LogisticRegressionModel.load(path)
    return lambda df: fitted.transform(df).withColumn("prob", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def scorer(train: DataFrame, label: str, alpha: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """A scorer that adds sent_pred within -1 and 1: ridge regression, or the mean if there is nothing to fit."""
    of = train.where(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.avg(label).alias("mean"), F.countDistinct(label).alias("k")).first()
    if of.n < 2 or of.k < 2:
        return lambda df: df.withColumn("sent_pred", F.lit(float(of.mean or 0.0)))
    fitted = LinearRegression(featuresCol="features", labelCol=label, regParam=alpha / of.n, elasticNetParam=0.0, maxIter=20).fit(train.where(F.col(label).isNotNull()))
    return lambda df: fitted.transform(df).withColumn("sent_pred", clip(F.col("prediction"), -1.0, 1.0)).drop("prediction")


def two_step(train: DataFrame, held: DataFrame, test: DataFrame, aspects: list[str], vocabulary: int = 5000, min_df: float = 1.0, sublinear: bool = False) -> DataFrame:
    """The fact table of the test rows: features, a detector per aspect with a threshold calibrated on ``held``, polarity where it is known.

    Rows: (review_id, text, y_<aspect> and optionally s_<aspect>).
    """
    features = terms.fit(train, vocabulary, min_df, sublinear)
    fit, calibration, rest = map(features, (train, held, test))  # every aspect reads them
    out = None
    for a in aspects:
        label, sentiment = f"y_{a}", f"s_{a}"
        detect = detector(fit, label)

        def rows(df: DataFrame) -> DataFrame:
            return detect(df).select("review_id", F.lit(a).alias("aspect"), F.col(label).cast("int").alias("y_true"), "prob", *([sentiment, "features"] if sentiment in df.columns else []))

        threshold = M.calibrate(rows(calibration), "aspect").select("aspect", "threshold")
        scored = rows(rest)
        scored = scorer(fit, sentiment)(scored).withColumnRenamed(sentiment, "sent_true").drop("features") if sentiment in rest.columns else scored.withColumn("sent_true", F.lit(None).cast("double")).withColumn("sent_pred", F.lit(None).cast("double"))
        scored = scored.join(F.broadcast(threshold), "aspect").withColumn("y_pred", (F.col("prob") >= F.col("threshold")).cast("int"))  # one row
        out = scored if out is None else out.unionByName(scored)
    return out


def learning_curve(train: DataFrame, held: DataFrame, test: DataFrame, aspects: list[str], shares: list[float], least: int = 200) -> DataFrame:
    """Micro metrics at shares of the training rows (at least ``least``), each a prefix of one hash order."""
    n = train.count()
    order = stage(ranked(train.withColumn("order_", hash_order(7, F.col("review_id"))), "order_", "review_id").drop("order_"), "order")
    out = None
    for share in shares:
        k = min(n, max(least, int(n * share)))
        fact = two_step(order.where(F.col("place") <= k).drop("place"), held, test, aspects)
        row = M.micro_macro(fact).withColumn("share", F.lit(share)).withColumn("n_train", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


def leave_one_out(rows: DataFrame, held: DataFrame, aspects: list[str], column: str, values: list[str]) -> DataFrame:
    """Micro metrics on each value's rows, trained on the rows of all others."""
    out = None
    for v in values:
        fact = two_step(rows.where(F.col(column) != v), held.where(F.col(column) != v), rows.where(F.col(column) == v), aspects)
        row = M.micro_macro(fact).withColumn(column, F.lit(v))
        out = row if out is None else out.unionByName(row)
    return out


def ask(prompts: DataFrame, client: Callable[[], Callable[[str], str]], key: str = "custom_id", tries: int = 4) -> DataFrame:
    """(key, text, error) of each prompt: a client made once per task answers; failures are tried again and then recorded."""
    kind = dict(prompts.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reply = client()
        for part in parts:
            rows = []
            for k, prompt in zip(part[key], part["prompt"]):
                error = None
                for _ in range(tries):
                    try:
                        rows.append((k, reply(prompt), None))
                        break
                    except Exception as e:  # noqa: BLE001  what a service throws is its own affair
                        error = f"{type(e).__name__}: {e}"
                else:
                    rows.append((k, None, error))
            yield pd.DataFrame(rows, columns=[key, "text", "error"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, text string, error string")
