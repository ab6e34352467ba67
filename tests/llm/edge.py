"""A table with nulls, empty and long texts, repeated rows, and columns named like an operator's own."""

from __future__ import annotations

CLASHES = ["id", "fp", "component_id", "fingerprint", "score", "features", "prob", "probability", "prediction", "rawPrediction", "epoch", "place", "key", "hash", "block", "n", "k", "range", "quality_score", "toxicity_score", "mix_key", "kept_id", "text_root"]


def rows():
    long = "Ärger über lange Wörter. " * 4000 + "x" * 30000
    texts = [(0, "the quick brown fox jumps over it"), (1, None), (2, ""), (3, " \t\n"), (4, "the quick brown fox jumps over it"), (5, long), (None, "no id here at all"), (None, None), (6, "ünï 中文 \U0001f600 one\n\ntwo\nthree"), (6, "ünï 中文 \U0001f600 one\n\ntwo\nthree"), (7, "a"), (8, "a b"), (9, "LIKE Like like!!! %%% 123")]
    return [(i, t, None if k % 4 == 1 else "en", None if k % 3 == 2 else f"src{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


def table(spark, clashes=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES]) if clashes else df


def empty(spark):
    return table(spark).where("false")


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 0, 1), (5, 1, None), (6, None, 1), (None, 1, 1), (7, 1, 0), (8, 0, 0), (9, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
