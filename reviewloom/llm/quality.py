"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Tokens are words and runs of punctuation.  A text's features are hashed
n-grams of two kinds: of the tokens as written (one and two in a row), and of
their forms (one to three in a row), a form being a word's capitals and digits,
whether it repeats the token before, or the punctuation itself.  A feature's
value is its share of the text's n-grams of its kind, so length doesn't matter
and an n-gram of any place counts alike.  The model is trained with FTRL-proximal
updates, one document at a time, on a bounded sample of labelled rows, and a
score is the logistic function of a sparse dot product with its weights.  The
n-grams of a very long text are counted block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.arrow import LONG_TEXT, LONG_WORD, Memo, chunks, slices
from reviewloom.staging import fresh_name, table

BITS = 18
KINDS = 5  # surface 1- and 2-grams, form 1- to 3-grams
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_TOKEN = _TOKENS.findall
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_STEP = np.uint64(0x100000001B3)
_FORMS = 64
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Training:
    """max_rows: labelled rows to learn from, about; a fixed share of the rows by a hash of their ids if there are more."""

    max_rows: int = 8000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 0.02
    l1: float = 1e-5
    l2: float = 1e-4
    seed: int = 42


def _coded(token: str) -> int:
    """The hash of a token above 8 bits of its form."""
    if not (token[0].isalnum() or token[0] == "_"):
        form = 16 + sum(token.encode()) * (1 + min(len(token), 3)) % 40
    elif token.isdigit():
        form = 1
    elif any(c.isdigit() for c in token):
        form = 2
    elif token.isupper():
        form = 3 if len(token) > 1 else 4
    elif token.istitle():
        form = 5
    else:
        form = 6 if token.islower() else 7
    h = 0
    for c in token.encode():
        h = (h * 1099511628211 ^ c) & 0xFFFFFFFFFFFF
    return h << 8 | form


_tokens = Memo(_coded, 120_000, LONG_WORD)


def _words_and_forms(flat: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word, form = flat >> np.uint64(8), flat & np.uint64(255)
    same = np.zeros(len(flat), np.uint64)
    same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    return word, form + np.uint64(_FORMS) * same


def _hashed(codes: np.ndarray, n: int, kind: int) -> np.ndarray:
    """The feature of each n codes in a row."""
    m = len(codes) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = (h * _STEP + codes[j : j + m] + np.uint64(1)) * _SEEDS[kind]
        h ^= h >> np.uint64(29)
    return (h * _SEEDS[0] >> np.uint64(64 - BITS)).astype(np.int64)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per n-gram of all texts: its feature, its text and its value; n-grams don't cross texts."""
    coded = [[_tokens[t] for t in _TOKEN(x.decode())] for x in texts]
    sizes = np.array([len(c) for c in coded])
    flat = np.fromiter((v for c in coded for v in c), np.int64, sizes.sum()).view(np.uint64)
    text = np.repeat(np.arange(len(texts)), sizes)
    word, form = _words_and_forms(flat, text)
    features, owners, kinds = [], [], []
    for kind, (codes, n) in enumerate(((word, 1), (word, 2), (form, 1), (form, 2), (form, 3))):
        m = len(codes) - n + 1
        if m < 1:
            continue
        inside = text[:m] == text[n - 1 :]
        features.append(_hashed(codes, n, kind)[inside])
        owners.append(text[:m][inside])
        kinds.append(np.full(inside.sum(), kind))
    if not features:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    feature, owner, kind = map(np.concatenate, (features, owners, kinds))
    total = np.bincount(owner * KINDS + kind, minlength=len(texts) * KINDS)
    return feature, owner, 1.0 / total[owner * KINDS + kind]


def _long(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one long text and their values, without all of its tokens or n-grams in memory as objects."""
    flat = np.fromiter((_tokens[m[0]] for m in _TOKENS.finditer(text.decode())), np.int64).view(np.uint64)
    word, form = _words_and_forms(flat, np.zeros(len(flat), np.int8))
    summed = np.zeros(1 << BITS)
    for kind, (codes, n) in enumerate(((word, 1), (word, 2), (form, 1), (form, 2), (form, 3))):
        m = len(codes) - n + 1
        for start in range(0, m, _BLOCK):
            summed += np.bincount(_hashed(codes[start : min(start + _BLOCK, m) + n - 1], n, kind), minlength=1 << BITS) / m
    feature = np.nonzero(summed)[0]
    return feature, summed[feature]


def _vectors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, values) of each text."""
    if any(len(t) > LONG_TEXT for t in texts):
        for t in texts:
            yield _long(t) if len(t) > LONG_TEXT else next(_vectors([t]))
        return
    feature, owner, value = _grams(texts)
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(texts))) if len(owner) else np.zeros(len(texts), np.int64)
    for a, b in zip([0, *ends[:-1]], ends):
        own, at = np.unique(feature[order[a:b]], return_inverse=True)
        yield own, np.bincount(at, value[order[a:b]], minlength=len(own))


def _dots(weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    if any(len(t) > LONG_TEXT for t in texts):
        return np.array([weights[i] @ x for i, x in _vectors(texts)]) + weights[-1]
    feature, owner, value = _grams(texts)
    return np.bincount(owner, weights[feature] * value, minlength=len(texts)) + weights[-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], how: Training) -> np.ndarray:
    """Weights (one more for the bias) from rows of (features, values, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(how.seed)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= how.l1, 0.0, -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for k in order.permutation(len(rows)):
            i, x, y = rows[k]
            w = weights(i)
            g = (sigmoid(w @ x) - y) * x
            n_next = n[i] + g * g
            z[i] += g - (np.sqrt(n_next) - np.sqrt(n[i])) / how.alpha * w
            n[i] = n_next
    return weights(slice(None))


def held_out(id_col: Column, remainder: int = 0) -> Column:
    """Whether the row's fold, crc32 of its id as text modulo 5, is ``remainder``; rows without an id are not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def sample(labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """(doc_id, y): the labelled rows outside the held-out fold, or a share of them by a hash if there are more than max_rows.

    Rows without id or label are left out; an id that is labelled twice counts with its greater label.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    return known.where((F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """(doc_id, y, text): about max_rows labelled rows at most, however often an id is repeated; equal rows count once."""
    chosen = F.broadcast(sample(labels, label, max_rows, seed))  # about max_rows ids
    n = docs.select("doc_id").join(chosen, "doc_id").count()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    share = int((1 << 30) * min(1.0, max_rows / max(n, 1)))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 2)), F.lit(1 << 30)) < share)
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "y", "digest"]).select("doc_id", "y", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", how: Training = Training()) -> np.ndarray:
    """The weights.  Without any labelled row they are zero, so that every score is one half."""
    rows = labelled(docs, labels, label, how.max_rows, how.seed).withColumn("place", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text").cast("binary")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            i, x = zip(*[(np.append(own, 1 << BITS).astype(np.int32), np.append(values, 1.0).astype(np.float32)) for own, values in _vectors(texts)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["place", "y", "i", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            seen += [(i.values.to_numpy(), x.values.to_numpy().astype(np.float64), y) for i, x, y in zip(batch.column("i"), batch.column("x"), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([ftrl(seen, how).astype("<f4").tobytes()])], names=["w"])

    extracted = rows.select("place", "y", "text").mapInArrow(features, "place string, y int, i array<int>, x array<float>")
    # one task learns from the bounded sample, in an order that doesn't depend on how it was dealt
    one = extracted.repartition(1).sortWithinPartitions("place", "y").mapInArrow(fit, "w binary")
    found = one.collect()  # the model: 1 MB
    return np.frombuffer(found[0].w, "<f4").astype(np.float64) if found else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with one more column: the score of each whole text.  A null text is an empty one and gets the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype("<f4"))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value.astype(np.float64)
        for texts in batches:
            out = [sigmoid(_dots(w, part)) for part in chunks(texts)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, scored(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Training = Training()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, by a model trained on the labelled rows outside the held-out fold.

    Nulls: a null text is an empty one; a null id is not held out and never
    learned from.  Repeated rows stay; a labelled id with several texts is
    learned from each, within max_rows.  Empty documents or labels work.  A
    text of any length is scored whole.  Inputs of a score are the text alone.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, "quality", how))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, how: Training = Training()) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with their own columns."""
    name = fresh_name(docs, "quality_score")
    return score(docs, train(docs, labels, "quality", how), name).where(F.col(name) >= threshold).drop(name)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
