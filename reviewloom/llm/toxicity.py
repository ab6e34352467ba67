"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a whole text are densities of lexicon words, how often they
stand near the second person, capitals, punctuation and obfuscated spellings.
The lexicon has a short fixed part and a learned part: words and beginnings of
words that labelled toxic texts use far more often.  It is learned on one half
of the training rows for the features of the other half, and the other way
round, so that the trees don't trust it more than it holds; texts are scored
with the lexicon of both halves.  Trees and calibration are fitted by
pyspark.ml on a bounded sample of labelled rows, the calibration on rows that
the trees did not see.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.arrow import LONG_TEXT, LONG_WORD, Memo, chunks, slices
from reviewloom.llm.quality import held_out, labelled
from reviewloom.staging import fresh_name, stage, table

#: Common insults and second-person pronouns of four languages.
INSULTS = set("idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic worthless disgusting clown jerk crap hate shut ugly filth".split()) | set("dumm trottel depp abschaum müll wertlos erbärmlich ekelhaft hasse hässlich versager blöd".split()) | set("imbécile crétin débile ordure nul minable dégoûtant connard stupide déteste".split()) | set("idiota imbécil estúpido basura inútil patético asqueroso payaso odio perdedor escoria".split())
SECOND_PERSON = set("you your yours yourself u ur du dich dir dein deine euch euer tu te toi ton tes vous votre vos tú ti usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$*", "oieastasi")
_WORDS = re.compile(r"\w(?:[\w@$*]*\w)?")
_WORD = _WORDS.findall
_PREFIXES = (4, 5, 7)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
NAMES = ["log_words", "fixed_density", "fixed_count", "strong_density", "strong_count", "weak_density", "weak_count", "weight_density", "weight_most", "near_density", "near_count", "second_density", "capitals", "shouted", "exclaimed", "asked", "punctuation", "repeated", "obfuscated", "spelled_out", "long_words"]
_NEAR = 3
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Training:
    """max_rows: labelled rows to learn from, about; a fixed share of the rows by a hash of their ids if there are more.

    max_terms: size of the learned lexicon; its terms have a G-squared of at
    least min_g2 and at least min_odds times the chance in toxic texts.
    """

    max_rows: int = 8000
    max_terms: int = 4000
    min_g2: float = 16.0
    min_odds: float = 3.0
    trees: int = 20
    depth: int = 3
    seed: int = 42


def _terms(word: str) -> list[str]:
    return [word] + [f"{word[:k]}*" for k in _PREFIXES if len(word) > k]


def _plain(word: str) -> tuple[str, bool]:
    """The word in lower case with look-alike signs read as letters, and whether there were any between letters."""
    inner = any(not c.isalpha() for c in word[1:-1]) and word[0].isalpha() and word[-1].isalpha()
    return (word.lower().translate(_LEET), True) if inner else (word.lower(), False)


def lexicon(rows: DataFrame, how: Training = Training()) -> dict[str, float]:
    """Term -> log odds, learned from ``rows`` (y, text); a term counts once per text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch, texts in slices(batches, "text"):
            for y, text in zip(batch.column(0).to_pylist(), texts):
                words = {_plain(m[0])[0] for m in _WORDS.finditer(text.decode())}
                (toxic if y else clean).update({t for w in words for t in _terms(w)})
        terms = list(toxic)  # a term of clean texts alone is never chosen
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([0] * len(terms), pa.int64())], names=["term", "toxic", "clean"])
        terms = list(clean)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([0] * len(terms), pa.int64()), pa.array([clean[t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    of = rows.agg(F.sum("y").alias("t"), F.count("y").alias("n")).first()
    if not of.t or of.t == of.n:
        return {}
    t, n = float(of.t), float(of.n - of.t)
    sums = rows.select("y", "text").mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where("a > 1")
    share = (F.col("a") + F.col("b")) / (t + n)
    part = lambda seen, total: F.when(seen > 0, seen * F.log(seen / (total * share))).otherwise(0.0)
    unseen = F.when(share < 1, (t - F.col("a")) * F.log(F.greatest((t - F.col("a")) / (t * (1 - share)), F.lit(1e-12))) + (n - F.col("b")) * F.log(F.greatest((n - F.col("b")) / (n * (1 - share)), F.lit(1e-12)))).otherwise(0.0)
    weight = F.log((F.col("a") + 0.5) / (t + 1)) - F.log((F.col("b") + 0.5) / (n + 1))
    found = sums.select("term", weight.alias("weight"), (2 * (part(F.col("a"), t) + part(F.col("b"), n) + unseen)).alias("g2"))
    found = found.where((F.col("g2") >= how.min_g2) & (F.col("weight") >= math.log(how.min_odds)))
    return {r.term: r.weight for r in found.orderBy(F.desc("g2"), "term").limit(how.max_terms).collect()}  # bounded by max_terms


class _Words(Memo):
    """word -> its flags below its lexicon weight in thousandths."""

    FIXED, STRONG, WEAK, SECOND, SHOUTED, OBFUSCATED, SINGLE, LONG = (1 << k for k in range(8))

    def __init__(self, learned: dict[str, float]):
        super().__init__(self.described, 120_000, LONG_WORD)
        self.learned = learned

    def described(self, word: str) -> int:
        plain, obfuscated = _plain(word)
        weight = max((self.learned.get(t, 0.0) for t in _terms(plain)), default=0.0)
        fixed = plain in INSULTS
        flags = self.FIXED * fixed | self.STRONG * (weight >= 2.5) | self.WEAK * (0 < weight < 2.5) | self.SECOND * (plain in SECOND_PERSON)
        flags |= self.SHOUTED * (len(word) > 1 and word.isupper()) | self.OBFUSCATED * obfuscated | self.SINGLE * (len(word) == 1) | self.LONG * (len(word) > 20)
        return int(weight * 1000) << 8 | flags


def _signs(text: bytes) -> np.ndarray:
    """How many bytes of a text are capitals, exclamation marks, question marks, punctuation, and punctuation that repeats the byte before; by blocks."""
    counts, before = np.zeros(5, np.int64), 0
    for start in range(0, len(text), _BLOCK):
        raw = np.frombuffer(text, np.uint8, min(_BLOCK, len(text) - start), start)
        sign = _PUNCTUATION[raw]
        same = np.append(raw[0] == before, raw[1:] == raw[:-1])
        counts += [((raw > 64) & (raw < 91)).sum(), (raw == 33).sum(), (raw == 63).sum(), sign.sum(), (sign & same).sum()]
        before = raw[-1]
    return counts


def dense(text: bytes, words: _Words) -> np.ndarray:
    """The features NAMES of one text."""
    decoded = text.decode()
    codes = np.fromiter((words[m[0]] for m in _WORDS.finditer(decoded)), np.int64) if len(text) > LONG_TEXT else np.array([words[w] for w in _WORD(decoded)], np.int64)
    n, size = max(len(codes), 1), max(len(text), 1)
    has = lambda flag: codes & flag != 0
    fixed, strong, weak, second = has(words.FIXED), has(words.STRONG), has(words.WEAK), has(words.SECOND)
    weight = (codes >> 8) / 1000
    hit = fixed | strong
    near = np.zeros(len(codes), bool)
    for k in range(1, _NEAR + 1):
        near[k:] |= second[:-k]
        near[:-k] |= second[k:]
    single = has(words.SINGLE)
    run = single[2:] & single[1:-1] & single[:-2]
    counts = [fixed.sum(), strong.sum(), weak.sum(), (hit & near).sum()]
    capitals, exclaimed, asked, signs, repeated = _signs(text) / size
    return np.array(
        [math.log1p(len(codes)), counts[0] / n, counts[0], counts[1] / n, counts[1], counts[2] / n, counts[2], weight.sum() / n, weight.max(initial=0), counts[3] / n, counts[3], second.sum() / n]
        + [capitals, has(words.SHOUTED).sum() / n, exclaimed, asked, signs, repeated, has(words.OBFUSCATED).sum() / n, run.sum() / n, has(words.LONG).sum() / n]
    )


def with_features(docs: DataFrame, learned: dict[str, float], name: str = "features", text_col: str = "text") -> DataFrame:
    """``docs`` with an array of the features of each whole text; a null text is an empty one.  The lexicon is bounded, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    @F.pandas_udf("array<double>")
    def featured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _Words(shared.value)
        for texts in batches:
            yield pd.Series([dense(t, words) for part in chunks(texts) for t in part], dtype=object)

    return docs.withColumn(name, featured(F.col(text_col).cast("string")))


@dataclass
class Model:
    learned: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float = 0.5


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Model:
    """A model from the labelled rows outside the held-out fold; with rows of one class only, or none, it is that class's constant."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(how.seed + 1)), F.lit(20))
    rows = stage(labelled(docs, labels, "toxic", how.max_rows, how.seed).select("y", "text", fold.alias("fold")), "labelled")
    of = rows.agg(F.sum("y").alias("t"), F.count("y").alias("n")).first()
    if not of.n or not of.t or of.t == of.n:
        return Model({}, None, None, 0.5 if not of.n else float(of.t > 0))
    halves = [rows.where(F.col("fold") % 2 == k) for k in (0, 1)]
    lexica = [lexicon(half, how) for half in halves]
    featured = with_features(halves[0], lexica[1]).union(with_features(halves[1], lexica[0]))
    ready = stage(featured.select(F.col("y").cast("double").alias("label"), "fold", "features").coalesce(4), "features").select("label", "fold", array_to_vector("features").alias("features"))
    fit, rest = ready.where("fold < 14"), ready.where("fold >= 14")
    seen = fit.agg(F.countDistinct("label").alias("k")).first()["k"]
    if seen < 2:
        fit = rest = ready  # too few rows to hold any back
    trees = GBTClassifier(maxIter=how.trees, maxDepth=how.depth, stepSize=0.2, minInstancesPerNode=3, seed=how.seed).fit(fit)
    raw = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw.select("label", array_to_vector(F.array("raw")).alias("raw"))) if rest.agg(F.countDistinct("label").alias("k")).first()["k"] == 2 else None
    return Model(lexicon(rows, how), trees, calibration)


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, the calibrated probability; a hundredth of the trees' own keeps the order within calibrated steps."""
    if model.trees is None:
        return docs.withColumn(name, F.lit(model.prior))
    taken = [fresh_name(docs, x) for x in ("tox_features", "tox_raw", "tox_probability", "tox_class", "tox_one", "tox_calibrated")]
    features, raw, probability, kind, one, calibrated = taken
    rows = with_features(docs, model.learned, features, text_col).withColumn(features, array_to_vector(features))
    trees = model.trees.copy().setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(probability).setPredictionCol(kind)
    rows = trees.transform(rows)
    p = vector_to_array(F.col(probability))[1]
    if model.calibration is None:
        return rows.withColumn(name, p).drop(*taken)
    rows = model.calibration.copy().setFeaturesCol(one).setPredictionCol(calibrated).transform(rows.withColumn(one, array_to_vector(F.array(p))))
    return rows.withColumn(name, 0.99 * F.least(F.greatest(F.col(calibrated), F.lit(0.0)), F.lit(1.0)) + 0.01 * p).drop(*taken)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, how: Training = Training()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, by a model trained on the labelled rows outside the held-out fold.

    Nulls: a null text is an empty one; a null id is not held out and never
    learned from.  Repeated rows stay; a labelled id with several texts is
    learned from each, within max_rows.  Empty documents or labels work.  A
    text of any length is scored whole.  Inputs of a score are the text alone.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels, how))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, how: Training = Training()) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with their own columns."""
    name = fresh_name(docs, "toxicity_score")
    return score(docs, train(docs, labels, how), name).where(F.col(name) < threshold).drop(name)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
