"""Scalar formulas over columns: polarities, probabilities, rates and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def ratio(over: Column, under: Column, empty: float | None = 0.0) -> Column:
    """over / under as a double; ``empty`` (None: null) where nothing is counted."""
    value = over.cast("double") / F.nullif(under.cast("double"), F.lit(0.0))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def polarity_score(polarity: Column) -> Column:
    return F.when(polarity == "negative", -1.0).when(polarity == "neutral", 0.0).when(polarity == "positive", 1.0)


def nearest_polarity(score: Column) -> Column:
    """The polarity whose score is nearest; of two alike the lower."""
    return F.when(score.isNull(), None).when(score <= -0.5, "negative").when(score <= 0.5, "neutral").otherwise("positive")


def banded_polarity(score: Column, dead: float = 0.2) -> Column:
    """Neutral within a dead zone around zero."""
    return F.when(score.isNull(), None).when(score > dead, "positive").when(score < -dead, "negative").otherwise("neutral")


def exact_polarity(score: Column) -> Column:
    """Only scores that saturate are polar; all others are neutral."""
    return F.when(score.isNull(), None).when(score == 1.0, "positive").when(score == -1.0, "negative").otherwise("neutral")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = clip(p, edge, 1 - edge)
    return F.log(q / (1 - q))


def entropy_bits(p: Column) -> Column:
    """Entropy of a coin of that probability."""
    q = clip(p, 0.0, 1.0)
    return F.when((q <= 0) | (q >= 1), F.lit(0.0)).otherwise(-(q * F.log2(F.greatest(q, F.lit(1e-300))) + (1 - q) * F.log2(F.greatest(1 - q, F.lit(1e-300)))))


def confidence(value: Column) -> Column:
    """A stated confidence in 0 to 100; 50 where it is missing or no number."""
    return clip(F.coalesce(value.cast("string").try_cast("double"), F.lit(50.0)), 0.0, 100.0)


def item_confusion(correct: Column, stated: Column) -> Column:
    return F.when(correct, 1 - confidence(stated) / 100).otherwise(F.lit(1.0))


def entropy_of_confidence(stated: Column) -> Column:
    return entropy_bits(clip(confidence(stated) / 100, 0.5, 1.0))


def chance_confusion(accuracy: Column) -> Column:
    """100 at an accuracy of one half, 0 at none or all."""
    return 100 * F.greatest(F.lit(0.0), 1 - F.abs(clip(accuracy, 0.0, 1.0) - 0.5) / 0.5)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the score interval of k successes in n; 0 and 1 without any trial."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = k / m, z * z
    under = 1 + z2 / m
    middle, margin = (p + z2 / (2 * m)) / under, z / under * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    return F.coalesce(F.greatest(F.lit(0.0), middle - margin), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), middle + margin), F.lit(1.0))


def specificity(tn: Column, fp: Column) -> Column:
    return ratio(tn, tn + fp)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    d = [x.cast("double") for x in (tp + fp, tp + fn, tn + fp, tn + fn)]
    return ratio(tp.cast("double") * tn - fp.cast("double") * fn, F.sqrt(d[0] * d[1] * d[2] * d[3]))


def kappa(agreed: Column, expected: Column) -> Column:
    """Agreement beyond chance; with nothing left to chance 1 for full agreement, else 0."""
    return F.when(expected == 1, F.when(agreed == 1, 1.0).otherwise(0.0)).otherwise((agreed - expected) / F.nullif(1 - expected, F.lit(0.0)))
