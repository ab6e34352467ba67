"""From annotation spans to labelled reviews, and models trained on one corpus and tried on another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.dims import ASPECT_CODES, OPINION_CODES
from reviewloom.functions.scores import polarity_score
from reviewloom.functions.text import collapse_space
from reviewloom.operators.agreement import majority
from reviewloom.operators.models import two_step
from reviewloom.operators.retrieval import contained, nearest_opinions
from reviewloom.operators.samples import split
from reviewloom.staging import stage


def decoded(raw: Column, codes: dict[str, str]) -> Column:
    """The value of a raw code; null if it has none."""
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.trim(raw)]


def review_labels(pairs: DataFrame, *review: str) -> DataFrame:
    """(review, aspect, polarity): pairs of raw codes (aspect_raw, opinion_raw) decoded, aspects without a code dropped.

    An aspect with several opinions takes the most frequent, and neutral if two lead.
    """
    known = pairs.select(*review, decoded(F.col("aspect_raw"), ASPECT_CODES).alias("aspect"), decoded(F.col("opinion_raw"), OPINION_CODES).alias("polarity"))
    return majority(known.where("aspect IS NOT NULL AND polarity IS NOT NULL"), "polarity", *review, "aspect", tie="neutral").drop("n")


def labelled(annotations: DataFrame) -> DataFrame:
    """(file, span, text, aspect, polarity) of annotations as the XML reader gives them.

    span is "begin-end" of the review in its file.  Reviews without text or
    without a known aspect have no row.  A file's text meets its own spans
    only; marks meet spans by buckets of positions.
    """
    spans = annotations.where("kind = 'span'").select("file", F.col("begin").alias("span_begin"), F.col("end").alias("span_end")).distinct()
    texts = annotations.where("kind = 'text'").select("file", F.col("aspect_raw").alias("whole"))
    span = F.concat_ws("-", "span_begin", "span_end")
    cut = F.substring(F.col("whole"), F.col("span_begin") + 1, F.col("span_end") - F.col("span_begin"))
    reviews = spans.join(texts, "file").select("file", span.alias("span"), collapse_space(cut).alias("text")).where("text <> ''")
    marks = annotations.where("kind = 'mark'").select("file", "begin", "end", F.trim("aspect_raw").alias("aspect_raw"), F.trim("opinion_raw").alias("opinion_raw"))
    inside = contained(spans, marks).withColumn("span", span).drop("span_begin", "span_end").withColumnRenamed("span", "span_begin")
    pairs = nearest_opinions(inside).withColumnRenamed("span_begin", "span")
    return reviews.join(review_labels(pairs, "file", "span"), ["file", "span"])


def overlap(labels: DataFrame) -> DataFrame:
    """A row per aspect: reviews that have it and how many say what; the most frequent first by place, equal ones by name."""
    count = lambda p: F.count(F.when(F.col("polarity") == p, 1)).alias(p)
    per = labels.groupBy("aspect").agg(F.count("*").alias("review_count"), count("positive"), count("neutral"), count("negative"))
    # a row per aspect: one array, sorted
    first = F.array_sort(F.collect_list(F.struct((-F.col("review_count")).alias("k"), "aspect", "review_count", "positive", "neutral", "negative")))
    return per.agg(first.alias("l")).select(F.posexplode("l").alias("p", "r")).select((F.col("p") + 1).cast("long").alias("place"), "r.aspect", "r.review_count", "r.positive", "r.neutral", "r.negative")


def strict_overlap(labels: DataFrame, support: int, least: int, *review: str) -> DataFrame:
    """Labels of aspects that ``support`` reviews or more have, of reviews that still have ``least`` of them."""
    strong = labels.groupBy("aspect").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("aspect")
    kept = labels.join(F.broadcast(strong), "aspect")  # a row per aspect
    enough = kept.groupBy(*review).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*review)
    return kept.join(enough, list(review), "left_semi").select(*labels.columns)


def wide(reviews: DataFrame, labels: DataFrame, aspects: list[str]) -> DataFrame:
    """(review_id, text, y_<aspect>, s_<aspect>): reviews that have one of the aspects, flags and polarity scores."""
    has = lambda a: F.max(F.when(F.col("aspect") == a, 1))
    flags = [F.coalesce(has(a), F.lit(0)).alias(f"y_{a}") for a in aspects]
    scores = [F.max(F.when(F.col("aspect") == a, polarity_score(F.col("polarity")))).cast("double").alias(f"s_{a}") for a in aspects]
    per = labels.where(F.col("aspect").isin(aspects)).groupBy("review_id").agg(*flags, *scores)
    return reviews.select("review_id", "text").join(per, "review_id")


def transfer(synthetic: DataFrame, real: DataFrame, aspects: list[str], seed: int = 42) -> DataFrame:
    """The fact table of all real reviews by models of the synthetic ones.

    Both sides as ``wide`` gives them.  The synthetic side is split as for its
    own evaluation: it trains and calibrates, and its test part stays unused.
    """
    parts = stage(split(synthetic, "review_id", seed=seed), "split")
    train, held = (parts.where(F.col("part") == p).drop("part") for p in ("train", "calibration"))
    return two_step(train, held, real, aspects)
