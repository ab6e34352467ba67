"""From requests and replies of models to metrics, as one plan.

A review's labels stay in its row: counts per review are array functions, and
only the labels that are there are grouped by aspect, not the dense table of
every review and aspect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.dims import POLARITIES
from reviewloom.functions.scores import f1, polarity_score, ratio
from reviewloom.functions.text import json_block
from reviewloom.operators.batch import answered, last_by_key
from reviewloom.operators.metrics import rates
from reviewloom.operators.models import ask
from reviewloom.operators.prompting import aspect_map
from reviewloom.staging import stage

LABELS = "array<struct<aspect:string,sentiment:string>>"


def responses(manifest: DataFrame, results: DataFrame, aspects: list[str]) -> DataFrame:
    """(approach, custom_id, gold, reply, ok, predicted): every request with its last reply.

    ``manifest``: (custom_id, approach, gold); ``results``: (custom_id, pos,
    text), of which the one with the greatest pos counts.  A request without a
    reply, or with one that holds no JSON object, has ok 0 and predicts nothing.
    Gold and predicted labels of unknown aspects and polarities drop; a null
    gold is an empty one.
    """
    known = F.array(*[F.lit(a) for a in aspects])
    last = last_by_key(results.select("custom_id", "pos", "text"), "custom_id", "pos").select("custom_id", json_block(F.col("text")).alias("reply"))
    both = answered(manifest.select("custom_id", "approach", "gold"), last)
    empty = F.array().cast(LABELS)
    gold = F.filter(F.coalesce(F.col("gold").cast(LABELS), empty), lambda e: F.array_contains(known, e["aspect"]) & e["sentiment"].isin([p for p, _ in POLARITIES]))
    return both.select("approach", "custom_id", gold.alias("gold"), "reply", F.get_json_object("reply", "$").isNotNull().cast("int").alias("ok"), F.coalesce(aspect_map(F.col("reply"), known), empty).alias("predicted"))


def _names(labels: str) -> Column:
    return F.transform(labels, lambda e: e["aspect"])


def metrics(said: DataFrame, aspects: list[str]) -> tuple[DataFrame, DataFrame]:
    """(summary per approach, rates per approach and aspect) of ``responses``.

    The summary has micro and macro metrics, label and subset accuracy, samples
    F1 and Jaccard, the squared error of polarities over labels found in both
    (null if there are none), rows and the share of replies that could be read.
    """
    tp = F.size(F.array_intersect(_names("gold"), _names("predicted")))
    error = lambda g, p: polarity_score(p["sentiment"]) - polarity_score(g["sentiment"])
    squares = F.flatten(F.transform("gold", lambda g: F.transform(F.filter("predicted", lambda p: p["aspect"] == g["aspect"]), lambda p: error(g, p) * error(g, p))))
    row = said.select("approach", "ok", F.size("gold").alias("g"), F.size("predicted").alias("p"), tp.alias("tp"), F.aggregate(squares, F.lit(0.0), lambda a, x: a + x).alias("squares"))
    fp, fn = F.col("p") - F.col("tp"), F.col("g") - F.col("tp")
    total = row.groupBy("approach").agg(
        F.count("*").alias("n_examples"), F.avg("ok").alias("parse_success_rate"), F.sum("tp").alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"),
        (1 - F.sum(fp + fn) / (F.count("*") * len(aspects))).alias("label_accuracy"), F.avg((fp + fn == 0).cast("double")).alias("subset_accuracy"),
        F.avg(f1(F.col("tp"), fp, fn)).alias("samples_f1"), F.avg(ratio(F.col("tp"), F.col("tp") + fp + fn)).alias("samples_jaccard"), ratio(F.sum("squares"), F.sum("tp"), None).alias("sentiment_mse"),
    )
    total = stage(total, "totals")
    here = said.select("approach", _names("gold").alias("gold"), _names("predicted").alias("predicted"))
    each = here.select("approach", "gold", "predicted", F.explode(F.array_union("gold", "predicted")).alias("aspect"))
    of = lambda side: F.array_contains(side, F.col("aspect")).cast("int")
    found = each.groupBy("approach", "aspect").agg(F.sum(of("gold") * of("predicted")).alias("tp"), F.sum(of("predicted")).alias("p"), F.sum(of("gold")).alias("g"))
    grid = total.select("approach", "n_examples", F.explode(F.array(*[F.lit(a) for a in aspects])).alias("aspect")).join(found, ["approach", "aspect"], "left").na.fill(0, ["tp", "p", "g"])
    counts = grid.select("approach", "aspect", "tp", (F.col("n_examples") - F.col("p") - F.col("g") + F.col("tp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
    per = stage(rates(counts), "per_aspect")
    macro = per.groupBy("approach").agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    micro = total.select("*", ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), f1(tp, fp, fn).alias("micro_f1"))
    return micro.join(macro, "approach"), per


def evaluate(manifest: DataFrame, results: DataFrame, aspects: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(responses, summary, per aspect) of a finished batch; replies are read once."""
    said = stage(responses(manifest, results, aspects), "responses")
    return said, *metrics(said, aspects)


def evaluate_live(requests: DataFrame, manifest: DataFrame, aspects: list[str], client: Callable[[], Callable[[str], str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with replies from a client; they are written before they are read, so none is paid for twice."""
    replies = stage(ask(requests, client), "replies")
    return evaluate(manifest, replies.select("custom_id", F.lit(0).alias("pos"), "text"), aspects)
