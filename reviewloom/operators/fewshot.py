"""Requests with labelled examples: drawn once for all reviews, or retrieved for each.

A pool has the columns doc_id, text and aspects, an array of (aspect,
sentiment).  Draws are by hash of seed and id, so they don't depend on how rows
are dealt.  Only ids are ranked; texts join the few that are chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.operators.retrieval import token_overlap

#: Examples in a prompt, by variant. Fixed values.
SHOTS = {"zero-shot": 0, "zero-shot-glossary": 0, "few-shot": 3, "few-shot-diverse": 5, "retrieval-few-shot": 5, "two-pass": 4, "aspect-by-aspect": 0}

LABEL = "Which of the aspects below does this course review clearly discuss, and is what it says positive, neutral or negative? Reply with JSON only: {\"aspects\": [{\"aspect\": name, \"sentiment\": value}]}. Leave out what is doubtful; an empty list is a valid reply.\nAspects: "
NOTES = {
    "few-shot": "The examples show the form of a reply and how labels are used.",
    "few-shot-diverse": "The examples differ in style and in how many aspects they have; they show the form of a reply.",
    "retrieval-few-shot": "The examples share words with the review; they show how labels are used.",
}
#: Numbers of aspects of which a diverse draw has one example each.
SIZES = (1, 2, 3)
_EXAMPLE = "struct<doc_id:{0},text:string,aspects:array<struct<aspect:string,sentiment:string>>>"


def drawn(pool: DataFrame, k: int, seed: int, diverse: bool = False) -> DataFrame:
    """One row (examples): up to k examples, the same for every review.

    A diverse draw begins with one example of each of SIZES, as far as the pool
    has them, and goes on with any.  A text that was drawn before isn't repeated
    or replaced, so there may be fewer than k.  No rows in the pool, or k of 0:
    an empty array.
    """
    any_ = len(SIZES) + 1
    n = F.size(F.coalesce("aspects", F.array().cast("array<struct<aspect:string,sentiment:string>>")))
    slot = F.when(n.isin(*SIZES), n) if diverse else F.lit(None).cast("int")
    ids = pool.select("doc_id", F.explode(F.array_compact(F.array(slot, F.lit(any_)))).alias("slot"))
    ids = ids.withColumn("turn", F.row_number().over(Window.partitionBy("slot").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "slot", "doc_id")), "doc_id"))).where(F.col("turn") <= k)
    ids = ids.where((F.col("slot") == any_) | (F.col("turn") == 1))
    picked = pool.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "aspects").join(F.broadcast(ids), "doc_id")  # k + 3 ids at most
    row = picked.agg(F.array_sort(F.collect_list(F.struct("slot", "turn", "doc_id", "text", "aspects"))).alias("all"))
    rest = F.lit(k) - F.size(F.filter("all", lambda e: e["slot"] < any_))
    row = row.select(F.filter("all", lambda e: (e["slot"] < any_) | (e["turn"] <= rest)).alias("all"))
    once = F.filter("all", lambda e, i: ~F.exists(F.slice("all", 1, i), lambda before: before["text"] == e["text"]))
    shape = _EXAMPLE.format(dict(pool.dtypes)["doc_id"])
    return row.select(F.slice(F.transform(once, lambda e: F.struct(e["doc_id"].alias("doc_id"), e["text"].alias("text"), e["aspects"].alias("aspects"))), 1, max(k, 0)).cast(f"array<{shape}>").alias("examples"))


def retrieved(reviews: DataFrame, pool: DataFrame, k: int, seed: int) -> DataFrame:
    """(custom_id, examples): k pool rows for each review, drawn from the 3k that share most tokens with it.

    Pool rows that share none count with 0, so every review has k examples if
    the pool has as many rows.  custom_id and doc_id are unique.
    """
    queries = reviews.select(F.col("custom_id").alias("query_id"), "text")
    near = token_overlap(queries, pool, 3 * k, min_overlap=0)
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "query_id", "doc_id")), "doc_id"))
    chosen = near.withColumn("turn", turn).where(F.col("turn") <= k).select("query_id", "doc_id", "turn")
    full = chosen.join(pool.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "aspects"), "doc_id")
    per = full.groupBy(F.col("query_id").alias("custom_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "doc_id", "text", "aspects"))).alias("all"))  # k rows each
    return per.select("custom_id", F.transform("all", lambda e: F.struct(e["doc_id"].alias("doc_id"), e["text"].alias("text"), e["aspects"].alias("aspects"))).alias("examples"))


def shown(examples: Column) -> Column:
    """Examples as text: each review with the reply that is right for it, aspects by name."""
    reply = lambda e: F.to_json(F.struct(F.array_sort(F.coalesce(e["aspects"], F.array().cast("array<struct<aspect:string,sentiment:string>>"))).alias("aspects")))
    block = lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\n"), e["text"], F.lit("\nReply: "), reply(e), F.lit("\n\n"))
    return F.array_join(F.transform(examples, block), "")


def requests(reviews: DataFrame, pool: DataFrame, aspects: list[str], variant: str, seed: int, shots: int | None = None, glossary: dict[str, str] | None = None) -> DataFrame:
    """(custom_id, text, examples, prompt) of each review (custom_id, text); a null text is an empty one.

    ``glossary`` has a line for an aspect and is used by zero-shot-glossary.
    Examples that are drawn once reach every task as one row of ``shots`` texts.
    """
    if variant not in SHOTS:
        raise ValueError(f"unknown variant {variant}")
    k = SHOTS[variant] if shots is None else shots
    asked = reviews.select("custom_id", F.coalesce("text", F.lit("")).alias("text"))
    if variant == "retrieval-few-shot" and k > 0:
        asked = asked.join(retrieved(asked, pool, k, seed), "custom_id", "left")
    elif k > 0:
        asked = asked.crossJoin(F.broadcast(drawn(pool, k, seed, variant in ("few-shot-diverse", "two-pass"))))  # one row
    else:
        asked = asked.withColumn("examples", F.lit(None))
    shape = _EXAMPLE.format(dict(pool.dtypes)["doc_id"])
    asked = asked.withColumn("examples", F.coalesce(F.col("examples").cast(f"array<{shape}>"), F.array().cast(f"array<{shape}>")))
    lines = [LABEL + ", ".join(aspects)]
    if variant == "zero-shot-glossary":
        lines += ["What they mean:", *[f"{a}: {(glossary or {}).get(a, '')}" for a in aspects]]
    lines += [NOTES[variant]] if variant in NOTES else []
    return asked.select("custom_id", "text", "examples", F.concat(F.lit("\n".join(lines) + "\n\n"), shown(F.col("examples")), F.lit("Review:\n"), F.col("text")).alias("prompt"))
