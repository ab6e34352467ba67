"""Hand-picked views of a corpus: representative examples, best and worst labels, platform answers, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import titles_match
from reviewloom.operators.positions import cumulative


def representatives(df: DataFrame, predicates: dict[str, Column], order: list[Column | str], text: str = "text") -> DataFrame:
    """For each predicate its first row in the order, a text used once: the predicate that comes first keeps it."""
    out = None
    for k, (name, holds) in enumerate(predicates.items()):
        one = df.where(holds).orderBy(*order).limit(1).withColumn("kind", F.lit(name)).withColumn("rank_", F.lit(k))
        out = one if out is None else out.unionByName(one)
    first = F.row_number().over(Window.partitionBy(F.md5(text)).orderBy("rank_"))
    return out.withColumn("copy_", first).where("copy_ = 1").drop("copy_", "rank_")


def top_labels(fact: DataFrame, k: int) -> DataFrame:
    """Each row's k most probable labels with their place; equal ones in the labels' order."""
    place = F.row_number().over(Window.partitionBy("approach", "review_id").orderBy(F.desc("prob"), "idx"))
    return fact.withColumn("place", place).where(F.col("place") <= k).select("approach", "review_id", "place", "aspect", "prob")


def quartiles(df: DataFrame, score: str, key: str) -> DataFrame:
    """``df`` with rank, by the score from the best, ties by key, and quarter 1 (best) to 4; a null score is the worst.

    Ranks are counted by ranges of (score, key), so neither many scores nor many equal ones meet in one task.
    """
    n = df.count()
    ranked = cumulative(df, [F.desc_nulls_last(score), F.col(key)], {"rank": F.lit(1)})
    return ranked.withColumn("quarter", F.floor((F.col("rank") - 1) * 4 / F.lit(max(n, 1))) + 1)


def platform_answers(log: DataFrame, questions: list[str], letters: dict[str, str]) -> DataFrame:
    """(rater, item_id, a column per question) from a log (user, item_id, question, answer, at): the last answer counts.

    Users without a letter get their name's first character in upper case.
    """
    known = F.create_map(*[F.lit(x) for pair in sorted(letters.items()) for x in pair]) if letters else None
    first = F.upper(F.left("user", F.lit(1)))
    rater = first if known is None else F.coalesce(known[F.col("user")], first)
    return log.groupBy(rater.alias("rater"), "item_id").agg(*[F.max_by(F.when(F.col("question") == q, F.col("answer")), F.when(F.col("question") == q, F.col("at"))).alias(q) for q in questions])


def references(listed: DataFrame, found: DataFrame, key: str = "index") -> DataFrame:
    """Each listed reference (index, title, href) with its status by what services found (index, service, title)."""
    hits = found.join(listed.select(key, F.col("title").alias("own")), key).where(titles_match(F.col("title"), F.col("own"))).groupBy(key).agg(F.count("*").alias("n"), F.min("service").alias("service"))
    joined = listed.join(hits, key, "left")
    status = F.when(F.col("n") > 1, "verified").when(F.col("n") == 1, F.concat(F.lit("verified_by_"), F.col("service"))).when(F.col("href") != "", "link_only").otherwise("unverified")
    return joined.select(key, "title", status.alias("status"))
