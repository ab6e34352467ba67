"""Mixing sources to target weights by temperature.

A source's share of the tokens is raised to an exponent between 0 (all sources
alike) and 1 (as they are) and normalised.  The exponent is bisected to the
largest whose weights still have the target entropy, or to the smallest that
repeats no source more often than allowed within the budget.  Weights become
token quotas, and each quota is realised by block permutations: a source's
documents are dealt to blocks by a hash of their ids and texts, one order of the blocks
is drawn for each source and kept in all its epochs, whole epochs are used
while the quota holds out, and of the last epoch the leading blocks, with the
last of them cut at the budget.

Only DataFrame functions are used.  What is bisected is a table with one row
per source; each round evaluates 32 exponents in one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.staging import fresh_name, stage, table

#: Words of a text are the runs between bytes 32 and 9 to 13.
WORD_GAPS = "[ \\t\\n\\x0b\\f\\r]+"
_WAYS, _ROUNDS = 32, 6  # the exponent is found to 1 / 32**6


@dataclass(frozen=True)
class Target:
    """What the mixture is to meet.

    entropy: this share of the greatest entropy, that of equal weights; or
    repeats: no source is used more than so many times (entropy is then None).
    budget: tokens of the mixture, None for as many as there are.
    block_tokens: about so many tokens to a block.
    """

    entropy: float | None = 0.95
    repeats: float | None = None
    budget: int | None = None
    block_tokens: int = 1_000_000
    seed: int = 42


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), lambda w: w != "")).cast("long")


def _hash(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("long")


def _row_hash(seed: int, id: Column, text: Column) -> Column:
    """Texts count too, so that rows without an id, or of one id, don't all meet in one block."""
    return _hash(F.lit(seed), id, F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def source_key(source: Column) -> Column:
    """Rows without a source form one of their own, apart from any name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _measures(totals: DataFrame, grid: list[float], total: int, budget: int) -> list[tuple[float, float]]:
    """(entropy, most repeats) of the mixture at each exponent of the grid."""
    share = F.log(F.col("tokens") / F.lit(float(total)))
    spread = totals.select(share.alias("ln"), F.posexplode(F.array(*[F.lit(a) for a in grid])).alias("k", "a"))
    power = F.exp(F.col("a") * F.col("ln"))
    sums = spread.groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * F.col("ln")).alias("u"), F.max((F.col("a") - 1) * F.col("ln")).alias("most"))
    found = sums.select("k", (F.log("z") - F.element_at(F.array(*[F.lit(a) for a in grid]), F.col("k") + 1) * F.col("u") / F.col("z")).alias("entropy"), (F.exp("most") / F.col("z") * (budget / total)).alias("repeats"))
    return [(r.entropy, r.repeats) for r in found.orderBy("k").collect()]  # one row per exponent of the grid


def exponent(totals: DataFrame, target: Target) -> float:
    """The exponent for ``totals`` (key, tokens > 0), on a grid of 32**6 steps."""
    of = totals.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).first()
    if of.n < 2:
        return 1.0
    import math

    budget = of.tokens if target.budget is None else target.budget
    least = (target.entropy or 0) * math.log(of.n)
    fits = (lambda m: m[0] >= least) if target.repeats is None else (lambda m: m[1] > target.repeats)
    low, width = 0.0, 1.0
    for _ in range(_ROUNDS):
        grid = [low + width * k / _WAYS for k in range(_WAYS + 1)]
        k = max([i for i, m in enumerate(_measures(totals, grid, of.tokens, budget)) if fits(m)], default=0)
        if low == 0.0 and k == _WAYS and width == 1.0:
            return 1.0
        low, width = grid[min(k, _WAYS - 1)], width / _WAYS
    return low if target.repeats is None or not low else low + width


def plan(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(sources, blocks) that realise the target.

    sources: key, tokens, quota, n_blocks, epochs (whole ones) and left (tokens
    of the last).  blocks: key, block, place (the same in every epoch), used ("whole",
    "cut" or "none" in the last epoch), cut_hash and cut_id (the last document
    used of a cut block).
    """
    rows = stage(docs.select(source_key(F.col(source_col)).alias("key"), F.col(id_col).cast("string").alias("id"), _row_hash(target.seed, F.col(id_col), F.col(text_col)).alias("hash"), count_words(F.col(text_col)).alias("n")), "counted")
    totals = stage(rows.groupBy("key").agg(F.sum("n").alias("tokens")).where("tokens > 0"), "totals")
    total = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    budget = total if target.budget is None else target.budget
    power = F.exp(F.lit(exponent(totals, target)) * F.log(F.col("tokens") / F.lit(float(max(total, 1)))))
    summed = totals.agg(F.sum(power).alias("z"))
    sources = totals.crossJoin(F.broadcast(summed)).select("key", "tokens", F.floor(power / F.col("z") * (budget * (1 + 1e-12)) + 1e-6).alias("quota"))  # z: one row
    sources = stage(sources.select("*", F.ceil(F.col("tokens") / target.block_tokens).alias("n_blocks"), F.floor(F.col("quota") / F.col("tokens")).alias("epochs"), (F.col("quota") % F.col("tokens")).alias("left")), "sources")
    dealt = rows.join(sources.select("key", "n_blocks", "epochs", "left"), "key").withColumn("block", F.col("hash") % F.col("n_blocks"))
    blocks = dealt.groupBy("key", "block").agg(F.sum("n").alias("n"), F.first("epochs").alias("epochs"), F.first("left").alias("left"))
    order = Window.partitionBy("key").orderBy(_hash(F.lit(target.seed), F.col("epochs"), F.col("key"), F.col("block")), "block")
    ordered = blocks.withColumn("place", F.row_number().over(order)).withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    used = F.when(F.col("upto") <= F.col("left"), "whole").when(F.col("upto") - F.col("n") < F.col("left"), "cut").otherwise("none")
    ordered = stage(ordered.select("key", "block", "place", used.alias("used"), (F.col("left") - F.col("upto") + F.col("n")).alias("room")), "blocks")
    inside = dealt.join(ordered.where("used = 'cut'").select("key", "block", "room"), ["key", "block"])  # one block of each source
    within = Window.partitionBy("key").orderBy("hash", "id", "n").rowsBetween(Window.unboundedPreceding, 0)
    kept = inside.withColumn("upto", F.sum("n").over(within)).where("upto <= room").groupBy("key").agg(F.max(F.struct("hash", "id")).alias("cut"))
    blocks = ordered.drop("room").join(kept, "key", "left").select("key", "block", "place", "used", F.col("cut.hash").alias("cut_hash"), F.col("cut.id").alias("cut_id"))
    return sources, stage(blocks, "blocks")


def mixture(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mixture uses them: each row once per epoch, with two more columns, epoch and place.

    Sorted by (epoch, place) a source's rows repeat one permutation of its
    blocks, the same in every epoch.  The two
    columns get other names if ``docs`` has them (see ``fresh_name``).  A source
    without words is in no mixture.  Nulls: a null source is a source of its
    own; a null text has no words and goes with its block; rows with null ids are
    dealt by their texts.  Rows that repeat both id and text share a place, and
    a cut keeps them all or none.  An empty table gives an empty mixture.
    """
    sources, blocks = plan(docs, target, id_col, text_col, source_col)
    names = [fresh_name(docs, x) for x in ("mix_key", "mix_block", "mix_hash", "mix_copies", "mix_used")]
    key, block, digest, copies, used = names
    epoch, place = fresh_name(docs, "epoch"), fresh_name(docs, "place")
    rows = docs.withColumn(key, source_key(F.col(source_col))).withColumn(digest, _row_hash(target.seed, F.col(id_col), F.col(text_col)))
    s = sources.select(F.col("key").alias(key), F.col("n_blocks").alias(block), F.col("epochs").alias(copies))
    rows = rows.join(s, key).withColumn(block, F.col(digest) % F.col(block))
    b = blocks.select(F.col("key").alias(key), F.col("block").alias(block), F.col("place").alias(place), F.struct("used", "cut_hash", "cut_id").alias(used))
    rows = rows.join(b, [key, block])
    at = F.struct(F.col(digest), F.col(id_col).cast("string"))
    last = (F.col(f"{used}.used") == "whole") | ((F.col(f"{used}.used") == "cut") & F.coalesce(at <= F.struct(F.col(f"{used}.cut_hash"), F.col(f"{used}.cut_id")), F.lit(False)))
    n = (F.col(copies) + F.when(last, 1).otherwise(0)).cast("int")
    epochs = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(epoch, F.explode(epochs)).select(*docs.columns, epoch, place)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixture(docs).select("doc_id", "source", count_words(F.col("text")).alias("n_tokens"), F.col("epoch").cast("long").alias("epoch"), F.col("place").cast("long").alias("place"))


OP5_SQL = r"""
WITH RECURSIVE rows AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS key, coalesce(CAST(doc_id AS VARCHAR), 'null') AS hashed, CAST(doc_id AS VARCHAR) AS id, md5(coalesce(text, '')) AS text_md5,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')) AS BIGINT) AS n FROM documents),
docs AS (SELECT *, CAST('0x' || left(md5('42:' || hashed || ':' || text_md5), 15) AS BIGINT) AS hash FROM rows),
totals AS (SELECT key, CAST(sum(n) AS BIGINT) AS tokens FROM docs GROUP BY key HAVING sum(n) > 0),
shares AS (SELECT key, tokens, (SELECT CAST(sum(tokens) AS BIGINT) FROM totals) AS total, ln(tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM totals)) AS l FROM totals),
goal AS (SELECT 0.95 * ln(count(*)) AS least FROM totals),
search(step, low, width) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL
    SELECT step + 1, CASE WHEN (SELECT ln(sum(exp((low + width / 2) * l))) - (low + width / 2) * sum(exp((low + width / 2) * l) * l) / sum(exp((low + width / 2) * l)) FROM shares) >= (SELECT least FROM goal) THEN low + width / 2 ELSE low END, width / 2
    FROM search WHERE step < 30),
whole AS (SELECT ln(sum(exp(l))) - sum(exp(l) * l) / sum(exp(l)) >= (SELECT least FROM goal) OR count(*) < 2 AS fits FROM shares),
found AS (SELECT CASE WHEN (SELECT fits FROM whole) THEN 1.0::DOUBLE ELSE (SELECT low FROM search WHERE step = 30) END AS a),
sources AS (SELECT key, tokens, CAST(floor(exp(a * l) / (SELECT sum(exp(a * l)) FROM shares, found) * (total * (1 + 1e-12::DOUBLE)) + 1e-6) AS BIGINT) AS quota, CAST(ceil(tokens / 1000000.0) AS BIGINT) AS n_blocks FROM shares, found),
dealt AS (SELECT docs.*, hash % n_blocks AS block, quota // tokens AS epochs, quota % tokens AS rest FROM docs JOIN sources USING (key)),
blocks AS (SELECT key, block, epochs, rest, sum(n) AS n FROM dealt GROUP BY ALL),
placed AS (SELECT *, row_number() OVER w AS place, sum(n) OVER w AS upto FROM blocks
    WINDOW w AS (PARTITION BY key ORDER BY md5('42:' || epochs || ':' || key || ':' || block)[1:15], block ROWS UNBOUNDED PRECEDING)),
ranked AS (SELECT d.*, place, p.upto, p.upto - p.n AS before, sum(d.n) OVER (PARTITION BY d.key, d.block ORDER BY hash, id, d.n ROWS UNBOUNDED PRECEDING) AS inside FROM dealt d JOIN placed p ON d.key = p.key AND d.block = p.block),
copies AS (SELECT *, epochs + CASE WHEN upto <= rest OR before < rest AND before + inside <= rest THEN 1 ELSE 0 END AS copies FROM ranked)
SELECT doc_id, source, n AS n_tokens, unnest(range(1, copies + 1)) AS epoch, place FROM copies
"""
