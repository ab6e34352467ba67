"""SimHash near duplicates by meet-in-the-middle ball hashing.

Fingerprint: lower-case A-Z, words are runs of anything but the bytes 32 and
9 to 13, shingles are three words joined by a space, repeats included (fewer
words: the whole sequence; none: fingerprint zero).  A bit is set if it is set
in over half of the shingles' XXH64 (seed 42).

Links: two fingerprints link at three or fewer differing bits.  Each emits all
variants within half that radius, and two fingerprints link if and only if
they meet in a variant.  Three is odd, so "half" is rounded by parity: of two
fingerprints an odd number of bits apart, one has an even number of ones.
Odd fingerprints emit the ball of radius 1, even ones that of radius 2.  Of
three differing bits two lie in the same 32-bit half, so of the radius-2
variants only those that flip two bits of one half are needed: 65 variants for
an odd, 1056 for an even fingerprint, and no pair within the radius is lost.

Only fingerprints travel.  A variant's route is 16 of its bits; a fingerprint
goes once to each route that its ball touches (17 or 73), and unfolds the
variants of that route there, behind the shuffle.  In the group of a variant,
the members at most one bit away are all within the radius of every member, so
the least of them is linked to each member (a star, not all pairs); a group
without such a member holds only even fingerprints two bits from the middle,
whose links at distance two meet in other variants.

Components come from least-label propagation with pointer jumping over the
stars; every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.llm import minhash
from reviewloom.llm.arrow import slices
from reviewloom.llm.graph import components
from reviewloom.staging import fresh_name, stage, table

RADIUS = 3
SEED = 42
SHINGLE_WORDS = 3
_ROUTE_BITS = [*range(8), *range(32, 40)]
_BLOCK = 1 << 15


def fingerprint(text: bytes, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    ones = np.zeros(64, np.int64)
    n = len(words) - k + 1
    for start in range(0, n, _BLOCK):
        part = words[start : start + _BLOCK + k - 1]
        shingles = map(b" ".join, zip(*(part[j:] for j in range(k))))
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row (id, fp) per row of ``docs``; fp is the fingerprint as a signed long.  A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            fp = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _masks() -> list[tuple[int, int, int]]:
    """(odd, part of the mask that lies in the route, mask) for each variant of either ball."""
    route = sum(1 << b for b in _ROUTE_BITS)
    single = [0] + [1 << b for b in range(64)]
    double = [1 << a | 1 << b for half in (range(32), range(32, 64)) for a, b in combinations(half, 2)]
    rows = [(1, m) for m in single] + [(0, m) for m in single[1:] + double]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(odd, signed(m & route), signed(m)) for odd, m in rows]


def links(fps: DataFrame) -> DataFrame:
    """Edges (fp, center) that connect distinct fingerprints exactly as all links within the radius do.

    ``fps`` has one column fp without repeats.
    """
    spark = fps.sparkSession
    masks = _masks()
    route = sum(1 << b for b in _ROUTE_BITS)
    ball = spark.createDataFrame(masks, "odd int, diff long, mask long")

    def touched(odd: int) -> F.Column:
        return F.array(*[F.lit(d).cast("long") for d in sorted({r for o, r, _ in masks if o == odd})])

    odd = F.bit_count("fp") % 2
    routed = (
        fps.select("fp", odd.cast("int").alias("odd"))
        .select("fp", "odd", F.explode(F.when(F.col("odd") == 1, touched(1)).otherwise(touched(0))).alias("diff"))
        .select(F.col("fp").bitwiseAND(F.lit(route)).bitwiseXOR(F.col("diff")).alias("route"), "fp")
        .repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "route")
    )
    members = (
        routed.withColumn("odd", odd.cast("int"))
        .withColumn("diff", F.col("fp").bitwiseAND(F.lit(route)).bitwiseXOR(F.col("route")))
        .join(F.broadcast(ball), ["odd", "diff"])  # a fixed table of 1121 rows
        .select("route", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", (F.bit_count("mask") <= 1).alias("near"))
    )
    center = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("variant", "route"))
    return (
        members.select("fp", center.alias("center"))
        .where("center IS NOT NULL AND fp <> center")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("center"))) <= RADIUS)
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the least id that links reach from here, its own included.
    Nulls: a null text is an empty one, whose fingerprint is zero and links
    like any other; a null id stays null and is the component's id only if no
    other is there.  Repeated rows and ids stay.  An empty table gives an empty
    result.  Other columns of ``docs`` are not read, whatever they are called.
    """
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    least = stage(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(least.select("fp")), "fp", "center")
    of = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(ids, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def ball_pairs(texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Pairs (a, b) of digests of different texts that the ball hashing links; ``texts`` has the columns digest and text.

    The least text of a fingerprint stands for it: the others meet this one,
    and the texts that stand for two linked fingerprints meet each other.
    """
    fps = stage(fingerprints(texts, "digest", "text", words).distinct(), "fingerprints")
    least = stage(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    equal = fps.join(least.where("n > 1"), "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    of = lambda fp, x: least.select(F.col("fp").alias(fp), F.col("least").alias(x))
    linked = links(least.select("fp")).join(of("fp", "x"), "fp").join(of("center", "y"), "center")
    return equal.union(linked.select(F.least("x", "y"), F.greatest("x", "y")))


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, all columns unchanged.

    Without a similarity, texts link as in ``near_duplicates``, by shingles of
    ``words`` words; with one, their sets of such shingles have that Jaccard
    similarity or more: the texts that the ball hashing links are verified on
    these sets, and what lies beyond its radius is added by ``minhash``.  The
    row that stays has the least
    (doc_id, digest of the text) of its component, null ids last.  Of rows with
    that id and that text one stays; a doc_id with texts in several components
    stays in each where it is least.
    """
    digest = fresh_name(docs, "text_digest")
    docs_with = docs.withColumn(digest, minhash.text_digest(F.col("text")))
    texts = docs_with.select(F.col(digest).alias("digest"), F.col("text").cast("string").alias("text"))
    if similarity is None:
        fps = stage(fingerprints(texts, "digest", "text", words).distinct(), "fingerprints")
        roots = components(links(fps.select("fp").distinct()), "fp", "center")
        of = fps.join(roots, fps.fp == roots.node, "left").select(F.col("id").alias("node"), F.coalesce("root", "fp").cast("string").alias("root"))
    else:
        of = minhash.groups(texts, words, similarity, ball_pairs(texts, words)).select("node", F.hex("root").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first")
    rows = docs_with.groupBy(F.col(digest).alias("digest")).agg(first)  # one row to a text, however many copies it has
    rows = rows.join(of, rows.digest == of.node, "left").withColumn("root", F.coalesce("root", F.hex("digest")))
    least = rows.groupBy("root").agg(F.min(F.struct("first.none", "first.id", "digest")).alias("least"))
    kept = stage(least.select("least.id", "least.digest"), "kept").select(F.col("id").alias(kept_id := fresh_name(docs, "kept_id")), F.col("digest").alias(kept_text := fresh_name(docs, "kept_text")))
    stays = docs_with.join(kept, (docs_with[digest] == kept[kept_text]) & docs_with.doc_id.eqNullSafe(kept[kept_id]), "left_semi")
    return stays.dropDuplicates(["doc_id", digest]).drop(digest)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
