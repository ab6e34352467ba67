"""Near copies by Jaccard similarity: the links of SimHash balls and MinHash bands are candidates, the texts themselves decide.

Shingles are runs of ``words`` words as in ``simhash`` (fewer words: the whole
sequence; none: no shingle, and such texts are copies of each other), as a set.
A signature is BANDS keys of ROWS minima each; a pair at similarity 0.8 shares
a key with chance 1 - (1 - 0.8**5)**20 = 0.9996.  At 0.8 two SimHashes are about
ten of 64 bits apart, so the balls (``simhash.ball_pairs``) reach the close
copies, and the bands what lies further off.

Every candidate pair is verified on the exact sets of shingles, and the
components are those of all verified pairs.  Pairs of the balls come as given;
the bands have two ways to find theirs.

Texts that share a key are first compared with pivots of that key, not all with
all: the members are dealt to PIVOTS classes by a hash of key and text, and the
pivot of a class is the one that shares most keys with other texts, so the
original of many edited copies before any of these.  Large groups of copies
come together here at the cost of a few comparisons a member.

A key whose members are not all in one component after that may hide links
between two that are no pivots, such as pairs in a family that shares a
template.  All such members of such keys are joined once more, exactly, by
prefixes: shingles are ordered by how many of these texts have them, rarest
first.  Of two sets at similarity t the smaller has one of its first
|x| - ceil(2 t / (1 + t) |x|) + 1 shingles among the first |y| - ceil(t |y|) + 1
of the larger, so it is enough to meet in those, and texts of one component
needn't meet.  Long lists of texts that meet in a shingle are first compared with
the few that come first by PIVOTS hashes, the same in every such list, so what
is left of a large group of copies joins it before texts of different
components meet one by one.  A shingle of a template is not in the smaller text's prefix
unless the template is 2 t / (1 + t) of that text or more; texts of equal size
that share so much are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.arrow import Memo, slices
from reviewloom.llm.graph import components
from reviewloom.staging import stage

BANDS, ROWS, PIVOTS, SEED = 20, 5, 4, 42
_BLOCK = 1 << 12
_draw = np.random.default_rng(SEED)
_FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]


def text_digest(text: Column) -> Column:
    """16 bytes that stand for a text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def shingles(text: bytes, words: int) -> set[bytes]:
    parts = text.lower().split()  # bytes: A-Z and ASCII white space only
    k = min(words, len(parts))
    return set(map(b" ".join, zip(*(parts[j:] for j in range(k)))))


def band_keys(text: bytes, words: int) -> list[int]:
    """The signed 64-bit keys of a text."""
    own = shingles(text, words)
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in own], np.uint64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for start in range(0, len(h), _BLOCK):
        np.minimum(least, (h[start : start + _BLOCK] * _FACTORS + _SHIFTS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def groups(texts: DataFrame, words: int, similarity: float, candidates: DataFrame | None = None) -> DataFrame:
    """(node, root) of the texts that are linked at the similarity or above, by digests; ``texts`` has the columns digest and text.

    ``candidates`` are pairs (a, b) of digests that are verified too.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([band_keys(t, words) for t in part], pa.list_(pa.int64()))], names=["digest", "keys"])

    signed = stage(texts.select("digest", "text").mapInArrow(sign, "digest binary, keys array<long>"), "signatures")
    signed = signed.groupBy("digest").agg(F.first("keys").alias("keys"))  # equal texts have equal keys
    asked = stage(signed.select("digest", F.explode("keys").alias("key")), "keys")
    shared = asked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(asked.join(shared, "key"), "members")
    score = members.groupBy("digest").agg(F.sum("n").alias("score"))
    ranked = members.join(score, "digest").withColumn("class", F.pmod(F.xxhash64("key", "digest"), F.lit(PIVOTS)))
    best = [F.max(F.when(F.col("class") == c, F.struct("score", "digest"))) for c in range(PIVOTS)]
    pivots = stage(ranked.groupBy("key").agg(F.array(*best).alias("best")), "pivots")
    met = members.select("key", "digest").join(pivots, "key").select("digest", F.explode("best").alias("best"))
    met = met.select("digest", F.col("best.digest").alias("pivot")).where("pivot IS NOT NULL AND digest <> pivot")
    met = met.select(F.least("digest", "pivot").alias("a"), F.greatest("digest", "pivot").alias("b"))
    pairs = stage((met if candidates is None else met.union(candidates.select("a", "b"))).distinct(), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda t: shingles(t, words), 64)
        for batch in batches:
            for one, part in slices([batch], "text_a"):
                others = one.column(3).cast(pa.binary()).to_pylist()
                close = [jaccard(known[x], known[y]) >= similarity for x, y in zip(part, others)]
                yield one.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

    # one row to each text that has a candidate; copies go on the map side, so a semi join, which Spark would put below, won't do
    needed = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    held = stage(texts.select("digest", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["digest"]).join(needed, "digest"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda x: held.select(F.col("digest").alias(x), F.col("text").alias(f"text_{x}"))
        return stage(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(verify, "a binary, b binary"), "near")

    near = verified(pairs)
    roots = components(near, "a", "b")
    rest = members.select("key", "digest").join(pivots, "key").where(~F.array_contains(F.transform("best", lambda b: b["digest"]), F.col("digest"))).select("key", "digest")
    rest = stage(rest.join(roots, rest.digest == roots.node, "left").select("key", "digest", F.coalesce("root", "digest").alias("root")), "rest")
    apart = rest.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    open_ = stage(rest.join(apart, "key", "left_semi").select("digest", "root").distinct(), "open")
    if open_.isEmpty():
        return roots
    first = _prefixes(held, open_, words, similarity)

    def between(pairs: DataFrame) -> DataFrame:
        """Links of components that verified pairs join, one for two components."""
        of = lambda x: roots.select(F.col("node").alias(f"node_{x}"), F.col("root").alias(f"root_{x}"))
        joined = verified(pairs).join(of("a"), F.col("a") == F.col("node_a"), "left").join(of("b"), F.col("b") == F.col("node_b"), "left")
        return stage(joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b").distinct(), "between")

    stars = between(stage(_star_pairs(first, similarity), "star_pairs"))
    met = components(stars, "a", "b").select(F.col("node").alias("met"), F.col("root").alias("above"))
    first = first.join(met, F.col("root") == F.col("met"), "left").withColumn("root", F.coalesce("above", "root")).drop("met", "above")
    more = stars.union(between(stage(_prefix_pairs(first, similarity), "more_pairs")))
    up = stage(components(more, "a", "b").select(F.col("node").alias("met"), F.col("root").alias("above")), "above")
    own = roots.union(up.join(roots, up.met == roots.node, "left_anti").select("met", "met"))  # texts that nothing joined before
    return own.join(up, F.col("root") == F.col("met"), "left").select("node", F.coalesce("above", "root").alias("root"))


def _prefixes(texts: DataFrame, open_: DataFrame, words: int, similarity: float) -> DataFrame:
    """(h, digest, root, m, short): the prefixes of the texts in ``open_`` (digest, root) as far as others have their shingles; m is the set's size, ``texts`` has each digest once."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in slices(batches, "text"):
            own = [np.array(list({xxhash.xxh64_intdigest(s, SEED) for s in shingles(t, words)}), np.uint64).view(np.int64).tolist() for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int64()))], names=["digest", "root", "own"])

    rows = texts.join(open_, "digest").select("digest", "root", "text").mapInArrow(hashes, "digest binary, root binary, own array<long>")
    rows = stage(rows.select("digest", "root", F.size("own").alias("m"), F.explode("own").alias("h")), "shingles")
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    least = lambda share: (F.col("m") - F.ceil(F.col("m") * F.lit(share) - F.lit(1e-9)) + 1).cast("int")
    place = F.row_number().over(Window.partitionBy("digest").orderBy("n", "h"))
    placed = rows.join(often, "h", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("place", place)
    return stage(placed.where((F.col("place") <= least(similarity)) & (F.col("n") > 1)).select("h", "digest", "root", "m", "place", (F.col("place") <= least(2 * similarity / (1 + similarity))).alias("short")), "prefixes")


def _fits(similarity: float) -> Column:
    """Sizes and roots that allow two sets to be alike and apart so far; y is the larger, or of two of a size the later."""
    return (F.struct("m_x", "digest_x") < F.struct("m_y", "digest_y")) & (F.col("m_x") >= F.col("m_y") * F.lit(similarity) - F.lit(1e-9)) & (F.col("root_x") != F.col("root_y"))


def _shared(similarity: float) -> Column:
    """How many shingles two sets of these sizes must share."""
    return F.ceil((F.col("m_x") + F.col("m_y")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))


def _star_pairs(first: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each text with the pivots of the long lists that it is in."""
    best = [F.min(F.struct(F.xxhash64("digest", F.lit(c)).alias("by"), "digest", "root", "m")) for c in range(PIVOTS)]
    pivots = first.groupBy("h").agg(F.count("*").alias("many"), F.array(*best).alias("best")).where(F.col("many") > 2 * PIVOTS)
    met = first.join(pivots.select("h", F.explode("best").alias("p")), "h").where((F.col("digest") != F.col("p.digest")) & (F.col("root") != F.col("p.root")))
    like = F.least("m", "p.m") >= F.greatest("m", "p.m") * F.lit(similarity) - F.lit(1e-9)
    return met.where(like).select(F.least("digest", "p.digest").alias("a"), F.greatest("digest", "p.digest").alias("b")).distinct()


def _prefix_pairs(first: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of two roots whose prefixes meet and that can share enough.

    Two sets that share n shingles have the first of them among their first
    |x| - n + 1 and |y| - n + 1; with c in common up to places i and j they
    share no more than c and what follows i or j.
    """
    side = lambda df, x: df.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("digest", "root", "m", "place")])
    after = F.least(F.col("m_x") - F.col("place_x"), F.col("m_y") - F.col("place_y"))
    at_most = (F.col("place_x") <= F.col("m_x") - _shared(similarity) + 1) & (F.col("place_y") <= F.col("m_y") - _shared(similarity) + 1)
    met = side(first.where("short"), "x").join(side(first, "y"), "h").where(_fits(similarity) & at_most)
    pairs = met.groupBy("digest_x", "digest_y", "m_x", "m_y").agg(F.count("*").alias("c"), F.max("place_x").alias("place_x"), F.max("place_y").alias("place_y"))
    pairs = pairs.where(F.col("c") + after >= _shared(similarity))
    return pairs.select(F.least("digest_x", "digest_y").alias("a"), F.greatest("digest_x", "digest_y").alias("b"))
