"""How far a language's sources are apart in the words they use, by inclusion-exclusion over supports.

Terms are runs of letters: A-Z and a-z, lower-cased, and everything outside
ASCII.  A language keeps the V terms that at least MIN_DOCS of its documents
hold.  In a (language, source) group whose kept terms occur N times, a term
with n occurrences has p = 1 + floor(10**9 * (n + 2) / (N + 2 V)); two groups
differ by f = floor((p - q)**2 / (p + q)) at a term, and by the sum of f over
all kept terms.  All of it is exact integer arithmetic.

The sum is never taken over all terms of all pairs.  With p0 and q0 for terms
that a group lacks:

* one-sided: a group's histogram (a count's p -> number of its terms) prices its own
  terms as if the other group lacked them, f(p, q0), once per distinct count;
* overlap: groups that share a term meet in a join of postings and correct
  both prices there, f(p, q) - f(p, q0) - f(p0, q);
* both zero: f(p0, q0) times V - |A| - |B| + |both|, a constant of the pair.

Texts are counted inside tasks, with a bounded table that is passed on when it
is full, so what is shuffled is a row per group, term and task.  A term of
every document is as many rows as there are tasks and sources, not documents.
The posting join has at most a row for each pair of sources and term, which is
summed on the map side to a row for each pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.llm.arrow import slices
from reviewloom.staging import stage, table

MIN_DOCS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_MOST_TERMS, _MOST_BYTES, _PIECE = 1 << 17, 64 << 20, 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order, a list for each MB or so."""
    start = 0
    while start < len(text):
        piece = text[start : start + _PIECE].translate(_LETTERS)
        if start + _PIECE < len(text):  # end with the last gap; a term longer than that grows the piece
            size = _PIECE
            while (gap := piece.rfind(b" ")) < 0 and start + size < len(text):
                size *= 2
                piece = text[start : start + size].translate(_LETTERS)
            piece = piece[: gap + 1] if gap >= 0 and start + len(piece) < len(text) else piece
        start += len(piece)
        yield piece.split()


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, for each group and term that occurs.  Nulls are ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_with) in found.items():
                words = list(n)
                for at in range(0, len(words), 1 << 14):
                    part = words[at : at + (1 << 14)]
                    columns = [[lang] * len(part), [source] * len(part), pa.array(part, pa.binary()).cast(pa.string()), [n[w] for w in part], [docs_with[w] for w in part]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(columns)], names=["lang", "source", "term", "n", "docs"])
            found.clear()

        for batch, texts in slices(batches, "text"):
            for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), texts):
                if key not in found:
                    found[key] = Counter(), Counter()
                n, docs_with = found[key]
                before, seen = len(n), set()
                for part in terms(text):
                    n.update(part)
                    seen.update(part)
                docs_with.update(seen)
                held, size = held + len(n) - before, size + len(text)
                if held > _MOST_TERMS or size > _MOST_BYTES:
                    yield from passed_on()
                    held = size = 0
        yield from passed_on()

    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(known(lang_col).alias("lang"), known(source_col).alias("source"), known(text_col).alias("text"))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 kept)), exact for any counts of a long."""
    wide = lambda c: c.cast("decimal(20, 0)")
    scaled = F.lit(SCALE).cast("decimal(10, 0)") * (wide(n) + F.lit(2).cast("decimal(1, 0)"))
    below = wide(total) + F.lit(2).cast("decimal(1, 0)") * wide(kept)
    return F.call_function("div", scaled, F.greatest(below, F.lit(1).cast("decimal(23, 0)"))) + F.lit(1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); both at most 10**9 + 1, so that longs hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``docs``, even one without terms.

    Part "pair": item is each other source of the language, value the distance
    to it, all ranks.  Part "term": item is each term that the group uses more
    than its language does, value f against the language, the first
    ``top_terms``.  Ranks follow the value, greatest first, then the item in
    byte order.  Nulls: a null text, language or source is an empty one.  Equal
    rows count as often as they are there.  A language without kept terms has
    pairs at distance 0 and no terms; an empty table gives an empty result.
    Other columns of ``docs`` are not read, whatever they are called.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    by_term = Window.partitionBy("lang", "term")
    counted = count_terms(docs, lang_col, source_col, text_col)
    counted = counted.withColumn("in_docs", F.sum("docs").over(by_term)).where(F.col("in_docs") >= min_docs)
    lead = F.row_number().over(by_term.orderBy("source")) == 1
    kept = stage(counted.select("lang", "term", "source", "n", F.sum("n").over(by_term).alias("lang_n"), lead.alias("lead")), "postings")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"), F.sum(F.col("lead").cast("long")).alias("leads"))
    present = docs.select(known(lang_col).alias("lang"), known(source_col).alias("source")).distinct()
    groups = present.join(sums, ["lang", "source"], "left").fillna(0, ["total", "support", "leads"])
    of_lang = groups.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("total").alias("lang_total"))
    groups = stage(groups.join(of_lang, "lang").select("lang", "source", "total", "support", "v", "lang_total", share(F.lit(0), F.col("total"), F.col("v")).alias("p0")), "groups")
    shared = kept.join(groups, ["lang", "source"])
    shared = stage(shared.select("lang", "term", "source", "n", "p0", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "shares")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    near = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    near = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms)

    far = _distances(groups, shared)
    far = far.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(far.select("lang", "b", "a", "value"))
    far = far.withColumn("rank", F.row_number().over(ranked))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(far, "pair").union(part(near, "term"))


def _distances(groups: DataFrame, shared: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a < b, from the three kinds of terms."""
    side = lambda df, x, *more: df.select("lang", F.col("source").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in more])
    pairs = side(groups, "a", "p0", "support").join(side(groups, "b", "p0", "support"), "lang").where("a < b").join(groups.groupBy("lang").agg(F.first("v").alias("v")), "lang")
    zero = apart(F.col("p0_a"), F.col("p0_b"))
    constant = pairs.select("lang", "a", "b", (zero * (F.col("v") - F.col("support_a") - F.col("support_b"))).alias("value"))
    histogram = stage(shared.groupBy("lang", "source", "p").agg(F.count("*").alias("many")), "histogram")

    def one_sided(x: str, y: str) -> DataFrame:
        prices = histogram.select("lang", F.col("source").alias(x), "p", "many").join(pairs.select("lang", "a", "b", f"p0_{y}"), ["lang", x])
        return prices.groupBy("lang", "a", "b").agg(F.sum(apart(F.col("p"), F.col(f"p0_{y}")) * F.col("many")).alias("value"))

    posting = lambda x: shared.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p_{x}"), F.col("p0").alias(f"p0_{x}"))
    both = posting("a").join(posting("b"), ["lang", "term"]).where("a < b")
    f = lambda x, y: apart(F.col(f"{x}_a"), F.col(f"{y}_b"))
    overlap = both.groupBy("lang", "a", "b").agg(F.sum(f("p", "p") - f("p", "p0") - f("p0", "p") + f("p0", "p0")).alias("value"))
    parts = constant.union(one_sided("a", "b")).union(one_sided("b", "a")).union(overlap.select("lang", "a", "b", "value"))
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v, CAST(sum(lang_n) AS HUGEINT) AS total FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM found JOIN kept USING (lang, term) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
        CAST(1 + 1000000000::HUGEINT * (coalesce(f.n, 0) + 2) // (coalesce(t.total, 0) + 2 * s.v) AS BIGINT) AS p,
        CAST(1 + 1000000000::HUGEINT * (k.lang_n + 2) // (s.total + 2 * s.v) AS BIGINT) AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
near AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM near) WHERE rank <= 10
"""
