"""Document fingerprints: a Merkle tree over sections, paragraphs and runs of words.

Sections are parted by an empty line, paragraphs by a line feed, and a
paragraph is cut into runs of words after every word whose length is divisible
by five, so that an edit moves only the cuts beside it.  A leaf is the MD5 of a
run; a paragraph's digest is that of its leaves' digests, and so on up to the
root, which is the fingerprint.  Equal texts have equal roots and different
ones different roots, whatever characters they hold; where roots differ, the
branches whose digests differ locate the edit.  Likeness of two trees is twice
the distinct nodes that they share, root included, over those of both: 1 for
equal roots and less for any others.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.staging import stage, table

#: About one row in so many begins a range of ids within which each is paired with the next, and of how many ranges at most.
RANGE, MOST_RANGES = 1024, 1 << 16
#: Stands between runs; the text's own are escaped before.
_CUT, _ESCAPE = "\x01", "\x02"


def _runs(paragraph: Column) -> Column:
    own = F.replace(F.replace(paragraph, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_CUT), F.lit(_ESCAPE + "a"))
    marked = F.transform(F.split(own, " "), lambda w: F.when(F.length(w) % 5 == 0, F.concat(w, F.lit(_CUT))).otherwise(w))
    return F.split(F.array_join(marked, " "), _CUT)


def _digest(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def tree(text: Column) -> Column:
    """array(section) of array(paragraph) of array(leaf digest)."""
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(_runs(p), _digest)))


def paragraph_digests(nodes: Column) -> Column:
    return F.transform(nodes, lambda s: F.transform(s, lambda p: _digest(F.array_join(p, ""))))


def section_digests(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: _digest(F.array_join(s, "")))


def root(sections: Column) -> Column:
    """The fingerprint of a tree: 32 hex digits."""
    return _digest(F.array_join(sections, ""))


def nodes_of(leaves: Column, paragraphs: Column, sections: Column) -> Column:
    """The distinct digests of a tree, of leaves and of all branches, the root included."""
    return F.array_distinct(F.concat(F.flatten(F.flatten(leaves)), F.flatten(paragraphs), sections, F.array(root(sections))))


def likeness(nodes_a: Column, nodes_b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(nodes_a, nodes_b)) / (F.size(nodes_a) + F.size(nodes_b))


def changed(a: Column, b: Column) -> Column:
    """(section, paragraph) of every branch of two paragraph_digests() that differs or is in one only, counted from 0."""

    def unlike(of: Column, other: Column, only: bool) -> Column:
        there = lambda i, j: F.get(F.get(other, i), j)
        at = lambda p, i, j: F.when(there(i, j).isNull() if only else ~p.eqNullSafe(there(i, j)), F.struct(i.alias("section"), j.alias("paragraph")))
        return F.filter(F.flatten(F.transform(of, lambda s, i: F.transform(s, lambda p, j: at(p, i, j)))), lambda x: x.isNotNull())

    return F.array_sort(F.concat(unlike(a, b, False), unlike(b, a, True)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, paragraphs) of each row; a null text is an empty one, which has one empty leaf."""
    rows = docs.select(F.col(id_col).alias(id_col), tree(F.coalesce(F.col(text_col), F.lit(""))).alias("nodes"))
    return rows.select(id_col, root(section_digests(paragraph_digests(F.col("nodes")))).alias("fingerprint"), paragraph_digests(F.col("nodes")).alias("paragraphs"))


def _place(key: Column, bounds: Column, n: int) -> Column:
    """How many of the n sorted bounds are not above the key, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(bounds, at + step - 1) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """(k, text) -> (k, text, next_text): the text of the row of the next k; after the last comes the first.

    Rows are ordered by k, nulls first, and of one k by the text's MD5.  About
    one row in RANGE, chosen by a hash of both, begins a range, so ranges are
    alike however the ids lie, whatever their type.  Rows are dealt once by
    ranges and paired by a window inside each; the last of a range gets the
    text that begins the following one, which is the chosen row's.  A range has
    about RANGE rows (more beyond MOST_RANGES ranges), but rows that repeat both
    k and text stay together.  A single row is its own next.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("d", F.md5(F.col("text").cast("binary")))
    keys = keyed.select("k", "d")
    n = keys.count()
    chance = int((1 << 30) * min(1.0 / RANGE, MOST_RANGES / max(n, 1)))
    begins = F.pmod(F.xxhash64("k", "d"), F.lit(1 << 30)) < chance
    chosen = [r.key for r in keys.where(begins).distinct().orderBy(F.col("k").asc_nulls_first(), "d").select(F.to_json(F.struct("k", "d"), {"ignoreNullFields": "false"}).alias("key")).collect()]  # about MOST_RANGES at most
    least = keys.orderBy(F.col("k").asc_nulls_first(), "d").limit(1).select(F.to_json(F.struct("k", "d"), {"ignoreNullFields": "false"}).alias("key")).collect()
    kind = f"struct<k:{docs.schema['k'].dataType.simpleString()},d:string>"
    bounds = F.from_json(F.lit(f"[{','.join(chosen)}]"), f"array<{kind}>")
    ordered = keyed.withColumn("range", _place(F.struct("k", "d"), bounds, len(chosen)))
    firsts = spark.createDataFrame([(i, key) for i, key in enumerate([*chosen, *(r.key for r in least)])], "range int, key string")
    firsts = firsts.select("range", F.from_json("key", kind).alias("begin"))
    same = keyed.k.eqNullSafe(firsts.begin.k) & (keyed.d == firsts.begin.d)
    after = keyed.join(F.broadcast(firsts), same).select("range", F.col("text").alias("head")).dropDuplicates(["range"])  # the least key may be chosen too
    inside = F.lead("text").over(Window.partitionBy("range").orderBy(F.col("k").asc_nulls_first(), "d"))
    return ordered.withColumn("inside", inside).join(stage(after, "heads"), "range").select("k", "text", F.coalesce("inside", "head").alias("next_text"))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and how alike they are and how alike the next document is.

    The edited text has the last quarter of its code points (rounded down)
    replaced by the first as many of the next document's, by ascending id.
    ``changed`` lists the branches in which the two differ, as section.paragraph
    counted from 0, joined by commas.  Nulls: a null text is an empty one (whose
    tree is one empty leaf), null ids come first.  Repeated rows stay; of one
    id, the next is by the text's MD5.  Control characters count like any
    other.  A text of any length is taken whole, in one task.  An empty table
    gives an empty result; ids of any ordered type work; other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    paired = with_next(rows)
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.left("text", (n - quarter).cast("int")), F.left("next_text", quarter))
    texts = paired.select("k", n.cast("long").alias("n_chars"), F.col("text").alias("a"), edited.alias("b"), F.col("next_text").alias("c"))
    leaves = texts.select("k", "n_chars", F.sha2(F.col("b").cast("binary"), 256).alias("edited_sha256"), *[tree(F.col(x)).alias(x) for x in "abc"])
    paragraphs = leaves.select("*", *[paragraph_digests(F.col(x)).alias(f"{x}p") for x in "abc"])
    sections = paragraphs.select("*", *[section_digests(F.col(f"{x}p")).alias(f"{x}q") for x in "abc"])
    nodes = sections.select("k", "n_chars", "edited_sha256", "ap", "bp", "aq", "bq", *[nodes_of(F.col(x), F.col(f"{x}p"), F.col(f"{x}q")).alias(x) for x in "abc"])
    places = F.transform(changed(F.col("ap"), F.col("bp")), lambda x: F.concat_ws(".", x.section, x.paragraph))
    return nodes.select(F.col("k").alias(id_col), "n_chars", "edited_sha256", root(F.col("aq")).alias("fingerprint"), root(F.col("bq")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), F.array_join(places, ",").alias("changed"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edit(table(spark, sf_dir, "documents"))


def _tree_sql(text: str) -> str:
    own = "replace(replace(p, chr(2), chr(2) || 'b'), chr(1), chr(2) || 'a')"
    runs = f"string_split(array_to_string(list_transform(string_split({own}, ' '), lambda w: CASE WHEN length(w) % 5 = 0 THEN w || chr(1) ELSE w END), ' '), chr(1))"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform({runs}, lambda r: md5(r))))"


_md5_sql = lambda x: f"md5(array_to_string({x}, ''))"
_nodes_sql = lambda x: f"list_distinct(flatten(flatten({x})) || flatten({x}p) || {x}q || [{_md5_sql(x + 'q')}])"
_near_sql = lambda x, y: f"2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y}))"
_unlike_sql = lambda x, y, test: f"flatten(list_transform({x}, lambda s, i: list_filter(list_transform(s, lambda p, j: CASE WHEN {test} THEN {{'s': i - 1, 'p': j - 1}} END), lambda z: z IS NOT NULL)))".replace("OTHER", f"{y}[i][j]")

OP8_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
paired AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM docs WINDOW w AS (ORDER BY doc_id NULLS FIRST, md5(text))),
edits AS (SELECT *, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM paired),
leaves AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_tree_sql("text")} AS a, {_tree_sql("edited")} AS b, {_tree_sql("next_text")} AS c FROM edits),
paragraphs AS (SELECT *, {", ".join(f"list_transform({x}, lambda s: list_transform(s, lambda p: {_md5_sql('p')})) AS {x}p" for x in "abc")} FROM leaves),
sections AS (SELECT *, {", ".join(f"list_transform({x}p, lambda s: {_md5_sql('s')}) AS {x}q" for x in "abc")} FROM paragraphs),
nodes AS (SELECT doc_id, n_chars, edited_sha256, ap, bp, aq, bq, {", ".join(f"{_nodes_sql(x)} AS {x}" for x in "abc")} FROM sections)
SELECT doc_id, n_chars, edited_sha256, {_md5_sql("aq")} AS fingerprint, {_md5_sql("bq")} AS edited_fingerprint, {_near_sql("a", "b")} AS near_edited, {_near_sql("a", "c")} AS near_next,
    array_to_string(list_transform(list_sort({_unlike_sql("ap", "bp", "p IS DISTINCT FROM OTHER")} || {_unlike_sql("bp", "ap", "OTHER IS NULL")}), lambda z: z.s || '.' || z.p), ',') AS changed FROM nodes
"""
