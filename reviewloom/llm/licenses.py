"""License scans by canonical digests.

A text is brought to a canonical form: comment marks go, case is folded,
equivalent spellings become one, copyright notices go, punctuation and white
space become single spaces.  The SHA-256 of the canonical form is joined to the
digests of known licence texts and notices, which went through the same steps.
The whole document is looked up that way, and so are its lines, its sentences
and the sentences that are wrapped over several lines, as a notice is often one
of these among other text.

A copyright notice is the mark, years and a holder of at most HOLDER
characters, up to the beginning of a known text or notice or the line's end; a
holder that begins on the next line, or goes on there after a comma or "and",
belongs to it.  So a licence whose white space is collapsed keeps its words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.license_texts import DIGESTS, FORMS, NAMES, TEXTS, TITLES
from reviewloom.staging import table

#: Pairs of equivalent spellings, applied to lower-case words.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("favour", "favor"), ("http", "https")]
HOLDER = 120


def known() -> list[tuple[str, str, str]]:
    """(identifier, scope, text) of every known text under each of its titles and none, and of every notice in each form."""
    texts = [(name, "text", f"{title}\n\n{text}".strip()) for name, text in TEXTS.items() for title in ["", *TITLES[name]]]
    named = [(name, f"{article}{said}") for name, own in NAMES.items() for said in own for article in ("", "the ")]
    return texts + [(name, "notice", re.sub(r"(?i)(license) license$", r"\1", form.format(said))) for name, said in named for form in FORMS] + [(name, "notice", f"SPDX-License-Identifier: {name}") for name in NAMES]


KNOWN = known()


def _beginnings() -> str:
    """The first three words of every known text, title and notice, as alternatives."""
    said = [*TEXTS.values(), *(f.format("the") for f in FORMS), *(t for own in TITLES.values() for t in own), "Everyone is permitted"]
    return "|".join(sorted({" ".join(w[:3]) for x in said if len(w := re.findall("[a-z0-9]+", x.lower())) > 1}))


def _copyright() -> str:
    mark = r"(?:copyright ?(?:\(c\)|©)|copyright ?[0-9]{4}|\(c\) ?[0-9]{4}|©)"
    holder = rf"[^\n]{{0,{HOLDER}}}?"
    return rf"{mark}[0-9 ,-]*(?:\n ?)?(?:{holder}({_beginnings()})|{holder}(?:,|\band|\bof|\bby|&) ?\n{holder}(\n|$)|{holder}(\n|$))"


#: The steps after lower-casing: pattern, replacement.  Both engines' regular expressions read them alike.
STEPS = [
    (r"[ \t\r\x0b\x0c]+", " "),
    (r"(?m)^ ?(?:#+|//+|/\*+|\*+/|\*+|;+|--+) ?", ""),
    *((rf"\b{old}\b", new) for old, new in SPELLINGS),
    (r"all rights reserved\.?", " "),
    (_copyright(), "{1}{2}{3}"),
    (r"spdx-license-identifier: ?", "spdx license identifier "),
    (r"[.!?;:](?: \n?|\n)", "\n\n"),
    (r"[!-/:-@\[-`{-~]+", " "),
    (r" v([0-9])", " version {1}"),
    (r" +", " "),
    (r" ?\n ?", "\n"),
]
_WORDS = ("licens", "released under")  # one of them is in the canonical form of every notice


def canonical(text: F.Column) -> F.Column:
    """Canonical form of a text: lines are parted by a line feed, sentences by two.  A null text is an empty one."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in STEPS:
        t = F.regexp_replace(t, pattern, re.sub(r"\{(\d)\}", r"$\1", new))
    return t


def _one_line(lines: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_licenses(spark: SparkSession, known: list[tuple[str, str, str]], digests: list[tuple[str, str]]) -> DataFrame:
    """(digest, license, scope), one row per canonical form; of several licences with one form the first by name."""
    rows = spark.createDataFrame(known, "license string, scope string, text string")
    rows = rows.select(F.sha2(_one_line(canonical(F.col("text"))), 256).alias("digest"), "license", "scope")
    more = spark.createDataFrame([(d, name, "text") for name, d in digests], "digest string, license string, scope string")
    best = rows.union(more).groupBy("digest").agg(F.min(F.struct("license", "scope")).alias("best"))
    return best.select("digest", "best.license", "best.scope")


def scan(docs: DataFrame, known: list[tuple[str, str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, digest, license, notices, n_notice_lines.

    ``known`` lists licence texts and notices (identifier, scope, text), and
    ``digests`` licences by digest alone; lists in memory, so what is broadcast
    is a table of that size.  license: the known licence whose text or notice
    the whole document is, else null.  notices: the licences that lines or
    sentences of it name, sorted and joined by commas, else empty;
    n_notice_lines: how many do.  Nulls: a null text is an empty one, and an
    empty text is no licence; a null id stays.  Repeated rows stay; empty
    tables work; a text of any length is taken whole, in one task; other
    columns are not read.
    """
    spark = docs.sparkSession
    keys = known_licenses(spark, known, digests)
    held = {r.digest: r.license for r in keys.where("scope = 'notice'").collect()}  # of the list in memory
    licenses = F.create_map(*[F.lit(x) for pair in sorted(held.items()) for x in pair]) if held else F.lit(None).cast("map<string,string>")
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("lines"))
    could = lambda x: F.contains(x, F.lit(_WORDS[0])) | F.contains(x, F.lit(_WORDS[1]))
    lines = F.filter(F.split("lines", "\n+"), could)
    wrapped = F.transform(F.filter(F.split("lines", "\n\n+"), lambda x: could(F.replace(x, F.lit("\n"), F.lit(" "))) & F.contains(x, F.lit("\n"))), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))
    hits = F.filter(F.transform(F.concat(lines, wrapped), lambda x: licenses[F.sha2(F.trim(x), 256)]), lambda x: x.isNotNull())
    rows = rows.select("id", F.sha2(_one_line(F.col("lines")), 256).alias("digest"), hits.alias("hits"))
    whole = rows.join(F.broadcast(keys.select("digest", "license")), "digest", "left")
    return whole.select(F.col("id").alias(id_col), "digest", "license", F.array_join(F.sort_array(F.array_distinct("hits")), ",").alias("notices"), F.size("hits").cast("long").alias("n_notice_lines"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    t = f"lower(coalesce({text}, ''))"
    for pattern, new in STEPS:
        new = "||".join(["chr(10)"] * len(new)) if new.strip("\n") == "" and new else quote(re.sub(r"\{(\d)\}", r"\\\1", new))
        t = f"regexp_replace({t}, {quote(pattern)}, {new}, 'g')"
    return t


def op9_sql(known: list[tuple[str, str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    one = r"sha256(trim(regexp_replace({}, '[ \n]+', ' ', 'g')))"
    values = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)})" for a, b, c in known)
    more = ", ".join(f"({quote(d)}, {quote(a)}, 'text')" for a, d in digests)
    could = lambda x: "(" + " OR ".join(f"contains({x}, '{w}')" for w in _WORDS) + ")"
    return f"""
WITH known(license, scope, text) AS (VALUES {values}), more(digest, license, scope) AS (VALUES {more}),
keys AS (SELECT digest, min(license) AS license, arg_min(scope, (license, scope)) AS scope FROM
    (SELECT {one.format(_canonical_sql("text"))} AS digest, license, scope FROM known UNION ALL SELECT * FROM more) GROUP BY digest),
docs AS (SELECT row_number() OVER () AS k, doc_id, {_canonical_sql("text")} AS lines FROM documents),
pieces AS (SELECT k, list_filter(string_split_regex(lines, '\n+'), lambda x: {could('x')}) || list_transform(list_filter(string_split_regex(lines, '\n\n+'), lambda x: {could('replace(x, chr(10), chr(32))')} AND contains(x, chr(10))), lambda x: replace(x, chr(10), ' ')) AS p FROM docs),
said AS (SELECT k, sha256(trim(unnest(p))) AS digest FROM pieces),
hits AS (SELECT k, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM said JOIN keys USING (digest) WHERE scope = 'notice' GROUP BY k)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notice_lines
FROM (SELECT k, doc_id, {one.format("lines")} AS digest FROM docs) LEFT JOIN keys USING (digest) LEFT JOIN hits USING (k)
"""
