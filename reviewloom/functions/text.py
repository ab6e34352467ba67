"""Scalar text functions over columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = r"[ \t\n\x0b\f\r]+"


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def token_set(text: Column) -> Column:
    """Distinct runs of a-z, 0-9 and underscore of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_key(text: Column) -> Column:
    """A title for comparison: letters and digits in lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def titles_match(a: Column, b: Column) -> Column:
    """Whether one title's key contains the other's, neither being empty."""
    x, y = title_key(a), title_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def inferred_title(entry: Column) -> Column:
    """The title of a reference entry: what follows the year and its full stop, up to a stop between spaces; else the whole entry."""
    found = F.regexp_extract(entry, r"\b(?:19|20)\d{2}\.\s+(.*?)\s+\.\s+", 1)
    return F.when(found == "", entry).otherwise(F.trim(found))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def preview(text: Column, n: int = 80) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def unfence(text: Column) -> Column:
    """Text inside a code fence, without the fence and its language."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*[ \t]*\n?|\n?```$", ""))


def cue_tags(raw: Column) -> Column:
    """Sorted distinct tags of a string delimited by comma, semicolon, slash or bar, words of a tag joined by underscores."""
    parts = F.transform(F.split(F.lower(raw), r"[,;/|]"), lambda x: F.replace(collapse_space(x), F.lit(" "), F.lit("_")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


#: The length schemes: bounds below which a text's words fall in each band, and the bands' names.
BANDS = {"packet": ([30, 80, 180], ["short", "mid", "long", "very_long"]), "annotation": ([15, 40], ["short", "mid", "long"]), "generation": ([80, 150], ["short", "medium", "long"])}


def length_band(n_words: Column, scheme: str) -> Column:
    bounds, names = BANDS[scheme]
    band = F.when(n_words < bounds[0], names[0])
    for bound, name in zip(bounds[1:], names[1:]):
        band = band.when(n_words < bound, name)
    return band.otherwise(names[-1])


def salvage_field(text: Column, field: str) -> Column:
    """A string field of JSON that doesn't parse, by a pattern; null if it isn't there."""
    found = F.regexp_extract(text, rf'(?is)"{field}"\s*:\s*"([^"]*)"', 1)
    return F.nullif(found, F.lit(""))


def _block(text: str | None) -> str | None:
    """The first run from a brace to its partner, counting braces in strings too."""
    if text is None or (start := text.find("{")) < 0:
        return None
    depth = 0
    for m in re.finditer(r"[{}]", text[start:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return text[start : start + m.end()]
    return None


@F.pandas_udf(StringType())
def json_block(texts: pd.Series) -> pd.Series:
    """The first balanced JSON object in a text; null if there is none.  Braces are not regular, so this is Python."""
    return texts.map(_block)


def _prefix_matches(w: list[str]) -> list[int]:
    """How many words from each place on agree with the beginning, in time linear in the words."""
    z, left, right = [len(w)] + [0] * (len(w) - 1), 0, 0
    for i in range(1, len(w)):
        n = min(right - i, z[i - left]) if i < right else 0
        while i + n < len(w) and w[n] == w[i + n]:
            n += 1
        z[i] = n
        if i + n > right:
            left, right = i, i + n
    return z


def _unrepeated(text: str | None) -> str | None:
    """The longest beginning of 25 words or more that is at once said again; or half of 80 words or more whose halves begin alike."""
    w = (text or "").split()
    if len(w) < 50:
        return text
    z = _prefix_matches(w)
    said = max((n for n in range(25, len(w) // 2 + 1) if z[n] >= n), default=0)
    if not said and len(w) >= 80:
        halves = (w[: len(w) // 2], w[len(w) // 2 :])
        one, other = (" ".join(half)[:200] for half in halves)
        said = len(halves[0]) if one == other else 0
    return " ".join(w[:said]) if said else text


@F.pandas_udf(StringType())
def collapse_repeats(texts: pd.Series) -> pd.Series:
    """One copy of a text that says the same 25 or more words twice; the split point is searched, so this is Python."""
    return texts.map(_unrepeated)


def slang(text: Column, swaps: dict[str, str], key: Column, share: float) -> Column:
    """Word swaps in a fixed share of the rows, by a hash of ``key``."""
    out = text
    for word, new in sorted(swaps.items()):
        out = F.regexp_replace(out, rf"\b{re.escape(word)}\b", new)
    return F.when(F.pmod(F.xxhash64(key), F.lit(1000)) < int(share * 1000), out).otherwise(text)


