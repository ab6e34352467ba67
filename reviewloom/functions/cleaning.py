"""Cleaning of generated reviews: quotes, preambles, notes, closers, cut endings and cut beginnings.

All of it is column functions, so it stays inside the JVM; where a value is
needed twice it is bound once by a lambda's argument.  Ends are trimmed and rare
phrases looked for without regular expressions, which try every character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of lines that are about the review, what a note in brackets at the end begins with, closing
# remarks, and words that no sentence ends with.
PREAMBLES = ["Here", "Sure", "Okay", "Review", "Rewrite", "Style", "The review"]
REMARKS = ["i kept", "maintained", "style", "sentiment", "wrote", "just"]
CLOSERS = ["Let me know", "Hope this", "Is there anything", "Feel free", "Does this meet"]
LOOSE_ENDS = (
    "and but so or because cuz tho although if that they he she it we i you the a an my ur his her their was is are were been be "
    "didn wasn weren isn aren can cant wont dont feelin hopin tryin goin of in on at to for with about"
).split()
#: What is left of a cut contraction at the beginning, and the words it stands for.
CUT_STARTS = [("m", "I'm"), ("s", "It's"), ("re", "They're"), ("t", "Didn't")]

#: The characters of Unicode's property White_Space, which (?U)\s matches.
_LATIN, _WIDE = ("".join(map(chr, codes)) for codes in ([*range(9, 14), 32, 0x85, 0xA0], [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WHITE = _LATIN + _WIDE
#: Java looks Latin characters up in a table, and others only within the range up to the last.
_WHITES = f"[{_LATIN}[\u1680-\u3000&&[{_WIDE}]]]+"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _WHITES), lambda w: w != "")


def _before(remark: str) -> Callable[[Column], Column]:
    """What stands before a remark in any case, of a stripped text; only texts that have it are searched for where."""
    return lambda text: F.when(F.contains(F.lower(text), F.lit(remark.lower())), _stripped(F.regexp_replace(text, rf"(?is){remark}.*\z", ""))).otherwise(text)


def _without_loose_ends(text: Column) -> Column:
    """The words up to the last that may end a sentence; one letter may not."""
    ends = lambda w: F.lower(w).isin(LOOSE_ENDS) | (F.char_length(w) < 2)

    def cut(words: Column) -> Column:
        last = F.array_max(F.transform(words, lambda w, i: F.when(~ends(w), i + 1)))
        kept = F.slice(words, F.lit(1), F.coalesce(last, F.lit(0)))
        return F.array_join(F.when(ends(F.try_element_at(words, F.lit(-1))), kept).otherwise(words), " ")

    return bound(_words(text), cut)


def clean_generated(text: Column) -> Column:
    """The review in a generated text; null and empty texts give an empty one.

    In this order: of a text with quotes what stands in the first pair, if more
    than three characters; lines that begin like a preamble go; what precedes a
    colon among the first 40 characters goes; notes in brackets at the end and
    everything from a closing remark go; words that can't end a sentence are
    taken off the end; cut contractions at the beginning are completed; quotes,
    commas, stops and hyphens are taken off both ends, and a lone title off the end.
    """
    one_of = lambda values: "|".join(values)
    s = _stripped(F.coalesce(text, F.lit("")))
    s = F.regexp_replace(s, r"""(?sU)\A[^"']*["']\s*([^"'\s][^"']{2,}[^"'\s])\s*["'].*\z""", "$1")
    s = F.filter(F.split(s, "\n"), lambda line: ~F.regexp_like(line, F.lit(rf"(?iU)\A\s*(?:{one_of(PREAMBLES)})")))
    s = _stripped(F.array_join(s, " "))
    s = _stripped(F.regexp_replace(s, r"\A[^:]{0,39}:", ""))
    s = _stripped(F.regexp_replace(s, r"(?is)\(Note:.*\)\z", ""))
    s = _stripped(F.regexp_replace(s, rf"(?is)\((?:{one_of(REMARKS)}).*\)\z", ""))
    for closer in CLOSERS:
        s = bound(s, _before(closer))
    s = _without_loose_ends(s)  # from here on single spaces part the words
    for start, whole in CUT_STARTS:
        s = F.regexp_replace(s, rf"\A'?{start}\s", f"{whole} ")
    s = F.regexp_replace(s, r"\Ad ", "Didn't ")
    s = F.btrim(s, F.lit("\"' ,.-"))
    return _stripped(F.regexp_replace(s, r"(?U)(?=Dr|Prof)\b(?:Dr|Prof)\.?\z", ""))
