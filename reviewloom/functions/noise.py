"""Typing noise in generated texts, by hashes of a row's key and the place in its text.

What happens at a place depends on seed, key and place alone, so results are
the same however rows are partitioned and however often a task runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.cleaning import bound

_PRIME = 2_147_483_647
#: Casual spellings.
SPELLINGS = {"to": "2", "for": "4", "you": "u", "are": "r", "because": "cuz", "really": "rly", "please": "plz", "people": "ppl", "homework": "hw", "though": "tho", "through": "thru", "and": "&", "professor": "prof"}
CASUAL_STYLES = ("Casual", "Rant", "Short")


def draw(seed: str, key: Column, place: Column | int = 0) -> Column:
    """A whole number below 2**31 - 1 for each key and place."""
    of_key = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long") % _PRIME
    place = F.lit(place) if isinstance(place, int) else place
    return bound((of_key + place.cast("long") * 7919) % _PRIME, lambda x: (x * x + place.cast("long")) % _PRIME)


def _edits(text: str, start: int, most: int) -> str:
    """``text`` with its edits; all places are drawn at once, and only those below ``most`` are looked at."""
    place = np.arange(len(text), dtype=np.int64)
    x = (start + place * 7919) % _PRIME
    x = (x * x + place) % _PRIME  # below 2**62
    out, done = [], 0
    for i in np.flatnonzero(x % 10_000 < most).tolist():
        if i < done or not text[i].isalpha():
            continue
        kind = x[i] // 10_000 % 3
        if kind == 2:
            if i % 2 or not text[i + 1 : i + 2].isalpha():
                continue
            new, after = text[i + 1] + text[i], i + 2
        else:
            new, after = text[i] * 2 * int(kind), i + 1
        out += [text[done:i], new]
        done = after
    return "".join([*out, text[done:]])


def edited(text: Column, key: Column, rate: float = 0.02, seed: str = "noise") -> Column:
    """``text`` with about ``rate`` of its letters dropped, doubled or swapped with the next letter.

    An even place may begin a swap with the odd one after it, which then has no
    edit of its own, so edits never overlap.  Only letters are edited.  A null text stays null,
    a null key is a key of its own.
    """
    most = int(rate * 10_000)

    @F.pandas_udf("string")
    def spoiled(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _edits(t, s, most) for t, s in zip(texts, starts)], dtype=object)

    start = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), F.lit(8)), 16, 10).cast("long") % _PRIME
    return spoiled(text, start)


def casual(text: Column, style: Column, key: Column, seed: str = "casual") -> Column:
    """``text`` as informal styles write it: lower case in seven texts of ten, no full stop at the end, known words respelt in six cases of ten.

    Words are separated by one blank afterwards.  Other styles, and null texts, stay as they are.
    """
    informal = F.lit(False)
    for name in CASUAL_STYLES:
        informal = informal | F.coalesce(F.contains(style, F.lit(name)), F.lit(False))
    spelt = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    s = F.when(draw(f"{seed}l", key) % 10 < 7, F.lower(text)).otherwise(text)
    s = F.filter(F.split(F.regexp_replace(s, r"\.\z", ""), r"(?U)\s+"), lambda w: w != "")

    def word(w: Column, i: Column) -> Column:
        new = F.try_element_at(spelt, F.lower(F.regexp_replace(w, r"(?U)[^\w\s]", "")))
        return F.when(draw(f"{seed}w", key, i) % 10 < 6, F.coalesce(new, w)).otherwise(w)

    return F.when(informal & text.isNotNull(), F.array_join(F.transform(s, word), " ")).otherwise(text)


def slipped(text: Column, key: Column, seed: str = "slip") -> Column:
    """One slip in four texts of ten with 15 characters or more: a letter that isn't the first goes, or the gap after the first stop."""
    n = F.char_length(text)
    at = (draw(f"{seed}p", key) % F.greatest(n - 1, F.lit(1)) + 2).cast("int")
    dropped = F.when(F.regexp_like(F.substr(text, at, F.lit(1)), F.lit(r"\p{L}")), F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1, n))).otherwise(text)
    joined = F.regexp_replace(text, r"(?sU)\A([^.,!?]*(?:[.,!?](?!\s)[^.,!?]*)*[.,!?])\s+", "$1")
    slip = (n >= 15) & (draw(seed, key) % 10 < 4)
    return F.when(slip & (draw(f"{seed}o", key) % 2 == 0), dropped).when(slip, joined).otherwise(text)
