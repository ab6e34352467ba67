"""Periodic runs of words in texts, by suffix automata with ordered end-position sets.

A run is a stretch of words with smallest period q, at least max(12, 2 q) long,
that no neighbouring word extends.  An automaton of the words holds in each
state the substrings with the same set of end positions.  The sets are ordered
and merge, the smaller into the larger, from the longest states to the
shortest.  Two positions that become neighbours in a state, a distance d apart
and d no greater than the state's length, end a square: the words before the
first repeat at distance d.

* No run is lost.  The last two occurrences of its first L - q words are q
  apart and meet in a state of that length, and no occurrence lies between
  them, for a primitive word doesn't occur inside its own square but at its
  halves.
* No period is too long, for the same reason: neighbours of the state's final
  set are a smallest period apart.  Neighbours that a later merge parts don't count.
* A square is extended to its run.  The state where two positions first meet is
  as long as what they share to the left, so the run begins there; of the pairs
  with one beginning and distance the last ends it.

What the automaton is built over.  The first L - q words of a run, six at
least, occur again q further on, and the two occurrences cover the run.  So each
word of a run lies in a sequence of six words that occurs again in the run.
Words that don't are in no run and cut the text into stretches, within which the
same holds again; an automaton is built for each stretch that is left.  Sequences are
compared by hash: equal hashes of unlike sequences only keep words in.  This
drops no candidate, at any size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.arrow import slices
from reviewloom.llm.mixing import WORD_GAPS
from reviewloom.staging import fresh_name, table

SHORTEST = 12
_SEQUENCE = SHORTEST // 2
_ROUNDS, _BLOCK = 8, 512
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, _SEQUENCE + 1, np.uint64) * np.uint64(2) + np.uint64(1)

Run = tuple[int, int, int]  # start, length, period, in words


class Blocks:
    """An ordered set of integers; an insertion moves the elements of one block only."""

    def __init__(self, ordered: list[int]):
        self.blocks = [ordered[k : k + _BLOCK] for k in range(0, len(ordered), _BLOCK)]
        self.heads = [b[0] for b in self.blocks]
        self.size = len(ordered)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        return chain.from_iterable(self.blocks)

    def __getitem__(self, first: int) -> int:
        return self.blocks[0][first]

    def below(self, x: int) -> int:
        """The greatest element less than x, or -1."""
        k = bisect_left(self.heads, x) - 1
        return self.blocks[k][bisect_left(self.blocks[k], x) - 1] if k >= 0 else -1

    def insert(self, x: int) -> None:
        k = max(bisect_left(self.heads, x) - 1, 0)
        block = self.blocks[k]
        insort(block, x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > 2 * _BLOCK:
            self.blocks[k : k + 1] = block[:_BLOCK], block[_BLOCK:]
            self.heads.insert(k + 1, block[_BLOCK])


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length, end position) of each state; the position is -1 for a state split off another, and for the root, 0."""
    step: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]
    last = 0
    for i, word in enumerate(words):
        new = len(step)
        step.append({})
        length.append(i + 1)
        end.append(i)
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            to = step[at][word]
            if length[to] == length[at] + 1:
                link.append(to)
            else:
                half = new + 1
                link.append(half)
                step.append(step[to].copy())
                link.append(link[to])
                length.append(length[at] + 1)
                end.append(-1)
                link[to] = half
                while at >= 0 and step[at].get(word) == to:
                    step[at][word] = half
                    at = link[at]
        last = new
    return link, length, end


def squares(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, period, end) of repeats that together give every run with its bounds."""
    link, length, end = automaton(words)
    ends: dict[int, list[int] | Blocks] = {}
    after = [-1] * len(words)  # a position's next one in its set
    met: dict[int, list[tuple[int, int]]] = {}
    for state in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
        own = ends.pop(state, None)
        if own is None:
            own = [end[state]]
        elif end[state] >= 0:  # the end of a prefix that occurs again
            own = _merged(own, [end[state]], after, length[state], met.setdefault(state, []))
        for one, other in met.pop(state, ()):
            if after[one] == other:
                yield one - length[state] + 1, other - one, other
        up = link[state]
        if up > 0:
            held = ends.get(up)
            ends[up] = own if held is None else _merged(held, own, after, length[up], met.setdefault(up, []))


def _merged(a: list[int] | Blocks, b: list[int] | Blocks, after: list[int], most: int, met: list[tuple[int, int]]) -> list[int] | Blocks:
    """Both sets as one; pairs of new neighbours at most ``most`` apart are added to ``met``."""
    large, small = (a, b) if len(a) >= len(b) else (b, a)
    if isinstance(large, list) and len(large) + len(small) > 4 * _BLOCK:
        large = Blocks(large)
    flat = isinstance(large, list)
    before = -1  # the element of the smaller set that went in last
    for x in small:
        if flat:
            k = bisect_left(large, x)
            one = large[k - 1] if k else -1
        else:
            one = large.below(x)
        if one >= 0:
            other = after[one]
            after[one] = x
            if one != before and x - one <= most:
                met.append((one, x))
        else:
            other = large[0]
        if 0 <= other and other - x <= most:
            met.append((x, other))
        after[x] = other
        if flat:
            large.insert(k, x)
        else:
            large.insert(x)
        before = x
    return large


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of what is left of the words once those that can be in no run are cut out."""
    n = len(codes)
    if n < SHORTEST:
        return []
    h = np.zeros(n - _SEQUENCE + 1, np.uint64)
    for j in range(_SEQUENCE):
        h += (codes[j : j + len(h)] + np.uint64(1)) * _FACTORS[j]
    at = np.arange(len(h))  # where the sequences start that lie in one stretch
    key, left = h, None
    for _ in range(_ROUNDS):
        order = np.argsort(key, kind="stable")
        alike = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:][alike]] = True
        again[order[:-1][alike]] = True
        at = at[again]
        if not len(at):
            return []
        cut = np.nonzero(np.diff(at) > _SEQUENCE)[0]  # stretches that touch are one
        start, end = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + _SEQUENCE
        fits = end - start >= SHORTEST
        found = list(zip(start[fits].tolist(), end[fits].tolist()))
        if found == left or not found:
            return found
        left = found
        size = np.array([e - s - _SEQUENCE + 1 for s, e in found])
        at = np.concatenate([np.arange(s, e - _SEQUENCE + 1) for s, e in found])
        key = h[at] + np.repeat(np.arange(len(found), dtype=np.uint64), size) * _FACTORS[-1]
    return left


def find_runs(words: list) -> list[Run]:
    """All runs of a sequence of hashable words, by start, then period."""
    known: dict = {}
    codes = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    found: dict[tuple[int, int], int] = {}
    for start, end in stretches(codes):
        for at, period, last in squares(codes[start:end].tolist()):
            key = start + at, period
            found[key] = max(found.get(key, 0), start + last)
    return sorted((at, last - at + 1, q) for (at, q), last in found.items() if last - at + 1 >= max(SHORTEST, 2 * q))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.nonzero(np.cumsum(change[:-1]) == 0)[0].tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (array of start, length, period) and collapsed, the text without repeats.

    Words are runs of anything but the bytes 32 and 9 to 13, compared as they
    are; ``collapsed`` joins the kept words by one space.  Nulls: a null text is an
    empty one, with no runs and an empty collapsed text; a null id stays.  Of
    runs that start together the shorter period comes first.  Repeated rows
    give repeated results; an empty table gives an empty one; other columns are
    not read.  A text is held whole, as about 100 bytes a word, and 0.5 KB for each word
    of its longest stretch of repeats.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            counts, found, kept = [], [], []
            for text in texts:
                words = text.split()  # bytes: ASCII white space only
                runs = find_runs(words)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "collapsed"])

    own = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {own}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the ends of one text in ten, chosen by the CRC-32 of the id, made periodic; a null id chooses none.

    With h that CRC, g = floor(h / 10) and n words: if h % 10 is 0, each word
    from a = g % n on is word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    words, n, g = (fresh_name(docs, x) for x in ("tail_words", "tail_n", "tail_g"))
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    gaps = F.filter(F.split(F.col(text_col).cast("string"), WORD_GAPS), lambda w: w != "")
    rows = docs.withColumn(words, F.when(chosen, gaps)).withColumn(n, F.size(words)).withColumn(g, F.floor(h / 10))
    a, p = F.col(g) % F.col(n), F.lit(1) + F.floor((F.col(n) - F.col(g) % F.col(n)) / (F.lit(3) + F.col(g) % 8))
    start, period = fresh_name(docs, "tail_start"), fresh_name(docs, "tail_period")
    planted = F.col(n) > 0
    rows = rows.withColumn(start, F.when(planted, a).cast("int")).withColumn(period, F.when(planted, p).cast("int"))

    def repeated(w: Column, i: Column) -> Column:
        return F.when(i < F.col(start), w).otherwise(F.get(words, F.col(start) + F.pmod(i - F.col(start), F.col(period))))

    text = F.when(planted, F.array_join(F.transform(words, repeated), " ")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*docs.columns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document with the ends that the query's contract plants, as digests, and the longest of them."""
    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    longest = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = periodic_runs(docs).withColumn("top", F.get(longest, F.lit(0)))
    length, period = -F.col("top.l"), F.col("top.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.call_function("div", F.lit(1000) * length, period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
