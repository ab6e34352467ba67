"""TF-IDF of words and pairs of words at size: texts are read once to count and once to weigh, by numpy inside tasks.

Words are lower-case runs of letters, digits and underscores of two or more
UTF-16 units, as RegexTokenizer in ``models.tfidf`` cuts them.  A term is known by
64 bits: XXH64 of a word, a mix of both for a pair.  So what is shuffled and held per term
is three longs, not its letters.  The vocabulary has the terms with most
occurrences in the training texts; equal ones go by their hash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from reviewloom.llm.arrow import Memo, slices
from reviewloom.staging import shared_dir

_WORD = re.compile(r"\w\w+|(?=\w)[\U00010000-\U0010FFFF]")
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # two odd factors
_WORDS, _LONG = 1 << 17, 64  # words whose hash a task remembers, and letters of the longest
TABLE, _BATCH, ROWS = 1 << 21, 1 << 16, 2048  # rows of a task's table and of what it sends at once; texts to a partition of terms


def _terms(texts: list[bytes], known: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, term) of every word and pair of neighbours."""
    words = [_WORD.findall(t.decode("utf-8", "replace").lower()) for t in texts]
    coded = pa.array([w for part in words for w in part], pa.string()).dictionary_encode()  # each word is hashed once
    h = np.array([known[w] for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    row = np.repeat(np.arange(len(texts)), [len(part) for part in words])
    same = np.flatnonzero(row[1:] == row[:-1])
    pairs = h[same] * _FIRST + h[same + 1] * _SECOND
    return np.concatenate([row, row[same]]), np.concatenate([h, pairs]).view(np.int64)


def _memo() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 42), _WORDS, _LONG)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """The columns term, tf, df of all parts, a term once."""
    all_ = np.concatenate(parts, axis=1)
    all_ = all_[:, np.argsort(all_[0])]
    first = np.flatnonzero(np.r_[True, all_[0, 1:] != all_[0, :-1]])
    return np.stack([all_[0, first], np.add.reduceat(all_[1], first), np.add.reduceat(all_[2], first)])


def counts(texts: DataFrame, partitions: int) -> DataFrame:
    """(term, tf, df): how often each term occurs in column text, and in how many rows.

    A task adds up in a table of TABLE rows and sends it on when it is full, so
    its memory does not grow with its texts; terms are dealt to ``partitions`` tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, held = _memo(), [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            for start in range(0, parts[0].shape[1], _BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0][:, start : start + _BATCH]], names=["term", "tf", "df"])

        for _, part in slices(batches, "text"):
            row, term = _terms(part, known)
            if not len(term):
                continue
            order = np.argsort(term, kind="stable")  # rows stay in order within a term
            term, row = term[order], row[order]
            new = np.r_[True, term[1:] != term[:-1]]
            first = np.flatnonzero(new)
            rows = new | np.r_[True, row[1:] != row[:-1]]
            parts.append(np.stack([term[first], np.diff(np.r_[first, len(term)]), np.add.reduceat(rows.astype(np.int64), first)]))
            held += len(first)
            if held > TABLE:
                parts = [_merged(parts)]
                held = parts[0].shape[1]
                if held > TABLE // 2:
                    yield from sent()
                    parts, held = [], 0
        if parts:
            parts = [_merged(parts)]
            yield from sent()

    per = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, tf long, df long")
    # dealt before Spark adds up: a table of all terms of a task would grow with its texts
    return per.repartition(partitions, "term").groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def fit(train: DataFrame, vocabulary: int = 5000, min_df: float = 1.0, sublinear: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A function that gives a frame's rows with their weighted and normalised terms in column features, in place of text.

    ``min_df`` is a number of rows, or a share of them if less than 1;
    ``sublinear`` damps counts to 1 + ln(count).  Rows are written once and read back.
    """
    n = train.count()
    partitions = max(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS)
    kept = counts(train, partitions).where(F.col("df") >= (min_df if min_df >= 1 else min_df * n)).orderBy(F.desc("tf"), "term").limit(vocabulary).collect()
    size = max(1, len(kept))
    term = np.array([r.term for r in kept], np.int64)
    idf = np.log((n + 1.0) / (np.array([r.df for r in kept], np.float64) + 1.0))
    by_term = np.argsort(term)
    term = term[by_term]

    def weighed(texts: list[bytes], known: Memo) -> pa.StructArray:
        row, own = _terms(texts, known)
        at = np.minimum(np.searchsorted(term, own), max(0, len(term) - 1))
        hit = np.flatnonzero(term[at] == own) if len(term) else np.zeros(0, np.int64)
        cell, tf = np.unique(row[hit] * size + by_term[at[hit]], return_counts=True)
        row, index = cell // size, cell % size
        value = (1.0 + np.log(tf) if sublinear else tf) * idf[index]
        norm = np.sqrt(np.bincount(row, value * value, len(texts)))
        value = value / np.where(norm == 0, 1.0, norm)[row]
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (index.astype(np.int32), value)]
        sparse, sizes = (pa.array(np.full(len(texts), x), t) for x, t in ((0, pa.int8()), (size, pa.int32())))
        return pa.StructArray.from_arrays([sparse, sizes, *lists], names=["type", "size", "indices", "values"])

    def transform(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != "text"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _memo()
            for batch, part in slices(batches, "text"):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), weighed(part, known)], names=[*rest, "features"])

        fields = [df.schema[c] for c in rest]
        path = f"{shared_dir(df.sparkSession)}/features-{uuid.uuid4().hex}"
        df.mapInArrow(run, StructType([*fields, StructField("features", VectorUDT.sqlType())])).write.parquet(path)
        # a vector is stored as that struct, so the rows read back have vectors
        return df.sparkSession.read.schema(StructType([*fields, StructField("features", VectorUDT())])).parquet(path)

    return transform
