"""Joins by text, by position and by nearness."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reviewloom.dims import OPINION_CODES
from reviewloom.functions.text import token_set
from reviewloom.pieces import pieces


#: Bytes of query tokens that every task may hold.
QUERY_BYTES = 64 << 20


def token_overlap(queries: DataFrame, pool: DataFrame, k: int, max_bytes: int = QUERY_BYTES, min_overlap: int = 1) -> DataFrame:
    """(query_id, doc_id, overlap, place): the k pool rows that share most distinct tokens with each query.

    Equal overlaps are ordered by doc_id; rows that share fewer than
    ``min_overlap`` tokens with a query don't appear.  With 0, rows that share
    none follow those that do, so every query has k rows if the pool has.  Null
    texts have no tokens.

    Queries whose tokens fit in ``max_bytes`` go to every task, which counts
    its rows against all of them and keeps the k best of each: what is shuffled
    is k rows per task and query, however common a token is.  Larger query sets
    are joined to the pool token by token, with the same rows.
    """
    q = queries.select("query_id", token_set(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    size = q.agg(F.sum(F.aggregate("tokens", F.lit(0), lambda n, t: n + F.octet_length(t) + 64)).alias("bytes")).first()["bytes"] or 0
    hits = _best_by_scan(q, pool, k) if size <= max_bytes else _pairs_by_join(q, pool)
    if min_overlap <= 0:
        # a query with fewer than k hits lacks no more rows than the first k of the pool have for it
        firsts = pool.select("doc_id").orderBy("doc_id").limit(k).agg(F.collect_list(F.struct("doc_id")).alias("firsts"))
        none = queries.select("query_id").crossJoin(F.broadcast(firsts)).select("query_id", F.inline("firsts"))  # one row of k ids
        hits = hits.unionByName(none.withColumn("overlap", F.lit(0).cast("long"))).groupBy("query_id", "doc_id").agg(F.max("overlap").alias("overlap"))
    hits = hits.where(F.col("overlap") >= min_overlap)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "doc_id"))
    return hits.withColumn("place", place).where(F.col("place") <= k)


def _pairs_by_join(q: DataFrame, pool: DataFrame) -> DataFrame:
    asked = q.select("query_id", F.explode("tokens").alias("token"))
    told = pool.select("doc_id", F.explode(token_set(F.col("text"))).alias("token"))
    return asked.join(told, "token").groupBy("query_id", "doc_id").agg(F.count("*").alias("overlap"))


def _best_by_scan(q: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    rows = q.collect()  # within max_bytes
    ids = [r.query_id for r in rows]
    postings: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        for t in r.tokens:
            postings.setdefault(t, []).append(i)
    shared = q.sparkSession.sparkContext.broadcast((ids, {t: np.array(p, np.int32) for t, p in postings.items()}))
    kinds = dict(q.dtypes)["query_id"], dict(pool.dtypes)["doc_id"]
    types = [to_arrow_type(q.schema["query_id"].dataType), to_arrow_type(pool.schema["doc_id"].dataType), pa.int64()]

    def rank(hit: tuple) -> tuple:  # nulls first, as Spark sorts them
        return -hit[0], hit[1] is not None, hit[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, postings = shared.value
        best: list[list[tuple]] = [[] for _ in ids]  # (overlap, doc_id), the best first
        least = np.ones(len(ids), np.int64)  # overlaps below don't enter
        for doc, tokens in chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in pieces(batches)):
            met = [postings[t] for t in tokens if t in postings]
            if not met:
                continue
            overlap = np.bincount(np.concatenate(met), minlength=len(ids))
            for i in np.flatnonzero(overlap >= least):
                mine, new = best[i], (int(overlap[i]), doc)
                if len(mine) < k or rank(new) < rank(mine[-1]):
                    insort(mine, new, key=rank)
                    del mine[k:]
                    if len(mine) == k:
                        least[i] = mine[-1][0]
        out = [(ids[i], doc, n) for i, mine in enumerate(best) for n, doc in mine]
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "doc_id", "overlap"])

    tokens = F.coalesce(token_set(F.col("text")), F.array().cast("array<string>"))
    return pool.select("doc_id", tokens.alias("tokens")).mapInArrow(count, f"query_id {kinds[0]}, doc_id {kinds[1]}, overlap long")


def contained(spans: DataFrame, marks: DataFrame, width: int = 256) -> DataFrame:
    """Marks inside spans of the same file: (file, span_begin, span_end, begin, end).

    A range join by buckets of positions: a span is listed in each bucket it
    touches and a mark in the one where it begins, so a long file's spans and
    marks don't all meet.
    """
    s = spans.select("file", "span_begin", "span_end", F.explode(F.sequence(F.floor(F.col("span_begin") / width), F.floor(F.col("span_end") / width))).alias("bucket"))
    m = marks.withColumn("bucket", F.floor(F.col("begin") / width))
    return s.join(m, ["file", "bucket"]).where("begin >= span_begin AND end <= span_end").drop("bucket")


def nearest_opinions(marks: DataFrame, within: int = 80, known: tuple[str, ...] = tuple(OPINION_CODES)) -> DataFrame:
    """(file, span_begin, aspect_raw, opinion_raw): each aspect with its own opinion, or the nearest free one of its span.

    An opinion is a code in ``known``; an aspect with another code looks for
    the nearest like one without.  Aspects choose in order of position; an opinion is used once; the first of
    equally near ones wins.

    Aspects with their own opinion need no partner and stay in the plan.  Of
    the others, what one takes the next can't, so the marks of each span that
    has both kinds are walked in order, as one row of a batch; a span is a
    review's passage and has a handful.
    """
    aspect, own = F.coalesce(F.col("aspect_raw"), F.lit("")) != "", F.coalesce(F.col("opinion_raw").isin(list(known)), F.lit(False))
    kinds = dict(marks.dtypes)
    schema = f"file {kinds['file']}, span_begin {kinds['span_begin']}, aspect_raw string, opinion_raw string"
    direct = marks.where(aspect & own).select("file", "span_begin", "aspect_raw", "opinion_raw")
    # an opinion by itself has an empty aspect, an aspect in search of one gets an empty opinion
    open_ = marks.where(aspect != own).select("file", "span_begin", F.struct("begin", "end", F.when(aspect, F.col("aspect_raw")).otherwise("").alias("a"), F.when(own, F.col("opinion_raw")).otherwise("").alias("o")).alias("m"))
    spans = open_.groupBy("file", "span_begin").agg(F.array_sort(F.collect_list("m")).alias("m"))
    both = spans.where(F.exists("m", lambda m: m["a"] != "") & F.exists("m", lambda m: m["o"] != ""))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for file, span, *fields in part.itertuples(index=False):
                rows = list(zip(*fields))
                free = [r for r in rows if r[3]]
                for begin, end, name, opinion in rows:
                    away = [] if opinion else [min(abs(begin - o[0]), abs(end - o[1])) for o in free]
                    if away and min(away) <= within:
                        out.append((file, span, name, free.pop(away.index(min(away)))[3]))
            yield pd.DataFrame(out, columns=["file", "span_begin", "aspect_raw", "opinion_raw"])

    found = both.select("file", "span_begin", "m.begin", "m.end", "m.a", "m.o").mapInPandas(walk, schema)
    return direct.unionByName(found)


def overlay(packet: DataFrame, answers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The packet's rows and column order, with answered values in place of its own."""
    a = answers.select(key, *[F.col(c).alias(f"{c}_new") for c in columns])
    joined = packet.join(a, key, "left")
    return joined.select(*[F.coalesce(f"{c}_new", c).alias(c) if c in columns else F.col(c) for c in packet.columns])


def demonstrations(pool: DataFrame, key: str, size: str, k: int) -> DataFrame:
    """Few-shot examples of different sizes: one of each size in turn, texts used once."""
    once = pool.withColumn("copy", F.row_number().over(Window.partitionBy(F.md5("text")).orderBy(key))).where("copy = 1")
    turn = once.withColumn("turn", F.row_number().over(Window.partitionBy(size).orderBy(F.md5(F.col(key).cast("string")), key))).where(F.col("turn") <= k)
    return turn.orderBy("turn", size).limit(k).drop("copy")
