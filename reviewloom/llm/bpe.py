"""Byte-level BPE as a monoid: encode by tree reduction, decode by concatenation.

An encoding is valid exactly if each of its tokens and each pair of neighbours
is what byte-pair merging makes of those bytes alone: merges inside a span of
final tokens happen in the same order with and without the text around it, and
the first merge across a border would also be made with only the two tokens
beside that border present.  So valid encodings form a monoid under this join:
re-encode a window around the seam, and grow it on the side whose border pair
is not stable, until both border pairs are; then the tokens outside provably
stay.  A piece of text is split in halves down to short leaves, and the halves
are joined on the way up.  Merging takes the pair of least rank, the leftmost
of equal ones.  A piece that is a token as a whole is that token.

Texts are cut by the tokenizer's pattern first; no merge crosses such a cut, so
pieces are encoded once and kept in a bounded cache of each worker, with their
ids as text and the bytes that the ids decode to.  The pieces of a slice of
texts that are leaves are merged together in numpy.  Decoding concatenates the tokens' bytes up a tree of FAN children a node:
bytes of tokens to bytes of a piece, and so on to the whole text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.arrow import Memo, slices
from reviewloom.staging import table

LEAF_BYTES = 16
CACHED_PIECES = 240_000
CACHED_PAIRS = 120_000
CACHED_PIECE_CHARS = 64
LONG_CHARS, BLOCK_PIECES = 1 << 20, 1 << 17
FAN = 256


def fold(parts: list, between: str | bytes) -> str | bytes:
    """The parts concatenated up a tree: FAN neighbours at a time, level by level."""
    while len(parts) > FAN:
        parts = [between.join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    return between.join(parts)


class Codec:
    """Encoder and decoder for one rank file; ``ranks`` is its content (base64 token, space, rank, by line)."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.decimal = {rank: str(rank) for rank in self.token}
        self.unmerged = max(self.token) + 1
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self.pair = {(a, b): rank for token, rank in self.rank.items() for k in range(1, len(token)) if (a := self.rank.get(token[:k])) is not None and (b := self.rank.get(token[k:])) is not None}
        codes = np.array([[a * (self.unmerged + 1) + b, rank] for (a, b), rank in self.pair.items()], np.int64).reshape(-1, 2)
        self.codes, self.becomes = codes[np.argsort(codes[:, 0])].T.copy()
        self.regex = regex.compile(pattern)
        self.known, self.spelled = Memo(self.piece, CACHED_PIECES), Memo(self.spell, CACHED_PIECES)
        self.stable_pairs = Memo(lambda pair: self.merge(self.token[pair[0]] + self.token[pair[1]]) == list(pair), CACHED_PAIRS)

    def merge(self, data: bytes) -> list[int]:
        """Plain merging of a short run of bytes: leaves and windows."""
        get, none = self.pair.get, self.unmerged
        ids = [self.byte[b] for b in data]
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)  # the leftmost of equal ranks; the rank of a pair is the id that it becomes
            ids[i] = least
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((least, ids[i + 1]), none)
            if i:
                ranks[i - 1] = get((ids[i - 1], least), none)
        return ids

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; ``unmerged`` for what is no pair, and beside the padding, which has that id."""
        asked = a * (self.unmerged + 1) + b
        at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
        return np.where(self.codes[at] == asked, self.becomes[at], self.unmerged)

    def leaves(self, spans: list[bytes]) -> list[list[int]]:
        """merge() of many leaves at once, in rounds: each merges the least pair of every span that has one."""
        sizes = np.array([len(x) for x in spans])
        inside = np.arange(sizes.max(initial=0) + 1) < sizes[:, None]
        ids = np.full(inside.shape, self.unmerged, np.int64)
        ids[inside] = np.array(self.byte)[np.frombuffer(b"".join(spans), np.uint8)]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        out: list[list[int]] = [[]] * len(spans)
        row = np.arange(len(spans))
        while True:
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)  # the leftmost of equal ranks
            least = ranks[np.arange(len(row)), best] if ranks.shape[1] else np.full(len(row), self.unmerged)
            done = least == self.unmerged
            for k, own in zip(row[done].tolist(), ids[done].tolist()):
                out[k] = [x for x in own if x != self.unmerged]
            if done.all():
                return out
            row, ids, ranks, best, least = (x[~done] for x in (row, ids, ranks, best, least))
            each, column = np.arange(len(row)), np.arange(ids.shape[1] - 1)
            ids[each, best] = least
            ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= best[:, None]), 1)
            for at in (best - 1, best):
                some = (at >= 0) & (at < ranks.shape[1])
                ranks[each[some], at[some]] = self.pair_ranks(ids[each[some], at[some]], ids[each[some], at[some] + 1])

    def stable(self, left: int, right: int) -> bool:
        """Whether these two tokens stay as they are when they stand side by side."""
        return self.stable_pairs[left, right]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbouring texts from their encodings."""
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        i, j = len(a) - 1, 1
        while True:
            window = self.span(a[i:], b[:j])
            left = i == 0 or self.stable(a[i - 1], window[0])
            right = j == len(b) or self.stable(window[-1], b[j])
            if left and right:
                return a[:i] + window + b[j:]
            grow = len(a) - i + j  # windows double at least, so long unstable runs cost n log n
            if not left:
                i = max(0, i - grow)
            if not right:
                j = min(len(b), j + grow)

    def span(self, a: list[int], b: list[int]) -> list[int]:
        data = b"".join(map(self.token.__getitem__, a + b))
        return self.merge(data) if len(data) <= 2 * LEAF_BYTES else self.heap(data)

    def heap(self, data: bytes) -> list[int]:
        """Merging of a longer window, by a heap of neighbouring pairs."""
        from heapq import heapify, heappop, heappush

        rank, n = self.rank, len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(r, i, data[i : i + 2]) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, whole = heappop(queue)
            k = after[i]
            if part[i] is None or k < 0 or part[i] + part[k] != whole:
                continue
            part[i], part[k] = whole, None
            after[i] = after[k]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := rank.get(both := part[x] + part[y])) is not None:
                    heappush(queue, (r, x, both))
        return [rank[p] for p in part if p is not None]

    def tree(self, data: bytes) -> list[int]:
        """Encode halves and join them."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        data = piece.encode()
        whole = self.rank.get(data)
        return (whole,) if whole is not None else tuple(self.tree(data))

    def encode_all(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """piece() of many: the short ones are leaves and are merged together."""
        data = [p.encode() for p in pieces]
        out = [(whole,) if (whole := self.rank.get(x)) is not None else None for x in data]
        short = [k for k, x in enumerate(data) if out[k] is None and len(x) <= LEAF_BYTES]
        for k, ids in zip(short, self.leaves([data[k] for k in short])):
            out[k] = tuple(ids)
        return [tuple(self.tree(x)) if ids is None else ids for x, ids in zip(data, out)]

    def spelling(self, ids: tuple[int, ...]) -> tuple[str, bytes]:
        """Ids in decimals joined by commas, and the bytes that they decode to."""
        return ",".join(map(self.decimal.__getitem__, ids)), self.decode(ids)

    def spell(self, piece: str) -> tuple[str, bytes]:
        return self.spelling(self.piece(piece))

    def spell_all(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        return list(map(self.spelling, self.encode_all(pieces)))

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text; those of a long one in blocks, so that they are not all in memory."""
        if len(text) <= LONG_CHARS:
            yield self.regex.findall(text)
            return
        matches = self.regex.finditer(text)
        while block := [m[0] for m in islice(matches, BLOCK_PIECES)]:
            yield block

    def values(self, lists: list[list[str]], memo: Memo, make_all: Callable[[list[str]], list]) -> list[list]:
        """A value per piece, remembered for pieces that are not long."""
        long = {p for own in lists for p in own if len(p) > CACHED_PIECE_CHARS}
        if not long:
            return memo.rows(lists, make_all)
        made = {p: memo.make(p) for p in long}
        rows = memo.rows([[p for p in own if p not in long] for own in lists], make_all)
        return [[made[p] if p in long else next(rest) for p in own] for own, rest in zip(lists, map(iter, rows))]

    def encode(self, text: str) -> list[int]:
        return [i for block in self.blocks(text) for ids in self.values([block], self.known, self.encode_all)[0] for i in ids]

    def decode(self, ids: list[int] | tuple[int, ...]) -> bytes:
        """The bytes of the tokens, concatenated up the tree."""
        return fold(list(map(self.token.__getitem__, ids)), b"")

    def round_trips(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text: the number of ids, the digest of the ids as text, and that of the bytes that they decode to."""
        together = self.values([self.regex.findall(t) for t in texts if len(t) <= LONG_CHARS], self.spelled, self.spell_all)
        short = iter(together)
        for t in texts:
            ids_digest, data_digest, n = hashlib.sha256(), hashlib.sha256(), 0
            for rows in [next(short)] if len(t) <= LONG_CHARS else (self.values([block], self.spelled, self.spell_all)[0] for block in self.blocks(t)):
                ids = fold([r[0] for r in rows], ",")
                ids_digest.update((f",{ids}" if n else ids).encode())
                data_digest.update(fold([r[1] for r in rows], b""))
                n += ids.count(",") + 1 if rows else 0
            yield n, ids_digest.hexdigest(), data_digest.hexdigest()


_codecs: dict[str, Codec] = {}


def _codec(ranks: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary, so that its cache outlives a task."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _ranks(spark: SparkSession, path: str):
    """The rank file of a tokenizer (a fixed size, under 1 MB here), read on the driver and broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the token ids of each whole text; a null text is an empty one, without tokens."""
    shared = _ranks(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch, texts in slices(batches, "text"):
            ids = pa.array([codec.encode(t.decode()) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, data): the bytes that the ids stand for; null ids give none."""
    shared = _ranks(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            data = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    kind = tokens.schema[id_col].dataType.simpleString()
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for each row: encoded, decoded again, and both digested.

    Ids and decoded bytes of a text stay in the task that made them.  A null
    text is an empty one (no tokens, the digest of nothing); repeated rows and
    null ids stay; an empty table gives an empty result; a text of any length
    is encoded whole.  Other columns are not read.
    """
    shared = _ranks(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch, texts in slices(batches, "text"):
            counts, encoded, decoded = zip(*codec.round_trips([t.decode() for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def default_tokenizer() -> tuple[str, str]:
    """Path and pattern of the public many-language vocabulary that the query and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *default_tokenizer())
