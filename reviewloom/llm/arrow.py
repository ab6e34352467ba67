"""Walking over Arrow batches inside tasks, a bounded slice at a time."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

SLICE_ROWS = 512
SLICE_BYTES = 2 << 20
LONG_WORD, LONG_TEXT = 64, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of each batch, none of them empty, with the bytes of column ``text`` (null: empty).

    A piece has at most SLICE_ROWS rows and about SLICE_BYTES of text, so that
    a batch of very long texts does not become as many Python objects at once.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = 0
        while start < batch.num_rows:
            rows = min(SLICE_ROWS, batch.num_rows - start)
            while rows > 1 and column.slice(start, rows).nbytes > SLICE_BYTES:
                rows //= 2
            part = column.slice(start, rows).cast(pa.binary()).to_pylist()
            yield batch.slice(start, rows), [b"" if t is None else t for t in part]
            start += rows


def chunks(texts: list, most_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts (None: empty) as UTF-8 in runs of about ``most_bytes``, a longer text alone."""
    part, size = [], 0
    for t in texts:
        data = b"" if t is None else t.encode()
        if part and size + len(data) > most_bytes:
            yield part
            part, size = [], 0
        part.append(data)
        size += len(data)
    if part:
        yield part


class Memo(dict):
    """Values made once per key, of bounded number and, with ``longest``, size: what was used since the last turnover outlives it.

    Texts bring new words forever, so a task that remembers them needs a bound;
    common words are asked for again before two turnovers and stay.
    """

    def __init__(self, make: Callable, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most // 2, longest, {}

    def __missing__(self, key: Hashable):  # type: ignore[no-untyped-def]
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            self.keep(key, value)
        return value

    def keep(self, key: Hashable, value) -> None:  # type: ignore[no-untyped-def]
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def rows(self, lists: list[list], make_all: Callable[[list], list]) -> list[list]:
        """The values of all keys of all lists; what is not remembered is made in one call."""
        out = [list(map(self.get, keys)) for keys in lists]
        absent = {k for keys, row in zip(lists, out) if None in row for k, v in zip(keys, row) if v is None}
        if absent:
            found = {k: v for k in absent if (v := self.old.get(k)) is not None}
            fresh = sorted(absent - found.keys())
            found.update(zip(fresh, make_all(fresh)))
            for k, v in found.items():
                self.keep(k, v)
            out = [[found[k] if v is None else v for k, v in zip(keys, row)] if None in row else row for keys, row in zip(lists, out)]
        return out
