"""Arrow batches in tasks, a bounded number of rows at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PIECE = 256


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows at most, without copies: what is made of them as Python objects is freed before the next."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)
