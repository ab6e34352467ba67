"""What tasks hold at a time does not grow with the rows they are given."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from reviewloom.operators import joint, retrieval
from reviewloom.pieces import PIECE, pieces
from reviewloom.sources import readers


def test_pieces_are_bounded_and_whole():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["a"]) for n in (0, 1, PIECE, 3 * PIECE + 1)]
    found = list(pieces(iter(batches)))
    assert max(p.num_rows for p in found) == PIECE
    assert [x for p in found for x in p.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]
    assert all(m.pieces is pieces for m in (joint, retrieval, readers))


def test_weights_of_many_tasks_are_averaged_in_rounds(spark, monkeypatch):
    """More tasks than FAN_IN squared: no step but the last may leave FAN_IN weights to one task."""
    t = joint.Training(buckets=64, hidden=2)
    rows = spark.createDataFrame([(i, f"word{i} other{i}", i % 2) for i in range(90)], "review_id long, text string, y_a int")
    dealt = joint.featured(rows, ["a"], t.buckets).repartition(70)
    dealt.count()
    rounds, by_id = [], type(rows).repartitionById
    monkeypatch.setattr(type(rows), "repartitionById", lambda df, n, c: rounds.append(n) or by_id(df, n, c))
    w = joint.start(1, t)
    after = joint.epoch(dealt, w, np.ones(t.buckets), np.ones(1), 0.0, t)  # at rate 0 nothing but the sums of squares moves
    assert rounds == [9, 8]
    assert all(np.allclose(after[k], w[k]) for k in ("words", "detect", "feel"))
