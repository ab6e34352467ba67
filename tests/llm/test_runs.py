from __future__ import annotations

import hashlib
import os
import random
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

from reviewloom.llm import runs as R  # noqa: E402


def plain(words, shortest=12):
    """All runs by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(shortest, 2 * q) and not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out)


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain(words)
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in drop)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (None,) * 4 if top is None else (top[0], top[1], top[2], 1000 * top[1] // top[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), *first, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words))


def sequences(draw):
    yield from ([], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 40, list("ab" * 6), list("abcabcabcabca"), list("abaababaabaab" * 4))
    for _ in range(400):
        n, k = draw.randrange(90), draw.choice([1, 2, 3, 6, 30])
        yield [draw.randrange(k) for _ in range(n)]
    for _ in range(300):  # repeats inside of repeats, and edited ones
        words = [draw.randrange(40) for _ in range(draw.randrange(1, 12))]
        for _ in range(draw.randrange(1, 5)):
            at, size = draw.randrange(len(words)), draw.randrange(1, 9)
            words[at:at] = words[at : at + size] * draw.randrange(1, 6)
            words.insert(draw.randrange(len(words)), draw.randrange(40))
        yield words[:160]


def test_runs_equal_every_period_at_every_place():
    for words in sequences(random.Random(12)):
        assert R.find_runs(words) == plain(words), words


def test_sets_in_blocks_and_any_shortest_length(monkeypatch):
    monkeypatch.setattr(R, "_BLOCK", 2)
    for words in sequences(random.Random(13)):
        found = {}
        for at, q, last in R.squares(words):
            found[at, q] = max(found.get((at, q), 0), last)
        assert sorted((at, last - at + 1, q) for (at, q), last in found.items()) == plain(words, 1), words


def test_the_cut_keeps_every_run_and_drops_plain_prose():
    draw = random.Random(14)
    words = [draw.randrange(30) for _ in range(4000)]
    words[500:500] = words[100:120] * 3
    cut = R.stretches(np.array(words, np.uint64))
    assert sum(e - s for s, e in cut) < 200 and R.find_runs(words) == plain(words) != []


def test_long_stretches_end_in_time():
    n = 200_000
    assert R.find_runs([0] * n) == [(0, n, 1)]
    draw = random.Random(15)
    part = [draw.randrange(1000) for _ in range(700)]
    found = R.find_runs(part * 100 + [1])
    assert (0, 70_000, 700) in found or (0, 70_001, 700) in found


def test_the_query_equals_brute_force_on_a_whole_table(spark, sf):
    from reviewloom.staging import table

    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    small = [(i, t if len((t or "").split()) <= 1500 else " ".join(t.split()[-1500:])) for i, t in docs]
    got = spark_rows(spark, small)
    assert sorted(got) == sorted(plain_row(*r) for r in small) and sum(r[1] for r in got) > 20
    whole = R.op12_periodic_runs(spark, sf).collect()
    assert len(whole) == len(docs)
    want = {i: planted(i, t) for i, t in docs}
    for r in whole:
        assert r.n_words == len(want[r.doc_id]) and (r.n_runs > 0) == (r.length is not None)


def spark_rows(spark, rows, schema="doc_id long, text string"):
    """The query's rows for a table of our own."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-runs-")
    df = rows if hasattr(rows, "write") else spark.createDataFrame(rows, schema)
    df.write.parquet(f"{folder}/documents.parquet")
    return [tuple(r) for r in R.op12_periodic_runs(spark, folder).collect()]


def test_edges(spark):
    docs = edge.table(spark)
    key = lambda r: tuple(map(str, r))
    got = spark_rows(spark, docs)
    short = [r for r in docs.collect() if len(r.text or "") < 10**4]
    assert sorted((r for r in got if r[0] != 5), key=key) == sorted((plain_row(r.doc_id, r.text) for r in short), key=key)
    (long,) = [r for r in got if r[0] == 5]  # 4,000 times four words, then one more; its CRC chooses no tail
    assert zlib.crc32(b"5") % 10 and long[1:6] == (1, 0, 16_000, 4, 4_000_000) and long[8] == 16_001
    assert long[7] == hashlib.sha256(f"Ärger über lange Wörter. {'x' * 30000}".encode()).hexdigest()
    assert spark_rows(spark, edge.empty(spark)) == []
    out = R.periodic_runs(docs).collect()
    assert len(out) == docs.count() and all(r.collapsed is not None and r.runs is not None for r in out)
