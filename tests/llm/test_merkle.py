from __future__ import annotations

import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import edge  # noqa: E402
from oracle import same  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from reviewloom.llm import merkle  # noqa: E402
from reviewloom.llm.queries import ORACLE_SQL  # noqa: E402


def digest(x):
    return hashlib.md5(x.encode()).hexdigest()


def runs(paragraph):
    out = [[]]
    for w in paragraph.replace("\x02", "\x02b").replace("\x01", "\x02a").split(" "):
        out[-1].append(w)
        if len(w) % 5 == 0:
            out.append([])
    texts = [" ".join(r) for r in out]
    return texts[:1] + [" " + t if r else "" for t, r in zip(texts[1:], out[1:])]


def tree(text):
    return [[[digest(r) for r in runs(p)] for p in s.split("\n")] for s in text.split("\n\n")]


def levels(text):
    leaves = tree(text)
    paragraphs = [[digest("".join(p)) for p in s] for s in leaves]
    sections = [digest("".join(s)) for s in paragraphs]
    return leaves, paragraphs, sections, digest("".join(sections))


def near(a, b):
    x, y = ({d for s in leaves for p in s for d in p} | {d for s in paragraphs for d in s} | set(sections) | {top} for leaves, paragraphs, sections, top in (levels(a), levels(b)))
    return 2 * len(x & y) / (len(x) + len(y))


def differing(a, b):
    x, y = ({(i, j): d for i, s in enumerate(levels(t)[1]) for j, d in enumerate(s)} for t in (a, b))
    return ",".join(f"{i}.{j}" for i, j in sorted(k for k in x.keys() | y.keys() if x.get(k) != y.get(k)))


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), levels(t)[3], levels(edited)[3], near(t, edited), near(t, following), differing(t, edited)))
    return sorted(out, key=repr)


def test_against_plain_python_with_edge_cases(spark):
    got = sorted((tuple(r) for r in merkle.compare_with_edit(edge.table(spark)).collect()), key=repr)
    assert got == expected([(i, t) for i, t, *_ in edge.rows()])
    assert merkle.compare_with_edit(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("every", [1, 3, 50])
def test_next_across_ranges_and_gaps(spark, monkeypatch, every):
    monkeypatch.setattr(merkle, "RANGE", every)
    ids = [*range(0, 40), 90, 91, 1000, 5000, 5001, -7, *(10**15 + i for i in range(30))]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "k long, text string")
    want = sorted(ids)
    got = {r.k: r.next_text for r in merkle.with_next(df).collect()}
    assert got == {i: f"t{want[(n + 1) % len(want)]}" for n, i in enumerate(want)}
    assert [r.next_text for r in merkle.with_next(df.where("k = 5")).collect()] == ["t5"]
    named = spark.createDataFrame([(f"n{i:02d}", f"t{i}") for i in range(30)] + [(None, "none")], "k string, text string")
    assert {r.k: r.next_text for r in merkle.with_next(named).collect()} == {None: "t0", "n29": "none"} | {f"n{i:02d}": f"t{i + 1}" for i in range(29)}


def test_bunched_and_repeated_ids_fill_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE", 50)
    far = [(1 << 60, "far")]
    rows = [(i, f"text {i}") for i in range(2000)] + [(None, f"no id {i}") for i in range(1500)] + [(5, f"same id {i}") for i in range(1500)] + far
    df = spark.createDataFrame(rows, "k long, text string")
    seen = []
    window = merkle.Window.partitionBy
    monkeypatch.setattr(merkle.Window, "partitionBy", lambda *c: (seen.append(c), window(*c))[1])
    got = merkle.with_next(df)
    assert got.count() == len(rows) and seen == [("range",)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    assert {(r.k, r.text): r.next_text for r in got.collect()} == {x: y[1] for x, y in zip(order, order[1:] + order[:1])}


def test_every_control_character_tells_texts_apart(spark):
    texts = ["hello x", *(f"hello{chr(c)} x" for c in range(32)), "hello\x02a x", "hello\x02b x", "hello\x02\x01 x", "hello\x01", "hello", "one line\nsecond line", "second line\none line", "a a", "a a a"]
    rows = merkle.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in rows}) == len(texts)
    pairs = [(0, "one line\nsecond line"), (1, "second line\none line"), (2, "hello x"), (3, "hello\x01 x")]
    got = {r.doc_id: r.near_next for r in merkle.compare_with_edit(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert 0 < got[0] < 1 and got[2] < 1


def test_branches_locate_an_edit(spark):
    a = "one two three\nfour five\n\nsix seven\neight"
    df = spark.createDataFrame([(1, a), (2, a.replace("five", "FIVE!")), (3, a)], "doc_id long, text string")
    p = {r.doc_id: r for r in merkle.fingerprints(df).collect()}
    assert p[1].fingerprint == p[3].fingerprint != p[2].fingerprint
    both = merkle.fingerprints(df.where("doc_id = 1")).alias("a").crossJoin(merkle.fingerprints(df.where("doc_id = 2")).alias("b"))
    found = both.select(merkle.changed(F.col("a.paragraphs"), F.col("b.paragraphs")).alias("c")).first().c
    assert [(x.section, x.paragraph) for x in found] == [(0, 1)]


def test_plan_has_no_python(spark, sf):
    plan = merkle.op8_document_fingerprints(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_documents_equal_sql(spark, sf):
    assert same(spark, merkle.op8_document_fingerprints, ORACLE_SQL["op8_document_fingerprints"], sf) > 0
