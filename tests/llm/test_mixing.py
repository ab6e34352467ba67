from __future__ import annotations

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import edge  # noqa: E402
from oracle import same  # noqa: E402

from reviewloom.llm import mixing  # noqa: E402
from reviewloom.llm.mixing import Target  # noqa: E402
from reviewloom.llm.queries import ORACLE_SQL  # noqa: E402


def skewed(spark, n=900):
    rows = [(i, "w " * (1 + i * 7 % 23), "big" if i % 3 else ("mid" if i % 2 else ("tiny" if i % 10 == 0 else "mid"))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def used(df):
    got = {}
    for r in df.collect():
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    return got


def entropy(w):
    total = sum(w.values())
    return -sum(x / total * math.log(x / total) for x in w.values())


def test_entropy_target_is_met_within_the_budget(spark):
    df, rows = skewed(spark)
    total = sum(len(t.split()) for _, t, _ in rows)
    mixed = used(mixing.mixture(df, Target(entropy=0.9, block_tokens=500)))
    assert entropy(mixed) == pytest.approx(0.9 * math.log(3), abs=0.01)
    assert total * 0.98 < sum(mixed.values()) <= total


def test_repetition_limit_and_whole_epochs(spark):
    df, rows = skewed(spark)
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    got = mixing.mixture(df, Target(entropy=None, repeats=2.0, block_tokens=500)).collect()
    copies = {}
    for r in got:
        copies.setdefault(r.source, {}).setdefault(r.doc_id, set()).add(r.epoch)
    most = {s: max(len(e) for e in d.values()) for s, d in copies.items()}
    assert max(most.values()) == 2 and most["tiny"] == 2
    assert len(copies["tiny"]) == sum(s == "tiny" for *_, s in rows)  # all of it in the first epoch
    assert all(e == set(range(1, len(e) + 1)) for d in copies.values() for e in d.values())


def test_a_small_budget_cuts_the_last_block(spark):
    df, _ = skewed(spark)
    mixed = mixing.mixture(df, Target(entropy=0.9, budget=1000, block_tokens=200))
    assert 900 < sum(used(mixed).values()) <= 1000
    again = mixing.mixture(df.repartition(7), Target(entropy=0.9, budget=1000, block_tokens=200))
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))


def test_rows_without_ids_are_dealt_to_many_blocks(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, f"w {i} " * 10, "s") for i in range(600)], "doc_id long, text string, source string")
    _, blocks = mixing.plan(df, Target(block_tokens=500))
    assert blocks.count() == 24
    placed = mixing.mixture(df, Target(block_tokens=500)).groupBy("place").count().collect()
    assert len(placed) == 24 and max(r["count"] for r in placed) < 60


def test_exponents(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "key string, tokens long")
    share = [0.9, 0.09, 0.01]

    def h(x):
        w = [s**x for s in share]
        return -sum(v / sum(w) * math.log(v / sum(w)) for v in w)

    a = mixing.exponent(totals, Target(entropy=0.8))
    assert h(a) >= 0.8 * math.log(3) > h(a + 1e-6)
    r = mixing.exponent(totals, Target(entropy=None, repeats=5.0))
    most = lambda x: max(s**x / sum(v**x for v in share) / s for s in share)
    assert most(r) <= 5.0 < most(r - 1e-6)
    assert mixing.exponent(totals, Target(entropy=0.1)) == 1.0
    assert mixing.exponent(totals.limit(1), Target(entropy=0.9)) == 1.0


def test_edge_cases(spark):
    docs = edge.table(spark)
    got = mixing.mixture(docs)
    assert got.columns == [*docs.columns, "epoch_1", "place_1"]  # the table has columns of those names
    rows = got.collect()  # the long text fits in no quota, and a cut stops at the first row that doesn't fit
    assert {"src0", "src1"} <= {r.source for r in rows} <= {None, "src0", "src1"} and used(got.fillna("", ["text"])).keys()
    assert mixing.mixture(edge.empty(spark)).count() == 0
    silent = docs.where("text IS NULL OR trim(text) = ''")
    assert mixing.mixture(silent).count() == 0


def test_plan_has_no_python(spark, sf):
    plan = mixing.op5_source_mixing(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_documents_equal_sql(spark, sf):
    assert same(spark, mixing.op5_source_mixing, ORACLE_SQL["op5_source_mixing"], sf) > 0
