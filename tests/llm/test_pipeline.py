from __future__ import annotations

import hashlib
import os
import sys

import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402
from test_near_copies import plain  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from reviewloom.llm import bpe, mixing, quality, toxicity  # noqa: E402
from reviewloom.staging import stage  # noqa: E402


def first_of_each_component(shingles):
    """Least place of every component whose links are pairs of sets at Jaccard 0.8 or more, all pairs compared."""
    root = list(range(len(shingles)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(shingles):
        for j in range(i):
            b = shingles[j]
            both = len(a & b) if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) else 0
            if both >= 0.8 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in range(len(shingles))}


def test_every_stage_against_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns = docs.columns
    for (name, step), of in zip(P.STAGES[:2], (toxicity, quality)):
        verdict = {r.doc_id: r.predicted for r in of.classify(docs, labels).collect()}
        after = stage(step(spark, docs, sf), name)
        keep = 0 if of is toxicity else 1
        assert after.columns == columns and sorted(r.doc_id for r in after.collect()) == sorted(i for i, p in verdict.items() if p == keep)
        docs = after
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    after = stage(P.near_dedup(spark, docs, sf), "near_dedup")
    want = {rows[k][0] for k in first_of_each_component([plain(t) for _, t in rows])}
    assert after.columns == columns and {r.doc_id for r in after.collect()} == want
    mixed = stage(P.mixed(spark, after, sf), "mixing")
    assert mixed.columns == columns
    total = sum(len(r.text.encode().split()) for r in after.collect())
    assert 0.9 * total < sum(len(r.text.encode().split()) for r in mixed.collect()) <= total
    kept = after.groupBy("doc_id").count().collect()
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in kept}
    got = P.tokens(spark, mixed, sf).collect()
    codec = bpe.Codec(open(bpe.default_tokenizer()[0], "rb").read(), bpe.default_tokenizer()[1])
    library = tiktoken.Encoding("own", pat_str=bpe.default_tokenizer()[1], mergeable_ranks=codec.rank, special_tokens={})
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert len(got) == mixed.count()
    for r in got:
        assert r.n_tokens == len(library.encode_ordinary(text[r.doc_id])) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("make", [edge.table, edge.empty])
def test_stages_on_edge_cases(spark, sf, make):
    docs = make(spark)
    for name, step in P.STAGES:
        out = stage(step(spark, docs, sf), name)
        assert name == "bpe" or out.columns == docs.columns
        docs = out
    assert make is edge.table or docs.count() == 0


def test_repeated_runs_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = sorted((r.doc_id, r.epoch, r.place) for r in mixing.mixture(docs).collect())
    b = sorted((r.doc_id, r.epoch, r.place) for r in mixing.mixture(docs.repartition(5)).collect())
    assert a == b
