from __future__ import annotations

import os
import random
import re
import sys

import numpy as np
import xxhash

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

from reviewloom.llm import simhash  # noqa: E402


def plain(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    """The least index reachable from each by links of at most 3 bits, all pairs compared."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprints_match_the_definition():
    draw = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join("".join(draw.choice("abÄÉß0") for _ in range(draw.randrange(1, 6))) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain(text)
    assert simhash.fingerprint("a\u00a0b C\x1cd".encode()) == plain("a\u00a0b C\x1cd")


def test_links_connect_exactly_what_all_pairs_do(spark):
    draw = random.Random(7)
    fps = set()
    for _ in range(12):
        center = draw.getrandbits(64)
        for _ in range(40):
            fps.add(center ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(0, 6))))
    fps |= {0, (1 << 64) - 1, 1 << 63, 7, 1 << 31, 3 << 31}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(df)
    assert all((r.fp ^ r.center).bit_count() <= 3 or bin((r.fp ^ r.center) & (2**64 - 1)).count("1") <= 3 for r in edges.collect())
    root = {r.node: r.root for r in simhash.components(edges, "fp", "center").collect()}
    want = groups(fps)
    by_root, by_want = {}, {}
    for f, w in zip(signed, want):
        by_root.setdefault(root.get(f, f), set()).add(f)
        by_want.setdefault(w, set()).add(f)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))


def test_a_long_chain_is_one_component(spark):
    chain, fp = [], 0
    for b in range(0, 63, 3):
        chain.append(fp)
        fp |= 7 << b
    signed = np.array(chain, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert len({r.root for r in simhash.components(edges, "fp", "center").collect()}) == 1


def test_documents_against_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash_near_dedup(spark, sf).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [plain(t) for _, t in docs]
    assert got == {i: (f"{f:016x}", docs[g][0]) for (i, _), f, g in zip(docs, fps, groups(fps))}


def test_edge_cases(spark):
    got = simhash.near_duplicates(edge.table(spark)).collect()
    assert len(got) == len(edge.rows()) and set(got[0].asDict()) == {"doc_id", "fingerprint", "component_id"}
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in zero) == [(False, 1), (False, 2), (False, 3), (True, 0)] and {r.component_id for r in zero} == {1}
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (0, 4)} == {0: 0, 4: 0}
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = edge.table(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=lambda i: (i is None, i)) == [0, 1, 5, 6, 7, 8, 9, None]
    assert simhash.keep_one(edge.empty(spark)).count() == 0
