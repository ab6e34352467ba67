from __future__ import annotations

import hashlib
import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from reviewloom.llm import minhash, simhash  # noqa: E402

SCHEMA = "doc_id long, text string"


def plain(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_null_ids_with_different_texts_all_stay(spark):
    rows = [(None, "no id here at all"), (None, "another text that is not like it"), (None, "no id here at all"), (3, "the third text has an id"), (None, "the third text has an id")]
    want = sorted([rows[0], rows[1], rows[3]], key=str)
    for how in ({}, {"words": 5, "similarity": 0.8}):
        got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), **how)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_one_id_in_two_components_stays_in_both(spark):
    rows = [(1, "a first text under this id"), (1, "quite another one under the same id"), (1, "a first text under this id")]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(set(rows))


def test_the_stage_drops_edited_copies_at_similarity_080(spark, sf):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows = []
    for base in range(12):
        text = [word() for _ in range(200)]
        rows.append((10 * base, " ".join(text)))
        for copy, edits in ((1, 2), (2, 3), (3, 9)):  # similarities of about 0.90, 0.86 and 0.63
            at = draw.sample(range(0, 200, 10), edits)
            rows.append((10 * base + copy, " ".join(word() if i in at else w for i, w in enumerate(text))))
    got = {r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf).collect()}
    assert got == {10 * b + c for b in range(12) for c in (0, 3)}


def test_many_copies_of_one_text_link_by_the_original(spark):
    draw = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    edited = lambda: " ".join(f"x{draw.random()}" if i in (a, a + 1) else w for a in [draw.randrange(5, 90)] for i, w in enumerate(base))
    rows = [(i, edited()) for i in range(60)] + [(99, " ".join(base))]  # copies are at 0.87 to it, mostly below 0.8 to each other
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA), 5, 0.8).collect()] == [0]


def test_edges_are_exact(spark):
    docs = edge.table(spark)
    kept = simhash.keep_one(docs, 5, 0.8)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect() if r.doc_id is not None) == [(False, i) for i in (0, 1, 5, 6, 7, 8, 9)]
    assert minhash.jaccard(set(), set()) == 1.0 and minhash.shingles(b"A b", 5) == {b"a b"}
    assert simhash.keep_one(edge.empty(spark), 5, 0.8).count() == 0


def family(draw, pairs, template_words, own_words, edited):
    """Texts two and two alike that all share a template of words."""
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(7))
    template, rows = [word() for _ in range(template_words)], []
    for k in range(pairs):
        own = [word() for _ in range(own_words)]
        other = [word() if i in range(edited) else w for i, w in enumerate(own)]  # the edits sit together
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template + other))]
    return rows


def test_pairs_within_a_family_of_templates_all_link(spark):
    for pairs, template, own, edited in ((4000, 112, 44, 10), (3000, 131, 29, 8)):
        rows = family(random.Random(pairs), pairs, template, own, edited)
        sets = [plain(t) for _, t in rows[:4]]
        like = lambda a, b: len(a & b) / len(a | b)
        assert like(sets[0], sets[1]) >= 0.8 and like(sets[2], sets[3]) >= 0.8 and 0.5 < like(sets[0], sets[2]) < 0.8
        kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(8), 5, 0.8)
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(0, 2 * pairs, 2))


def test_links_equal_all_pairs(spark):
    draw = random.Random(21)
    rows = family(draw, 80, 60, 30, 3)
    for base in (30, 8, 5):  # short texts and edits of any size, too
        for k in range(40):
            words = [draw.choice("abc") * draw.randrange(1, 4) for _ in range(draw.randrange(1, base))]
            rows.append((1000 + len(rows), " ".join(words)))
    texts = spark.createDataFrame(rows, SCHEMA).withColumn("digest", minhash.text_digest(F.col("text"))).select("digest", "text")
    roots = {bytes(r.node): bytes(r.root) for r in minhash.groups(texts, 5, 0.8).collect()}
    digests = {bytes(r.digest): r.text for r in texts.collect()}
    sets = {d: plain(t) for d, t in digests.items()}
    want = {d: d for d in digests}
    changed = True
    edges = [(a, b) for a in digests for b in digests if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in edges:
            least = min(want[a], want[b])
            changed |= want[a] != least or want[b] != least
            want[a] = want[b] = least
    assert {d: roots.get(d, d) for d in digests} == want and len(edges) > 60


def test_the_stage_verifies_what_simhash_balls_link(spark, sf, monkeypatch):
    draw = random.Random(8)
    rows = []
    for base in range(15):
        text = [f"w{draw.random()}" for _ in range(400)]
        rows += [(10 * base, " ".join(text)), (10 * base + 1, "  ".join(text)), (10 * base + 2, " ".join([*text[:-1], "other"]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    text_of = {hashlib.md5(t.encode()).digest(): (i, t) for i, t in rows}
    fp = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows}
    seen, groups = [], minhash.groups
    monkeypatch.setattr(minhash, "groups", lambda texts, words, similarity, candidates: seen.append(candidates) or groups(texts, words, similarity, candidates))
    assert {r.doc_id for r in P.near_dedup(spark, docs, sf).collect()} == set(range(0, 150, 10))
    linked = {tuple(sorted(text_of[bytes(d)][0] for d in r)) for r in seen[0].collect()}
    assert all((fp[a] ^ fp[b]).bit_count() <= 3 for a, b in linked) and len(linked) >= 15
    for base in range(0, 150, 10):  # texts of one fingerprint, and of two within the radius, come together
        near = {i for i in (base, base + 1, base + 2) if (fp[i] ^ fp[base]).bit_count() <= 3}
        assert base + 1 in near and near <= {i for pair in linked if pair[0] // 10 == base // 10 for i in pair}
