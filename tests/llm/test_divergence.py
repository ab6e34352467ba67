from __future__ import annotations

import os
import random
import re
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import edge  # noqa: E402
from oracle import same  # noqa: E402

from reviewloom.llm import divergence as D  # noqa: E402

SCHEMA = "lang string, source string, text string"


def plain(rows, min_docs=10, top=10):
    """The audit of (lang, source, text) rows as its definition says it, over all terms of all pairs."""
    counts, docs_with, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs_with[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = {t for t, n in docs_with[lang].items() if n >= min_docs}
        others = [s for x, s in groups if x == lang]
        whole = sum((counts[lang, s] for s in others), Counter())

        def p(own, t):
            return 1 + 10**9 * (own[t] + 2) // (sum(own[x] for x in kept) + 2 * len(kept))

        f = lambda a, b: (a - b) ** 2 // (a + b)
        own = counts[lang, source]
        pairs = sorted((-sum(f(p(own, t), p(counts[lang, s], t)) for t in kept), s.encode()) for s in others if s != source)
        near = sorted((-f(p(own, t), p(whole, t)), t.encode()) for t in kept if own[t] and p(own, t) > p(whole, t))[:top]
        for part, found in (("pair", pairs), ("term", near)):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_equals_sql(spark, sf):
    assert same(spark, D.op11_source_divergence, D.OP11_SQL, sf) > 200


def test_equals_the_definition(spark):
    draw = random.Random(11)
    words = ["alpha", "Beta", "gamma", "Ärger", "日本", "ét", "\U0001d54f", "x1y", "it's", "q"]
    rows = [(draw.choice(["en", "de", None, "one"]), draw.choice(["s1", "s2", "S2", "é", None]), " ".join(draw.choice(words) for _ in range(draw.randrange(12)))) for _ in range(300)]
    rows += [("en", "none", None), ("zz", "a", "no term is kept here"), ("zz", "b", "none at all"), ("de", "s1", "alpha " * 50)]
    for least in (1, 10, 10_000):
        got = D.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs=least).collect()
        assert sorted(map(tuple, got)) == plain(rows, least)


def test_counts_survive_a_full_table_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(D, "_MOST_TERMS", 3)
    monkeypatch.setattr(D, "_PIECE", 7)
    rows = [("en", f"s{k % 2}", t) for k, t in enumerate(["one two three four five six", "a" * 100 + " b", "", "one ONE onE", "x" * 7, "x" * 6 + " y", "  two"])]
    want = {(r[1], w): 0 for r in rows for w in r[2].lower().split()}
    for _, s, t in rows:
        for w in t.lower().split():
            want[s, w] += 1
    for text in (r[2].encode() for r in rows):
        assert [w for part in D.terms(text) for w in part] == text.lower().split()
    # the patched sizes hold in this process; tasks run the same code with their own
    got = {(r.source, r.term): r.n for r in D.count_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_terms_of_long_texts_are_not_cut():
    text = ("Wort " * 300_000 + "ü" * 3_000_000 + " ende").encode()
    assert Counter(w for part in D.terms(text) for w in part) == {b"wort": 300_000, ("ü" * 3_000_000).encode(): 1, b"ende": 1}
    assert [list(p) for p in D.terms(b"")] == [] and [w for p in D.terms(b"9_9") for w in p] == []


def test_shares_are_exact_where_longs_overflow(spark):
    n, total, v = 9 * 10**17, 9 * 10**18, 10**7
    from pyspark.sql import functions as F

    got = spark.range(1).select(D.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_edges(spark):
    docs = edge.table(spark)
    got = sorted(map(tuple, D.audit(docs, min_docs=1).collect()))
    assert got == plain([(r.lang, r.source, r.text) for r in docs.collect()], 1)
    assert D.audit(edge.empty(spark)).count() == 0
    twice = docs.union(docs)
    assert sorted(map(tuple, D.audit(twice, min_docs=2).collect())) == plain([(r.lang, r.source, r.text) for r in twice.collect()], 2)
