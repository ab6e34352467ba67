from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same  # noqa: E402

from reviewloom.llm import urls  # noqa: E402
from reviewloom.llm.queries import ORACLE_SQL  # noqa: E402

URLS = ["http://a.Example.COM/en/7x?q", "https://example.com/en/8", "http://com/en/", "http://xcom/en/1", "http://example.net/de/8/9#f", "http://b.net/de/1", "x://es.org/es/", "x://org/ES/", "no scheme/en/", None, "", "http://", "http:///en/", "http://a..com/en/1", "http://user@h.com:80/en/2", "http://com/en/\nx", "http://é.com/en/1", "http://a.com?/en/", "http://net/de/8", "http://example.net/de/8"]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, None, "allow")
    return host, path, best[2], best[3]


def both_ways(spark, pages, rules):
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for held, limit in ((rules, 1 << 30), (frame, 1 << 30), (frame, 0)):
        yield {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, held, max_index_bytes=limit).collect()}


def test_both_ways_match_a_plain_loop(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, rule string")
    want = {i: brute(u, urls.RULES) for i, u in enumerate(URLS + URLS[:3])}
    assert all(got == want for got in both_ways(spark, pages, urls.RULES))


def test_rules_of_equal_length_and_odd_rules(spark):
    rules = [("a.com", "/", "block"), ("com", "/en", "allow"), ("b.com", "/x", "allow"), ("b.com", "/x", "block"), ("", "/en", "block"), ("com", "en", "block"), ("C.com", "", "block")]
    asked = ["http://a.com/en/abcde", "http://x.b.com/x", "http://com", "http://c.COM/en", "http://c.com/q", "http://d.com/enx"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    want = {0: ("a.com/", "block"), 1: ("b.com/x", "block"), 2: (None, "allow"), 3: ("com/en", "allow"), 4: ("c.com", "block"), 5: ("com/en", "allow")}
    for got in both_ways(spark, pages, rules):
        assert {i: r[2:] for i, r in got.items()} == want


def test_thousands_of_lengths_and_of_labels(spark):
    rules = [("a.com", "/" + "x" * n, "block") for n in range(5000)] + [("b.a.com", "/y", "allow")]
    asked = ["http://c.a.com/" + "x" * 4999 + "z", "http://" + "a." * 100_000 + "b.a.com/yy", "http://" + "l" * 1_000_000 + ".org/x", "http://" + "m" * 1_000_000 + ".a.com/xx"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    want = {0: ("a.com/" + "x" * 4999, "block"), 1: ("b.a.com/y", "allow"), 2: (None, "allow"), 3: ("a.com/xx", "block")}
    for got in both_ways(spark, pages, rules):
        assert {i: r[2:] for i, r in got.items()} == want


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda data: len(data))  # every string of a length collides
    f = tmp_path / "i"
    f.write_bytes(urls.build_index(urls.RULES))
    index = urls.Index(str(f))
    found = index.probe([b"com/en/", b"org/es/", b"net/zz/", b"example.com/en/7", b""])
    text = [index.strings[int(index.offsets[k]) : int(index.offsets[k + 1])].tobytes() if k >= 0 else None for k in found]
    assert text == [b"com/en/", b"org/es/", None, b"example.com/en/7", None]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(None, "http://a.com/en/")], "page_id long, url string")
    assert [tuple(r) for r in urls.judge(pages, []).collect()] == [(None, "a.com", "/en/", None, "allow")]
    assert urls.judge(pages.limit(0), urls.RULES).count() == 0


def test_pages_equal_sql(spark, sf):
    assert same(spark, urls.op3_url_filters, ORACLE_SQL["op3_url_filters"], sf) > 0


def test_verdicts_are_read_alike_both_ways(spark):
    pages = spark.createDataFrame([(0, "http://a.com/x"), (1, "http://b.com/x")], "page_id long, url string")
    for got in both_ways(spark, pages, [("a.com", "/", " BLOCK "), ("b.com", "/x", "Allow")]):
        assert {i: r[2:] for i, r in got.items()} == {0: ("a.com/", "block"), 1: ("b.com/x", "allow")}
    for odd in ("deny", None, ""):
        rules = [("a.com", "/", "block"), ("b.com", "/x", odd)]
        for held in (rules, spark.createDataFrame(rules, "host string, path string, verdict string")):
            for limit in (1 << 30, 0):
                with pytest.raises(ValueError, match="verdict"):
                    urls.judge(pages, held, max_index_bytes=limit)
    without = [("", "/x", "deny"), (None, "/x", None)]  # no host: fits nothing, whatever its verdict
    for got in both_ways(spark, pages, without):
        assert {r[3] for r in got.values()} == {"allow"}
