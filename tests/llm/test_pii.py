from __future__ import annotations

import hashlib
import os
import random
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

from reviewloom.llm import pii  # noqa: E402
from reviewloom.staging import table  # noqa: E402

AUTOMATON = pii.anchors()
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, text):
    digits = [int(c) for c in text if c.isascii() and c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        double = [d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    """The base spans as the patterns give them."""
    return [(kind, m.start(), m.end()) for kind, pattern in PATTERNS for m in re.finditer(pattern, text) if passes(kind, m[0])]


def spans(text):
    return pii.find_spans(text, text.encode().lower().decode(), AUTOMATON)


def base(text):
    return [s[:3] for s in spans(text) if s[3]]


def added(text):
    return [(k, text[a:b]) for k, a, b, own in spans(text) if not own]


def test_base_spans_equal_the_patterns_on_random_texts():
    draw = random.Random(13)
    bits = ["@", "a", "b.c", ".", "..", "-", "+", "1", "25", "255.", "256", " ", "  ", "(", ")", "4465758382889437", "4465 7583 8288 9437", "x@y.z", "@b.c@", "+1 (743) 555-3824", "Ü", "\n", "0", "\U0001f600", "٣", "1.2.3.4", ".5.6"]
    for _ in range(20_000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(14)))
        assert base(text) == plain(text), text


def test_base_spans_equal_the_patterns_on_the_table(spark, sf):
    rows = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = pii.op13_personal_data(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    line = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    for r in got:
        want = plain(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(line(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.BASE)
        listed = [x for x in r.spans.split(",") if x]
        assert set(line(want).split(",")) - {""} <= set(listed)
        order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in listed)]
        assert order == sorted(order) and all(0 <= a < b <= len(rows[r.doc_id]) for _, a, b in order)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 10


def test_added_spans():
    assert added("cards 4465758382889437 4465758382889437 here") == [("card", "4465758382889437")] * 2
    assert added("no: 4465758382889438 4465758382889438 and 123456789012345678901234567890") == []
    assert added("mail jane.doe [at] example [dot] com or bob(at)mail.example.org.") == [("email", "jane.doe [at] example [dot] com"), ("email", "bob(at)mail.example.org")]
    assert added("look (at) him. Then leave (at) 5.30 and stay (at) home") == []
    assert added("IBAN: DE89 3704 0044 0532 0130 00, and GB82WEST12345698765432.") == [("account", "DE89 3704 0044 0532 0130 00"), ("account", "GB82WEST12345698765432")]
    assert added("IBAN: DE88 3704 0044 0532 0130 00 XDE89370400440532013000 de89370400440532013000") == []
    assert added("Account No. 1234-5678-90; SSN 123-45-6789, ssn 666-45-6789") == [("account", "1234-5678-90"), ("account", "123-45-6789")]
    assert added("https://jane:secret@example.com/a?b and http://example.com/@jane") == [("url", "https://jane:secret@example.com/a?b")]
    text = "write x@y.org (at) y.org"
    assert base(text) == [("email", 6, 13)] and added(text) in ([], [("email", "x@y.org (at) y.org")]) and spans(text)[0][3]


def test_checks_of_numbers():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.iban("DE89370400440532013000") and not pii.iban("DE8937040044053201300") and not pii.iban("XX89370400440532013000")


def test_long_texts_cost_time_in_proportion():
    began = time.time()
    for text in ("1" * 300_000, "1 " * 300_000, "1." * 300_000, "a" * 300_000 + "@", "a@" * 150_000, "+1" + "-" * 300_000, "://" * 100_000, "DE11 " * 60_000, "a@b." * 70_000, "account no " * 20_000, "(at)" * 60_000):
        assert base(text) == [s for s in base(text)] and len(spans(text)) < 10**5
    assert time.time() - began < 60
    assert base("ü" * 10**6 + " a@b.co") == [("email", 10**6 + 1, 10**6 + 7)]


def test_redaction():
    text = "Ask a@b.co or +1 (743) 555-3824 at 10.0.0.1"
    assert pii.redacted(text, spans(text)) == "Ask <email> or <phone> at <ip>"
    both = "https://u:p@h.org/x"
    assert pii.redacted(both, spans(both)) == "<url>" and pii.redacted("", []) == ""


def test_edges(spark):
    docs = edge.table(spark)
    got = pii.personal_data(docs).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.redacted) for r in got), key=key) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=key)
    assert all(r.spans == [] for r in got)
    assert pii.personal_data(edge.empty(spark)).count() == 0
    rows = spark.createDataFrame([("a", "x a@b.co"), ("a", "x a@b.co"), (None, None)], "name string, body string")
    out = sorted(map(tuple, pii.personal_data(rows, "name", "body").selectExpr("name", "size(spans)", "redacted").collect()), key=str)
    assert out == [("a", 1, "x <email>"), ("a", 1, "x <email>"), (None, 0, "")]
