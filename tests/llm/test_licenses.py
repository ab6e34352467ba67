from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import edge  # noqa: E402
from oracle import same  # noqa: E402

from reviewloom.llm import licenses  # noqa: E402
from reviewloom.llm.queries import ORACLE_SQL  # noqa: E402

MIT = next(t for name, scope, t in licenses.KNOWN if name == "MIT" and scope == "text")


BSD = next(t for name, scope, t in licenses.KNOWN if name == "BSD-3-Clause" and scope == "text")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_variants_of_a_text_have_one_digest(spark):
    framed = "/*\n" + "\n".join(f" * {x}" for x in ("Copyright (c) 2019\n *    Some Holder and\n *    others\n\n" + MIT).split("\n")) + "\n */"
    variants = [MIT, MIT.upper(), MIT.replace("\n\n", "\r\n\r\n  "), "Copyright (c) 2019 Someone\n\n" + MIT.replace('"', "'"), MIT.replace("License", "Licence"), MIT + "\n© 2020 X\n", f"The MIT License (MIT)\n\n{MIT}"]
    variants += [" ".join(("MIT License Copyright (c) 2020 X, Y and Z " + MIT).split()), framed, "\n".join("# " + x for x in MIT.split("\n")), "Copyright 2001, 2003-2009 A Very Long Company Name,\nInc.\n" + MIT]
    other = [MIT.replace("free of charge", "for a fee"), "text before\n" + MIT, "Copyright (c) 2020 X", ""]
    got = [r.license for r in licenses.scan(frame(spark, variants + other)).orderBy("doc_id").collect()]
    assert got == ["MIT"] * len(variants) + [None] * len(other)
    bsd = [BSD, "Copyright (c) 2019, Someone\nAll rights reserved.\n\n" + BSD, "BSD 3-Clause License\n\n" + BSD]
    assert {r.license for r in licenses.scan(frame(spark, bsd)).collect()} == {"BSD-3-Clause"}


def test_at_least_twenty_whole_licences_are_known():
    assert len(set(licenses.TEXTS) | {name for name, _ in licenses.DIGESTS}) >= 20
    assert all(any(w in t.lower() for w in licenses._WORDS) for _, scope, t in licenses.KNOWN if scope == "notice")


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="the published texts are not on this machine")
def test_published_texts_are_found(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [open(f"/usr/share/common-licenses/{f}").read() for f in files]
    got = licenses.scan(frame(spark, texts + [" ".join(t.split()) for t in texts])).orderBy("doc_id").collect()
    assert [r.license for r in got] == [*files.values()] * 2


def test_notices_in_lines_and_sentences(spark):
    rows = {
        "Prose here.\nReleased under the MIT License.": "MIT",
        "Licenced under the Apache Licence, version 2.0\nRELEASED UNDER THE MIT LICENSE": "Apache-2.0,MIT",
        "We said: Released under the MIT License. Then more.": "MIT",
        "Copyright (c) 2020 X. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Some words. This work is licensed under the GNU General\nPublic License, version 3.\nMore words.": "GPL-3.0",
        "# SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        "// Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
        "The license of a driver was released under the bridge": "",
    }
    got = [r.notices for r in licenses.scan(frame(spark, list(rows))).orderBy("doc_id").collect()]
    assert got == list(rows.values())
    r = licenses.scan(frame(spark, ["Licensed under the Apache License v2.0"])).first()
    assert (r.notices, r.license, r.n_notice_lines) == ("Apache-2.0", "Apache-2.0", 1)


def test_every_planted_notice_of_the_documents_is_found(spark, sf):
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = {r.doc_id: sum(bool(re.search("(licensed|released) under", x, re.I)) for x in (r.text or "").split("\n")) for r in docs.collect()}
    got = {r.doc_id: r.n_notice_lines for r in licenses.scan(docs).collect()}
    assert sum(planted.values()) > 0 and got == planted


def test_edge_cases(spark):
    got = licenses.scan(edge.table(spark)).collect()
    assert len(got) == len(edge.rows()) and {r.license for r in got} == {None} and {r.notices for r in got} == {""}
    assert licenses.scan(edge.empty(spark)).count() == 0


def test_documents_equal_sql(spark, sf):
    assert same(spark, licenses.op9_license_scan, ORACLE_SQL["op9_license_scan"], sf) > 0
