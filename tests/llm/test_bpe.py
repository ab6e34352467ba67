from __future__ import annotations

import hashlib
import os
import random
import sys

import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

from reviewloom.llm import bpe  # noqa: E402

PATH, PATTERN = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read(), PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.rank, special_tokens={})


def test_equals_the_library_on_random_texts(codec, reference):
    draw = random.Random(11)
    kinds = [lambda: draw.choice("abcdeth "), lambda: chr(draw.choice([draw.randrange(32, 900), draw.randrange(0x4E00, 0x4F00), draw.randrange(0x1F600, 0x1F640)])), lambda: draw.choice(["the", "ing", "ß", "zz", "===", "\n", " "])]
    for _ in range(600):
        kind = draw.choice(kinds)
        text = "".join(kind() for _ in range(draw.randrange(150)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text) and codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "=" * 4000, " " * 3000 + "x", "é" * 2000, "thethe" * 1500])
def test_runs_in_which_borders_move_far(codec, reference, text):
    assert codec.encode(text) == reference.encode_ordinary(text)


def test_join_is_associative(codec):
    draw = random.Random(2)
    for _ in range(200):
        a, b, c = (bytes(draw.choice(b"abe th") for _ in range(draw.randrange(12))) for _ in range(3))
        x, y, z = map(codec.tree, (a, b, c))
        assert codec.join(codec.join(x, y), z) == codec.join(x, codec.join(y, z)) == codec.merge(a + b + c)


def test_documents(spark, sf, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op7_byte_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_edge_cases_and_real_outputs(spark):
    docs = edge.table(spark)
    got = bpe.round_trip(docs, PATH, PATTERN).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(edge.rows()) and [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id == 1] == [(0, nothing, nothing)]
    back = bpe.decode(bpe.encode(docs.where("doc_id < 9"), PATH, PATTERN), PATH, PATTERN).collect()
    want = {i: (t or "").encode() for i, t, *_ in edge.rows()}
    assert all(bytes(r.data) == want[r.doc_id] for r in back)
    assert bpe.round_trip(edge.empty(spark), PATH, PATTERN).count() == 0


def test_leaves_merged_together_equal_leaves_merged_alone(codec):
    draw = random.Random(3)
    spans = [bytes(draw.choice(b"abe thing\xc3\xa9\n=") for _ in range(draw.randrange(17))) for _ in range(500)]
    assert codec.leaves(spans) == [codec.merge(x) for x in spans] and codec.leaves([]) == []


def test_long_texts_go_in_blocks(codec, reference, monkeypatch):
    text = "Ünder the 中文 sky " * 500 + "x" * 300 + " =" * 400
    whole = list(codec.round_trips([text, "", text]))
    monkeypatch.setattr(bpe, "LONG_CHARS", 1000)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    ids = reference.encode_ordinary(text)
    assert list(codec.round_trips([text, "", text])) == whole and codec.encode(text) == ids
    assert whole[0] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_fold_is_a_join(codec):
    parts = [str(i) for i in range(70_000)]
    assert bpe.fold(parts, ",") == ",".join(parts) and bpe.fold([], ",") == "" and bpe.fold([], b"") == b""
