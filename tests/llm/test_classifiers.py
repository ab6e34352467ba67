from __future__ import annotations

import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import edge  # noqa: E402

from reviewloom.llm import quality, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def auc(rows, labels, label):
    pairs = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in pairs if y == k] for k in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("query,label,least", [(quality.op4_quality_classifier, "quality", 0.97), (toxicity.op10_toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, query, label, least):
    rows = query(spark, SF).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert auc(rows, labels, label) >= least


@pytest.mark.parametrize("module,keep", [(quality, quality.keep_good), (toxicity, toxicity.keep_civil)])
def test_edge_cases(spark, module, keep):
    docs, labels = edge.table(spark), edge.labels(spark)
    got = module.classify(docs, labels).collect()
    assert len(got) == len(edge.rows()) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    kept = keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(edge.rows())
    assert module.classify(edge.empty(spark), labels).count() == 0
    assert {r.score for r in module.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels) == quality.train(docs, flipped)).all()


def test_weights_do_not_depend_on_partitioning(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert np.allclose(quality.train(docs, labels), quality.train(docs.repartition(9), labels), atol=1e-6)


def test_ngrams_do_not_cross_texts():
    parts = [b"a b", b"", b"c", b"d d E!!"]
    feature, owner, value = quality._grams(parts)
    alone = [quality._grams([p])[0] for p in parts]
    assert all(sorted(feature[owner == k]) == sorted(a) for k, a in enumerate(alone))
    for k in range(len(parts)):
        assert value[owner == k].sum() == pytest.approx(sum(1 for n in (1, 2, 1, 2, 3) if len(quality._TOKEN(parts[k].decode())) >= n))


def test_ftrl_separates():
    draw = random.Random(1)
    rows = [(np.array([y, 2 + draw.randrange(5), 1 << quality.BITS]), np.ones(3), y) for y in (0, 1) * 50]
    w = quality.ftrl(rows, quality.Training())
    assert w[1] > 0.5 > -0.5 > w[0]


def test_dense_features():
    words = toxicity._Words({"grumble": 3.0, "zzap*": 1.5})
    of = dict(zip(toxicity.NAMES, toxicity.dense("You are an id1ot! STOP grumble zzapped".encode(), words)))
    assert of["fixed_count"] == 1 and of["strong_count"] == 1 and of["weak_count"] == 1 and of["near_count"] == 1
    assert of["obfuscated"] == pytest.approx(1 / 7) and of["shouted"] == pytest.approx(1 / 7) and of["exclaimed"] > 0
    assert not any(toxicity.dense(b"", words))


def test_lexicon_finds_words_and_beginnings(spark):
    rows = [(int(i % 4 == 0), f"plain text {i} " + (f"grix{'abcdefgh'[i % 8]}{i} vile" if i % 4 == 0 else "calm")) for i in range(400)]
    found = toxicity.lexicon(spark.createDataFrame(rows, "y int, text string"))
    assert {"vile", "grix*"} <= set(found) and "plain" not in found and "calm" not in found


def plain_features(text):
    """Feature -> value, in Python's own integers."""
    wide = (1 << 64) - 1
    seeds, step = [int(x) for x in quality._SEEDS], int(quality._STEP)
    words, forms, before = [], [], None
    for token in re.findall(r"\w+|[^\w\s]+", text):
        code = quality._coded(token)
        words.append(code >> 8)
        forms.append((code & 255) + quality._FORMS * (before == code >> 8))
        before = code >> 8
    out = {}
    for kind, (codes, n) in enumerate(((words, 1), (words, 2), (forms, 1), (forms, 2), (forms, 3))):
        m = len(codes) - n + 1
        for k in range(m):
            h = 0
            for c in codes[k : k + n]:
                h = (h * step + c + 1) * seeds[kind] & wide
                h ^= h >> 29
            i = (h * seeds[0] & wide) >> (64 - quality.BITS)
            out[i] = out.get(i, 0.0) + 1 / m
    return out


def test_quality_scores_of_all_documents_by_plain_dot_products(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    w = quality.train(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality.op4_quality_classifier(spark, sf).collect():
        want = 1 / (1 + math.exp(-(w[-1] + math.fsum(w[i] * x for i, x in plain_features(text[r.doc_id]).items()))))
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.3)


def plain_dense(text, learned):
    """The dense features of a text, one count after another."""
    words = re.findall(r"\w(?:[\w@$*]*\w)?", text)
    plain = [(w.lower().translate(str.maketrans("013457@$*", "oieastasi")) if len(w) > 2 and w[0].isalpha() and w[-1].isalpha() and any(not c.isalpha() for c in w[1:-1]) else w.lower()) for w in words]
    weight = [int(max([learned.get(p, 0.0)] + [learned.get(f"{p[:k]}*", 0.0) for k in (4, 5, 7) if len(p) > k]) * 1000) / 1000 for p in plain]
    strong, weak = [x >= 2.5 for x in weight], [0 < x < 2.5 for x in weight]
    fixed, second = [p in toxicity.INSULTS for p in plain], [p in toxicity.SECOND_PERSON for p in plain]
    near = [any(second[j] for j in range(max(0, i - 3), min(len(words), i + 4)) if j != i) for i in range(len(words))]
    hits = sum((f or s) and x for f, s, x in zip(fixed, strong, near))
    data, n = text.encode(), max(len(words), 1)
    size = max(len(data), 1)
    sign = [chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for b in data]
    single = [len(w) == 1 for w in words]
    obfuscated = sum(len(w) > 2 and w[0].isalpha() and w[-1].isalpha() and any(not c.isalpha() for c in w[1:-1]) for w in words)
    return [math.log1p(len(words)), sum(fixed) / n, sum(fixed), sum(strong) / n, sum(strong), sum(weak) / n, sum(weak), sum(weight) / n, max(weight, default=0), hits / n, hits, sum(second) / n, sum(65 <= b <= 90 for b in data) / size, sum(len(w) > 1 and w.isupper() for w in words) / n, data.count(b"!") / size, data.count(b"?") / size, sum(sign) / size, sum(s and a == b for s, a, b in zip(sign[1:], data[1:], data)) / size, obfuscated / n, sum(all(single[i : i + 3]) for i in range(len(words) - 2)) / n, sum(len(w) > 20 for w in words) / n]


def walked(node, x):
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def test_toxicity_scores_of_all_documents_by_trees_walked_by_hand(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    trees = [(w, t._java_obj.rootNode()) for w, t in zip(model.trees.treeWeights, model.trees.trees)]
    steps = (list(model.calibration.boundaries), list(model.calibration.predictions)) if model.calibration else None
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    words = toxicity._Words(model.learned)
    scored = toxicity.score(docs, model).select("doc_id", "score").collect()
    assert len(scored) == len(text)
    for r in scored:
        x = plain_dense(text[r.doc_id], model.learned)
        assert toxicity.dense(text[r.doc_id].encode(), words) == pytest.approx(x, abs=1e-12)
        p = 1 / (1 + math.exp(-2 * sum(w * walked(node, x) for w, node in trees)))
        want = p if steps is None else 0.99 * min(max(float(np.interp(p, *steps)), 0.0), 1.0) + 0.01 * p
        assert r.score == pytest.approx(want, abs=1e-9)


def test_long_texts_score_as_they_would_whole(monkeypatch):
    text = ("Ärger über lange Wörter, you STUPID id1ot!! a b c\n" * 40).encode()
    w = np.random.default_rng(2).normal(0, 1, (1 << quality.BITS) + 1)
    words = toxicity._Words({"grumble": 3.0})
    before, dense = quality._dots(w, [text, b"", b"x"]), toxicity.dense(text, words)
    for module in (quality, toxicity):
        monkeypatch.setattr(module, "LONG_TEXT", 100)
        monkeypatch.setattr(module, "_BLOCK", 37)
    assert np.allclose(quality._dots(w, [text, b"", b"x"]), before, atol=1e-9) and np.allclose(toxicity.dense(text, words), dense)
    alone = [dict(zip(*v)) for v in quality._vectors([text, b"", b"x y"])]
    assert alone[1] == {} and alone[0].keys() == plain_features(text.decode()).keys()


def test_repeated_ids_and_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(2, "same")] * 3000 + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    ids = {r.doc_id for r in docs.where(~quality.held_out(F.col("doc_id"))).select("doc_id").distinct().collect()} & {1, 2, 3}
    rows = quality.labelled(docs, labels, "quality", 300, 42).collect()
    assert {r.doc_id for r in rows} <= ids and sum(r.doc_id == 1 for r in rows) < 400 and sum(r.doc_id == 2 for r in rows) <= 1
    assert (quality.train(docs, labels, how=quality.Training(max_rows=300)) == quality.train(docs.repartition(7), labels, how=quality.Training(max_rows=300))).all()


def test_long_tokens_are_not_remembered():
    known = len(quality._tokens)
    quality._dots(np.zeros((1 << quality.BITS) + 1), [b"z" * 5000])
    assert len(quality._tokens) == known
