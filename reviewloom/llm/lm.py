"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Tokens are the words of a text (A-Z lower-cased) and one end.  The model
predicts a token in two steps.  First its class: the most frequent words are
classes of their own, the others share BUCKETS classes by their last two
characters, and the end is one.  The class has a log-bilinear distribution
given the two classes before it: the context vector is the sum of their
vectors, each scaled by its position's diagonal, and a class's logit is the dot
product with its own vector and a bias.  Then the word within its bucket, by
its smoothed count over all training documents, with room for an unseen word.
The class distribution is normalised over all classes and the second step over
a bucket's known words and one unseen one, so a score can be held against the
smoothed unigram score beside it, which treats unseen words alike.

Word counts, bucket totals and the counts of class trigrams cover all training
documents and are summed in Spark.  All trigrams train, each with its count as
weight: they are dealt to as many tasks as their number asks for, each task
takes its share of a round through numpy, and the tasks' parameters are
averaged after every round.  A context's normaliser is a matrix product, made
once per worker for each pair of classes that occurs.

Counts of frequent words are broadcast (at most HOT_WORDS of them, none above
HOT_BYTES); the other words of a text meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.arrow import slices
from reviewloom.llm.quality import held_out
from reviewloom.staging import stage, table

WORDS, BUCKETS = 511, 64
END = WORDS + BUCKETS  # the class of the end
BEGIN = END + 1  # stands before a text, as a context only
CLASSES = END + 1
HOT_WORDS, HOT_BYTES = 200_000, 64
_FLUSH_WORDS = 300_000
_FLUSH_EVENTS = 2_000_000
_SCORED_TOKENS = 1 << 18
_END_WORD = ""  # no word is empty
_RUN_BYTES = 1 << 20
_GAP = re.compile(rb"[ \t\n\x0b\f\r]")


@dataclass(frozen=True)
class Training:
    """rounds: after each, the tasks' parameters are averaged; share: distinct trigrams to a task, about.

    weight: an event stands for so many occurrences at most, a more frequent
    trigram is several events; noise: classes drawn for a whole minibatch.
    """

    size: int = 32
    rounds: int = 4
    share: int = 1 << 20
    weight: float = 8.0
    batch: int = 256
    noise: int = 128
    rate: float = 0.2
    seed: int = 42


def word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in runs of about _RUN_BYTES, so that those of a very long one aren't all in memory."""
    start = 0
    while len(text) - start > _RUN_BYTES:
        gap = _GAP.search(text, start + _RUN_BYTES)
        end = gap.start() if gap else len(text)
        yield text[start:end].lower().split()
        start = end
    yield (text[start:] if start else text).lower().split()


def bucket(word: str) -> int:
    return WORDS + zlib.crc32(word[-2:].encode()) % BUCKETS


def bucket_column(word: Column) -> Column:
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % BUCKETS + WORDS).cast("int")


class _Classes(dict):
    """UTF-8 word -> its class; bounded."""

    LIMIT = 300_000

    def __init__(self, words: list[str]):
        self.words = {w.encode(): k for k, w in enumerate(words)}
        super().__init__(self.words)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
            self.update(self.words)
        value = bucket(word.decode())
        if len(word) <= HOT_BYTES:
            self[word] = value
        return value


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column text of all rows; the end counts once per text, as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch, part in slices(batches, "text"):
            for t in part:
                for words in word_runs(t):
                    seen.update(words)
                    if len(seen) > _FLUSH_WORDS:
                        yield flush()
            seen[b""] += batch.num_rows
        yield flush()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _runs_of_classes(text: bytes, known: _Classes) -> Iterator[tuple[list[bytes], list[int]]]:
    """(words, classes) of each run of a text; the classes begin with the two before the run, and the last ends with the end."""
    before, held = [BEGIN, BEGIN], None
    for words in word_runs(text):
        if held is not None:
            yield held
        own = before + list(map(known.__getitem__, words))
        held, before = (words, own), own[-2:]
    held[1].append(END)
    yield held


def _contexts(runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two before, before, class) of every token of runs that begin with two classes of context."""
    sizes = np.array([len(own) for own in runs], np.int64)
    flat = np.fromiter((c for own in runs for c in own), np.int64, sizes.sum())
    inside = np.ones(len(flat), bool)
    starts = np.cumsum(sizes) - sizes
    inside[starts] = inside[starts + 1] = False
    at = np.nonzero(inside)[0]
    return flat[at - 2], flat[at - 1], flat[at]


def class_events(texts: DataFrame, words: list[str]) -> DataFrame:
    """(code, n): how often each class trigram occurs; at most (CLASSES + 1) ** 3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _Classes(words), [], 0

        def flush() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

        for _, part in slices(batches, "text"):
            runs, waiting = [], 0
            for t in part:
                for _, own in _runs_of_classes(t, known):
                    runs.append(own)
                    waiting += len(own)
                    if waiting > _SCORED_TOKENS:
                        held.append(encoded(*_contexts(runs)))
                        size, runs, waiting = size + waiting, [], 0
                        if size > _FLUSH_EVENTS:
                            yield flush()
                            size = 0
            held.append(encoded(*_contexts(runs)))
            size += waiting
        yield flush()

    return texts.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def encoded(far: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
    return (far * (CLASSES + 1) + near) * (CLASSES + 1) + target


class LogBilinear:
    """Vectors of contexts and classes, the positions' diagonals and the classes' biases; and the squares of their gradients."""

    NAMES = ("before", "after", "near", "far", "bias")

    def __init__(self, how: Training, unigram: np.ndarray):
        draw = np.random.default_rng(how.seed)
        self.before = draw.normal(0, 0.1, (CLASSES + 1, how.size)).astype(np.float32)
        self.after = draw.normal(0, 0.1, (CLASSES, how.size)).astype(np.float32)
        self.near, self.far = np.ones(how.size, np.float32), np.full(how.size, 0.5, np.float32)
        self.unigram = unigram / unigram.sum()
        self.bias = np.log(self.unigram).astype(np.float32)
        self.squares = {k: np.full_like(getattr(self, k), 1e-3) for k in self.NAMES}

    def packed(self) -> np.ndarray:
        return np.concatenate([x.ravel() for k in self.NAMES for x in (getattr(self, k), self.squares[k])])

    def unpack(self, values: np.ndarray) -> None:
        at = 0
        for k in self.NAMES:
            shape, size = getattr(self, k).shape, getattr(self, k).size
            setattr(self, k, values[at : at + size].reshape(shape).astype(np.float32))
            self.squares[k] = values[at + size : at + 2 * size].reshape(shape).astype(np.float32)
            at += 2 * size

    def context(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.before[far] * self.far + self.before[near] * self.near

    def normalisers(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The log of the sum of exponentiated logits for each of these contexts."""
        out = np.empty(len(far), np.float32)
        for k in range(0, len(far), 1 << 12):
            part = slice(k, k + (1 << 12))
            logits = self.context(far[part], near[part]) @ self.after.T + self.bias
            top = logits.max(1)
            out[part] = top + np.log(np.exp(logits - top[:, None]).sum(1))
        return out


def train_nce(model: LogBilinear, codes: np.ndarray, counts: np.ndarray, how: Training, seed: int) -> None:
    """One pass of noise-contrastive estimation over (code, count) with Adagrad; noise is the class unigram.

    A trigram is as many events as its count asks for, each of the same weight.
    """
    if not len(codes):
        return
    repeats = np.ceil(counts / how.weight).astype(np.int64)
    events, weights = np.repeat(codes, repeats), np.repeat(counts / repeats, repeats).astype(np.float32)
    weights /= weights.mean()
    draw = np.random.default_rng([how.seed, seed])
    log_noise = np.log(how.noise * model.unigram).astype(np.float32)
    cumulative = np.cumsum(model.unigram)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def step(name: str, gradient: np.ndarray, at: np.ndarray | None = None) -> None:
        value, square = getattr(model, name), model.squares[name]
        if at is None:
            square += gradient * gradient
            value -= how.rate * gradient / np.sqrt(square)
            return
        order = np.argsort(at, kind="stable")
        sorted_ = at[order]
        firsts = np.nonzero(np.append(True, sorted_[1:] != sorted_[:-1]))[0]
        rows, summed = sorted_[firsts], np.add.reduceat(gradient[order], firsts, axis=0)
        square[rows] += summed * summed
        value[rows] -= how.rate * summed / np.sqrt(square[rows])

    order = draw.permutation(len(events))
    for start in range(0, len(order), how.batch):
        chosen = order[start : start + how.batch]
        code, size = events[chosen], weights[chosen] / len(chosen)
        w = code % (CLASSES + 1)
        near, far = code // (CLASSES + 1) % (CLASSES + 1), code // (CLASSES + 1) ** 2
        noise = np.minimum(np.searchsorted(cumulative, draw.random(how.noise)), CLASSES - 1)
        h = model.context(far, near)
        true = (sigmoid((h * model.after[w]).sum(1) + model.bias[w] - log_noise[w]) - 1) * size
        false = sigmoid(h @ model.after[noise].T + model.bias[noise] - log_noise[noise]) * size[:, None]
        dh = true[:, None] * model.after[w] + false @ model.after[noise]
        pull, push = true[:, None] * h, false.T @ h
        d_near, d_far = dh * model.near, dh * model.far
        gradients = (dh * model.before[near]).sum(0), (dh * model.before[far]).sum(0)
        step("after", np.concatenate([pull, push]), np.concatenate([w, noise]))
        step("bias", np.concatenate([true, false.sum(0)]), np.concatenate([w, noise]))
        step("before", np.concatenate([d_near, d_far]), np.concatenate([near, far]))
        step("near", gradients[0])
        step("far", gradients[1])


_AVERAGED = 8


def _averaged(models: DataFrame) -> np.ndarray:
    """The mean of (weight, values) rows; the driver gets at most _AVERAGED of them, however many tasks there were."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0.0, 0.0
        for batch in batches:
            for w, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                weight, total = weight + w, total + w * np.frombuffer(blob.as_py(), np.float32).astype(np.float64)
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["weight", "model"])

    rows = stage(models, "models")
    while (n := rows.count()) > _AVERAGED:
        rows = stage(rows.repartition(-(-n // _AVERAGED)).mapInArrow(mean, "weight double, model binary"), "models")
    found = rows.collect()
    return sum(r.weight * np.frombuffer(r.model, np.float32).astype(np.float64) for r in found) / sum(r.weight for r in found) if found else np.zeros(0)


def fit_classes(events: DataFrame, unigram: np.ndarray, how: Training) -> LogBilinear:
    """The class model from the table of all class trigrams, every one of which trains with its count."""
    model = LogBilinear(how, unigram)
    tasks = max(1, -(-events.count() // how.share))
    hashed = events.select("code", "n", F.pmod(F.xxhash64("code", F.lit(how.seed)), F.lit(1 << 40)).alias("h"))
    parts = hashed.select("code", "n", (F.col("h") % tasks).alias("task"), (F.floor(F.col("h") / tasks) % how.rounds).alias("round"))
    parts = stage(parts.repartition(tasks, "task"), "parts")
    for number in range(how.rounds):
        shared = parts.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # 0.3 MB

        def run(batches: Iterator[pa.RecordBatch], number: int = number, shared=shared) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
            got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
            codes, n, task = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
            for k in np.unique(task):  # tasks that met in one partition train apart, so the result doesn't depend on that
                own = pickle.loads(shared.value)
                at = np.nonzero(task == k)[0]
                at = at[np.argsort(codes[at])]
                train_nce(own, codes[at], n[at], how, int(k) * how.rounds + number)
                yield pa.RecordBatch.from_arrays([pa.array([float(n[at].sum())]), pa.array([own.packed().tobytes()], pa.binary())], names=["weight", "model"])

        of_round = parts.where(F.col("round") == number).select("code", "n", "task")
        mean = _averaged(of_round.repartition(tasks, "task").mapInArrow(run, "weight double, model binary"))
        if len(mean):
            model.unpack(mean)
    return model


@dataclass
class Model:
    """What scoring needs: words (the classes of their own), hot (word -> count), bucket totals, all tokens and distinct ones."""

    classes: LogBilinear
    words: list[str]
    hot: dict[str, int]
    hot_least: int
    bucket_mass: np.ndarray
    tokens: int
    distinct: int


def _hot_least(counts: DataFrame) -> int:
    """Of short enough words, the least count such that at most HOT_WORDS words have it or a greater one, by a histogram of the counts."""
    step = 16  # to a doubling
    bins = counts.groupBy(F.floor(F.log2("n") * step).alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, words = None, 0
    for r in bins.orderBy(F.desc("bin")).collect():  # a few hundred bins at most
        words += r.words
        if words > HOT_WORDS:
            break
        least = r.least
    return 1 << 62 if least is None else least


def _can_be_hot() -> Column:
    return F.octet_length("word") <= HOT_BYTES


def fit(docs: DataFrame, how: Training = Training()) -> tuple[Model, DataFrame]:
    """The model from all rows of ``docs`` (text), and the table (word, n) of all counts."""
    counts = stage(word_counts(docs), "words")
    of = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    least = max(_hot_least(counts.where(F.col("n") > 0).where(_can_be_hot())), 1)
    hot = {r.word: r.n for r in counts.where(F.col("n") >= least).where(_can_be_hot()).collect()}  # at most HOT_WORDS of HOT_BYTES
    words = sorted((w for w in hot if w != _END_WORD), key=lambda w: (-hot[w], w))[:WORDS]
    mass, unigram = np.full(BUCKETS, 0.5), np.full(CLASSES, 0.5)
    unigram[: len(words)] += [hot[w] for w in words]
    unigram[END] += hot.get(_END_WORD, 0)
    rest = counts.where(F.col("n") > 0).join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in [*words, _END_WORD]], "word string")), "word", "left_anti")  # WORDS rows
    for r in rest.groupBy(bucket_column(F.col("word")).alias("k")).agg(F.sum(F.col("n") + 0.5).alias("mass"), F.sum("n").alias("n")).collect():  # BUCKETS rows
        mass[r.k - WORDS] += r.mass
        unigram[r.k] += r.n
    events = stage(class_events(docs, words), "events")
    return Model(fit_classes(events, unigram, how), words, hot, least, mass, of.tokens, of.distinct), counts


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model.classes, _Classes(model.words)
        self.norm = np.full((CLASSES + 1) ** 2, np.nan, np.float32)
        denominator = model.tokens + 0.5 * (model.distinct + 1)
        self.rest = math.log10(denominator)
        self.mass = np.log10(model.bucket_mass).tolist()
        own = {w.encode() for w in model.words} | {b""}
        words = [w.encode() for w in model.hot]
        counts = np.array(list(model.hot.values()), np.float64) + 0.5
        self.hot = {w: k for k, w in enumerate(words)}
        # with a last entry for words that are not hot: their counts come in the join
        self.base = np.append(np.log10(counts / denominator), -self.rest)
        self.inside = np.append(np.log10(counts) - [0.0 if w in own else self.mass[bucket(w.decode()) - WORDS] for w in words], 0.0)
        self.inside[[k for k, w in enumerate(words) if w in own]] = 0.0

    def log_classes(self, runs: list[list[int]]) -> np.ndarray:
        """The natural log of each token's class probability."""
        far, near, target = _contexts(runs)
        pair = far * (CLASSES + 1) + near
        new = np.unique(pair[np.isnan(self.norm[pair])])
        self.norm[new] = self.model.normalisers(new // (CLASSES + 1), new % (CLASSES + 1))
        logits = np.einsum("ij,ij->i", self.model.context(far, near), self.model.after[target])
        return (logits + self.model.bias[target] - self.norm[pair]).astype(np.float64)

    def score(self, texts: list[bytes]) -> tuple[list, list, list, list, list, list]:
        """Per text: tokens, known ones, base score and model score without the counts of rare words, these words and their counts."""
        n = len(texts)
        score = np.zeros(n)
        runs, owners, waiting = [], [], 0
        words, times, distinct = [], [], []

        def flush() -> None:
            logs = self.log_classes(runs)
            np.add.at(score, np.repeat(owners, [len(own) - 2 for own in runs]), logs / math.log(10))
            runs.clear(), owners.clear()

        for i, text in enumerate(texts):
            seen: Counter = Counter((b"",))  # the end
            for said, own in _runs_of_classes(text, self.known):
                seen.update(said)
                runs.append(own)
                owners.append(i)
                waiting += len(own)
                if waiting > _SCORED_TOKENS:
                    flush()
                    waiting = 0
            words += seen
            times += seen.values()
            distinct.append(len(seen))
        if runs:
            flush()
        none = len(self.hot)
        at = np.fromiter(map(self.hot.get, words, repeat(none)), np.int64, len(words))
        owner, said = np.repeat(np.arange(n), distinct), np.array(times, np.float64)
        add = lambda values: np.bincount(owner, values, minlength=n)
        inner = self.inside[at]
        missing = np.nonzero(at == none)[0].tolist()
        for k in missing:
            inner[k] = -self.mass[self.known[words[k]] - WORDS] if words[k] else 0.0
        rare, counted = [[] for _ in texts], [[] for _ in texts]
        for k, i in zip(missing, owner[missing].tolist()):
            rare[i].append(words[k].decode())
            counted[i].append(times[k])
        sizes, known = add(said).astype(np.int64), add(said * (at < none)).astype(np.int64)
        return sizes.tolist(), known.tolist(), add(said * self.base[at]).tolist(), (score + add(said * inner)).tolist(), rare, counted


_scorers: dict[str, _Scorer] = {}


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text; logarithms to base 10.

    A null text is an empty one, which has the end alone; repeated rows and null ids stay.
    """
    blob = pickle.dumps(model)
    key = hashlib.sha256(blob).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(blob)  # bounded by HOT_WORDS and CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = _Scorer(pickle.loads(shared.value))
        for batch, texts in slices(batches, "text"):
            names = ["n_tokens", "known", "base", "model", "rare", "times"]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _scorers[key].score(texts), kinds)], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, f"id {kind}, n_tokens long, known long, base double, model double, rare array<string>, times array<long>")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "scored")  # written once, so the numbers stay
    asked = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    seen = counts.where(F.col("n") > 0).where((F.col("n") < model.hot_least) | ~_can_be_hot())
    met = asked.join(seen, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"))
    out = rows.drop("rare", "times").join(met, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("more")).alias("base_score"), (F.col("model") + F.col("more")).alias("score"))


def score_documents(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """Every row of ``docs`` scored by a model of those outside fold 1 (crc32 of the id modulo 5).

    Nulls: a null text is an empty one, a null id is in no fold and so learned
    from.  Without training rows every word is unseen.  Repeated rows count and
    stay, an empty table gives an empty result, other columns are not read.  A
    text of any length is scored whole, run by run, and a word of any length is
    a word: a long one meets its count in the join.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    model, counts = fit(rows.where(~held_out(F.col("doc_id"), 1)), how)
    scored = score(rows, model, counts)
    return scored.select("doc_id", held_out(F.col("doc_id"), 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
