"""One model for detection and sentiment of all aspects, trained together.

A text is a bag of hashed words, weighted by inverse document frequency.  Their
vectors sum to a hidden layer that all aspects share and to a direct part for
each aspect; a probability and a sentiment are read off both.  The loss is the weighted
cross-entropy of detection plus the squared error of sentiment where a
sentiment is known.  After every epoch the held-out rows decide: the score is
macro-F1 less the mean squared error, the rate is halved while it stands still,
and training stops when it does so for long; the best weights count.

Rows are dealt to tasks once, by their ids.  In an epoch each task takes small
batches of its own rows from the same weights; the tasks' results are averaged
by their rows, FAN_IN at a time in as many rounds as it takes, then on the driver, which holds FAN_IN
copies of the weights and no rows.  What an epoch ends with is written, so a killed run
resumes with the last one and comes to the same weights.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import metrics as M
from reviewloom.pieces import pieces
from reviewloom.staging import stage

FAN_IN = 8
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Training:
    buckets: int = 1 << 15
    hidden: int = 8
    rate: float = 0.3
    batch: int = 64
    epochs: int = 15
    patience: int = 4  # epochs without a better score until it stops
    plateau: int = 2  # and until the rate is halved
    sentiment_weight: float = 0.5
    rows_per_task: int = 2000
    seed: int = 42


def _bag(text: str | None, buckets: int) -> tuple[list[int], list[float]]:
    """Hashed words with damped counts, of length one."""
    counts = Counter(zlib.crc32(w.encode()) % buckets for w in re.findall(r"\w\w+", (text or "").lower()))
    damped = {k: 1 + np.log(n) for k, n in counts.items()}
    size = np.sqrt(sum(v * v for v in damped.values())) or 1.0
    keys = sorted(damped)
    return keys, [float(damped[k] / size) for k in keys]


def featured(rows: DataFrame, aspects: list[str], buckets: int) -> DataFrame:
    """(review_id, at, value, y, s): a text's buckets and their values, labels and sentiments in the order of ``aspects``, nulls where unknown."""
    number = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    bare = rows.select("review_id", F.col("text").cast("string").alias("text"), F.array(*[number(f"y_{a}", "double") for a in aspects]).alias("y"), F.array(*[number(f"s_{a}", "double") for a in aspects]).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            bags = [_bag(t, buckets) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in bags], pa.list_(pa.int32())), pa.array([v for _, v in bags], pa.list_(pa.float64())), b.column(2), b.column(3)], names=["review_id", "at", "value", "y", "s"])

    kind = rows.schema["review_id"].dataType.simpleString()
    return bare.mapInArrow(run, f"review_id {kind}, at array<int>, value array<double>, y array<double>, s array<double>")


def start(aspects: int, t: Training) -> Weights:
    draw = np.random.default_rng(t.seed)
    w = {"words": np.c_[draw.normal(0, 0.3, (t.buckets, t.hidden)), np.zeros((t.buckets, 2 * aspects))], "detect": draw.normal(0, 0.3, (t.hidden + 1, aspects)), "feel": draw.normal(0, 0.3, (t.hidden + 1, aspects))}
    return w | {f"{k}_seen": np.full_like(v, 1e-3) for k, v in w.items()}  # sums of squared gradients


class Rows:
    """Some texts as arrays."""

    def __init__(self, batch: pa.RecordBatch, idf: np.ndarray):
        at, value = batch.column(1), batch.column(2)
        self.n = batch.num_rows
        self.ends = np.diff(at.offsets.to_numpy()).cumsum()
        self.at = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.value = value.flatten().to_numpy(zero_copy_only=False) * idf[self.at]
        self.row = np.repeat(np.arange(self.n), np.diff(np.r_[0, self.ends]))
        square = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(self.n, -1)
        self.y, self.s = square(batch.column(3)), square(batch.column(4))  # nulls are NaN

    def outputs(self, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden layer with a constant, probabilities and sentiments."""
        sums = np.zeros((self.n, w["words"].shape[1]))
        np.add.at(sums, self.row, self.value[:, None] * w["words"][self.at])
        aspects = w["detect"].shape[1]
        h = np.c_[np.tanh(sums[:, : -2 * aspects]), np.ones(self.n)]
        logit = h @ w["detect"] + sums[:, -2 * aspects : -aspects]
        return h, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), np.tanh(h @ w["feel"] + sums[:, -aspects:])


def _descend(w: Weights, rows: Rows, weight: np.ndarray, rate: float, t: Training) -> None:
    h, p, feel = rows.outputs(w)
    known = ~np.isnan(rows.y)
    y = np.where(known, rows.y, 0)
    down = known * (p - y) * np.where(y > 0, weight, 1) / rows.n
    felt = ~np.isnan(rows.s)
    down_s = t.sentiment_weight * 2 * felt * (feel - np.where(felt, rows.s, 0)) * (1 - feel**2) / rows.n
    hidden = (down @ w["detect"][:-1].T + down_s @ w["feel"][:-1].T) * (1 - h[:, :-1] ** 2)
    back = np.c_[hidden, down, down_s]
    used, place = np.unique(rows.at, return_inverse=True)
    words = np.zeros((len(used), back.shape[1]))
    np.add.at(words, place, rows.value[:, None] * back[rows.row])
    for name, grad, part in (("detect", h.T @ down, slice(None)), ("feel", h.T @ down_s, slice(None)), ("words", words, used)):
        w[f"{name}_seen"][part] += grad**2
        w[name][part] -= rate * grad / np.sqrt(w[f"{name}_seen"][part])


def _packed(w: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **w)
    return out.getvalue()


def _unpacked(data: bytes) -> Weights:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def epoch(dealt: DataFrame, w: Weights, idf: np.ndarray, weight: np.ndarray, rate: float, t: Training) -> Weights:
    """The average of what each task makes of ``w`` by its own rows, in their order."""
    sent = dealt.sparkSession.sparkContext.broadcast(_packed(w))  # the weights' size is fixed by Training

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = _unpacked(sent.value), 0
        for b in batches:
            for k in range(0, b.num_rows, t.batch):
                part = b.slice(k, t.batch)
                _descend(own, Rows(part, idf), weight, rate, t)
                n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([_packed(own)])], names=["n", "weights"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((r["slot"], r["n"], r["weights"]) for b in batches for r in b.to_pylist()), key=lambda r: r[0])  # FAN_IN at most
        total, sums = 0, None
        for _, n, data in found:
            part = _unpacked(data)
            total += n
            sums = {k: n * v + (0 if sums is None else sums[k]) for k, v in part.items()}
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([found[0][0]]), pa.array([total]), pa.array([_packed({k: v / total for k, v in sums.items()})])], names=["slot", "n", "weights"])

    made = dealt.mapInArrow(train, "n long, weights binary").select(F.spark_partition_id().cast("long").alias("slot"), "n", "weights")
    left, first = dealt.rdd.getNumPartitions(), True
    while first or left > FAN_IN:  # a task gets FAN_IN weights at most, however many rows are trained on
        left, first = min(left, max(FAN_IN, -(-left // FAN_IN))), False
        met = made.repartitionById(left, F.col("slot").cast("int") % left)
        made = met.mapInArrow(mean, "slot long, n long, weights binary").select(F.spark_partition_id().cast("long").alias("slot"), "n", "weights")
    groups = made.collect()  # FAN_IN rows at most
    if not groups:
        return w
    groups.sort(key=lambda r: r.slot)  # sums of floats in one order
    total = sum(r.n for r in groups)
    parts = [(r.n / total, _unpacked(r.weights)) for r in groups]
    sent.unpersist()
    return {k: sum(share * part[k] for share, part in parts) for k in w}


def scored(rows: DataFrame, w: Weights, idf: np.ndarray, aspects: list[str]) -> DataFrame:
    """(review_id, aspect, y_true, prob, sent_true, sent_pred), a row for each text and aspect."""
    sent = rows.sparkSession.sparkContext.broadcast(_packed(w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _unpacked(sent.value)
        for b in pieces(batches):
            part = Rows(b, idf)
            _, p, feel = part.outputs(held)
            wide = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(p.tolist(), wide), pa.array(feel.tolist(), wide)], names=["review_id", "y", "s", "p", "feel"])

    kind = rows.schema["review_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"review_id {kind}, y array<double>, s array<double>, p array<double>, feel array<double>")
    names = F.array(*[F.lit(a) for a in aspects])
    cells = out.select("review_id", F.explode(F.arrays_zip(names.alias("aspect"), "y", "s", "p", "feel")).alias("c"))
    return cells.select("review_id", "c.aspect", F.col("c.y").cast("int").alias("y_true"), F.col("c.p").alias("prob"), F.col("c.s").alias("sent_true"), F.col("c.feel").alias("sent_pred"))


def held_score(fact: DataFrame) -> float:
    """Macro-F1 at one half less the mean squared error of known sentiments."""
    guess, miss = (F.col("prob") >= 0.5).cast("int"), (F.col("sent_pred") - F.col("sent_true")) ** 2
    sums = fact.groupBy("aspect").agg(F.sum(F.col("y_true") * guess).alias("tp"), F.sum("y_true").alias("true"), F.sum(F.when(F.col("y_true").isNotNull(), guess)).alias("said"), F.sum(miss).alias("miss"), F.count(miss).alias("n"))
    found = sums.collect()  # a row an aspect
    f1 = [2 * (r.tp or 0) / max((r.true or 0) + (r.said or 0), 1) for r in found]
    return sum(f1) / max(len(f1), 1) - sum(r.miss or 0.0 for r in sorted(found, key=lambda r: r.aspect)) / max(sum(r.n for r in found), 1)


class Checkpoints:
    """The state after each epoch, as a row of Parquet in a folder that outlives the driver."""

    schema = "epoch int, rate double, best double, best_epoch int, waited int, weights binary, best_weights binary"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, n: int) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/epoch={n}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def last(self):  # type: ignore[no-untyped-def]
        n = 0
        while self._exists(n + 1):
            n += 1
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/epoch={n}").first() if n else None

    def put(self, *state) -> None:  # type: ignore[no-untyped-def]
        self.spark.createDataFrame([state], self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/epoch={state[0]}")


def fit(train: DataFrame, held: DataFrame, aspects: list[str], root: str, t: Training = Training()) -> tuple[Weights, np.ndarray, int]:
    """(weights, idf, the epoch they are of) for rows (review_id, text, y_<aspect>, s_<aspect>); goes on from what ``root`` holds.

    Nulls: a null text is an empty one, null labels and sentiments teach
    nothing, rows are dealt by id, null ids together.  Without training rows the
    weights are those it starts with.
    """
    spark = train.sparkSession
    fit_rows = featured(train, aspects, t.buckets)
    n = train.count()
    tasks = max(1, -(-n // t.rows_per_task))
    order = F.xxhash64("review_id", "at", F.lit(t.seed)).alias("order")
    dealt = stage(fit_rows.select("*", order), "dealt")
    rows = lambda: dealt.repartition(tasks, F.xxhash64("review_id")).sortWithinPartitions("order", "review_id").drop("order")  # noqa: E731  the same tasks and order each time
    holds = stage(featured(held, aspects, t.buckets), "held")
    seen = {r.at: r.n for r in dealt.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect()}  # a row a bucket
    idf = np.log((n + 1) / (np.array([seen.get(k, 0) for k in range(t.buckets)]) + 1)) + 1
    counts = dealt.select([F.sum(F.get("y", F.lit(k))).alias(f"p{k}") for k in range(len(aspects))] + [F.count(F.get("y", F.lit(k))).alias(f"n{k}") for k in range(len(aspects))]).first()
    weight = np.array([min(50.0, max(1.0, (counts[f"n{k}"] - (counts[f"p{k}"] or 0)) / max(counts[f"p{k}"] or 0, 1))) for k in range(len(aspects))])
    kept = Checkpoints(spark, root)
    if (was := kept.last()) is None:
        w, done, rate, best, best_epoch, waited = start(len(aspects), t), 0, t.rate, -np.inf, 0, 0
        best_w = w
    else:
        done, rate, best, best_epoch, waited = was.epoch, was.rate, was.best, was.best_epoch, was.waited
        w, best_w = _unpacked(was.weights), _unpacked(was.best_weights)
    while done < t.epochs and waited < t.patience and n:
        w = epoch(rows(), w, idf, weight, rate, t)
        done += 1
        now = held_score(scored(holds, w, idf, aspects))
        if now > best:
            best, best_epoch, best_w, waited = now, done, w, 0
        else:
            waited += 1
            rate = rate / 2 if waited % t.plateau == 0 else rate
        kept.put(done, rate, float(best), best_epoch, waited, _packed(w), _packed(best_w))
    return best_w, idf, best_epoch


def joint(train: DataFrame, held: DataFrame, test: DataFrame, aspects: list[str], root: str, t: Training = Training()) -> DataFrame:
    """The fact table of the test rows, with a threshold for each aspect calibrated on ``held``."""
    w, idf, _ = fit(train, held, aspects, root, t)
    of = lambda rows: scored(featured(rows, aspects, t.buckets), w, idf, aspects)
    threshold = M.calibrate(of(held).where("y_true IS NOT NULL"), "aspect").select("aspect", "threshold")
    return of(test).join(F.broadcast(threshold), "aspect").withColumn("y_pred", (F.col("prob") >= F.col("threshold")).cast("int"))  # a row an aspect
