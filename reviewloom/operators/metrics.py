"""Multilabel metrics over a long fact table (approach, review_id, aspect, y_true, y_pred, prob, sent_true, sent_pred).

All start from integer counts, which Spark sums on the map side; what follows
is arithmetic on one short row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.scores import f1, mcc, nearest_polarity, polarity_score, ratio, specificity
from reviewloom.operators.positions import cumulative

#: The 19 thresholds of a calibration grid, and the 101 of a curve.
GRID = [round(0.05 * k, 2) for k in range(1, 20)]
CURVE = [round(0.01 * k, 2) for k in range(101)]


def confusion(fact: DataFrame, *keys: str) -> DataFrame:
    """tp, tn, fp, fn by keys."""

    def cells(name: str, true: int, pred: int) -> Column:
        return F.sum(F.when((F.col("y_true") == true) & (F.col("y_pred") == pred), 1).otherwise(0)).alias(name)

    return fact.groupBy(*keys).agg(cells("tp", 1, 1), cells("tn", 0, 0), cells("fp", 0, 1), cells("fn", 1, 0))


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, specificity, balanced_accuracy, mcc beside the counts; 0 where nothing is counted."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall, spec = ratio(tp, tp + fn), specificity(tn, fp)
    return counts.select(
        "*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), f1(tp, fp, fn).alias("f1"),
        spec.alias("specificity"), ((recall + spec) / 2).alias("balanced_accuracy"), mcc(tp, tn, fp, fn).alias("mcc"),
    )


def micro_macro(fact: DataFrame, *keys: str) -> DataFrame:
    """Micro metrics from summed counts and macro metrics as means over aspects, from one pass over the fact table."""
    per = rates(confusion(fact, *keys, "aspect"))
    total = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc")])
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return total.select(*keys, "tp", "tn", "fp", "fn", ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"), f1(tp, fp, fn).alias("micro_f1"), *[F.col(f"macro_{c}") for c in ("precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc")])


def samples_metrics(fact: DataFrame, *keys: str) -> DataFrame:
    """Label and subset accuracy, samples-F1 and samples-Jaccard: per review first, then the mean over reviews."""
    row = confusion(fact, *keys, "review_id")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return row.groupBy(*keys).agg(
        ratio(F.sum(tp + tn), F.sum(tp + tn + fp + fn)).alias("label_accuracy"), F.avg((fp + fn == 0).cast("double")).alias("subset_accuracy"),
        F.avg(f1(tp, fp, fn)).alias("samples_f1"), F.avg(ratio(tp, tp + fp + fn)).alias("samples_jaccard"), ratio(F.sum(fp + fn), F.sum(tp + tn + fp + fn)).alias("hamming_loss"),
    )


def sentiment_errors(fact: DataFrame, *keys: str) -> DataFrame:
    """n_eval, mse, mae and polarity accuracy over cells that are both labelled and detected; null where there are none."""
    both = (F.col("y_true") == 1) & (F.col("y_pred") == 1)
    error = F.col("sent_pred") - F.col("sent_true")
    right = polarity_score(nearest_polarity(F.col("sent_pred"))) == F.col("sent_true")
    return fact.groupBy(*keys).agg(
        F.count(F.when(both, 1)).alias("n_eval"), F.avg(F.when(both, error * error)).alias("mse"), F.avg(F.when(both, F.abs(error))).alias("mae"), F.avg(F.when(both, right.cast("double"))).alias("polarity_accuracy")
    )


def collapse(fact: DataFrame, group: str) -> DataFrame:
    """The fact table with aspects collapsed to the groups of a scheme: a flag is set if any member's is."""
    return fact.groupBy("approach", "review_id", F.col(group).alias("aspect")).agg(F.max("y_true").alias("y_true"), F.max("y_pred").alias("y_pred"))


def group_rollup(per_aspect: DataFrame, dim: DataFrame, *keys: str) -> DataFrame:
    """Per-aspect rows (counts, rates) rolled up to groups: micro-F1 from counts, macro means; aspects without a group drop."""
    joined = per_aspect.join(F.broadcast(dim), "aspect")  # a dimension of 20 rows
    sums = joined.groupBy(*keys, "group").agg(F.count("*").alias("n_aspects"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg("f1").alias("macro_f1"), F.avg("balanced_accuracy").alias("macro_balanced_accuracy"))
    return sums.select(*keys, "group", "n_aspects", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("micro_f1"), "macro_f1", "macro_balanced_accuracy")


def _thresholds_passed(p: Column, grid: list[float]) -> Column:
    """How many values of an even, ascending grid p reaches; 0 for null.  The place found by division is put right by one comparison each way."""
    held = F.array(*map(F.lit, grid))
    step = (grid[-1] - grid[0]) / max(len(grid) - 1, 1) or 1.0
    k = F.least(F.greatest(F.floor((p - grid[0]) / step), F.lit(0)), F.lit(len(grid) - 1)).cast("int")
    found = F.when(p >= F.get(held, k + 1), k + 2).when(p >= F.get(held, k), k + 1).otherwise(k)
    return F.coalesce(found, F.lit(0))


def at_thresholds(fact: DataFrame, grid: list[float], *keys: str) -> DataFrame:
    """Counts at each threshold of a grid, without multiplying the fact table by it.

    Each probability falls in one bin of the grid; the counts of a threshold
    are the sums of the bins at and above it, over one row per bin.
    """
    passed = _thresholds_passed(F.col("prob"), grid)
    bins = fact.groupBy(*keys, passed.alias("bin")).agg(F.sum("y_true").alias("pos"), F.count("*").alias("n"))
    steps = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("bin"), F.lit(t).alias("threshold")) for k, t in enumerate(grid)])).alias("step")
    every = bins.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n")).select(*keys, "all_pos", "all_n", steps).select(*keys, "all_pos", "all_n", "step.*")
    joined = every.alias("e").join(bins.alias("b"), [F.col(f"e.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("b.bin") >= F.col("e.bin")], "left")
    sums = joined.groupBy(*[f"e.{k}" for k in keys], "e.threshold", "e.all_pos", "e.all_n").agg(F.coalesce(F.sum("b.pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.col("b.n") - F.col("b.pos")), F.lit(0)).alias("fp"))
    return sums.select(*keys, "threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("all_pos") - F.col("fp")).alias("tn"))


def calibrate(fact: DataFrame, *keys: str, grid: list[float] = GRID) -> DataFrame:
    """The threshold of each group with the best F1, the least of equal ones; one half if nothing is found anywhere."""
    scored = at_thresholds(fact, grid, *keys).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("minus"))).alias("best"))
    return best.select(*keys, F.when(F.col("best.f1") > 0, -F.col("best.minus")).otherwise(0.5).alias("threshold"), F.col("best.f1").alias("f1"))


def precision_curve(fact: DataFrame, grid: list[float] = CURVE) -> DataFrame:
    """Precision and the number detected at each threshold; thresholds that detect nothing are left out."""
    at = at_thresholds(fact, grid, "approach").where("tp + fp > 0")
    return at.select("approach", "threshold", (F.col("tp") + F.col("fp")).alias("n"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def positive_weights(fact: DataFrame, *keys: str) -> DataFrame:
    """Negatives per positive, within 1 and 50, as a class weight."""
    sums = fact.groupBy(*keys).agg(F.sum("y_true").alias("pos"), F.count("*").alias("n"))
    return sums.select(*keys, "pos", "n", F.least(F.greatest((F.col("n") - F.col("pos")) / F.greatest(F.col("pos"), F.lit(1)), F.lit(1.0)), F.lit(50.0)).alias("weight"))


def ranking(fact: DataFrame, *keys: str) -> DataFrame:
    """Average precision and AUROC by keys; equal scores count as one step.  Groups of one class only are left out.

    Scores are first summed to one row per distinct value.  These are summed up
    in ranges of the order, so a group's values are spread over tasks however many it has.
    """
    steps = fact.groupBy(*keys, "prob").agg(F.sum("y_true").alias("pos"), F.count("*").alias("n"))
    totals = fact.groupBy(*keys).agg(F.sum("y_true").alias("all_pos"), F.count("*").alias("all_n")).where("all_pos > 0 AND all_pos < all_n")
    run = cumulative(steps, [F.desc("prob")], {"tp": F.col("pos"), "seen": F.col("n")}, list(keys))
    sums = run.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("precise"), F.sum((F.col("n") - F.col("pos")) * (F.col("tp") - F.col("pos") / 2.0)).alias("beaten"))
    return sums.join(totals, list(keys)).select(*keys, (F.col("precise") / F.col("all_pos")).alias("average_precision"), (F.col("beaten") / (F.col("all_pos") * (F.col("all_n") - F.col("all_pos")))).alias("auroc"))


def separation(fact: DataFrame, *keys: str) -> DataFrame:
    """Predicted less true prevalence, and the mean probability of positives less that of negatives."""
    return fact.groupBy(*keys).agg(
        F.avg("y_true").alias("prevalence"), (F.avg("y_pred") - F.avg("y_true")).alias("prevalence_shift"), (F.avg(F.when(F.col("y_true") == 1, F.col("prob"))) - F.avg(F.when(F.col("y_true") == 0, F.col("prob")))).alias("score_separation")
    )


def oracle_k(fact: DataFrame) -> DataFrame:
    """Metrics of each review's k most probable aspects, k being its number of true ones."""
    rows = Window.partitionBy("approach", "review_id")
    ranked = fact.withColumn("k", F.sum("y_true").over(rows)).withColumn("place", F.row_number().over(rows.orderBy(F.desc("prob"), "idx")))
    chosen = ranked.withColumn("y_pred", (F.col("place") <= F.col("k")).cast("int"))
    per = confusion(chosen, "approach", "review_id")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.groupBy("approach").agg(f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("micro_f1"), F.avg(f1(tp, fp, fn)).alias("samples_f1"))


def calibration_error(fact: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error in equal bins of probability."""
    p, y = F.col("prob"), F.col("y_true")
    per = fact.groupBy("approach", F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((p - y) * (p - y)).alias("se"))
    return per.groupBy("approach").agg((F.sum("se") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))


def extremes(scored: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k greatest and the k least rows by value, tagged; ties by key."""
    top = scored.orderBy(F.desc(value), key).limit(k).withColumn("end", F.lit("top"))
    return top.unionByName(scored.orderBy(value, key).limit(k).withColumn("end", F.lit("bottom")))


def seed_spread(runs: DataFrame, values: list[str], *keys: str) -> DataFrame:
    """Mean, population and sample deviation of each value over runs."""
    return runs.groupBy(*keys).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std_pop", F.stddev_pop), ("std_samp", F.stddev_samp))])


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, for reports and for comparison between engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def shown(value: Column) -> Column:
    """Four decimals as text, empty for null."""
    return F.coalesce(F.format_string("%.4f", value), F.lit(""))
