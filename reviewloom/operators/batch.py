"""Request and response logs: reading responses, joining manifests, gates and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.scores import ratio
from reviewloom.functions.text import salvage_field, unfence

#: Schema of a response body in its three layouts.
BODY = "status string, output_text string, incomplete_details struct<reason:string>, output array<struct<type:string, text:string, content:array<struct<type:string, text:string>>>>, choices array<struct<message:struct<content:string>>>"


def response_text(body: Column) -> Column:
    """The text of a response: output_text, else the output's pieces one after another, else the first choice's message."""
    pieces = F.filter(F.flatten(F.transform(body["output"], lambda o: F.coalesce(F.transform(o["content"], lambda c: c["text"]), F.array(o["text"])))), lambda t: t.isNotNull())
    return F.coalesce(F.nullif(body["output_text"], F.lit("")), F.nullif(F.array_join(pieces, "\n"), F.lit("")), F.element_at(body["choices"], 1)["message"]["content"])


def last_by_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of each key; what came earlier is superseded."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def answered(manifest: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every request, with its response if there is one."""
    return manifest.join(results, key, "left")


def known_results(manifest: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every response to a request of the manifest; others drop."""
    return results.join(manifest, key)


def unanswered(manifest: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    return manifest.join(results, key, "left_anti")


def strict(manifest: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    """Requests with their responses; an error if one has none."""
    missing = unanswered(manifest, results, key).select(key).limit(1).collect()
    if missing:
        raise KeyError(f"no response to {missing[0][0]}")
    return manifest.join(results, key)


def judgement(text: Column) -> Column:
    """(label, justification) of a judge's reply: JSON, fenced JSON, or fields picked out of broken JSON."""
    parsed = F.from_json(unfence(text), "label string, justification string")
    return F.struct(F.lower(F.coalesce(parsed["label"], salvage_field(text, "label"))).alias("label"), F.coalesce(parsed["justification"], salvage_field(text, "justification")).alias("justification"))


def batch_summary(rows: DataFrame) -> DataFrame:
    """Over (status, text, length): counts, completion and duplicate rates, mean length; rates of no rows are 0."""
    kept = rows.where("status = 'completed'")
    distinct = kept.groupBy(F.md5("text").alias("m")).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_completed"))
    size = rows.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("status") == "incomplete", 1)).alias("n_incomplete"), F.avg(F.when(F.col("status") == "completed", F.col("length"))).alias("mean_length"), F.max(F.when(F.col("status") == "completed", F.col("length"))).alias("max_length"))
    both = size.crossJoin(distinct)  # one row each
    return both.select("n_rows", "n_completed", "n_incomplete", ratio(F.col("n_completed"), F.col("n_rows")).alias("completion_rate"), ratio(F.col("n_completed") - F.col("n_distinct"), F.col("n_completed")).alias("duplicate_rate"), "mean_length", "max_length")


def canary_gate(summary: DataFrame, text_success: float = 0.95, completion: float = 0.95, duplicates: float = 0.1, band: float = 0.7) -> DataFrame:
    """The verdict on a trial batch: texts, completion, duplicates and length bands meet their thresholds, and its rows load."""
    verdict = (F.col("text_success_rate") >= text_success) & (F.col("completion_rate") >= completion) & (F.col("duplicate_rate") <= duplicates) & (F.col("band_match_rate") >= band) & F.coalesce("loader_ok", F.lit(False))
    return summary.select("*", verdict.alias("accepted"))


def status_counts(rows: DataFrame, group: str) -> DataFrame:
    """Items by status within a group, progress, and the group's status: the worst of its items'."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    sums = rows.groupBy(group).agg(F.count("*").alias("n"), *[n(s) for s in ("completed", "failed", "running", "pending")])
    worst = F.when(F.col("failed") > 0, "failed").when(F.col("running") > 0, "running").when(F.col("pending") > 0, "pending").otherwise("completed")
    return sums.select("*", ratio(F.col("completed"), F.col("n")).alias("progress"), worst.alias("status"))


def restarted(rows: DataFrame, order: str, stop_on_failure: bool = True) -> DataFrame:
    """Batches of a round as a restart finds them: running ones pend again, and after a failure the rest is skipped."""
    again = rows.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))
    failed = F.max((F.col("status") == "failed").cast("int")).over(Window.partitionBy("round_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    skip = (failed == 1) & (F.col("status") == "pending")
    return again.withColumn("status", F.when(skip, "skipped").otherwise(F.col("status"))) if stop_on_failure else again


def pending_work(tasks: DataFrame, done: DataFrame, signature: str, key: str = "key") -> DataFrame:
    """Tasks not completed under this signature; work done under another one doesn't count."""
    return tasks.join(done.where(F.col("signature") == signature).select(key), key, "left_anti")


def requests(models: DataFrame, variants: DataFrame, items: DataFrame) -> DataFrame:
    """One request per model, variant and item, with its custom_id; models and variants are configuration."""
    grid = models.crossJoin(variants)
    x = items.crossJoin(F.broadcast(grid))
    return x.select(F.concat_ws("__", "model", "variant", F.format_string("row_%06d", "item_id")).alias("custom_id"), *x.columns)


def prompt(instructions: Column, text: Column, examples: Column | None = None) -> Column:
    """Instructions, worked examples (text, labels as JSON) and the text to label."""
    shots = F.lit("") if examples is None else F.array_join(F.transform(examples, lambda e: F.concat(F.lit("\nReview: "), e["text"], F.lit("\nLabels: "), e["labels"])), "")
    return F.concat(instructions, shots, F.lit("\nReview: "), text, F.lit("\nLabels:"))
