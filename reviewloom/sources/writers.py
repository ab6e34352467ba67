"""Sinks: run bundles, a registry, exports and tables for people."""

from __future__ import annotations

import html
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.operators.samples import hash_order


class RunStore:
    """Results of runs in one Parquet table per artifact, partitioned by run, and an append-only registry."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def fresh_id(prefix: str) -> str:
        """prefix, the time in UTC and a random part, so runs of the same second differ without looking at the store."""
        return f"{prefix}_{datetime.now(UTC):%Y%m%dT%H%M%SZ}_{uuid.uuid4().hex[:8]}"

    def write(self, run_id: str, name: str, df: DataFrame, *partitions: str) -> None:
        """A run's artifact; writing it again replaces that run's rows only."""
        df.withColumn("run_id", F.lit(run_id)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id", *partitions).parquet(f"{self.root}/{name}")

    def register(self, run_id: str, settings: dict[str, str]) -> None:
        row = self.spark.createDataFrame([(run_id, settings)], "run_id string, settings map<string,string>")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.root}/registry")

    def registry(self) -> DataFrame:
        return self.spark.read.schema("run_id string, settings map<string,string>, at timestamp").json(f"{self.root}/registry")

    def read(self, name: str, run_id: str | None = None) -> DataFrame:
        """An artifact of a run, by default the one registered last."""
        df = self.spark.read.parquet(f"{self.root}/{name}")
        if run_id is not None:
            return df.where(F.col("run_id") == run_id)
        last = self.registry().orderBy(F.desc("at"), F.desc("run_id")).limit(1).select("run_id")
        return df.join(F.broadcast(last), "run_id", "left_semi")  # one row


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; maps, arrays and structs as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_artifact(spark: SparkSession, value: DataFrame | dict | list | str, path: str) -> str:
    """A result by its kind: a DataFrame as CSV, a mapping or list as one line of JSON, other values as text; the path with its suffix."""
    if isinstance(value, DataFrame):
        write_csv(value, f"{path}.csv")
        return f"{path}.csv"
    plain = isinstance(value, str)
    line = value if plain else json.dumps(value, ensure_ascii=False, sort_keys=True)
    out = f"{path}.{'txt' if plain else 'json'}"
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(out)
    return out


def _few(df: DataFrame, rows: int) -> list:
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows are no table to read")
    return got


def html_table(df: DataFrame, heading: str, rows: int = 200) -> str:
    """A page with a short result as a table, texts escaped and their line breaks kept."""
    cell = lambda v: f"<td><pre>{html.escape('' if v is None else str(v))}</pre></td>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "\n".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in _few(df, rows))
    return f'<html><head><meta charset="utf-8"></head><body>\n<h2>{html.escape(heading)}</h2>\n<table>\n<tr>{head}</tr>\n{body}\n</table>\n</body></html>\n'


def sections(df: DataFrame, title: str, section: str, order: list[str], top: int = 10) -> str:
    """A Markdown report: a heading for each value of ``section`` and under it its first ``top`` rows by ``order`` as a table."""
    place = F.row_number().over(Window.partitionBy(section).orderBy(*order))
    first = df.withColumn("place_", place).where(F.col("place_") <= top)
    names = [r[section] for r in _few(df.select(section).distinct().orderBy(section), 200)]
    parts = [f"## {n}\n\n{markdown(first.where(F.col(section).eqNullSafe(n)).orderBy('place_').drop('place_', section), top)}" for n in names]
    return "\n\n".join([f"# {title}", *parts]) + "\n"


def markdown(df: DataFrame, rows: int = 200) -> str:
    """A short result as a Markdown table; a report's rows are few, and more than ``rows`` are refused."""
    got = _few(df, rows)
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in got])


def rater_packets(items: DataFrame, raters: list[str], key: str, seed: int) -> DataFrame:
    """Each rater's items in an order of their own: (rater, position, columns of items)."""
    letters = F.explode(F.array(*[F.lit(r) for r in raters])).alias("rater")
    dealt = items.select(letters, "*").withColumn("order_", hash_order(seed, F.concat_ws(":", "rater", F.col(key).cast("string"))))
    return dealt.withColumn("position", F.row_number().over(Window.partitionBy("rater").orderBy("order_", key))).drop("order_")
