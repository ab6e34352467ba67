"""Sources: JSON lines, CSV, XML annotations, HTML cards, notebook outputs, logs."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.functions.text import collapse_repeats, collapse_space, word_count
from reviewloom.pieces import pieces

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines, blank ones skipped.  Strict: a bad line is an error; else it is a row whose ``_corrupt`` holds it."""
    if strict:
        reader = spark.read.option("mode", "FAILFAST")
        return (reader.schema(schema) if schema else reader).json(path)
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return (reader.schema(f"{schema}, {CORRUPT} string") if schema else reader).json(path)


def read_jsonl_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or no rows if nothing is at the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return read_jsonl(spark, path, schema) if there else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, Parquet, ORC, a whole JSON document or JSON lines, by the path's suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    if kind == "json":
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(path)
    return read_jsonl(spark, path, schema)


def latest_by(df: DataFrame, *keys: str) -> DataFrame:
    """Of files read together, the rows of the newest file of each key (by modification time, then name)."""
    stamped = df.withColumn("file_", F.struct("_metadata.file_modification_time", "_metadata.file_path"))
    newest = Window.partitionBy(*keys)
    return stamped.withColumn("newest_", F.max("file_").over(newest)).where("file_ = newest_").drop("file_", "newest_")


def rater_of(path: Column) -> Column:
    """The rater's letter in a file name such as rater_A_complete.csv."""
    return F.nullif(F.regexp_extract(path, r"rater_([A-Z])(?:_|\.)", 1), F.lit(""))


def read_raters(spark: SparkSession, pattern: str) -> DataFrame:
    """All rater files of a glob, wide, with the rater's letter."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(pattern)
    return df.select(rater_of(F.col("_metadata.file_name")).alias("rater"), "*")


def long_votes(wide: DataFrame, aspects: list[str], key: str = "item_id") -> DataFrame:
    """(rater, item, aspect, discussed, polarity) from columns discussed_x and polarity_x."""
    cells = F.array(*[F.struct(F.lit(a).alias("aspect"), F.nullif(F.trim(f"discussed_{a}"), F.lit("")).alias("discussed"), F.nullif(F.trim(f"polarity_{a}"), F.lit("")).alias("polarity")) for a in aspects])
    return wide.select("rater", key, F.explode(cells).alias("c")).select("rater", key, "c.*")


def _annotations(name: str, data: bytes) -> Iterator[tuple]:
    root = ET.fromstring(data)
    for el in root:
        tag = el.tag.rpartition("}")[2]
        kind = "span" if tag == "Document_levelopinion" else "mark" if tag.startswith("Aspect") else None
        if kind and "begin" in el.attrib and "end" in el.attrib:
            get = el.attrib.get
            yield name, kind, int(get("begin")), int(get("end")), get("Aspect", ""), get("Opinion", "") if kind == "mark" else get(tag, "")
    for el in root:
        if el.tag.endswith("}Sofa"):
            yield name, "text", 0, 0, el.attrib.get("sofaString", ""), ""


def read_annotations(spark: SparkSession, root: str) -> DataFrame:
    """(file, kind, begin, end, aspect_raw, opinion_raw) of annotation XML below a folder.

    kind is span (of a document), mark (of an aspect or opinion) or text; a text's
    words are in aspect_raw.  Elements without positions are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xmi").load(root).select("path", "content")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for f, data in zip(part.path, part.content) for r in _annotations(f, data)]
            yield pd.DataFrame(rows, columns=["file", "kind", "begin", "end", "aspect_raw", "opinion_raw"])

    return files.mapInPandas(parse, "file string, kind string, begin int, end int, aspect_raw string, opinion_raw string")


class _Cards(HTMLParser):
    """Texts of elements by class: a card is a header and the paragraphs of its text."""

    def __init__(self) -> None:
        super().__init__()
        self.cards: list[list[str]] = []
        self.where: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = (dict(attrs).get("class") or "").split()
        role = next((c for c in ("card", "card-header", "card-text") if c in classes), "")
        if role == "card":
            self.cards.append(["", "", ""])
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self.where.append((tag, role))
        if self.cards and {"card", "card-header"} <= {r for _, r in self.where}:
            self.cards[-1][2] += " ".join(v for _, v in attrs if v) + " "

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.where) - 1, -1, -1):
            if self.where[k][0] == tag:
                del self.where[k:]
                break

    def handle_data(self, data: str) -> None:
        roles = {r for _, r in self.where}
        if self.cards and "card" in roles:
            code = any(t in ("script", "style") for t, _ in self.where)
            if "card-header" in roles:
                self.cards[-1][2] += f"{data} "
            if code:
                return
            if "card-header" in roles:
                self.cards[-1][0] += f" {data}"
            elif "card-text" in roles:
                self.cards[-1][1] += f" {data}"


def html_cards(pages: DataFrame, key: str = "page_id", html: str = "html", least_words: int = 25) -> DataFrame:
    """(key, ord, header, semester, text) of review cards in HTML, repeats within a text collapsed, short ones and later copies left out.

    The semester is the name that the header's script or an attribute asks for, else the header's text.
    """
    kind = dict(pages.dtypes)[key]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            rows = []
            for at, page in enumerate(part.column(1).to_pylist()):
                parser = _Cards()
                parser.feed(page or "")
                rows += [(at, i, *card) for i, card in enumerate(parser.cards)]
            columns = list(zip(*rows)) or [()] * 5
            keys = part.column(0).take(pa.array(columns[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(columns[1], pa.int32()), *[pa.array(c, pa.string()) for c in columns[2:]]], names=[key, "ord", "header", "text", "markup"])

    cards = pages.select(key, F.col(html).cast("string").alias(html)).mapInArrow(parse, f"{key} {kind}, ord int, header string, text string, markup string")
    header = collapse_space(F.col("header"))
    semester = F.coalesce(F.nullif(F.regexp_extract("markup", r"get_semester_name\('([^']+)'\)", 1), F.lit("")), header)
    clean = cards.select(key, "ord", header.alias("header"), semester.alias("semester"), collapse_repeats(collapse_space(F.col("text"))).alias("text")).where(word_count(F.col("text")) >= least_words)
    once = F.row_number().over(Window.partitionBy(F.md5("text")).orderBy(key, "ord"))
    return clean.withColumn("copy", once).where("copy = 1").drop("copy")


def html_paragraphs(html: Column) -> Column:
    """Texts of the paragraphs of a page, without tags, by patterns alone."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, lambda p: collapse_space(F.regexp_replace(p, "<[^>]*>", " "))), lambda p: p != "")


def notebook_outputs(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """What the last code cell of a notebook printed that has the marker in it: (pos, text).

    A cell's outputs of both kinds, streams and plain values, are joined by line
    feeds in their order.  Lines of an output may be a list or one string.
    """
    lines = "string"  # a list arrives as its JSON
    schema = f"cells array<struct<cell_type:string,outputs:array<struct<text:{lines},data:struct<`text/plain`:{lines}>>>>>"
    book = spark.read.option("multiLine", True).schema(schema).json(path)
    whole = lambda c: F.when(c.startswith("["), F.array_join(F.from_json(c, "array<string>"), "")).otherwise(c)
    said = lambda o: F.coalesce(whole(o["text"]), whole(o["data"]["text/plain"]))
    cells = book.select(F.posexplode("cells").alias("pos", "cell")).where("coalesce(cell.cell_type, 'code') = 'code'")
    texts = cells.select("pos", F.array_join(F.filter(F.transform("cell.outputs", said), lambda t: t.isNotNull()), "\n").alias("text"))
    found = texts.where(F.contains("text", F.lit(marker)))
    return found.groupBy().agg(F.max_by(F.struct("pos", "text"), "pos").alias("last")).where("last IS NOT NULL").select("last.pos", "last.text")


#: Lines of a training log, an aspect with its five rates and four counts, and one with its threshold.
METRIC_LINE = r"^\s*([a-z_]+)" + r"\s+([0-9.]+)" * 5 + r"\s+(\d+)" * 4
THRESHOLD_LINE = r"^\s*([a-z_]+)\s*:\s*threshold=([0-9.]+)\s+\(F1=([0-9.]+)\)"


def _fields(lines: DataFrame, line: str, pattern: str, names: dict[str, str]) -> DataFrame:
    get = [F.regexp_extract(line, pattern, k + 1).try_cast(kind).alias(name) for k, (name, kind) in enumerate(names.items())]
    return lines.where(F.regexp_like(line, F.lit(pattern))).select(*get)


def log_metrics(lines: DataFrame, line: str = "value") -> DataFrame:
    """aspect, its rates and its counts of the log lines that have them."""
    return _fields(lines, line, METRIC_LINE, {"aspect": "string"} | dict.fromkeys(("accuracy", "precision", "recall", "mse", "threshold"), "double") | dict.fromkeys(("tp", "tn", "fp", "fn"), "long"))


def log_thresholds(lines: DataFrame, line: str = "value") -> DataFrame:
    """aspect, its threshold and F1 in calibration of the log lines that have them."""
    return _fields(lines, line, THRESHOLD_LINE, {"aspect": "string", "threshold": "double", "calib_f1": "double"})


def reference_list(html: Column) -> Column:
    """Items of an ordered list of references: array of (href, text)."""
    body = F.regexp_extract(html, r'(?s)<ol[^>]*class="[^"]*refs[^"]*"[^>]*>(.*?)</ol>', 1)
    items = F.regexp_extract_all(body, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), F.lit(1))
    return F.transform(items, lambda x: F.struct(F.regexp_extract(x, 'href="([^"]*)"', 1).alias("href"), collapse_space(F.regexp_replace(x, "<[^>]*>", " ")).alias("text")))
