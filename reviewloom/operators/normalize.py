"""Reviews of any layout to one schema: column aliases, cells in several notations, label maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that a column may have, the preferred one first.
ALIASES = {
    "text": ["text", "review_text", "review", "content", "sentence"],
    "targets": ["aspects", "target_attributes", "targets", "labels"],
    "nuance": ["nuance_attributes", "nuances", "attributes", "context_attributes"],
}
POLARITY_NAMES = ("negative", "neutral", "positive")


def resolve(df: DataFrame, field: str) -> str | None:
    """The column that holds a field: the first alias that is there, whatever its case."""
    by_name = {c.lower(): c for c in df.columns}
    return next((by_name[a] for a in ALIASES[field] if a in by_name), None)


def jsonish(cell: Column) -> Column:
    """map<string,string> of a cell that is a JSON object or ``k: v | k: v``; an empty map for anything else."""
    parsed = F.from_json(cell, "map<string,string>")
    pairs = F.filter(F.split(cell, r"\|"), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value")))
    listed = last_wins(entries)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(F.trim(cell).startswith("{"), F.coalesce(parsed, none)).when(F.trim(cell).startswith("["), none).otherwise(F.coalesce(listed, none))


def last_wins(entries: Column) -> Column:
    """A map from entries whose keys may repeat; the last of a key counts."""
    size = F.size(entries)
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(size - i - 1, F.lit(0))), lambda later: later.key == e.key))
    return F.map_from_entries(kept)


def targets(cell: Column) -> Column:
    """Label map of a cell: an object, a list of objects with aliased fields, or ``k: v | k: v``; only the three polarities stay."""
    kind = "array<struct<aspect:string,name:string,label:string,sentiment:string,polarity:string,value:string>>"
    rows = F.filter(F.from_json(cell, kind), lambda r: F.coalesce(r["aspect"], r["name"], r["label"]).isNotNull())
    listed = last_wins(F.transform(rows, lambda r: F.struct(F.coalesce(r["aspect"], r["name"], r["label"]).alias("key"), F.coalesce(r["sentiment"], r["polarity"], r["value"]).alias("value"))))
    raw = F.when(F.trim(cell).startswith("["), listed).otherwise(jsonish(cell))
    return F.map_filter(F.transform_values(raw, lambda _, v: F.lower(F.trim(v))), lambda _, v: v.isin(*POLARITY_NAMES))


def nuances(cell: Column) -> Column:
    """Attribute map of a cell: an object without its nulls and blanks, list items as item_0 and on, any other text as ``value``.

    Blank list items go and keep their number; a null item is the text None.
    """
    items = F.from_json(cell, "array<string>")
    listed = F.transform(items, lambda x, i: F.struct(F.concat(F.lit("item_"), i.cast("string")).alias("key"), F.trim(F.coalesce(x, F.lit("None"))).alias("value")))
    pairs = F.filter(F.map_entries(jsonish(cell)), lambda e: e.value.isNotNull())
    pairs = last_wins(F.transform(pairs, lambda e: F.struct(F.trim(e.key).alias("key"), F.trim(e.value).alias("value"))))
    single = F.create_map(F.lit("value"), F.trim(cell))
    found = F.when(F.trim(cell).startswith("["), F.map_from_entries(listed)).when(F.trim(cell).startswith("{") | F.contains(cell, F.lit(":")), pairs).when(F.trim(F.coalesce(cell, F.lit(""))) == "", jsonish(F.lit(""))).otherwise(single)
    return F.map_filter(found, lambda k, v: (k != "") & (v != ""))


def normalized(df: DataFrame) -> DataFrame:
    """text, aspects, nuance, course_name, grade, style of reviews in any layout; rows without text or labels go."""
    text, label, nuance = (resolve(df, f) for f in ("text", "targets", "nuance"))
    if text is None or label is None:
        raise ValueError(f"no text or label column among {df.columns}")

    def as_text(name: str | None) -> Column:
        if name is None:
            return F.lit("")
        return F.col(name) if dict(df.dtypes)[name] == "string" else F.to_json(name)

    def first(*names: str) -> Column:
        have = [F.col(n).cast("string") for n in names if n in df.columns]
        return F.coalesce(*have, F.lit(""))

    out = df.select(
        F.trim(F.col(text)).alias("text"), targets(as_text(label)).alias("aspects"), nuances(as_text(nuance)).alias("nuance"), first("course_name", "course_title").alias("course_name"), first("grade", "grade_band").alias("grade"),
        first("style", "writing_style", "linguistic_style").alias("style"),
    )
    return out.where((F.length("text") > 0) & (F.cardinality("aspects") > 0))


def exploded(df: DataFrame, key: str, labels: str) -> DataFrame:
    """(key, aspect, polarity): a label map in long form."""
    return df.select(key, F.explode(labels).alias("aspect", "polarity"))


def restricted(labels: Column, allowed: list[str]) -> Column:
    """The label map without the aspects that aren't allowed."""
    return F.map_filter(labels, lambda k, _: k.isin(allowed))


def overridden(base: Column, over: Column) -> Column:
    """A map with another's values in place of its own."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(over, k), F.lit(False))), F.coalesce(over, F.map_filter(base, lambda k, v: F.lit(False))))
