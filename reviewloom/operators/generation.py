"""Generating requests: attribute draws by policy, rules that keep them coherent, settings by lookup."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.operators.samples import draw, hash_order

#: Instruction by length band, number of aspects up to which the lower token limit holds, lower and upper limit.
LENGTHS = {
    "very short comment": ("Write exactly one short paragraph of 20-40 words, ideally 1-2 sentences, and do not exceed 45 words. If needed, cut specifics rather than exceed the limit.", 1, 90, 110),
    "compact but informative review": ("Write one compact paragraph of 45-75 words, ideally 2-3 sentences, and do not exceed 85 words. If needed, cut secondary detail rather than exceed the limit.", 2, 120, 140),
    "mid-length reflective review": ("Write one mid-length paragraph of 85-125 words, ideally 3-5 sentences, and do not exceed 140 words. If needed, cut secondary detail rather than exceed the limit.", 2, 210, 230),
    "detailed review with one dominant complaint": ("Write one detailed paragraph of 140-190 words, ideally 5-7 sentences, and do not exceed 210 words. If needed, cut side comments rather than exceed the limit.", 2, 300, 330),
}
#: The same for any other band.
OTHER_LENGTH = ("Write one concise paragraph of 55-95 words, ideally 2-4 sentences, and do not exceed 105 words. If needed, cut secondary detail rather than exceed the limit.", 2, 160, 180)
#: Reasoning effort by the beginning of a model's name; the first that fits counts, else the last value.
EFFORTS = [("gpt-5.2", "none"), ("gpt-5-mini", "minimal"), ("gpt-5-nano", "minimal"), ("gpt-5", "low")]
OTHER_EFFORT = "minimal"


def targets(rows: DataFrame, key: str, dim: DataFrame, sizes: list[tuple[str, float]], polarities: list[str], seed: int = 42) -> DataFrame:
    """(key, idx, aspect, polarity): per row as many distinct aspects as a weighted draw says, each with a drawn polarity.

    ``dim``: (idx, aspect), a table of a few dozen rows.
    """
    n = draw(sizes, F.col(key), f"{seed}n").cast("int")
    cells = rows.select(key, n.alias("n")).crossJoin(F.broadcast(dim.select("idx", "aspect")))
    order = hash_order(seed, F.concat_ws(":", key, "idx"))
    placed = cells.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order, "idx"))).where("place <= n")
    return placed.select(key, "idx", "aspect", draw([(p, 1.0) for p in polarities], F.concat_ws(":", key, "idx"), f"{seed}p").alias("polarity"))


def attributes(rows: DataFrame, key: str, schema: DataFrame, sample_size: int, seed: int = 42) -> DataFrame:
    """(key, attribute, value): every required attribute and optional ones up to ``sample_size``, with drawn values.

    ``schema``: (attribute, required, values array), configuration.
    """
    return attributes_by_group(rows, key, schema.withColumns({"group": F.lit(""), "sample_size": F.lit(sample_size)}), seed).drop("group")


def attributes_by_group(rows: DataFrame, key: str, schema: DataFrame, seed: int = 42) -> DataFrame:
    """(key, group, attribute, value): of each group its required attributes and optional ones up to the group's ``sample_size``.

    ``schema``: (group, sample_size, attribute, required, values array), configuration.
    """
    cells = rows.select(key).crossJoin(F.broadcast(schema))
    order = hash_order(seed, F.concat_ws(":", key, "attribute"))
    placed = cells.withColumn("place", F.row_number().over(Window.partitionBy(key, "group").orderBy(F.desc("required"), order, "attribute")))
    kept = placed.where(F.col("required") | (F.col("place") <= F.col("sample_size")))
    pick = F.conv(F.left(hash_order(f"{seed}v", F.concat_ws(":", key, "attribute")), F.lit(8)), 16, 10).cast("long") % F.size("values")
    return kept.select(key, "group", "attribute", F.element_at("values", (pick + 1).cast("int")).alias("value"))


def load_document(spark: SparkSession, path: str, most: int = 1 << 24) -> str:
    """The text of a configuration file: a template or JSON; files of more than ``most`` bytes are no configuration."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size is None or size > most:
        raise ValueError(f"{path}: {size} bytes")
    return spark.read.text(path, wholetext=True).first().value


def load_schema(spark: SparkSession, path: str) -> DataFrame:
    """(group, sample_size, attribute, required, values) of a JSON file with ``schema`` and ``nuance_sampling_policy``.

    A group without a policy, or whose policy gives no size, is taken whole.
    Attributes without values are left out.  A file without a schema is refused.
    """
    kind = "struct<schema:map<string,map<string,array<string>>>,nuance_sampling_policy:map<string,struct<required:array<string>,sample_size:int>>>"
    file = spark.createDataFrame([(load_document(spark, path),)], "value string").select(F.from_json("value", kind).alias("f")).select("f.*")
    if file.where("schema IS NULL").count():
        raise ValueError(f"{path}: no schema")
    policy = F.try_element_at(F.coalesce("nuance_sampling_policy", F.from_json(F.lit("{}"), "map<string,struct<required:array<string>,sample_size:int>>")), F.col("group"))
    groups = file.select("nuance_sampling_policy", F.explode("schema").alias("group", "members")).withColumn("policy", policy)
    size = F.coalesce(F.col("policy.sample_size"), F.size("members")).alias("sample_size")
    each = groups.select("group", size, F.col("policy.required").alias("asked"), F.explode("members").alias("attribute", "values"))
    required = F.coalesce(F.array_contains("asked", F.col("attribute")), F.lit(False)).alias("required")
    return each.where(F.size("values") > 0).select("group", "sample_size", "attribute", required, "values")


def filled(template: str, **blocks: Column) -> Column:
    """A template's text with each ``{name}`` replaced by the column of that name and doubled braces by single ones; null blocks are empty."""
    parts = []
    for text, name, spec, conversion in Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in blocks or spec or conversion:
                raise ValueError(f"no block for {{{name}}}")
            parts.append(F.coalesce(blocks[name].cast("string"), F.lit("")))
    return F.concat(F.lit(""), *parts)


def listing(entries: Column) -> Column:
    """Lines ``- key: value`` of an array of (key, value)."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e.key, F.lit(": "), e.value)), "\n")


def coherent_state(grade: Column, n_positive: Column, n_negative: Column) -> Column:
    """A writer's state that fits the grade and the polarities drawn."""
    return F.when((grade == "F") & (n_positive == 0), "frustrated").when(grade.isin("A", "B") & (n_negative == 0), "satisfied").when(n_negative > n_positive, "critical").when(n_positive > n_negative, "content").otherwise("mixed")


def length_settings(band: Column, n_aspects: Column) -> tuple[Column, Column]:
    """(instruction, token limit) for a length band, whatever its case, and a number of aspects."""
    limit = lambda few, low, high: F.when(n_aspects <= few, low).otherwise(high)
    words, tokens = F.lit(OTHER_LENGTH[0]), limit(*OTHER_LENGTH[1:])
    for name, (said, *limits) in LENGTHS.items():
        fits = F.lower(F.trim(band)) == name
        words, tokens = F.when(fits, said).otherwise(words), F.when(fits, limit(*limits)).otherwise(tokens)
    return words, tokens


def effort(model: Column) -> Column:
    name = F.lower(model)
    out = F.when(name.startswith(EFFORTS[0][0]), EFFORTS[0][1])
    for prefix, value in EFFORTS[1:]:
        out = out.when(name.startswith(prefix), value)
    return out.otherwise(OTHER_EFFORT)


def remaining(spark: SparkSession, done: DataFrame, target: int) -> DataFrame:
    """Ids 0 to target that are not done yet, so that a generation goes on where it stopped."""
    return spark.range(target).join(done.select("id").distinct(), "id", "left_anti")


def numbered(df: DataFrame, prefix: str, *order: Column | str) -> DataFrame:
    """Ids such as J001 in the given order, for a packet's few rows."""
    place = F.row_number().over(Window.orderBy(*order))
    return df.withColumn("item_id", F.concat(F.lit(prefix), F.lpad(place.cast("string"), 3, "0")))


def plan_digest(plan: Column) -> Column:
    """SHA-256 of a plan's JSON."""
    return F.sha2(F.to_json(plan), 256)
