"""Labels from language models, in chained request stages.

Each stage is a table of requests (custom_id, prompt) and a table of replies
(custom_id, text), so it runs against an injected client (``models.ask``) or
as a submitted batch alike: the next stage's requests are a plan over the
replies of the one before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.dims import POLARITIES
from reviewloom.functions.scores import confidence
from reviewloom.functions.text import collapse_space, cue_tags, json_block
from reviewloom.operators.models import ask
from reviewloom.staging import stage

DETECT = "Which of these aspects does the review clearly discuss? Reply with JSON only: {\"aspects\": [names]}. Leave out what is doubtful.\nAspects: "
JUDGE_SENTIMENT = "What does the review say about each of these aspects: positive, neutral or negative? Reply with JSON only: {\"aspects\": [{\"aspect\": name, \"sentiment\": value}]}.\nAspects: "
PRESENCE = "Does the review clearly discuss this aspect? Reply with JSON only: {\"present\": true or false}.\nAspect: "
ONE_SENTIMENT = "What does the review say about this aspect: positive, neutral or negative? Reply with JSON only: {\"sentiment\": value}.\nAspect: "
REPAIR = "\n\nYour last reply lacked one of the two reviews. Reply for both, as the JSON described above and nothing else."
SINGLE = "Is this review real or synthetic? Reply with JSON only: {\"label\": value, \"confidence\": 0 to 100, \"reason\": text, \"cue_tags\": [tags]}.\n"


def _about(instructions: str, names: Column, text: str = "text") -> Column:
    return F.concat(F.lit(instructions), names, F.lit("\n\nReview:\n"), F.col(text))


def named_aspects(reply: Column, aspects: list[str]) -> Column:
    """The known aspects listed under "aspects", each once; none if the reply is no such JSON."""
    listed = F.from_json(F.get_json_object(reply, "$.aspects"), "array<string>")
    return F.coalesce(F.array_distinct(F.filter(listed, lambda a: a.isin(aspects))), F.array().cast("array<string>"))


def aspect_map(reply: Column, aspects: Column) -> Column:
    """Array of (aspect, sentiment) under "aspects", an object or a list of records; only known ones, the last of a repeated aspect."""
    raw = F.get_json_object(reply, "$.aspects")
    pairs = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.struct(e["key"].alias("aspect"), e["value"].alias("sentiment")))
    records = F.from_json(raw, "array<struct<aspect:string,sentiment:string>>")
    both = F.when(F.startswith(F.ltrim(raw), F.lit("{")), pairs).otherwise(records)
    clean = F.transform(both, lambda e: F.struct(F.trim(e["aspect"]).alias("aspect"), F.lower(F.trim(e["sentiment"])).alias("sentiment")))
    known = F.filter(clean, lambda e: F.array_contains(aspects, e["aspect"]) & e["sentiment"].isin([p for p, _ in POLARITIES]))
    last = F.filter(known, lambda e, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda later: later["aspect"] == e["aspect"]))
    return F.coalesce(last, F.array().cast("array<struct<aspect:string,sentiment:string>>"))


def detection_requests(reviews: DataFrame, aspects: list[str]) -> DataFrame:
    """First pass of two: one request per review (custom_id, text)."""
    return reviews.select("custom_id", "text", _about(DETECT, F.lit(", ".join(aspects))).alias("prompt"))


def sentiment_requests(reviews: DataFrame, replies: DataFrame, aspects: list[str]) -> DataFrame:
    """Second pass: a request for each review in which the first found known aspects, with them in ``detected``."""
    found = replies.select("custom_id", named_aspects(json_block(F.col("text")), aspects).alias("detected")).where(F.size("detected") > 0)
    both = reviews.select("custom_id", "text").join(found, "custom_id")
    return both.select("custom_id", "text", "detected", _about(JUDGE_SENTIMENT, F.array_join("detected", ", ")).alias("prompt"))


def labels_of(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """(custom_id, aspect, sentiment) of replies to ``sentiment_requests``; aspects that were not asked for are dropped."""
    said = requests.select("custom_id", "detected").join(replies.select("custom_id", json_block(F.col("text")).alias("reply")), "custom_id")
    return said.select("custom_id", F.inline(aspect_map(F.col("reply"), F.col("detected"))))


def two_pass(reviews: DataFrame, aspects: list[str], client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(custom_id, aspect, sentiment) by both passes; replies are written once, so no request is paid for twice."""
    found = stage(ask(detection_requests(reviews, aspects), client), "detected")
    second = stage(sentiment_requests(reviews, found, aspects), "requests")
    return labels_of(second, stage(ask(second, client), "sentiments"))


def presence_requests(reviews: DataFrame, aspects: list[str]) -> DataFrame:
    """A request for each review and aspect; its custom_id ends in the aspect."""
    each = reviews.select(F.col("custom_id").alias("review"), "text", F.explode(F.array(*[F.lit(a) for a in aspects])).alias("aspect"))
    return each.select("review", "aspect", "text", F.concat_ws("__", "review", "aspect").alias("custom_id"), _about(PRESENCE, F.col("aspect")).alias("prompt"))


def one_sentiment_requests(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """A second request for each aspect that is present."""
    here = replies.select("custom_id", json_block(F.col("text")).alias("reply")).where(F.lower(F.get_json_object("reply", "$.present")) == "true").select("custom_id")
    return requests.join(here, "custom_id", "left_semi").select("review", "aspect", "text", "custom_id", _about(ONE_SENTIMENT, F.col("aspect")).alias("prompt"))


def aspect_by_aspect(reviews: DataFrame, aspects: list[str], client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(custom_id, aspect, sentiment) by a question for each aspect and one for each that is present."""
    first = stage(presence_requests(reviews, aspects), "requests")
    second = stage(one_sentiment_requests(first, stage(ask(first, client), "present")), "requests")
    said = stage(ask(second, client), "sentiments").select("custom_id", F.lower(F.trim(F.get_json_object(json_block(F.col("text")), "$.sentiment"))).alias("sentiment"))
    known = said.where(F.col("sentiment").isin([p for p, _ in POLARITIES]))
    return second.join(known, "custom_id").select(F.col("review").alias("custom_id"), "aspect", "sentiment")


SIDES = ("review_a", "review_b")


def _first(json: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def _tags(raw: Column) -> Column:
    """Tags given as a JSON list or as one delimited string."""
    listed = F.array_join(F.from_json(raw, "array<string>"), ",")
    return cue_tags(F.coalesce(F.when(F.startswith(F.ltrim(raw), F.lit("[")), listed).otherwise(raw), F.lit("")))


def judged_sides(json: Column) -> Column:
    """A judge's verdict on both reviews: a struct (label, confidence, reason, cue_tags, justification) for each.

    Fields are flat (review_a_label) or nested (review_a.label or one of its
    other names); a confidence that is missing or no number is 50, other fields are empty.
    """

    def side(s: str) -> Column:
        flat, nested = f"$.{s}_", f"$.{s}."
        empty = F.lit("")
        reason = F.coalesce(_first(json, f"{flat}reason", f"{nested}reason", f"{nested}justification"), empty)
        return F.struct(
            F.lower(collapse_space(F.coalesce(_first(json, f"{flat}label", f"{nested}label", f"{nested}predicted_label"), empty))).alias("label"),
            confidence(_first(json, f"{flat}confidence", f"{nested}confidence")).alias("confidence"),
            reason.alias("reason"),
            _tags(_first(json, f"{flat}cue_tags", f"{nested}cue_tags", f"{nested}cues")).alias("cue_tags"),
            F.coalesce(_first(json, f"{flat}justification", f"{nested}justification"), reason).alias("justification"),
        ).alias(s)

    return F.struct(*[side(s) for s in SIDES])


def judged_one(json: Column) -> Column:
    """A verdict on a single review, in the shape of one side of ``judged_sides``."""
    empty = F.lit("")
    return F.struct(
        F.lower(F.trim(F.coalesce(_first(json, "$.label", "$.predicted_label"), empty))).alias("label"),
        confidence(_first(json, "$.confidence")).alias("confidence"),
        F.coalesce(_first(json, "$.reason", "$.justification"), empty).alias("reason"),
        _tags(_first(json, "$.cue_tags", "$.cues")).alias("cue_tags"),
        F.coalesce(_first(json, "$.justification", "$.reason"), empty).alias("justification"),
    )


def judge(pairs: DataFrame, client: Callable[[], Callable[[str], str]], tries: int = 3) -> DataFrame:
    """(custom_id, review_a, review_b, attempts) of pairs (custom_id, prompt, a_text, b_text).

    A reply with both labels is done.  If one side lacks its label, that review
    is judged by itself and fills the gap.  Pairs that still lack one are asked
    again with a reminder, up to ``tries`` times; those left have nulls and
    attempts 0.  Each round asks only the pairs that are open.
    """
    a, b = F.col("review_a.label") != "", F.col("review_b.label") != ""
    todo, done = pairs.select("custom_id", "prompt", "a_text", "b_text"), None
    for attempt in range(1, tries + 1):
        asked = todo if attempt == 1 else todo.withColumn("prompt", F.concat("prompt", F.lit(REPAIR)))
        replies = stage(ask(asked, client), "verdicts")
        said = stage(todo.join(replies.select("custom_id", judged_sides(json_block(F.col("text"))).alias("v")), "custom_id").select("custom_id", "prompt", "a_text", "b_text", "v.*"), "sides")
        lone = said.where(a != b).select("custom_id", F.concat(F.lit(SINGLE), F.when(a, F.col("b_text")).otherwise(F.col("a_text"))).alias("prompt"))
        single = ask(lone, client).select("custom_id", judged_one(json_block(F.col("text"))).alias("other"))
        filled = said.join(single, "custom_id", "left")
        for s, has in zip(SIDES, (a, b)):
            filled = filled.withColumn(f"{s}_", F.when(~has & F.col("other").isNotNull(), F.col("other")).otherwise(F.col(s)))
        filled = stage(filled.drop(*SIDES, "other").withColumnsRenamed({f"{s}_": s for s in SIDES}), "filled")
        ready = filled.where(a & b).select("custom_id", *SIDES, F.lit(attempt).alias("attempts"))
        done = ready if done is None else done.unionByName(ready)
        todo = filled.where(~(a & b)).select("custom_id", "prompt", "a_text", "b_text")
    kind = dict(done.dtypes)["review_a"]
    left = todo.select("custom_id", *[F.lit(None).cast(kind).alias(s) for s in SIDES], F.lit(0).alias("attempts"))
    return done.unionByName(left)
