"""Queries of ingestion: normalisation, logs, pages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.dims import OVERLAP
from reviewloom.functions import text as T
from reviewloom.operators import batch as B
from reviewloom.operators import metrics as M
from reviewloom.operators import normalize as N
from reviewloom.plans.binding import CELLS_SQL, REVIEWS_SQL, cells, reviews
from reviewloom.plans.core import query
from reviewloom.plans.samples import _WORDS
from reviewloom.sources.readers import html_cards, html_paragraphs
from reviewloom.staging import table
from reviewloom.streaming import status as ST


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a label cell in one of three notations by the id."""
    per = cells(spark, sf_dir).where("y_true = 1").groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("aspect", F.col("pol_true").alias("polarity")))).alias("l"))
    as_map = F.to_json(F.map_from_entries("l"))
    as_list = F.to_json(F.transform("l", lambda x: F.struct(x.aspect.alias("name"), F.upper(x.polarity).alias("value"))))
    as_text = F.array_join(F.transform("l", lambda x: F.concat(x.aspect, F.lit(" : "), x.polarity)), " | ")
    k = F.col("review_id") % 4
    cell = F.when(k == 0, as_map).when(k == 1, as_list).when(k == 2, as_text).otherwise('{"clarity":"great"}')
    r = reviews(spark, sf_dir).join(per, "review_id")
    return r.select("review_id", F.col("text").alias("Review"), cell.alias("Labels"), F.col("course_name").alias("course_title"), F.col("grade").alias("grade_band"), "style")


@query("q_alias_normalize", f"""WITH {CELLS_SQL}, g AS (SELECT review_id, count(*) AS n_aspects, string_agg(aspect || '=' || pol_true, ',' ORDER BY aspect) AS aspects FROM cells WHERE y_true = 1 GROUP BY 1)
SELECT course_name, grade, style, n_aspects, aspects, md5(trim(text)) AS text_md5 FROM reviews JOIN g USING (review_id) WHERE review_id % 4 <> 3 AND length(trim(text)) > 0""")
def alias_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = N.normalized(_raw(spark, sf_dir))
    entries = F.array_sort(F.map_entries("aspects"))
    return n.select("course_name", "grade", "style", F.size(entries).cast("long").alias("n_aspects"), F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("aspects"), F.md5("text").alias("text_md5"))


@query("q_jsonish_parse", f"""WITH {CELLS_SQL} SELECT review_id, aspect, pol_true AS polarity FROM cells WHERE y_true = 1 AND review_id % 4 <> 3""")
def jsonish_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.exploded(_raw(spark, sf_dir).select("review_id", N.targets(F.col("Labels")).alias("m")), "review_id", "m")


@query("q_restrict_overlap", f"""WITH {CELLS_SQL} SELECT review_id, count(*) AS kept FROM cells WHERE y_true = 1 AND review_id % 4 <> 3 AND aspect IN ({", ".join(f"'{a}'" for a in OVERLAP)}) GROUP BY 1""")
def restrict_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _raw(spark, sf_dir).select("review_id", N.restricted(N.targets(F.col("Labels")), OVERLAP).alias("m"))
    return m.where(F.cardinality("m") > 0).select("review_id", F.cardinality("m").cast("long").alias("kept"))


@query("q_props_extract", "SELECT event_id, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return m.select("event_id", F.explode("m").alias("key", "value"))


_CASES = lambda bounds, names: "CASE " + " ".join(f"WHEN w < {b} THEN '{n}'" for b, n in zip(bounds, names)) + f" ELSE '{names[-1]}' END"


@query("q_length_bands", f"WITH {REVIEWS_SQL}, w AS (SELECT review_id, {_WORDS} AS w, text FROM reviews) SELECT review_id, w AS n_words, length(text) AS n_chars, " + ", ".join(f"{_CASES(*v)} AS {k}" for k, v in T.BANDS.items()) + " FROM w")
def length_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = reviews(spark, sf_dir).select("review_id", T.word_count(F.col("text")).alias("n_words"), F.length("text").cast("long").alias("n_chars"))
    return w.select("*", *[T.length_band(F.col("n_words"), k).alias(k) for k in T.BANDS])


@query("q_text_normalize", r"""SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS collapsed, regexp_replace(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview, contains(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g'))) AND trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) <> '' AS matches FROM documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_space(t)).alias("collapsed"), T.slug(F.concat_ws(" / ", "source", "lang")).alias("slug"), T.preview(t).alias("preview"), T.titles_match(t, F.substring_index(t, "\n", 1)).alias("matches"))


@query("q_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS n_distinct, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n_tokens FROM documents")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.token_set(F.col("text"))).cast("long").alias("n_distinct"), F.size(t).cast("long").alias("n_tokens"))


@query("q_cue_tags", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(lang || ',  Read  ' || source || ';' || lang || '/X'), '[,;/|]'), lambda x: replace(trim(regexp_replace(x, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' ', '_')), lambda x: x <> ''))), ',') AS tags FROM documents")
def cue_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("lang", F.lit(",  Read  "), "source", F.lit(";"), "lang", F.lit("/X"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.cue_tags(raw), ",").alias("tags"))


@query("q_html_paragraphs", r"""SELECT page_id, len(p) AS n_paragraphs, md5(array_to_string(p, chr(10))) AS text_md5 FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<p>(.*?)</p>', 1, 's'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))), lambda x: x <> '') AS p FROM pages)""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = html_paragraphs(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", p.alias("p")).select("page_id", F.size("p").cast("long").alias("n_paragraphs"), F.md5(F.array_join("p", "\n")).alias("text_md5"))


@query("q_html_cards")
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review cards parsed from HTML; pages without cards have their article as one, made by a tag replacement."""
    html = F.regexp_replace(F.regexp_replace("html", "<article>", '<div class="card"><div class="card-header">Spring</div><div class="card-text">'), "</article>", "</div></div>")
    return html_cards(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    key = F.format_string("c%06d", "conv_id")
    asked = c.where("turn = 0").select(key.alias("custom_id"), F.col("role").alias("asked_by"), F.length("text").cast("long").alias("prompt_chars"))
    other = F.when(F.col("conv_id") % 7 == 0, F.format_string("old-%06d", "conv_id")).otherwise(key)  # answers to requests that the manifest doesn't list
    said = B.last_by_key(c.where("turn > 0").select(other.alias("custom_id"), "turn", "role", F.length("text").cast("long").alias("chars")), "custom_id", "turn")
    extra = said.withColumn("custom_id", F.concat(F.lit("x"), "custom_id")).where("turn % 5 = 1")
    return asked, said.unionByName(extra)


_LOG = """asked AS (SELECT printf('c%06d', conv_id) AS custom_id, role AS asked_by, length(text) AS prompt_chars FROM conversations WHERE turn = 0),
ranked AS (SELECT CASE WHEN conv_id % 7 = 0 THEN printf('old-%06d', conv_id) ELSE printf('c%06d', conv_id) END AS custom_id, turn, role, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE turn > 0),
one AS (SELECT custom_id, turn, role, chars FROM ranked WHERE r = 1), said AS (SELECT * FROM one UNION ALL SELECT 'x' || custom_id, turn, role, chars FROM one WHERE turn % 5 = 1)"""


@query("q_manifest_left_join", f"WITH {_LOG} SELECT custom_id, asked_by, prompt_chars, turn, role, chars FROM asked LEFT JOIN said USING (custom_id)")
def manifest_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.answered(*_log(spark, sf_dir))


@query("q_manifest_inner_join", f"WITH {_LOG} SELECT custom_id, asked_by, prompt_chars, turn, role, chars FROM asked JOIN said USING (custom_id)")
def manifest_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.known_results(*_log(spark, sf_dir))


@query("q_manifest_anti", f"WITH {_LOG} SELECT * FROM asked WHERE custom_id NOT IN (SELECT custom_id FROM said)")
def manifest_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.unanswered(*_log(spark, sf_dir))


@query("q_response_text", """SELECT doc_id, md5(CASE WHEN doc_id % 4 = 3 THEN NULL ELSE text END) AS said FROM documents""")
def response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of the three layouts written as JSON and read again."""
    t = F.col("text")
    piece = F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("text").alias("type"), t.alias("text"))).alias("content")))
    k = F.col("doc_id") % 4
    body = F.when(k == 0, F.to_json(F.struct(t.alias("output_text")))).when(k == 1, F.to_json(F.struct(piece.alias("output")))).when(k == 2, F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")))).otherwise('{"status":"failed"}')
    rows = table(spark, sf_dir, "documents").select("doc_id", F.from_json(body, B.BODY).alias("body"))
    return rows.select("doc_id", F.md5(B.response_text(F.col("body"))).alias("said"))


@query("q_judge_salvage", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS label, 'it reads ' || lang AS justification FROM documents""")
def judge_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("doc_id") % 2 == 0, "Real").otherwise("Synthetic")
    good = F.format_string('{"label": "%s", "justification": "it reads %s"}', label, "lang")
    k = F.col("doc_id") % 3
    reply = F.when(k == 0, good).when(k == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(F.concat(F.lit("My verdict: "), F.left(good, F.length(good) - 1)))
    return table(spark, sf_dir, "documents").select("doc_id", B.judgement(reply).alias("j")).select("doc_id", "j.*")


_STATUS = "CASE WHEN doc_id % 11 = 0 THEN 'incomplete' WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'completed' END"
_BATCH = f"""r AS (SELECT source, {_STATUS} AS status, text, {_WORDS} AS length FROM documents),
s AS (SELECT count(*) AS n_rows, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'incomplete') AS n_incomplete, count(DISTINCT text) FILTER (status = 'completed') AS d, round(avg(length) FILTER (status = 'completed'), 9) AS mean_length, max(length) FILTER (status = 'completed') AS max_length,
    round(avg((length >= 80)::INT), 9) AS band_match_rate, round(avg((length > 0)::INT), 9) AS text_success_rate, count(*) FILTER (length > 0) > 0 AS loader_ok FROM r), b AS (SELECT n_rows, n_completed, n_incomplete, round(n_completed / n_rows::DOUBLE, 9) AS completion_rate, round((n_completed - d) / n_completed::DOUBLE, 9) AS duplicate_rate, mean_length, max_length, band_match_rate, text_success_rate, loader_ok FROM s)"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.expr(_STATUS).alias("status"), "text", T.word_count(F.col("text")).alias("length"))


@query("q_batch_summary", f"WITH {_BATCH} SELECT n_rows, n_completed, n_incomplete, completion_rate, duplicate_rate, mean_length, max_length FROM b")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rounded(B.batch_summary(_batch(spark, sf_dir)))


@query("q_canary_gate", f"WITH {_BATCH} SELECT *, text_success_rate >= 0.95 AND completion_rate >= 0.95 AND duplicate_rate <= 0.1 AND band_match_rate >= 0.7 AND loader_ok AS accepted FROM b")
def canary_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _batch(spark, sf_dir)
    said = F.col("length") > 0
    matched = rows.agg(F.avg((F.col("length") >= 80).cast("int")).alias("band_match_rate"), F.avg(said.cast("int")).alias("text_success_rate"), (F.count(F.when(said, 1)) > 0).alias("loader_ok"))
    return B.canary_gate(M.rounded(B.batch_summary(rows).crossJoin(matched)))  # one row each


_ST = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE CASE WHEN value > 95 THEN 'failed' ELSE 'completed' END END"
_LAST = f"last AS (SELECT user_id, arg_max({_ST}, (ts, event_id)) AS status FROM events GROUP BY user_id)"


@query("q_status_counts", f"""WITH {_LAST}, c AS (SELECT user_id % 10 AS round_id, count(*) AS n, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS pending FROM last GROUP BY 1)
SELECT *, round(completed / n::DOUBLE, 9) AS progress, CASE WHEN failed > 0 THEN 'failed' WHEN running > 0 THEN 'running' WHEN pending > 0 THEN 'pending' ELSE 'completed' END AS status FROM c""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.expr(_ST), F.struct("ts", "event_id")).alias("status"))
    return M.rounded(B.status_counts(last.withColumn("round_id", F.col("user_id") % 10), "round_id"))


_SNAP = "SELECT user_id, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, CAST(max(ts) AS VARCHAR) AS ts FROM events GROUP BY user_id"
_TS = "yyyy-MM-dd HH:mm:ss"


def _shown(df: DataFrame) -> DataFrame:
    """The time as text, with the fraction only if there is one."""
    micros = F.date_format("ts", "SSSSSS")
    text = F.concat(F.date_format("ts", _TS), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), F.rtrim(micros, F.lit("0")))))
    return df.withColumn("ts", text)


@query("q_latest_state", _SNAP)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ST.latest_state(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "value"))


@query("q_stream_status_snapshot", _SNAP)
def stream_status_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ST.status_snapshot(spark, sf_dir))


@query("q_stream_windowed_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ST.run_windowed_counts(spark, sf_dir)
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))

