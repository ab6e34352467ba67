"""Queries of request logs: positions in files, shards of requests, monitored runs, merged shards, logged stages, routed requests, packages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.operators import positions as P
from reviewloom.operators.routing import Provider, route
from reviewloom.operators.stages import StageLog
from reviewloom.plans.core import query
from reviewloom.sources.packages import Packages
from reviewloom.staging import shared_dir, table
from reviewloom.streaming import merging
from reviewloom.streaming.monitor import Monitor
from reviewloom.streaming.snapshots import Snapshots
from reviewloom.streaming.status import event_stream

_BYTES, _REQUESTS, _SPAN, _ENVELOPE = 262_144, 50, 16, 200


@query("q_positional_ids", "SELECT doc_id, row_number() OVER () - 1 AS position FROM documents")
def positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the files it is read from."""
    return P.numbered(table(spark, sf_dir, "documents")).select("doc_id", "position")


_SHARDS = f"""WITH RECURSIVE r AS (SELECT doc_id, CAST(octet_length(encode(text)) + {_ENVELOPE} AS BIGINT) AS size FROM documents),
f AS (SELECT doc_id, size, row_number() OVER (ORDER BY doc_id) AS n, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r WHERE size <= {_BYTES}),
b AS (SELECT doc_id, size, n, (upto - size) // {_SPAN * _BYTES} + (n - 1) // {_SPAN * _REQUESTS} AS block FROM f),
w(n, doc_id, size, block, bytes, held, shard) AS (SELECT n, doc_id, size, block, size, 1, 0 FROM b WHERE n = 1 UNION ALL
    SELECT b.n, b.doc_id, b.size, b.block, CASE WHEN anew THEN b.size ELSE w.bytes + b.size END, CASE WHEN anew THEN 1 ELSE held + 1 END, shard + CASE WHEN anew THEN 1 ELSE 0 END
    FROM (SELECT w.*, b.block <> w.block OR w.bytes + b.size > {_BYTES} OR held >= {_REQUESTS} AS anew, b.n AS next FROM w JOIN b ON b.n = w.n + 1) w JOIN b ON b.n = w.next),
s AS (SELECT r.doc_id, r.size, shard FROM r LEFT JOIN w ON w.doc_id = r.doc_id)"""


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return P.shards(d, ["doc_id"], F.octet_length("text") + _ENVELOPE, _BYTES, _REQUESTS, _SPAN).drop("text")


@query("q_request_shards", f"{_SHARDS} SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(shard AS BIGINT) AS shard FROM s")
def request_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document's request, in order, within a budget of bytes and one of requests."""
    return _sharded(spark, sf_dir)


@query("q_shard_manifest", f"{_SHARDS} SELECT CAST(shard AS BIGINT) AS shard, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM s WHERE shard IS NOT NULL GROUP BY shard")
def shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shard_manifest(_sharded(spark, sf_dir), "doc_id")


_STATUS = {"view": "validating", "click": "in_progress", "signup": "finalizing", "purchase": "completed", "error": "failed"}


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir)
    status = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in _STATUS.items()])
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("poll_id"), F.col("ts").alias("polled_at"), status.alias("status"), F.when(F.col("value") >= 40, F.concat(F.lit("out-"), "event_id")).alias("output"))


@query("q_monitor_states", f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS poll_id, ts AS polled_at, CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATUS.items())} END AS status, CASE WHEN value >= 40 THEN 'out-' || event_id END AS output FROM events),
s AS (SELECT run_id, count(*) AS n_polls, arg_max(status, (polled_at, poll_id)) AS status, min(polled_at) FILTER (status = 'completed' AND output IS NOT NULL) AS ready_at, arg_min(output, (polled_at, poll_id)) FILTER (status = 'completed' AND output IS NOT NULL) AS output FROM p WHERE run_id IS NOT NULL GROUP BY run_id)
SELECT run_id, n_polls, status, strftime(ready_at, '%Y-%m-%d %H:%M:%S.%f') AS ready_at, output, ready_at IS NOT NULL AS downloaded, ready_at IS NOT NULL AS assembled, ready_at IS NOT NULL AS benchmarked FROM s""")
def monitor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final states and latched steps of runs that the events poll."""
    report = Monitor(spark, f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}").run(_polls(spark, sf_dir))
    return report.drop("polled_at", "poll_id").withColumn("ready_at", F.date_format("ready_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _STATUS.items())


@query("q_progress_snapshot", f"""WITH p AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS poll_id, ts AS polled_at, CASE event_type {_CASES} END AS status, value >= 40 AS named FROM events WHERE user_id IS NOT NULL),
s AS (SELECT run_id, count(*) AS n, arg_max(status, (polled_at, poll_id)) AS status, max(polled_at) AS last, bool_or(status = 'completed' AND named) AS ready FROM p GROUP BY run_id), w AS (SELECT max(last) - INTERVAL 2 DAY AS watermark FROM s)
SELECT status, count(*) AS n_runs, count(*) FILTER (ready) AS n_ready, count(*) FILTER (NOT coalesce(ready, false) AND last <= watermark) AS n_stalled, CAST(sum(n) AS BIGINT) AS n_polls, strftime(max(last), '%Y-%m-%d %H:%M:%S.%f') AS last_polled_at, strftime(any_value(watermark), '%Y-%m-%d %H:%M:%S.%f') AS watermark FROM s, w GROUP BY status""")
def progress_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of runs by status, with those that are ready and those that stall."""
    kept = Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    kept.start(_polls(spark, sf_dir)).awaitTermination()
    return kept.latest().select("status", "n_runs", "n_ready", "n_stalled", "n_polls", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("last_polled_at", "watermark")])


_OF_RUN, _LOST = 7, 101  # shards of a run; of so many events one never comes


@query("q_merged_shards", f"""WITH s AS (SELECT CAST(event_id // {_OF_RUN} AS VARCHAR) AS run_id, event_id % {_OF_RUN} AS shard, CAST(floor(value) AS BIGINT) AS n_rows, ts FROM events WHERE event_id % {_LOST} <> 0),
r AS (SELECT run_id, count(*) AS n, min(ts) AS began FROM s GROUP BY run_id), m AS (SELECT max(ts) AS latest FROM s)
SELECT run_id, shard, n_rows, CASE WHEN n = {_OF_RUN} THEN CAST(coalesce(sum(n_rows) OVER (PARTITION BY run_id ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS first_row, CASE WHEN n = {_OF_RUN} THEN 'merged' ELSE 'timeout' END AS state
FROM s JOIN r USING (run_id), m WHERE n = {_OF_RUN} OR epoch_ms(began) + 2 * 86400000 <= epoch_ms(latest) - 2 * 86400000""")
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge plans of runs of seven shards each, some of which never come, in order; runs that waited two days time out."""
    e = event_stream(spark, sf_dir).where(F.col("event_id") % _LOST != 0)
    run = F.expr(f"event_id div {_OF_RUN}").cast("string")
    shards = e.select(run.alias("run_id"), (F.col("event_id") % _OF_RUN).alias("shard"), F.lit(_OF_RUN).cast("long").alias("n_shards"), F.concat(F.lit("shard-"), "event_id").alias("path"), F.floor("value").alias("n_rows"), F.col("ts").alias("at"))
    return merging.Merges(spark, f"{shared_dir(spark)}/merge-{uuid.uuid4().hex}").run(shards).drop("path")


@query("q_stage_log", """WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\x09-\\x0D]+')) AS word FROM documents), t AS (SELECT doc_id, word FROM w WHERE word <> ''), c AS (SELECT word, count(*) AS n FROM t GROUP BY word)
SELECT CAST(1 AS INTEGER) AS place, 'tokens' AS stage, 'done' AS state, (SELECT count(*) FROM t) AS rows, (SELECT CAST(sum(length(word)) AS BIGINT) FROM t) AS measure UNION ALL
SELECT 2, 'counts', 'done', (SELECT count(*) FROM c), (SELECT max(n) FROM c) UNION ALL SELECT 3, 'repeated', 'done', (SELECT count(*) FROM c WHERE n > 1), (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE n > 1)""")
def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of three stages from texts to their repeated words, measured as they run."""
    log = StageLog(spark, f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = log.run("tokens", lambda: d.select("doc_id", F.explode(F.split("text", r"[ \x09-\x0D]+")).alias("word")).where("word <> ''"), {"measure": F.sum(F.char_length("word"))})
    counts = log.run("counts", lambda: tokens.groupBy("word").agg(F.count("*").alias("n")), {"measure": F.max("n")})
    log.run("repeated", lambda: counts.where("n > 1"), {"measure": F.sum("n")})
    return log.status().select("place", "stage", "state", *[F.col("metrics")[c].cast("long").alias(c) for c in ("rows", "measure")])


_NEAR, _FAR = 400, 1200  # the longest prompts, in code points, that the two providers take


def _limited(most: int):  # type: ignore[no-untyped-def]
    def make():  # type: ignore[no-untyped-def]
        def reply(prompt: str) -> str:
            if len(prompt) > most:
                raise ValueError(f"more than {most} characters")
            return f"{len(prompt)} of {most}"

        return reply

    return make


@query("q_routed_requests", f"""WITH d AS (SELECT doc_id, length(text) AS n, CASE WHEN lang = 'en' THEN 'near' ELSE 'far' END AS first FROM documents),
r AS (SELECT doc_id, n, first, CASE WHEN n IS NULL THEN NULL WHEN first = 'near' AND n <= {_NEAR} THEN 'near' WHEN n <= {_FAR} THEN 'far' END AS provider FROM d)
SELECT doc_id, provider, CASE provider WHEN 'near' THEN n || ' of {_NEAR}' WHEN 'far' THEN n || ' of {_FAR}' END AS reply, CAST(CASE WHEN n IS NULL THEN 0 WHEN provider = first THEN 1 ELSE 2 END AS BIGINT) AS calls,
CASE WHEN n IS NULL THEN 'no prompt' WHEN provider IS NULL THEN CASE first WHEN 'near' THEN 'far: ValueError: more than {_FAR} characters' ELSE 'near: ValueError: more than {_NEAR} characters' END END AS error FROM r""")
def routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as prompts to two providers that take prompts of different lengths: by language first, then to the other."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), F.when(F.col("lang") == "en", "near").otherwise("far").alias("to"))
    providers = [Provider("near", _limited(_NEAR), 1e6, 1000, tries=1), Provider("far", _limited(_FAR), 1e6, 1000, tries=1)]
    return route(d, providers, "doc_id", "to").withColumnRenamed("text", "reply")


@query("q_prompt_package", "SELECT lang || '/' || doc_id AS name, sha256('Which aspects does this text speak of?' || chr(10) || chr(10) || coalesce(text, '')) AS digest, CAST(octet_length(encode('Which aspects does this text speak of?' || chr(10) || chr(10) || coalesce(text, ''))) AS BIGINT) AS bytes, CAST(length('Which aspects does this text speak of?' || chr(10) || chr(10) || coalesce(text, '')) AS INTEGER) AS chars FROM documents")
def prompt_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package of a prompt for each document, written and read back."""
    d = table(spark, sf_dir, "documents")
    prompt = F.concat(F.lit("Which aspects does this text speak of?\n\n"), F.coalesce("text", F.lit("")))
    kept = Packages(spark, f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}")
    package = kept.write(d.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("name"), prompt.alias("content")))
    return kept.read(package).select("name", F.sha2("content", 256).alias("digest"), "bytes", F.char_length(F.col("content").cast("string")).alias("chars"))
