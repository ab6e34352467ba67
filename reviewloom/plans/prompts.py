"""Queries of prompts with examples and of replies evaluated against their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.dims import ASPECTS
from reviewloom.operators import evaluation as V
from reviewloom.operators import fewshot as W
from reviewloom.operators import retrieval as R
from reviewloom.operators.metrics import rounded
from reviewloom.plans.binding import CELLS_SQL, COUNTS_SQL, FACT_SQL, cells, fact, reviews
from reviewloom.plans.core import query
from reviewloom.plans.metrics import _F1, _MACRO, _MICRO, _PER, _R, _SAMPLES
from reviewloom.staging import stage, table

_NAMES = [a for a, _, _ in ASPECTS]
_SEED = 11


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = cells(spark, sf_dir).where("y_true = 1").groupBy("review_id").agg(F.collect_list(F.struct("aspect", F.col("pol_true").alias("sentiment"))).alias("aspects"))
    return stage(reviews(spark, sf_dir).select("review_id", "text").join(labels, "review_id", "left").withColumnRenamed("review_id", "doc_id"), "pool")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("custom_id"), "text")


def _requests(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    made = W.requests(_asked(spark, sf_dir), _pool(spark, sf_dir), _NAMES, variant, _SEED)
    return made.select("custom_id", F.size("examples").cast("long").alias("n_examples"), F.array_join(F.transform("examples", lambda e: e["doc_id"].cast("string")), ",").alias("example_ids"), F.md5("prompt").alias("prompt_md5"))


_POOL = f"""{CELLS_SQL}, labels AS (SELECT review_id, count(*) AS n, string_agg('{{"aspect":"' || aspect || '","sentiment":"' || pol_true || '"}}', ',' ORDER BY aspect) AS reply FROM cells WHERE y_true = 1 GROUP BY 1),
pool AS (SELECT review_id AS doc_id, coalesce(text, '') AS text, coalesce(n, 0) AS n, '{{"aspects":[' || coalesce(reply, '') || ']}}' AS reply FROM reviews LEFT JOIN labels USING (review_id))"""
_BLOCKS = """string_agg('Example ' || i || '\n' || text || '\nReply: ' || reply || '\n\n', '' ORDER BY i)"""


def _head(variant: str) -> str:
    return "'" + f"{W.LABEL}{', '.join(_NAMES)}\n{W.NOTES[variant]}\n\n".replace("'", "''") + "'"


def _drawn_sql(variant: str) -> str:
    k, sized = W.SHOTS[variant], variant == "few-shot-diverse"
    slots = f"SELECT doc_id, n AS slot FROM pool WHERE n IN {W.SIZES} UNION ALL SELECT doc_id, 4 FROM pool" if sized else "SELECT doc_id, 4 AS slot FROM pool"
    return f"""WITH {_POOL}, turns AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY md5('{_SEED}:' || slot || ':' || doc_id), doc_id) AS turn FROM ({slots})),
sized AS (SELECT * FROM turns WHERE slot < 4 AND turn = 1), more AS (SELECT * FROM turns WHERE slot = 4 AND turn <= {k} - (SELECT count(*) FROM sized)),
once AS (SELECT * FROM (SELECT * FROM sized UNION ALL SELECT * FROM more) JOIN pool USING (doc_id) QUALIFY row_number() OVER (PARTITION BY text ORDER BY slot, turn) = 1),
placed AS (SELECT *, row_number() OVER (ORDER BY slot, turn) AS i FROM once), shown AS (SELECT count(*) AS n_examples, string_agg(doc_id, ',' ORDER BY i) AS example_ids, {_BLOCKS} AS blocks FROM placed)
SELECT item_id AS custom_id, n_examples, example_ids, md5({_head(variant)} || blocks || 'Review:\n' || coalesce(benchmark.text, '')) AS prompt_md5 FROM benchmark, shown"""


@query("q_few_shot_requests", _drawn_sql("few-shot"))
def few_shot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir, "few-shot")


@query("q_few_shot_diverse_requests", _drawn_sql("few-shot-diverse"))
def few_shot_diverse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir, "few-shot-diverse")


_SHOTS = W.SHOTS["retrieval-few-shot"]
_OVERLAP = """q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents), h AS (SELECT query_id, doc_id, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY ALL)"""


def _near_sql(k: int) -> str:
    """Hits, and for each query the first k documents with an overlap of 0: no query can need more."""
    return f"""{_OVERLAP}, zero AS (SELECT item_id AS query_id, doc_id, 0 AS overlap FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {k})),
best AS (SELECT query_id, doc_id, max(overlap)::BIGINT AS overlap FROM (SELECT * FROM h UNION ALL SELECT * FROM zero) GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS place FROM best QUALIFY place <= {k})"""


@query("q_retrieval_requests", f"""WITH {_POOL}, {_near_sql(3 * _SHOTS)}, turns AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('{_SEED}:' || query_id || ':' || doc_id), doc_id) AS i FROM near QUALIFY i <= {_SHOTS}),
shown AS (SELECT query_id, count(*) AS n_examples, string_agg(doc_id, ',' ORDER BY i) AS example_ids, {_BLOCKS} AS blocks FROM turns JOIN pool USING (doc_id) GROUP BY 1)
SELECT item_id AS custom_id, n_examples, example_ids, md5({_head("retrieval-few-shot")} || blocks || 'Review:\n' || coalesce(text, '')) AS prompt_md5 FROM benchmark JOIN shown ON query_id = item_id""")
def retrieval_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir, "retrieval-few-shot")


@query("q_token_overlap_all", f"WITH {_near_sql(20)} SELECT query_id, doc_id, overlap, place FROM near")
def token_overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item has its 20 nearest documents, also where fewer share a token with it."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.token_overlap(queries, table(spark, sf_dir, "documents").select("doc_id", "text"), 20, min_overlap=0)


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, results): every approach's predictions as replies; some hold no JSON, some are missing, some replace an empty one."""
    label = lambda flag, polarity: F.collect_list(F.when(F.col(flag) == 1, F.struct("aspect", F.col(polarity).alias("sentiment"))))
    per = fact(spark, sf_dir).groupBy("approach", "review_id").agg(label("y_true", "pol_true").alias("gold"), label("y_pred", "pol_pred").alias("said"))
    per = stage(per.withColumn("custom_id", F.concat_ws("-", "approach", "review_id")), "batch")
    r = F.col("review_id")
    text = F.when(r % 19 == 0, "I can't tell {").otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("said").alias("aspects"))), F.lit("\n```")))
    last = per.where(r % 23 != 0).select("custom_id", F.lit(2).alias("pos"), text.alias("text"))
    first = per.where((r % 23 != 0) & (r % 5 == 0)).select("custom_id", F.lit(1).alias("pos"), F.lit('{"aspects": []}').alias("text"))
    return per.select("custom_id", "approach", "gold"), last.unionByName(first)


_SAID = f"""WITH {FACT_SQL.replace("fact AS (", "every AS (")}, fact AS (SELECT * REPLACE (CASE WHEN review_id % 19 = 0 OR review_id % 23 = 0 THEN 0 ELSE y_pred END AS y_pred) FROM every), {_PER}"""


@query("q_reply_evaluation", f"""{_SAID}, s AS (SELECT approach, {_MICRO}, {_MACRO} FROM per GROUP BY approach), r AS (SELECT approach, review_id, {COUNTS_SQL} FROM fact GROUP BY ALL), m AS ({_SAMPLES}),
e AS (SELECT approach, round(avg((2 * sent_pred - sent_true) ** 2) FILTER (y_true = 1 AND y_pred = 1), 9) AS sentiment_mse, count(DISTINCT review_id) AS n_examples, round(avg((review_id % 19 <> 0 AND review_id % 23 <> 0)::INT), 9) AS parse_success_rate FROM fact GROUP BY 1)
SELECT s.* EXCLUDE (tn), round({_R('tp', 'tp + fp')}, 9) AS micro_precision, round({_R('tp', 'tp + fn')}, 9) AS micro_recall, round({_F1}, 9) AS micro_f1, m.* EXCLUDE (approach, hamming_loss), e.* EXCLUDE (approach) FROM s JOIN m USING (approach) JOIN e USING (approach)""")
def reply_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.evaluate(*_batch(spark, sf_dir), _NAMES)[1])


@query("q_reply_evaluation_per_aspect", f"{_SAID} SELECT approach, aspect, tp, tn, fp, fn, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy", "mcc")) + " FROM per")
def reply_evaluation_per_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.evaluate(*_batch(spark, sf_dir), _NAMES)[2])
