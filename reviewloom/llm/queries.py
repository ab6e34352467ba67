"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm.bpe import op7_byte_bpe
from reviewloom.llm.divergence import OP11_SQL, op11_source_divergence
from reviewloom.llm.licenses import op9_license_scan, op9_sql
from reviewloom.llm.lm import op6_lm_scores
from reviewloom.llm.media import op2_media_columns
from reviewloom.llm.merkle import OP8_SQL, op8_document_fingerprints
from reviewloom.llm.mixing import OP5_SQL, op5_source_mixing
from reviewloom.llm.pii import op13_personal_data
from reviewloom.llm.quality import op4_quality_classifier
from reviewloom.llm.runs import op12_periodic_runs
from reviewloom.llm.simhash import op1_simhash_near_dedup
from reviewloom.llm.toxicity import op10_toxicity
from reviewloom.llm.urls import OP3_SQL, op3_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_media_columns,
        op3_url_filters,
        op4_quality_classifier,
        op5_source_mixing,
        op6_lm_scores,
        op7_byte_bpe,
        op8_document_fingerprints,
        op9_license_scan,
        op10_toxicity,
        op11_source_divergence,
        op12_periodic_runs,
        op13_personal_data,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filters": OP3_SQL,
    "op5_source_mixing": OP5_SQL,
    "op8_document_fingerprints": OP8_SQL,
    "op9_license_scan": op9_sql(),
    "op11_source_divergence": OP11_SQL,
}
