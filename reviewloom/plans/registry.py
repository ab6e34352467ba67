"""Names of the registered queries, their plans and the SQL to check them by."""

from __future__ import annotations

from reviewloom.plans import agreement, errors, generation, ingest, labels, logs, metrics, models, prompts, reports, samples, transfer, writing  # noqa: F401  (each registers its queries)
from reviewloom.plans.core import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
