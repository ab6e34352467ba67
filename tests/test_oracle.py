"""Every query outside the training-data subpackage against its SQL on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import same  # noqa: E402

from reviewloom.plans import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_sql(spark, sf, name):
    assert same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], sf) > 0


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 60
    assert set(e.oracle_sql()) <= set(e.queries())
