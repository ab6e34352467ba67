"""Queries against their SQL on rows that the tables at hand lack."""

from __future__ import annotations

import pytest
from oracle import connect, same

from reviewloom.plans import registry


def test_means_are_summed_in_the_order_of_aspects(spark, tmp_path):
    """Means whose last bit depends on the order of the sum rank alike however many reviews a task has.

    Not held against the SQL, whose own sums change with DuckDB's threads from 40,000 reviews on.
    """
    n = 200_000
    spark.range(0, n, 1, 1).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    score = {}
    for r in range(n):
        probs = [(35000 + 65 * ((r * 31 + i * 17) % 1000)) / 100000.0 for i in range(20) if (r * 7 + i * 3) % 20 < 1 + r % 3]
        total = 0.0
        for p in probs:  # not sum(), which compensates
            total += p
        score[r] = total / len(probs)
    want = {r: k for k, r in enumerate(sorted(score, key=lambda r: (-score[r], r)), 1)}
    got = registry.QUERIES["q_faithfulness_quarters"](spark, str(tmp_path)).select("review_id", "rank").toPandas()
    assert dict(zip(got["review_id"], got["rank"])) == want


def test_ranks_are_those_of_the_sql_on_one_thread(spark, tmp_path):
    """On four threads and more the SQL's own ranks change from run to run at this size."""
    spark.range(0, 260_000, 1, 1).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source").write.parquet(str(tmp_path / "d"))
    next(p for p in (tmp_path / "d").iterdir() if p.suffix == ".parquet").rename(tmp_path / "documents.parquet")
    name, con = "q_faithfulness_quarters", connect(str(tmp_path))
    con.execute("SET threads = 1")
    got, want = (df.sort_values("review_id").reset_index(drop=True) for df in (registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()))
    assert got.eq(want[list(got.columns)]).all(axis=None) and len(got) == 260_000


@pytest.mark.parametrize("title", ["The.", "an", "e", "1", "q", "Q x", "xx", "q" * 9, "", "...", None])
def test_status_of_references_with_short_titles(spark, tmp_path, title):
    html = "NULL" if title is None else f"'<title>{title}</title>'"
    pages = spark.range(10).selectExpr("id AS page_id", "if(id < 5, 'http://a.b/c', NULL) AS url", f"CAST({html} AS string) AS html")
    pages.coalesce(1).write.parquet(str(tmp_path / "d"))
    next(p for p in (tmp_path / "d").iterdir() if p.suffix == ".parquet").rename(tmp_path / "pages.parquet")
    name = "q_reference_status"
    assert same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], str(tmp_path)) == 10
