"""The driver's entry points."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"query_id", "doc_id", "score", "rank"}


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and "hybrid_rrf" in q
