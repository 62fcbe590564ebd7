"""Every registered query of the engine against its SQL counterpart in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from siltstone.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    show = lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA).toPandas()
    wanted = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) > 0
    f, w = found.copy(), wanted.copy()
    for c in f.columns:  # nullable integers come as doubles from one side
        if c in w and pd.api.types.is_float_dtype(f[c]) and pd.api.types.is_integer_dtype(w[c]):
            f[c] = f[c].astype("Int64")
    assert rows(f) == rows(w)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_has_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_injected_inputs_are_not_vacuous(spark):
    for name, column in (("query_type", "query_type"), ("detect_domain", "domain"), ("model_confidence", "model_confidence"), ("loader_routing", "loader"), ("interpret_scores", "ndcg_band"), ("recommendations", "weak")):
        assert catalogue.queries()[name](spark, DATA).select(column).distinct().count() > 2, name
