"""The registered queries of the retrieval and evaluation engine and their SQL counterparts."""

from __future__ import annotations

from . import agent_queries, chunk_queries, corpus_queries, evaluation_queries, observe_queries, retrieval_queries, text_queries  # noqa: F401  (they register)
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    """Query name to function."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return dict(SQL)
