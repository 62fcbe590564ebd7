"""Recall of the inverted file under its defaults."""

from __future__ import annotations

import pytest

from siltstone.operators.registry import IndexRegistry
from siltstone.plans import retrieval_queries as R


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_default_search_finds_the_neighbours(spark, size):
    folder = f"/root/testdata/{size}"
    vectors, queries = R.vectors(spark, folder), R.probes(spark, folder)
    registry = IndexRegistry()
    registry.build("c", vectors)
    registry.build("c", vectors, "ivf")
    found = lambda **how: {(r.query_id, r.doc_id) for r in registry.search("c", queries, 11, **how).collect() if r.query_id != r.doc_id}
    exact, near = found(), found(backend="ivf")
    assert len(exact) == 10 * queries.count()
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_search_finds_the_neighbours(spark, size):
    folder = f"/root/testdata/{size}"
    exact, near = ({(r.query_id, r.doc_id) for r in q(spark, folder).collect()} for q in (R.dense_topk, R.ivf_topk))
    assert len(exact & near) >= 0.9 * len(exact)
