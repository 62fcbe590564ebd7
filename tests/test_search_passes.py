"""What a search moves: sealed blocks, candidates' texts only, each arm once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from siltstone.operators import postings
from siltstone.operators.bm25 import Bm25
from siltstone.plans import corpus_queries, retrieval_queries

DATA = "/root/testdata/sf0.001"


def blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.schema([(c, postings.arrow_type(kind)) for c, kind in (x.split() for x in postings.BLOCKS.split(", "))])
    return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows], schema=kinds)


def test_sealed_blocks_come_back_by_batch_in_order_of_terms():
    some = blocks([(1, 0, "b", 2, 3, [1, 2], [1, 2], [3, 4]), (1, 0, "a", 1, 3, [1], [1], [3]), (1, 5, "a", 1, 9, [7], [1], [9])])
    more = blocks([(1, 0, "", 0, 0, [2], [], []), (2, 0, "a", 4, 4, [8], [4], [4])])
    sealed = list(postings.seal(iter([some, more, some.slice(0, 0)])))
    assert [b.column(1).to_pylist() for b in sealed] == [[0, 5], [0, 0], []]
    rows = pa.Table.from_batches(sealed).sort_by([("segment", "ascending"), ("batch", "ascending")])
    back = list(postings.unseal(iter(rows.to_batches(max_chunksize=1))))
    assert [b.column(2).to_pylist() for b in back] == [["", "a", "b"], ["a"], ["a"]]
    assert sorted(map(str, pa.Table.from_batches(back).to_pylist())) == sorted(map(str, pa.Table.from_batches([some, more]).to_pylist()))


def test_common_and_rare_blocks_give_a_documents_sum_in_one_order():
    """A term's block is added as a row or by places, as its batch has it; copies of a document keep equal sums, and weights below zero find too."""
    terms = [f"t{i}" for i in range(9)]
    w = np.random.default_rng(3).random(27) * 7
    weights = pa.table({"query_id": [str(q) for q in range(3) for _ in terms], "term": terms * 3, "w": w})
    common = [(1, 0, t, 3, 11, [*range(12)], [3] * 12, [11] * 12) for t in terms]
    rare = [(1, 1, t, 3, 11, [100] if i % 2 else [100, *range(101 + 40 * i, 140 + 40 * i)], [3] * (1 if i % 2 else 40), [11] * (1 if i % 2 else 40)) for i, t in enumerate(terms)]
    for sign in (1, -1):
        scorer = postings.Scorer(weights.set_column(2, "w", pa.array(sign * w)), 13, Bm25(), 10.0, True)
        scorer.add(blocks(common + rare))
        found = scorer.results().to_pylist()
        assert {r["query_id"] for r in found} == {"0", "1", "2"}
        for q in range(3):
            mine = {r["doc_id"]: r["score"] for r in found if r["query_id"] == str(q)}
            total = 0.0
            for i in range(9):
                total += sign * w[9 * q + i] * scorer.part(np.float64(3), 11)
            assert len(mine) == 13
            if sign > 0:
                assert set(mine.values()) == {total} and sorted(mine) == [*range(12), 100]


def test_texts_of_candidates_alone_are_moved(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as if documents were many
    try:
        plan = retrieval_queries.candidates(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(doc_id" not in plan


def test_each_arm_is_searched_once(spark, monkeypatch):
    calls, search, near = [], postings.PostingIndex.topk, corpus_queries.hashed_arm
    monkeypatch.setattr(postings.PostingIndex, "topk", lambda self, q, k=10, *a, **b: calls.append(("sparse", k)) or search(self, q, k, *a, **b))
    monkeypatch.setattr(corpus_queries, "hashed_arm", lambda s, d, q, k: calls.append(("dense", k)) or near(s, d, q, k))
    rows = {r["mode"]: r.n_results for r in corpus_queries.retrieval_modes(spark, DATA).collect()}
    assert calls == [("sparse", 20), ("dense", 20)] and set(rows) == {"sparse", "dense", "hybrid"}
