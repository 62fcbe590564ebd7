"""Hand-computed cases of the metrics, and properties."""

from __future__ import annotations

import math

import pytest

from siltstone.operators import evaluate


def scores(spark, run: list[str], qrels: dict[str, float]) -> dict:
    r = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(run)], "query_id long, doc_id string, rank int")
    q = spark.createDataFrame([(1, d, float(g)) for d, g in qrels.items()], "query_id long, doc_id string, grade double")
    return evaluate.per_query(r, q, spark.createDataFrame([(1,)], "query_id long")).first().asDict()


def test_graded_gain(spark):
    s = scores(spark, ["x", "a", "b"], {"a": 2, "b": 1})
    ideal = 3 + 1 / math.log2(3)
    assert s["ndcg_at_10"] == pytest.approx((3 / math.log2(3) + 1 / 2) / ideal)
    assert s["ndcg_at_1"] == 0 and s["mrr"] == 0.5 and s["map_at_10"] == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_perfect_and_empty(spark):
    s = scores(spark, ["a"], {"a": 1})
    assert s["ndcg_at_10"] == s["mrr"] == s["map_at_10"] == s["hit_rate_at_10"] == 1 and s["precision_at_10"] == pytest.approx(0.1)
    assert set(scores(spark, [], {"a": 1}).values()) == {1, 0.0}
    assert scores(spark, ["a"], {})["recall_at_10"] == 0


def test_zero_grades_count_in_recall_only(spark):
    s = scores(spark, ["a", "b"], {"a": 1, "b": 0})
    assert s["recall_at_10"] == 0.5 and s["precision_at_3"] == pytest.approx(1 / 3)


def test_beyond_the_cut(spark):
    s = scores(spark, [f"x{i}" for i in range(10)] + ["a"], {"a": 1})
    assert s["mrr"] == s["ndcg_at_10"] == s["hit_rate_at_10"] == 0


def test_aggregate(spark):
    none = spark.createDataFrame([], evaluate.per_query(spark.createDataFrame([], "query_id long, doc_id string, rank int"), spark.createDataFrame([], "query_id long, doc_id string, grade double"), spark.createDataFrame([], "query_id long")).schema)
    row = evaluate.aggregate(none).first()
    assert row.n_queries == 0 and row.ndcg_at_10 == 0


def test_plans_push_down(spark):
    """A dense plan has no Cartesian product, and scans read only what they need."""
    from siltstone.plans import retrieval_queries as r

    plan = r.bm25_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "lang" not in plan.split("Physical Plan")[-1]


def test_window_matches_equal_plain_sets(spark, monkeypatch):
    """Texts of any length, repeated windows, nulls; the same whether or not the passages' windows are sent to the tasks."""
    texts = ["a b c d e", "a b c d x", "a b", "", None, "b", "a b c a b c a b c", "x y z a b c d e"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(50, "a b a b")], "doc_id long, text string")

    def cut(text):
        t = (text or "").split()
        return {tuple(t[i : i + 3]) for i in range(len(t) - 2)} if len(t) >= 3 else {tuple(t)} if t else set()

    wanted = {(q, d.doc_id) for q, text in enumerate(texts) for d in docs.collect() if cut(text) and len(cut(text) & cut(d.text)) / len(cut(text)) >= 0.5}
    for block in (evaluate.QUERY_BLOCK, 1):
        monkeypatch.setattr(evaluate, "QUERY_BLOCK", block)
        assert {(r.query_id, r.doc_id) for r in evaluate.window_matches(asked, docs, 3, 0.5).collect()} == wanted
