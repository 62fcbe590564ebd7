"""Stored rows of the index hold many blocks each, its vectors come from the terms that are counted anyway."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import bm25, dense, postings

TEXTS = {1: "A\tb\fc\r\nA  İstanbul ΣΑΣ", 2: "", 3: None, 4: " \t\n", 5: "b\x0bb b c zz", 6: " x A a"} | {10 + i: " ".join(f"w{j}" for j in range(i, i + 40)) for i in range(200)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(2)


def test_rows_hold_many_blocks_and_texts_are_cut_once(spark, tmp_path, docs):
    def embed(texts):
        raise AssertionError("texts are cut again")

    embed.buckets, embed.of_counts = dense.hash_buckets, dense.of_counts
    index = postings.PostingIndex(spark, str(tmp_path / "index"), embed).build(docs)
    assert {tuple(r) for r in index.frequencies().collect()} == {tuple(r) for r in bm25.document_frequencies(docs).collect()}
    assert index._read("packed").count() * 5 < index._read("postings").count()
    assert {r.doc_id: r.dl for r in index.documents().collect()} == {r.doc_id: None if r.dl == -1 else r.dl for r in docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("dl")).collect()}
    assert {r.doc_id: r.vec for r in index.vectors().collect()} == {r.doc_id: r.vec for r in dense.hashed_vectors(docs).collect()}
    q = spark.createDataFrame([(1, "a b w20 w21 w22 zz"), (2, "İstanbul ΣΑΣ w5"), (3, "none of these")], "query_id long, text string")
    top = lambda found: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in found.collect())
    assert top(index.topk(q, 50)) == top(bm25.topk(docs, q, 50))


def test_long_rows_are_parted_between_terms(spark, tmp_path, docs, monkeypatch):
    monkeypatch.setattr(postings, "PACK", 16)
    monkeypatch.setattr(postings, "SHARES", 50)
    index = postings.PostingIndex(spark, str(tmp_path / "index")).build(docs)
    rows = index._read("packed").collect()
    assert all(sum(r.ns) == len(r.docs) == len(r.tfs) == len(r.dls) and list(r.terms) == sorted(r.terms) for r in rows)
    q = spark.createDataFrame([(i, f"w{i} w{i + 3} w{i + 9} a") for i in range(60)], "query_id long, text string")
    top = lambda found: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in found.collect())
    assert top(index.topk(q, 7)) == top(bm25.topk(docs, q, 7))
