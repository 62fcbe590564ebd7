"""An index is made in one pass over the texts, alike whatever order they come in; older forms are still read."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from siltstone.operators import bm25, dense, postings

TEXTS = {i: " ".join(f"w{(i * j) % 37}" for j in range(1, 9 + i % 5)) for i in range(120)} | {200: None, 201: "", 202: "A\tb c\r\nw1 İΣ", 203: "w1 " * 50}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def top(found):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in found.collect())


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 w30"), (2, "İΣ w9 w9"), (3, "none of these")], "query_id long, text string")


def test_rows_do_not_depend_on_the_order_of_arrival(spark, tmp_path, docs, monkeypatch):
    """A repeated task must make the batches that the first one made."""
    monkeypatch.setattr(postings, "BLOCK", 16)
    stored = []
    for name, some in (("a", docs.orderBy("doc_id").coalesce(1)), ("b", docs.orderBy(F.desc("doc_id")).coalesce(1))):
        index = postings.PostingIndex(spark, str(tmp_path / name)).build(some)
        stored.append(sorted(map(tuple, index._read("packed").select("batch", *(F.to_json(c).alias(c) for c in ("terms", "docs", "tfs", "dls"))).collect())))
        assert not os.path.exists(tmp_path / name / "docs") and index.documents().count() == len(TEXTS)
    assert stored[0] == stored[1]


def test_changes_and_merges_without_stored_terms(spark, tmp_path, docs, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    index = postings.PostingIndex(spark, str(tmp_path / "index"), dense.hashed_vectors).build(docs)
    now = TEXTS | {3: "w1 w1", 300: "new w2"}
    gone = [5, 203]
    index.apply(spark.createDataFrame([(3, "w1 w1"), (300, "new w2")], "doc_id long, text string"), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    index.apply(spark.createDataFrame([(3, "w30")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long"))
    now = spark.createDataFrame([(i, t) for i, t in (now | {3: "w30"}).items() if i not in gone], "doc_id long, text string")
    for _ in range(2):
        assert top(index.topk(asked(spark), 20)) == top(bm25.topk(now, asked(spark), 20))
        assert {tuple(r) for r in index.frequencies().collect()} == {tuple(r) for r in bm25.document_frequencies(now).collect()}
        index.compact()


def test_indexes_of_the_form_before_are_read_and_merged(spark, tmp_path, docs):
    index = postings.PostingIndex(spark, str(tmp_path / "new")).build(docs)
    old = tmp_path / "old"
    terms = index._entries(index.documents()).groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    index.documents().join(terms, "doc_id", "left").select("doc_id", "dl", "digest", "terms", "v").write.parquet(f"{old}/docs/segment=1")
    index._read("packed").drop("segment").write.partitionBy("bucket").parquet(f"{old}/packed/segment=1")
    for name in ("terms", "gone", "dead"):
        (old / name).mkdir()
        os.rename(tmp_path / "new" / name / "segment=1", old / name / "segment=1")
    (old / "manifest-00000001.json").write_text(json.dumps(index.manifest | {"form": 2}))
    again = postings.PostingIndex(spark, str(old))
    assert top(again.topk(asked(spark), 20)) == top(bm25.topk(docs, asked(spark), 20)) and again.documents().count() == len(TEXTS)
    again.apply(spark.createDataFrame([(3, "w1 w1")], "doc_id long, text string"), spark.createDataFrame([(5,)], "doc_id long"))
    now = spark.createDataFrame([(i, t) for i, t in (TEXTS | {3: "w1 w1"}).items() if i != 5], "doc_id long, text string")
    assert again.manifest["form"] == postings.FORM and top(again.topk(asked(spark), 20)) == top(bm25.topk(now, asked(spark), 20))
