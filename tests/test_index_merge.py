"""The registered upkeep goes its whole way: other texts first, two change sets, a merge; a merged index is one built anew."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import bm25, dense, postings
from siltstone.plans import retrieval_queries as R

DATA = "/root/testdata/sf0.001"


def held(index):
    """All postings and documents of an index, and the sizes of its batches."""
    each = index._read("postings").select("term", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).select("term", "p.docs", "p.tfs", "p.dls")
    sizes = [len(r.docs) for r in index._blocks(pa.array([postings.ALL])).collect()]
    docs = {r.doc_id: (r.dl, r.digest, r.v and tuple(r.v)) for r in index.documents().collect()}
    return sorted(map(tuple, each.collect())), docs, sorted(map(tuple, index.frequencies().collect())), sizes


def top(found):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in found.collect())


def upkeep(spark, monkeypatch, sf_dir):
    """The query's rows, the index that it leaves, its first documents and the versions that each step left."""
    seen, steps = {}, []

    class Seen(postings.PostingIndex):
        def build(self, docs):
            seen.update(index=self, first=docs)
            return super().build(docs)

        def _publish(self, manifest):
            super()._publish(manifest)
            steps.append(manifest["segments"])

    monkeypatch.setattr(R, "PostingIndex", Seen)
    return top(R.bm25_after_upkeep(spark, sf_dir)), seen["index"], seen["first"], steps


def test_the_query_changes_every_document_and_merges(spark, tmp_path, monkeypatch):
    docs, q = R.corpus(spark, DATA), R.questions(spark, DATA)
    found, index, first, steps = upkeep(spark, monkeypatch, DATA)
    assert steps == [[1], [1, 2], [1, 2, 3], [4]]  # a build, two change sets, a merge
    assert first.count() == docs.count() and first.withColumnRenamed("text", "other").join(docs, "doc_id").where(F.col("other").eqNullSafe(F.col("text"))).count() == 0
    assert found == top(bm25.topk(docs, q, R.K))
    assert held(index)[:3] == held(postings.PostingIndex(spark, str(tmp_path / "anew")).build(docs))[:3]


@pytest.mark.parametrize("texts", [{}, {-3: "a b", 2: "a", -4: None, 3: "b b", 0: "", 5: "a", -1: "c", 7: "aba"}])
def test_the_query_on_odd_tables(spark, tmp_path, monkeypatch, texts):
    """None at all; ids on both sides of zero, null and empty texts and such as are the same backwards."""
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b"), (2, "c"), (3, "none")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found, index, _, steps = upkeep(spark, monkeypatch, str(tmp_path))
    assert len(steps[-1]) == 1 and found == top(bm25.topk(docs, R.questions(spark, str(tmp_path)), R.K))
    assert held(index)[1].keys() == texts.keys()


def test_a_merged_index_is_one_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 1 + i % 30) % 90) for i in range(400)} | {500: None, 501: "", 502: "w1 w1 İΣ"}
    frame = lambda x: spark.createDataFrame(list(x.items()), "doc_id long, text string")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    index = postings.PostingIndex(spark, str(tmp_path / "index"), dense.hashed_vectors).build(frame(texts))
    for step in range(2):  # some are changed again and again, some leave and come back
        changed = {i: f"w{step} w{i % 7} new" for i in range(step, 300, 3 + step)} | {500: "back", 600 + step: "w2"}
        left = [*range(300 + step, 400, 2), 501]
        index.apply(frame(changed), ids(left))
        texts = {i: t for i, t in texts.items() if i not in left} | changed
    before = held(index)
    index.compact()
    now, anew = held(index), held(postings.PostingIndex(spark, str(tmp_path / "anew"), dense.hashed_vectors).build(frame(texts)))
    assert now[:3] == anew[:3] and before[1] == now[1] and index.totals() == (len(texts), pytest.approx(bm25.corpus_totals(frame(texts)).first().avgdl))
    assert max(now[3]) <= 16 and sum(now[3]) == len(texts) and len(now[3]) < len(before[3])  # small batches are put together
    asked = spark.createDataFrame([(1, "w1 new w30"), (2, "İΣ back w2 w2"), (3, "none")], "query_id long, text string")
    assert top(index.topk(asked, 20)) == top(bm25.topk(frame(texts), asked, 20))


def test_parts_may_come_in_any_order(spark, tmp_path, monkeypatch):
    """A repeated task must make the batches that the first one made."""
    monkeypatch.setattr(postings, "BLOCK", 16)
    index = postings.PostingIndex(spark, str(tmp_path / "index")).build(spark.createDataFrame([(i, f"w{i % 5} w{i % 11} w1") for i in range(60)], "doc_id long, text string"))
    index.apply(spark.createDataFrame([(3, "w1 w9")], "doc_id long, text string"), spark.createDataFrame([(4,)], "doc_id long"))
    made = []
    for order in ("asc", "desc"):
        parts = index._parts().coalesce(1).sortWithinPartitions("segment", "batch", getattr(F, order)(F.xxhash64("blocks", "kind")))
        rows = postings.segment_rows(parts, 8, lambda batches: postings.cut_parts(batches, 16)).select("doc_id", "dl", "digest", "batch", "terms", "ns", "docs", "tfs", "dls", "bucket")
        made.append([str(tuple(r)) for r in rows.collect()])
    assert made[0] == made[1] and len(made[0]) > 10
