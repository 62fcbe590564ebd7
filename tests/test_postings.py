"""The stored index against BM25 over the texts, before and after changes."""

from __future__ import annotations

import random

import pytest

from siltstone.operators import bm25, dense, postings

DATA = "/root/testdata/sf0.001"


def frame(spark, texts: dict[int, str | None]):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def rows(found):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in found.collect())


def made(seed: int, n: int) -> dict[int, str | None]:
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    return {i: rng.choice([None, "", "t0"]) if rng.random() < 0.05 else " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(1, 40))) for i in range(n)}


def same(index, spark, texts, questions):
    """The index gives what the texts give, with and without skipping, and holds their statistics."""
    docs = frame(spark, texts)
    wanted = rows(bm25.topk(docs, questions, 5))
    assert rows(index.topk(questions, 5)) == wanted and rows(index.topk(questions, 5, skip=False)) == wanted
    totals = bm25.corpus_totals(docs).first()
    assert index.totals() == pytest.approx((totals.n_docs, totals.avgdl or 0))
    assert {tuple(r) for r in index.frequencies().collect()} == {tuple(r) for r in bm25.document_frequencies(docs).collect()}
    assert len(wanted) > 0


@pytest.fixture(scope="module")
def questions(spark):
    texts = ["t0 t1", "t5 t40 t40", "t59", "t0 t7 t8 t9 t30 unknown", "nothing here", ""]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_upkeep(spark, tmp_path, questions, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 16)
    texts = made(1, 160)
    index = postings.PostingIndex(spark, str(tmp_path / "index"), dense.hashed_vectors).build(frame(spark, texts))
    same(index, spark, texts, questions)
    # changed, new and missing documents, found by comparison
    other = made(2, 60)
    texts = {i: t for i, t in texts.items() if i % 7} | {i: t for i, t in other.items() if i % 3 == 0} | {500: "t1 t1 t59", 501: None}
    index.sync(frame(spark, texts))
    assert index.manifest["segments"] == [1, 2]
    same(index, spark, texts, questions)
    index.sync(frame(spark, texts))
    assert index.manifest["version"] == 2  # nothing changed
    # given changes: one document again and again, another removed and put back
    texts |= {3: "t59 t59", 501: "t2"}
    index.apply(frame(spark, {3: "t59 t59", 501: "t2"}), frame(spark, {6: None}).select("doc_id"))
    texts.pop(6, None)
    texts |= {6: "t40", 3: "t30"}
    index.apply(frame(spark, {6: "t40", 3: "t30"}), frame(spark, {}).select("doc_id"))
    same(index, spark, texts, questions)
    # another session reads the same version; merging changes nothing
    again = postings.PostingIndex(spark, str(tmp_path / "index"))
    same(again, spark, texts, questions)
    with pytest.raises(ValueError):
        again.sync(frame(spark, texts | {900: "t0"}))  # without vectors for it
    again.compact()
    assert again.manifest["segments"] == [5]
    same(again, spark, texts, questions)
    fresh = {r.doc_id: [round(x, 9) for x in r.vec] for r in dense.hashed_vectors(frame(spark, texts)).collect()}
    assert {r.doc_id: [round(x, 9) for x in r.vec] for r in again.vectors().collect()} == fresh


def test_segments_are_merged(spark, tmp_path, questions, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENTS", 3)
    index, texts = postings.PostingIndex(spark, str(tmp_path / "index")), {}
    for i in range(4):
        texts |= {i: f"t{i} t0 t1", 10 + i: "t1"}
        index.sync(frame(spark, texts))
    assert len(index.manifest["segments"]) < 3
    same(index, spark, texts, questions)


def test_a_commit_that_was_cut_short_is_not_seen(spark, tmp_path, questions, monkeypatch):
    texts = made(4, 30)
    index = postings.PostingIndex(spark, str(tmp_path / "index")).build(frame(spark, texts))

    def fails(manifest):
        raise OSError("lost")

    monkeypatch.setattr(index, "_publish", fails)
    with pytest.raises(OSError):
        index.sync(frame(spark, texts | {900: "t0"}))
    again = postings.PostingIndex(spark, str(tmp_path / "index"))
    same(again, spark, texts, questions)
    again.sync(frame(spark, texts | {900: "t0"}))
    same(again, spark, texts | {900: "t0"}, questions)


def test_empty_index(spark, tmp_path, questions):
    index = postings.PostingIndex(spark, str(tmp_path / "index"))
    assert not index.exists()
    index.build(frame(spark, {}))
    assert index.topk(questions, 5).count() == 0 and index.totals() == (0, 0.0)
    index.sync(frame(spark, {1: "t0 t1"}))
    assert [r.doc_id for r in index.topk(questions, 5).collect()] == [1, 1]
    index.sync(frame(spark, {}))
    assert index.topk(questions, 5).count() == 0


def test_given_documents(spark, tmp_path):
    from siltstone.plans import retrieval_queries as R

    docs, q = R.corpus(spark, DATA), R.questions(spark, DATA)
    index = postings.PostingIndex(spark, str(tmp_path / "index")).build(docs)
    assert rows(index.topk(q, 10)) == rows(bm25.topk(docs, q, 10))


def test_queries_open_no_text_and_skip_blocks(spark, tmp_path, monkeypatch):
    """A rare and a common word: most blocks of the common one can't matter."""
    monkeypatch.setattr(postings, "BLOCK", 8)
    texts = {i: "common " + "filler " * (5 + i % 5) + ("rare rare" if i % 40 == 0 else "other") for i in range(400)} | {1000 + i: f"u{i}" for i in range(900)}
    index = postings.PostingIndex(spark, str(tmp_path / "index")).build(frame(spark, texts).repartition(4))
    q = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    assert rows(index.topk(q, 5)) == rows(bm25.topk(frame(spark, texts), q, 5))
    terms = spark.createDataFrame([(1, "rare", 1), (1, "common", 1)], "query_id long, term string, qtf int")
    config = bm25.Bm25()
    weights = index.weights(terms, config).selectExpr("cast(query_id as string)", "term", "w").toArrow()
    blocks = index._read("postings").where("term in ('rare', 'common')").select("segment", "batch", "term", "max_tf", "min_dl", "docs", "tfs", "dls").orderBy("segment", "batch").toArrow()
    for skip in (True, False):
        scorer = postings.Scorer(weights, 5, config, index.totals()[1], skip)
        for batch in blocks.to_batches():
            scorer.add(batch)
        found = {d for d in scorer.results().column(1).to_pylist()}
        assert found == {r.doc_id for r in index.topk(q, 5).collect()}
        assert scorer.opened < scorer.seen / 2 if skip else scorer.opened == scorer.seen > 40
