"""Failures of single documents beside all other rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone import api
from siltstone.operators import chunkers, outcomes
from siltstone.operators.chunkers import ChunkConfig

CONFIG = ChunkConfig(chunk_size=5, chunk_overlap=0, min_chunk_size=1)


def splitters():
    """Made in a function, so they are shipped by value: workers don't know this module."""

    def picky(text, config):
        if "BROKEN" in text:
            raise ValueError("no such words")
        return chunkers.split_recursively(text, config)

    def late(text, config):
        yield text[:3]
        if "BROKEN" in text:
            raise KeyError("half way")

    return picky, late


picky, late = splitters()


def documents(spark):
    rows = [(i, f"# Head\none two three four five {'BROKEN' if i % 10 == 3 else 'six'} seven {i} eight nine ten\n# Last\nend {i}", [[["a", "b"], ["1", str(i)]]]) for i in range(50)]
    return spark.createDataFrame([*rows, (90, None, None), (91, "", [])], "doc_id long, text string, tables array<array<array<string>>>")


@pytest.mark.parametrize("strategy", ["recursive", "document_structure", "table_aware"])
def test_one_broken_document_leaves_the_others(spark, tmp_path, strategy):
    docs = documents(spark)
    config = ChunkConfig(chunk_size=5, chunk_overlap=0, min_chunk_size=1, splitter=picky)
    good, bad = outcomes.store(chunkers.outcomes(docs, strategy, config), str(tmp_path / "out"))
    assert {r.doc_id: (r.error, r.text) for r in bad.collect()} == {i: ("ValueError: no such words", None) for i in range(3, 50, 10)} and bad.count() == 5
    wanted = chunkers.chunk(docs.where("doc_id % 10 <> 3"), strategy, CONFIG)
    key = lambda df: sorted((r.doc_id, r.chunk_index, r.text, r.token_count, r.strategy) for r in df.collect())
    assert key(good) == key(wanted) and good.columns == wanted.columns


def test_without_the_channel_an_exception_ends_the_job(spark):
    with pytest.raises(Exception, match="no such words"):
        chunkers.chunk(documents(spark), "recursive", ChunkConfig(splitter=picky, min_chunk_size=1)).count()


def test_pieces_before_the_exception_are_not_kept(spark, tmp_path):
    chunkers.register("late", chunkers.per_document("late", late))
    try:
        made = chunkers.outcomes(documents(spark), "late", min_chunk_size=1)
        assert sorted(r.doc_id for r in made.where("error is not null").collect()) == [3, 13, 23, 33, 43]
        assert made.where("error is null and doc_id % 10 = 3").count() == 0 and made.where("error is null").count() == 45
        assert {r.strategy for r in made.collect()} == {"late"}
    finally:
        del chunkers.STRATEGIES["late"]


def test_expressions_have_an_empty_channel_and_empty_frames_both(spark, tmp_path):
    made = chunkers.outcomes(documents(spark), "fixed", CONFIG)
    assert made.where("error is not null").count() == 0 and made.count() == chunkers.chunk(documents(spark), "fixed", CONFIG).count()
    good, bad = outcomes.store(made.limit(0), str(tmp_path / "none"))
    assert good.count() == bad.count() == 0 and "error" not in good.columns


def test_workspace_keeps_failures_and_the_rest(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(6):
        (src / f"f{i}.txt").write_text(f"{'BROKEN' if i == 2 else 'fine'} words of file number {i} " * 30)
    (src / "bad.docx").write_bytes(b"no archive")
    w = api.Workspace(spark, str(tmp_path / "ws"))
    r = w.ingest("picky_one", str(src), strategy="recursive", config=ChunkConfig(chunk_size=64, chunk_overlap=0, min_chunk_size=3, splitter=picky))
    assert r["status"] == "ready" and r["documents"] == 6 and [(s.rsplit("/", 1)[1], e.split(":")[0]) for s, e in r["failures"]] == [("bad.docx", "BadZipFile"), ("f2.txt", "Chunking failed")]
    assert {(x.source.rsplit("/", 1)[1], x.step) for x in w.failures("picky_one").collect()} == {("bad.docx", "load"), ("f2.txt", "chunk")}
    assert w.chunks("picky_one").select("doc_id").distinct().count() == 5 == len({x.doc_id for x in w.chunks("picky_one").where(F.col("text").contains("fine")).collect()})
    again = w.ingest("picky_one", str(src), strategy="recursive", config=ChunkConfig(chunk_size=64, chunk_overlap=0, min_chunk_size=3), force=True)
    assert [s.rsplit("/", 1)[1] for s, _ in again["failures"]] == ["bad.docx"] and w.chunks("picky_one").select("doc_id").distinct().count() == 6
    assert not (tmp_path / "ws" / "staging" / "picky_one").exists()
    w.delete("picky_one")
    assert w.failures("picky_one").count() == 0
