"""Chunker edge cases and the sequential splitter."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunkers
from siltstone.operators.chunkers import ChunkConfig


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_fixed_windows(spark):
    got = chunkers.fixed(docs(spark, " ".join(map(str, range(25))), "", "a b"), ChunkConfig(chunk_size=10, chunk_overlap=3)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.text.split()[0], r.token_count) for r in got] == [(0, 0, "0", 10), (0, 1, "7", 10), (0, 2, "14", 10), (0, 3, "21", 4), (2, 0, "a", 2)]


def test_overlap_bounds(spark):
    with pytest.raises(ValueError):
        chunkers.fixed(docs(spark, "a"), ChunkConfig(chunk_size=5, chunk_overlap=5))
    assert chunkers.fixed(docs(spark, "a b"), ChunkConfig(chunk_size=5, chunk_overlap=6)).count() == 0


def test_unknown_and_custom_strategy(spark):
    with pytest.raises(ValueError):
        chunkers.chunk(docs(spark, "a"), "nope")
    chunkers.register("whole", lambda d, c: chunkers.shaped(d.selectExpr("doc_id", "0 chunk_index", "text"), "whole"))
    assert chunkers.chunk(docs(spark, "a b c"), "whole", min_chunk_size=1).first().token_count == 3
    del chunkers.STRATEGIES["whole"]


def test_domain_default(spark):
    got = chunkers.chunk(docs(spark, "One two. Three four."), domain="healthcare", min_chunk_size=1)
    assert {r.strategy for r in got.collect()} == {"sentence_window"}


def test_sections(spark):
    text = "intro\n# One\n\n# Two\nbody two\n1. Three\nbody three"
    got = chunkers.section_rows(docs(spark, text)).orderBy("section").collect()
    assert [(r.heading, r.body) for r in got] == [("Introduction", "intro"), ("# Two", "body two"), ("1. Three", "body three")]


def test_nothing_from_empty_documents(spark):
    for name in ("fixed", "recursive", "sentence_window", "document_structure", "propositional"):
        assert chunkers.chunk(docs(spark, "", None), name, min_chunk_size=1).count() == 0, name


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "c.", "d!", "\n", "\n\n", "e?"]), max_size=80))
def test_recursive_keeps_all_words_without_overlap(parts):
    text = " ".join(parts)
    got = chunkers.split_recursively(text, ChunkConfig(chunk_size=7, chunk_overlap=0, min_chunk_size=1))
    letters = lambda t: [c for c in t if c.isalpha()]
    assert letters("".join(got)) == letters(text)
    assert all(len(p.split()) <= 7 for p in got)


def test_overlap_hands_on_last_words():
    got = chunkers.merge_short(["a b c", "d e f"], ChunkConfig(chunk_size=9, chunk_overlap=2, min_chunk_size=1))
    assert got == ["a b c", "b c d e f"]
    assert chunkers.merge_short(["a", "b c"], ChunkConfig(min_chunk_size=2)) == ["a b c"]


@pytest.mark.parametrize("gap", ["\t", " ", "\t\t\x0b"])
def test_recursive_keeps_words_of_any_white_space(spark, gap):
    """No word is lost where the text has none of the separators."""
    words = [f"w{i}" for i in range(1000)]
    docs = spark.createDataFrame([(1, gap.join(words)), (2, " ".join(words[:300]) + "\n\n" + gap.join(words[300:]))], "doc_id long, text string")
    config = chunkers.ChunkConfig(chunk_size=100, chunk_overlap=0, min_chunk_size=1)
    rows = chunkers.recursive(docs, config).orderBy("doc_id", "chunk_index").collect()
    for doc in (1, 2):
        held = [w for r in rows if r.doc_id == doc for w in r.text.split()]
        assert sorted(held) == sorted(words) and all(r.token_count <= 100 for r in rows)


def test_spaces_of_any_width_are_trimmed(spark):
    """Sentences and claims lose space separators at both ends, and nothing else; a vertical tab parts no words."""
    d = docs(spark, "One two. \u00a0Three four.\u3000 Five\x0bsix. \u2003", "\u00a0", None)
    assert [r.s for r in d.select(T.sentences(F.col("text")).alias("s")).collect()] == [["One two.", "Three four.\u3000 Five\x0bsix."], [], None]
    assert [r.n for r in docs(spark, "a\x0bb c").select(T.token_count(F.col("text")).alias("n")).collect()] == [2]
    claims = chunkers.propositional(docs(spark, "\u00a0a b; c d\u3000\n\n\u3000"), ChunkConfig(), short=1).orderBy("chunk_index").collect()
    assert [r.text for r in claims] == ["a b", "c d"]


def test_semantic_chunks_shuffle_nothing(spark):
    """The rows of the query's plan stay where they are, and equal those made from sentences in rows of their own."""
    from siltstone.operators import dense

    d = docs(spark, "The cat sat. The cat sat. Ships sail far away. Ships sail far away now.", "", None, "One. Two. Three.", ". ".join(f"w{i % 7} v{i % 3} u" for i in range(60)))
    config = ChunkConfig(min_chunk_size=2, breakpoint=0.5)
    got = chunkers.semantic_rows(dense.hashed_sentences(d.select("doc_id", T.sentences(F.col("text")).alias("sentences")), dim=16), config)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    s = d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    v = dense.hashed_vectors(s.select(F.struct("doc_id", "pos", "sentence").alias("k"), "sentence"), dim=16, doc_id="k", text="sentence").select("doc_id.*", "vec")
    rows = lambda df: sorted((r.doc_id, r.chunk_index, r.text) for r in df.collect())
    assert rows(got) == rows(chunkers.semantic(v, config)) and len(rows(got)) > 5


def test_nfc_of_mixed_batches(spark):
    texts = [None, "", "é", "plain", "한"] * 300
    got = docs(spark, *texts).coalesce(1).orderBy("doc_id").select(T.nfc(F.col("text")).alias("t")).collect()
    assert [r.t for r in got] == [None, "", "é", "plain", "한"] * 300
