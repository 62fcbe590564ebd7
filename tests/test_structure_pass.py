"""Sections are found once: small and long ones come from one pass over the documents."""

from __future__ import annotations

from siltstone.operators import chunkers


def test_one_scan(spark, tmp_path):
    texts = [(1, "intro\u00a0\n# One\nshort body \n# Two\n" + "word " * 60 + "\n\n" + "more " * 30), (2, None), (3, "# Only"), (4, " \n# A\n  x  ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    out = chunkers.document_structure(spark.read.parquet(str(tmp_path / "d")), chunkers.ChunkConfig(chunk_size=40, chunk_overlap=0, min_chunk_size=1))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {(r.doc_id, r.chunk_index): (r.heading, r.text) for r in out.collect()}
    assert got[1, 0] == ("Introduction", "Introduction\nintro\u00a0") and got[1, 1] == ("# One", "# One\nshort body") and got[4, 0] == ("# A", "# A\nx")
    long = [t for (d, i), (h, t) in got.items() if h == "# Two"]
    assert len(long) > 1 and " ".join(long).split() == ["word"] * 60 + ["more"] * 30 and not any(d in (2, 3) for d, _ in got)
