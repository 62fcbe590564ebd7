"""File loading, benchmark folders, sinks, streaming."""

from __future__ import annotations

import io
import json
import zipfile

from siltstone.operators import attacks, rerank
from siltstone.sources import benchmarks, files
from siltstone.streaming import latency

DATA = "/root/testdata/sf0.001"


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("line one\r\nline two")
    (tmp_path / "latin.log").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "b.md").write_text("---\nt: x\n---\n# Head\n**bold** and [link](http://x)")
    (tmp_path / "sub" / "c.html").write_text("<html><head><title>T</title></head><body><nav>menu</nav><main><p>Hello</p><script>x</script></main></body></html>")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "x.xyz").write_text("no")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "d.docx").write_bytes(data.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r.source.rsplit("/", 1)[1]: r for r in files.LoaderRegistry().load(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "latin.log", "b.md", "c.html", "empty.txt", "d.docx", "bad.docx"}
    assert got["a.txt"].text == "line one\nline two" and got["latin.log"].text == "café"
    assert got["b.md"].text == "Head\nbold and link" and got["c.html"].text == "Hello"
    assert got["d.docx"].tables == [[["A", "B"]]] and "A | B" in got["d.docx"].text
    assert got["empty.txt"].status == "skipped" and got["bad.docx"].status == "failed" and "BadZipFile" in got["bad.docx"].error
    assert got["a.txt"].doc_id and len(got["a.txt"].doc_id) == 16
    s = files.load_summary(files.LoaderRegistry().load(spark, str(tmp_path))).first()
    assert (s.total_files, s.success_count, s.failure_count) == (7, 5, 1)


def test_missing_and_unknown(spark, tmp_path):
    assert files.LoaderRegistry().load(spark, str(tmp_path / "none")).first().status == "failed"
    (tmp_path / "x.xyz").write_text("no")
    assert "No loader" in files.LoaderRegistry().load(spark, str(tmp_path / "x.xyz")).first().error


def test_custom_loader_wins(spark, tmp_path):
    from pyspark.sql import functions as F

    r = files.LoaderRegistry()
    r.register(files.Loader("mine", (".txt",), 999, files._plain(lambda c: F.upper(c))))
    (tmp_path / "a.txt").write_text("abc")
    assert r.load(spark, str(tmp_path)).first().text == "ABC" and ".txt" in r.extensions()


def test_beir(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(x) for x in ({"_id": "d1", "title": "T", "text": "body"}, {"_id": "d2", "title": "", "text": "other"})))
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q1", "text": "body"}))
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\n")
    c, q, r = benchmarks.read_beir(spark, str(tmp_path))
    assert {x.doc_id: x.text for x in c.collect()} == {"d1": "body T", "d2": "other"}
    assert q.count() == 1 and [(x.doc_id, x.grade) for x in r.collect()] == [("d1", 1.0)]


def test_chunk_table_overwrites_one_corpus(spark, tmp_path):
    rows = lambda c, n: spark.createDataFrame([(c, i, i, "t") for i in range(n)], "corpus_id string, doc_id long, chunk_index int, text string")
    path = str(tmp_path / "chunks")
    benchmarks.write_chunks(rows("a", 3).union(rows("b", 2)), path)
    benchmarks.write_chunks(rows("a", 1), path)
    assert benchmarks.read_chunks(spark, path, "a").count() == 1 and benchmarks.read_chunks(spark, path, "b").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.write.parquet(src)
    stream = latency.run_available(spark, src, events.schema, out, str(tmp_path / "cp"), watermark="0 seconds")
    key = lambda df: {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in df.collect()}
    batch, got = key(latency.windowed(events, watermark=None)), key(stream)
    last = max(k[0] for k in batch)
    assert got == {k: v for k, v in batch.items() if k[0] < last}  # the window that is still open isn't out


def test_typos_are_seeded(spark):
    q = spark.createDataFrame([(1, "cardiac arrest symptoms"), (2, ""), (3, None)], "query_id long, text string")
    from pyspark.sql import functions as F

    got = [r.t for r in q.select(attacks.typos(F.col("text")).alias("t")).collect()]
    assert got == [attacks.misspell("cardiac arrest symptoms"), "", None] and got[0] != "cardiac arrest symptoms"


def test_mmr_prefers_difference(spark):
    rows = [(1, 10, "a b c", 1.0, 1), (1, 11, "a b c", 0.99, 2), (1, 12, "x y z", 0.9, 3)]
    c = spark.createDataFrame(rows, "query_id long, doc_id long, text string, score double, rank int")
    assert [r.doc_id for r in rerank.mmr(c, 3).orderBy("rank").collect()] == [10, 12, 11]


def test_typos_follow_their_definition(spark):
    from pyspark.sql import functions as F

    from siltstone.operators import attacks

    texts = ["Compare revenue, growth and é😀 risk!\nlines", "a", "aaaa bbbb cccc dddd " * 20]
    q = spark.createDataFrame([(t,) for t in texts], "text string")
    for rate in (0.15, 1.0, 0.0):
        got = [r.t for r in q.select(attacks.typos(F.col("text"), rate).alias("t")).collect()]
        assert got == [attacks.misspell(t, rate) for t in texts]
    assert got == texts
    some = q.select(attacks.synonyms(F.lit("big revenue"), 0.5, F.col("text")).alias("t")).distinct().collect()
    assert {r.t for r in some} <= {"big revenue", "substantial revenue", "big income", "substantial income"}
