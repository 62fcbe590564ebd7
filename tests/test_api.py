"""A corpus from a folder to answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone import api
from siltstone.operators import embed
from siltstone.operators.chunkers import ChunkConfig
from siltstone.operators.registry import IndexRegistry

SMALL = ChunkConfig(chunk_size=64, chunk_overlap=8, min_chunk_size=3)


def folder(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i, word in enumerate(("heart", "market", "court")):
        (src / f"{word}.txt").write_text(f"The {word} report number {i}. It treats the {word} alone and nothing else. " * 6)
    return str(src)


def test_lifecycle(spark, tmp_path):
    w = api.Workspace(spark, str(tmp_path / "ws"))
    src = folder(tmp_path)
    r = w.ingest("first_one", src, config=SMALL)
    assert r["status"] == "ready" and r["documents"] == 3 and r["chunks"] > 3 and not r["skipped"]
    assert w.ingest("first_one", src, config=SMALL)["skipped"] and not w.ingest("first_one", src, config=SMALL, force=True)["skipped"]
    assert w.chunks("first_one").count() == r["chunks"]
    assert w.ingest("empty_one", str(tmp_path / "none"))["status"] == "failed"
    assert [x.corpus_id for x in w.list(status="READY").collect()] == ["first_one"] and w.list().count() == 2
    with pytest.raises(ValueError):
        w.ingest("no", src)
    with pytest.raises(LookupError):
        w.delete("missing")
    q = spark.createDataFrame([(1, "heart report"), (2, "court alone"), (3, "zebra")], "query_id long, text string")
    for mode in ("sparse", "dense", "hybrid"):
        best = {x.query_id: x.doc_id for x in w.retrieve("first_one", q, mode, 5).where("rank = 1").collect()}
        text = {x.doc_id: x.text for x in w.units("first_one").collect()}
        assert "heart" in text[best[1]] and "court" in text[best[2]], mode
    with pytest.raises(ValueError):
        w.retrieve("first_one", q, "psychic")
    with pytest.raises(ValueError):
        w.retrieve("first_one", q, top_k=101)
    answers = {x.query_id: x for x in w.answer("first_one", q, mode="sparse").collect()}
    assert "heart" in answers[1].answer and answers[3].confidence == 0 and answers[3].answer.startswith("No relevant")
    run = w.retrieve("first_one", q, "sparse", 5)
    qrels = w.units("first_one").where("text like '%heart%'").select(F.lit(1).cast("long").alias("query_id"), "doc_id", F.lit(1.0).alias("grade"))
    each, mean = w.score(run, qrels, q.select("query_id"))
    assert each.where("query_id = 1").first().ndcg_at_1 == 1 and mean.first().n_queries == 3
    report = w.robustness("first_one", q, qrels)
    assert report.count() == 6 and {x.attack for x in report.collect()} >= {"typo_noise", "domain_shift"}
    w.delete("first_one")
    assert w.list().count() == 1


def test_catalogues(spark):
    assert api.modes(spark).count() == 3 and api.metrics(spark).count() == 12 and embed.models(spark).count() == 7


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, "c")], "id long, text string")
    made = embed.embed(texts)
    rows = {r.id: r for r in made.collect()}
    assert rows[1].vec == rows[2].vec and not any(rows[3].vec) and len(rows[4].vec) == 384
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    cache = made.where("id = 4").select("key", F.array(F.lit(9.0)).alias("vec"), F.lit("2024-01-01 12:00:00").cast("timestamp").alias("created_at"))
    again = {r.id: r for r in embed.embed(texts, cache=cache, now=now).collect()}
    assert again[4].vec == [9.0] and again[4].cached and not again[1].cached
    with pytest.raises(ValueError):
        embed.embed(texts, "nope")
    with pytest.raises(ValueError):
        embed.embed(texts, "embed-english-v3.0")


def test_index_registry(spark):
    import random

    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)], "doc_id long, vec array<double>")
    q = v.where("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    r = IndexRegistry()
    r.build("c", v)
    r.build("c", v, "ivf", cells=8)
    exact = {(x.query_id, x.doc_id) for x in r.search("c", q, 5).collect()}
    near = {(x.query_id, x.doc_id) for x in r.search("c", q, 5, "ivf", n_probe=5).collect()}
    assert len(exact) == 100 and len(exact & near) >= 90
    with pytest.raises(ValueError):
        r.build("c", v, "psychic")
    with pytest.raises(KeyError):
        r.search("d", q)


def test_stored_indexes(spark, tmp_path):
    from siltstone.operators import registry

    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "doc_id long, vec array<double>")
    queries = vectors.limit(5).withColumnRenamed("doc_id", "query_id")
    registry.register("few", lambda v, cells: registry.dense.fit_centroids(v, 3))
    one, two = registry.IndexRegistry(), registry.IndexRegistry()
    for backend in ("flat", "few"):
        one.build("c", vectors, backend)
        one.save("c", backend, str(tmp_path / backend))
        two.load(spark, "c", backend, str(tmp_path / backend))
        rows = [sorted((r.query_id, r.doc_id, r.rank) for r in x.search("c", queries, 3, backend).collect()) for x in (one, two)]
        assert rows[0] == rows[1] and len(rows[0]) == 15
    del registry.BACKENDS["few"]


def test_index_follows_the_chunks(spark, tmp_path):
    w, src = api.Workspace(spark, str(tmp_path / "ws")), folder(tmp_path)
    w.ingest("first_one", src, config=SMALL)
    version = w.index("first_one").manifest["version"]
    q = spark.createDataFrame([(1, "zebra stripes"), (2, "heart report")], "query_id long, text string")
    assert {x.query_id for x in w.retrieve("first_one", q, "sparse").collect()} == {2}
    (tmp_path / "src" / "zebra.txt").write_text("The zebra has stripes that no other animal has. " * 8)
    (tmp_path / "src" / "heart.txt").unlink()
    w.ingest("first_one", src, config=SMALL)
    index = w.index("first_one")
    assert index.manifest["version"] == version + 1 and len(index.manifest["segments"]) == 2
    assert index.totals()[0] == w.chunks("first_one").count()
    found = w.retrieve("first_one", q, "sparse").join(w.units("first_one"), "doc_id").collect()
    assert {x.query_id for x in found} == {1, 2} and not any("heart" in x.text for x in found)
    assert w.retrieve("first_one", q, "hybrid", 3).where("query_id = 1 and rank = 1").join(w.units("first_one"), "doc_id").first().text.startswith("The zebra")
    w.delete("first_one")
    assert not w.index("first_one").exists()


def test_sub_queries_are_retrieved(spark, tmp_path):
    w = api.Workspace(spark, str(tmp_path / "ws"))
    w.ingest("first_one", folder(tmp_path), config=SMALL)
    q = spark.createDataFrame([(1, "compare heart versus court"), (2, "heart report")], "query_id long, text string")
    rows = {x.query_id: x for x in w.answer("first_one", q, 4, "sparse").collect()}
    assert rows[1].sub_queries == ["compare heart", "court"] and rows[2].sub_queries == []
    held = " ".join(s.text for s in rows[1].sources)
    assert "heart" in held and "court" in held and rows[2].confidence > 0


def test_fan_out_of_rankings(spark):
    """Two parts' rankings, added up by hand; ties go to the better rank, then the id."""
    from siltstone.operators import fusion

    q = spark.createDataFrame([(1, "a", ["b"]), (2, "c", None)], "query_id long, text string, sub_queries array<string>")
    ranks = {"a": [10, 11, 12], "b": [12, 13], "c": [11]}

    def run(parts):
        rows = [(r.query_id, d, i) for r in parts.collect() for i, d in enumerate(ranks[r.text], 1)]
        return spark.createDataFrame(rows, "query_id long, doc_id long, rank int")

    found = [(x.query_id, x.doc_id, x["rank"], [tuple(p) for p in x.parts], round(x.score, 9)) for x in fusion.fan_out(q, run, 3).orderBy("query_id", "rank").collect()]
    one = lambda *r: round(sum(1 / (60 + x) for x in r), 9)
    assert found == [(1, 12, 1, [(0, 3), (1, 1)], one(3, 1)), (1, 10, 2, [(0, 1)], one(1)), (1, 11, 3, [(0, 2)], one(2)), (2, 11, 1, [(0, 1)], one(1))]
