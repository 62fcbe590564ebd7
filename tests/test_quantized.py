"""Compressed cells against exact search, on clustered vectors made of the given ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import dense, quantized
from siltstone.plans import retrieval_queries as R


@pytest.fixture(scope="module")
def clustered(spark):
    rows = R.clustered(spark, "/root/testdata/sf0.1").collect()
    return spark.createDataFrame(rows, "doc_id long, vec array<double>").repartition(4).cache()


def found(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def test_recall_and_share_read(spark, clustered):
    q = clustered.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    book = quantized.fit(clustered, 32)
    coded = quantized.encode(clustered, book).cache()
    probes = quantized.calibrated(clustered, book)
    near = quantized.search(clustered, coded, q, book, 10, probes, exclude_self=True)
    exact = found(dense.exact_topk(clustered, q, 10, exclude_self=True))
    assert len(exact & found(near)) >= 0.9 * len(exact)
    n, held = clustered.count(), {r.cell: r["count"] for r in coded.groupBy("cell").count().collect()}
    read = sum(held.get(r.cell, 0) for r in quantized.probed(q, book, probes).collect()) / q.count()
    assert read < n / 3, (probes, read, n)
    scores = {(r.query_id, r.doc_id): r.score for r in near.collect()}
    true = {(r.query_id, r.doc_id): r.score for r in dense.exact_topk(clustered, q, 10, exclude_self=True).collect()}
    assert all(abs(scores[p] - true[p]) < 1e-9 for p in scores.keys() & true.keys())  # of the vectors themselves


def test_hot_cells_are_sliced(spark, clustered):
    """A cell that holds most vectors is searched in slices, with the same rows."""
    base = clustered.union(clustered.where("doc_id % 7 = 0").select((F.col("doc_id") + 100_000).alias("doc_id"), "vec"))
    q = clustered.where("doc_id % 200 = 0").withColumnRenamed("doc_id", "query_id")
    book = quantized.fit(clustered, 3)
    whole, cut = quantized.encode(base, book), quantized.encode(base, book, slice_rows=200)
    assert cut.agg(F.max("slice")).first()[0] > 2
    assert cut.groupBy("cell", "slice").count().agg(F.max("count")).first()[0] < 320
    rows = lambda c: [(r.query_id, r["rank"], r.doc_id) for r in quantized.search(base, c, q, book, 5, 3, 2500).orderBy("query_id", "rank").collect()]
    exact = [(r.query_id, r["rank"], r.doc_id) for r in dense.exact_topk(base, q, 5).orderBy("query_id", "rank").collect()]
    assert rows(whole) == rows(cut) == exact  # all cells and all vectors: nothing is approximate


def test_tables_give_distances_of_what_is_stored():
    rng = np.random.default_rng(4)
    x = quantized.unit(rng.standard_normal((300, 10)))
    codes = np.stack([quantized.lloyd(np.pad(x, ((0, 0), (0, 2)))[:, 4 * p : 4 * p + 4], 16, p) for p in range(3)])
    book = quantized.Codebook(np.stack([x[0] * 0, x[1] * 0.5]), codes)
    cell, code = book.encode(x)
    for i in range(20):
        stored = book.centres[cell[i]] + np.concatenate([book.codes[p, code[i, p]] for p in range(3)])[:10]
        padding = np.concatenate([book.codes[p, code[i, p]] for p in range(3)])[10:]
        assert book.tables(x[5:6], cell[i])[0][np.arange(3), code[i]].sum() == pytest.approx(((x[5] - stored) ** 2).sum() + (padding**2).sum())


def test_unusable_vectors_take_no_part(spark):
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(30)] + [(50, None), (51, [None, 1.0, 2.0]), (52, [float("nan")] * 3), (53, [])]
    v = spark.createDataFrame(rows, "doc_id long, vec array<double>")
    book = quantized.fit(v, 4, parts=2, codes=8)
    q = v.withColumnRenamed("doc_id", "query_id")
    got = quantized.search(v, quantized.encode(v, book), q, book, 3, 4, 30)
    assert {r.query_id for r in got.collect()} == set(range(30)) and {r.doc_id for r in got.collect()} <= set(range(30))
