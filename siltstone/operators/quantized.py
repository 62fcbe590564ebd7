"""Compressed vectors in cells: residuals from a cell's centre as a few bytes, searched by tables, re-ranked exactly.

Vectors are taken at unit length, so the nearest by distance are those of greatest cosine. What a vector differs from
its cell's centre is cut into ``parts``, and each part stands as the number of its nearest code. A query looks into
its nearest cells; there a table of its distances to all codes gives every vector's distance by ``parts`` look-ups, and
only the best few vectors themselves are read. A cell of more than ``slice_rows`` vectors is kept in slices that are
searched apart, so no task meets a hot cell whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from . import dense

#: Parts of a vector, codes of a part, vectors that centres and codes are fitted on at most, of a slice.
PARTS, CODES, SAMPLE, SLICE_ROWS = 8, 256, 20_000, 100_000
#: Rounds of the codes' k-means.
ROUNDS = 12


@dataclass(frozen=True)
class Codebook:
    """Centres (cells x dim) and codes (parts x codes x part of dim)."""

    centres: np.ndarray
    codes: np.ndarray

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Rows as rows x parts x part of dim, filled up with zeros."""
        parts, _, width = self.codes.shape
        return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of unit rows to all centres."""
        return 1 - 2 * x @ self.centres.T + (self.centres**2).sum(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of unit rows."""
        cell = self.cells(x).argmin(1)
        parts = self.cut(x - self.centres[cell])
        return cell, np.stack([nearest(parts[:, p], self.codes[p]) for p in range(len(self.codes))], 1).astype(np.uint8)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances (queries x parts x codes) of the queries' residuals in a cell to all codes."""
        parts = self.cut(q - self.centres[cell])
        return ((parts[:, :, None] - self.codes[None]) ** 2).sum(3)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.EPSILON)


def lloyd(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of k-means of a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def fit(vectors: DataFrame, cells: int = 100, parts: int = PARTS, codes: int = CODES, seed: int = 42) -> Codebook:
    """Centres by Spark's k-means, and codes of the residuals, both from SAMPLE vectors at most (by a hash of the id)."""
    some = usable(vectors).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE)
    x = unit(np.array([r.vec for r in some.collect()], np.float64))  # a bounded sample
    rows = vectors.sparkSession.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "doc_id bigint, vec array<double>")
    fitted = dense.fit_centroids(rows, min(cells, len(x)), seed, SAMPLE)
    centres = np.array([r.centre for r in fitted.orderBy("cell").collect()])
    width = -(-x.shape[1] // parts)
    rest = np.pad(x - centres[nearest(x, centres)], ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)
    return Codebook(centres, np.stack([pad(lloyd(rest[:, p], min(codes, len(x)), seed + p), codes) for p in range(parts)]))


def pad(x: np.ndarray, n: int) -> np.ndarray:
    """Rows repeated up to ``n``; a repeated code is never nearer than the first."""
    return np.concatenate([x, np.repeat(x[:1], n - len(x), 0)])


def usable(vectors: DataFrame) -> DataFrame:
    """(doc_id, vec) of the vectors that have finite components."""
    v = V.doubles(F.col("vec"))
    fine = F.size(v) > 0
    return vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), v.alias("vec")).where(fine & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def encode(vectors: DataFrame, book: Codebook, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(cell, slice, doc_id, codes): compressed vectors; cells of more than ``slice_rows`` are dealt into slices."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                x = unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                cell, codes = shared.value.encode(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["doc_id", "cell", "codes"])

    rows = usable(vectors).mapInArrow(run, "doc_id bigint, cell int, codes binary")
    size = rows.groupBy("cell").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices"))  # a row a cell
    return rows.join(F.broadcast(size), "cell").select("cell", F.pmod(F.xxhash64("doc_id"), "slices").cast("int").alias("slice"), "slices", "doc_id", "codes")


def probed(queries: DataFrame, book: Codebook, n_probe: int) -> DataFrame:
    """(query_id, vec, cell) of the ``n_probe`` nearest cells of each query."""
    shared = queries.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                near = np.argsort(shared.value.cells(unit(x)), axis=1, kind="stable")[:, :n_probe]
                at = np.repeat(np.arange(len(x)), near.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(near.ravel(), pa.int32())], names=["query_id", "vec", "cell"])

    q = usable(queries.withColumnRenamed("query_id", "doc_id"))
    return q.mapInArrow(run, "query_id bigint, vec array<double>, cell int")


def search(vectors: DataFrame, encoded: DataFrame, queries: DataFrame, book: Codebook, k: int = 10, n_probe: int = 8, rerank: int = 100, exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) with exact cosines of the ``rerank`` vectors that look nearest in the probed cells.

    ``encoded`` is what :func:`encode` made of ``vectors``. Equal scores go to the smaller id; vectors and queries
    without finite components take no part.
    """
    blocks = -(-queries.count() // dense.QUERY_BLOCK)
    if blocks > 1:  # a cell's queries meet in one group, so not more than a block of them at once
        out = None
        for b in range(blocks):
            one = _search(vectors, encoded, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), book, k, n_probe, rerank, exclude_self)
            out = one if out is None else out.unionByName(one)
        return out
    return _search(vectors, encoded, queries, book, k, n_probe, rerank, exclude_self)


def _search(vectors: DataFrame, encoded: DataFrame, queries: DataFrame, book: Codebook, k: int, n_probe: int, rerank: int, exclude_self: bool) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qs, near = [], [], []
        if left.num_rows and right.num_rows:
            cell = left.column("cell")[0].as_py()
            codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            docs, q = left.column("doc_id").to_numpy(), right.column("query_id").to_numpy()
            x = unit(np.array(right.column("vec").to_pylist()))
            for i in range(len(q)):
                table = shared.value.tables(x[i : i + 1], cell)[0]
                d = table[np.arange(codes.shape[1]), codes].sum(1)
                at = np.flatnonzero(docs != q[i]) if exclude_self else np.arange(len(docs))
                at = at[np.lexsort((docs[at], d[at]))[:rerank]]
                ids.append(docs[at])
                near.append(d[at])
                qs.append(np.full(len(at), q[i]))
        flat = lambda c, t: np.concatenate(c).astype(t) if c else np.empty(0, t)
        return pa.table([flat(qs, np.int64), flat(ids, np.int64), flat(near, np.float64)], names=["query_id", "doc_id", "near"])

    size = encoded.select("cell", "slices").distinct()
    asked = probed(queries, book, n_probe).join(F.broadcast(size), "cell")  # a row a cell
    asked = asked.select("query_id", "vec", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    hit = encoded.select("cell", "slice", "doc_id", "codes").groupBy("cell", "slice").cogroup(asked.groupBy("cell", "slice")).applyInArrow(run, "query_id bigint, doc_id bigint, near double")
    first = hit.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("near", "doc_id"))).where(F.col("r") <= rerank).select("query_id", "doc_id")
    q = usable(queries.withColumnRenamed("query_id", "doc_id")).select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qv"))
    pairs = first.join(usable(vectors), "doc_id").join(q, "query_id")
    scored = pairs.select("query_id", "doc_id", V.cosine(F.col("qv"), F.col("vec")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated(vectors: DataFrame, book: Codebook, k: int = 10, recall: float = 0.97, sample: int = dense.CALIBRATION_QUERIES) -> int:
    """Fewest cells with which a bounded sample of the vectors finds ``recall`` of its exact neighbours' cells; see :func:`dense.calibrated_probes`."""
    rows = vectors.sparkSession.createDataFrame([(i, v) for i, v in enumerate(book.centres.tolist())], "cell int, centre array<double>")
    return dense.calibrated_probes(usable(vectors), rows, k, recall, sample)
