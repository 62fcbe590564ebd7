"""Exact top-k by inner product: segment means and deviations bound every pair before it is computed.

Components are scaled to integers. Cut into segments, a vector x has a mean m and a deviation d in each; for two
vectors the squared distance is at least the sum over segments of length * ((m - m')**2 + (d - d')**2). As lengths are
known, a least distance is a greatest inner product. Bounds go from coarse to fine: pairs that one segment rules out
are never looked at with four, and so on; inner products are computed for what is left. A pair is ruled out if
its bound is below the k-th best score that its query has so far in the task, or has had from the start in a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, temporary, tidy

#: Number of segments of each resolution.
LEVELS = (1, 4, 16)
#: Queries that are sent to the tasks at once (8 MB at 64 components), those compared with a batch of vectors together, vectors of a batch.
QUERY_BLOCK, TILE, BATCH = 16_384, 256, 2048
#: Vectors from which every query's first bound comes; they are searched again with all others.
SAMPLE = 2048
#: Components are scaled by this and rounded down.
SCALE = 256
#: Share of pairs left from which a level or the scores are computed for the whole rectangle and not pair by pair.
DENSE = 0.1


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that inner products bound those of the vectors and lengths are kept."""
    parts = np.array_split(x, min(segments, max(1, x.shape[1])), axis=1)
    out = [f(p, axis=1) * np.sqrt(p.shape[1]) for f in (np.mean, np.std) for p in parts if p.shape[1]]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of equal rows, exact: in doubles where they can't lose a unit, else in whole numbers, within a long."""
    if not q.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    full = (sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q.tolist(), x.tolist(), strict=True))
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in full], np.int64)


def best_of(q: np.ndarray, s: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` rows of each query by falling score, then id; sorted by query."""
    order = np.lexsort((d, ~s, q))
    q, s, d = q[order], s[order], d[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], s[place < k], d[place < k]


class Search:
    """Queries of one dimension, and the best rows that they have met."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.levels = [features(q, n) for n in LEVELS]
        self.length = np.sqrt((q * q).sum(1))
        self.least = np.full(len(ids), -np.inf)  # a row of a lower score isn't among the k best
        self.found = [np.empty(0, np.int64) for _ in range(3)]  # query's place, score, id

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Compare all queries with vectors."""
        bounds = [features(x, n) for n in LEVELS]
        length = np.sqrt((x * x).sum(1))
        for a in range(0, len(self.ids), TILE):
            b = min(a + TILE, len(self.ids))
            slack = 1e-9 * self.length[a:b, None] * length + 1e-6  # of rounding, in the bounds
            row, col = self.left(a, b, bounds, ids, slack)
            if len(row):
                self.merge(row + a, self.scores(row + a, col, x), ids[col], np.arange(a, b))

    def left(self, a: int, b: int, bounds: list[np.ndarray], ids: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of the pairs that no resolution rules out; a query's own row is none."""
        least = self.least[a:b]
        row = col = None
        for mine, theirs in zip(self.levels, bounds, strict=True):
            mine = mine[a:b]
            if row is None or len(row) > DENSE * slack.size:
                keep = mine @ theirs.T + slack >= least[:, None]
                keep &= self.ids[a:b, None] != ids
                if row is not None:
                    before = np.zeros(slack.shape, bool)
                    before[row, col] = True
                    keep &= before
                row, col = np.nonzero(keep)
            else:
                keep = np.einsum("ij,ij->i", mine[row], theirs[col]) + slack[row, col] >= least[row]
                row, col = row[keep], col[keep]
            if not len(row):
                break
        return row, col

    def scores(self, row: np.ndarray, col: np.ndarray, x: np.ndarray) -> np.ndarray:
        first, last = int(row[0]), int(row[-1]) + 1
        few = np.abs(self.q[first:last]).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < 2.0**53
        if few and len(row) > DENSE * (last - first) * len(x):
            return (self.q[first:last] @ x.T)[row - first, col].astype(np.int64)
        return np.concatenate([exact(self.q[row[i : i + 65_536]], x[col[i : i + 65_536]]) for i in range(0, len(row), 65_536)])

    def merge(self, row: np.ndarray, s: np.ndarray, d: np.ndarray, tile: np.ndarray) -> None:
        keep = s >= self.least[row]
        mine = (self.found[0] >= tile[0]) & (self.found[0] <= tile[-1])
        new = [np.concatenate([f[mine], n[keep]]) for f, n in zip(self.found, (row, s, d), strict=True)]
        new = best_of(*new, self.k)
        self.found = [np.concatenate([f[~mine], n]) for f, n in zip(self.found, new, strict=True)]
        q, n = np.unique(new[0], return_counts=True)
        last = np.cumsum(n) - 1
        full = n == self.k
        self.least[q[full]] = np.maximum(self.least[q[full]], new[1][last[full]])


def vectors_of(piece: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scaled vectors) of rows (id, vector of doubles), for each dimension by itself."""
    dims = np.diff(piece.column(1).offsets.to_numpy())
    for dim in np.unique(dims):
        some = piece.filter(pa.array(dims == dim))
        x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, dim)
        with np.errstate(over="ignore"):
            yield some.column(0).to_numpy(), np.clip(np.floor(SCALE * x), -(2.0**63), 2.0**63)


def searches(table: pa.Table, k: int) -> dict[int, Search]:
    """A search for each dimension of the queries."""
    if not table.num_rows:
        return {}
    return {x.shape[1]: Search(ids, x, k) for ids, x in vectors_of(table.combine_chunks().to_batches()[0])}


def block_topk(vectors: DataFrame, queries: pa.Table, sample: pa.Table, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each task at most ``k`` rows a query, all of the k best among them."""
    first = searches(queries, k)
    for piece in slices(iter(sample.combine_chunks().to_batches()), BATCH):
        for ids, x in vectors_of(piece):
            if x.shape[1] in first:
                first[x.shape[1]].add(ids, x)
    least = {dim: s.least for dim, s in first.items()}
    shared = vectors.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches):
        table, least = shared.value
        open_ = searches(table, k)
        for dim, s in open_.items():
            s.least = least[dim].copy()
        for piece in slices(batches, BATCH):
            for ids, x in vectors_of(piece):
                if x.shape[1] in open_:
                    open_[x.shape[1]].add(ids, x)
        for s in open_.values():
            q, score, d = s.found
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[q], pa.int64()), pa.array(d, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return vectors.mapInArrow(tidy(run), "query_id bigint, vec_id bigint, score bigint")


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query, of components floor(256 * x).

    Queries are the rows whose id is divisible by ``every``, candidates all rows but those of the query's id. Equal
    scores go to the smaller id. Vectors that are null or hold null or non-finite components, and rows without an id,
    take no part; vectors are compared with those of their own number of components. Rows that repeat are candidates
    each; of rows that share a query's id the smallest vector asks. Components and scores beyond a long are the nearest long. An
    empty table gives no rows; other columns are never read.
    """
    v = F.col("v")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(good)
    with temporary() as keep:
        queries = materialize(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
        blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        parts = []
        for b in range(blocks):
            block = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == b).toArrow()  # some QUERY_BLOCK rows
            parts.append(materialize(block_topk(rows, block, sample, k)))
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return keep(materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
