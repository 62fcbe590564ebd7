"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected on many random directions. In each of these tables the vectors of one label are
sorted by their projection inside cells (the signs of some further projections, whose number follows the row
count so that cells stay small), and every vector collides with those in a window centred on its own value.
Pairs that collide in at least a calibrated number of tables are candidates: the number is the largest with
which a pair at exactly the wanted cosine is still found with the wanted probability. Candidates are verified in
double precision, so no pair below the threshold links.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, slices

#: Vectors that a cell holds on average, the windows' half width in standard deviations of a pair at the threshold.
CELL_ROWS, WIDTH = 16, 1.5
#: Rows of tables (25 bytes each, but for those seen from two slabs) that meet in one task's group.
PART_ROWS = 1 << 16
SEED = 20_250_101


@dataclass(frozen=True)
class Tables:
    """Number of tables, sign bits of a cell, half width of a window, collisions that a candidate needs."""

    count: int
    bits: int
    window: float
    least: int


def at_least(n: int, p: float, k: int) -> float:
    """P(Binomial(n, p) >= k)."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def calibrate(rows_per_label: float, cosine: float, recall: float = 0.995) -> Tables:
    """The smallest tables with which a pair at the threshold is found with probability ``recall`` by 3 collisions or more."""
    bits = max(0, math.ceil(math.log2(max(1.0, rows_per_label / CELL_ROWS))))
    distance = math.sqrt(2 - 2 * cosine)
    hit = math.erf(WIDTH / math.sqrt(2)) * (1 - math.acos(cosine) / math.pi) ** bits
    count = 16
    while at_least(count, hit, 3) < recall:
        count += 8
    least = next(k for k in range(count, 0, -1) if at_least(count, hit, k) >= recall)
    return Tables(count, bits, WIDTH * distance, least)


@lru_cache(maxsize=4)
def directions(dim: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Projection directions (dim x tables) and those of the cells' signs (dim x tables*bits), the same on every worker."""
    rng = np.random.default_rng(SEED + dim)
    return rng.standard_normal((dim, tables.count)), rng.standard_normal((dim, max(1, tables.count * tables.bits)))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column of equal lengths as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 1))


def table_rows(vectors: DataFrame, tables: Tables, parts: int) -> DataFrame:
    """(part, cell, id, value, home) of every vector in every table; a vector near a slab's lower border is also seen from the slab below."""
    names = "part int, cell bigint, id bigint, value double, home boolean"

    def run(batches):
        for piece in slices(batches, 2048):
            dims = np.array(piece.column(3).to_pylist())
            for dim in np.unique(dims):
                rows = piece.filter(pa.array(dims == dim))
                x = matrix(rows.column(2))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                line, signs = directions(int(dim), tables)
                values = x @ line  # a pair at distance d differs by a normal deviate of standard deviation d
                w = tables.window
                cells = np.zeros(values.shape, np.int64)
                if tables.bits:
                    s = (x @ signs >= 0).reshape(len(x), tables.count, tables.bits)
                    cells = s @ (1 << np.arange(tables.bits, dtype=np.int64))
                label = np.array(rows.column(1).to_pylist(), np.int64)
                slab = np.floor(values / (4 * w)).astype(np.int64)
                out = []
                for home, sl, keep in ((True, slab, np.ones(values.shape, bool)), (False, slab - 1, values - slab * 4 * w <= w)):
                    mixed = np.zeros(values.shape, np.uint64)
                    for v in (cells, np.broadcast_to(np.arange(tables.count), values.shape), np.broadcast_to(label[:, None], values.shape), sl, np.full(values.shape, dim)):
                        mixed = (mixed ^ v.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                        mixed ^= mixed >> np.uint64(29)
                    ids = np.broadcast_to(np.array(rows.column(0).to_pylist(), np.int64)[:, None], values.shape)
                    out.append((mixed[keep], ids[keep], values[keep], np.full(int(keep.sum()), home)))
                key, ids, value, home = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(parts)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(ids), pa.array(value), pa.array(home)], names=[n.split()[0] for n in names.split(", ")])

    return vectors.mapInArrow(run, names)


def collisions(rows: DataFrame, tables: Tables) -> DataFrame:
    """(a, b) for every collision, a < b: both in one cell and slab, the lower at home there, no farther apart than the window."""
    window = tables.window

    def run(table: pa.Table) -> pa.Table:
        cell, ids, value, home = (table.column(c).to_numpy() for c in ("cell", "id", "value", "home"))
        order = np.lexsort((value, cell))
        cell, ids, value, home = cell[order], ids[order], value[order], home[order]
        low, high = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = np.flatnonzero(home)
        for step in range(1, len(cell)):
            at = at[at + step < len(cell)]
            at = at[(cell[at + step] == cell[at]) & (value[at + step] - value[at] <= window)]
            if not len(at):
                break
            low.append(ids[at])
            high.append(ids[at + step])
        x, y = np.concatenate(low), np.concatenate(high)
        return pa.table([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return rows.groupBy("part").applyInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision reaches ``cosine``."""

    def run(batches):
        for piece in slices(batches, 4096):
            x, y = matrix(piece.column(2)), matrix(piece.column(3))
            cos = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], names=["a", "b"]).filter(pa.array(cos >= cosine))

    left = vectors.select(F.col("rep").alias("a"), F.col("v").alias("va"))
    right = vectors.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links of cosine >= ``cosine`` among equal non-null labels.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link
    with nothing and are their own component. Equal vectors of a label are one class, compared once. Vectors of
    different lengths never link. Repeated rows are equal vectors; an empty table gives no rows; other columns are
    never read.
    """
    v = F.col("v")
    good = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("class", F.when(good, F.xxhash64("label", "v")))
    classes = materialize(rows.where("class is not null").groupBy("class", "label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    size = classes.agg(F.count("*"), F.countDistinct("label")).first()
    tables = calibrate(size[0] / max(1, size[1]), cosine, recall)
    parts = max(1, -(-size[0] * tables.count // PART_ROWS))
    inputs = classes.select("rep", "label", "v", F.size("v").alias("dim"))
    hit = collisions(table_rows(inputs, tables, parts), tables).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= tables.least)
    links = materialize(verified(hit.select("a", "b"), classes, cosine))
    both = links.union(links.select("b", "a"))
    linked = both.join(classes.select(F.col("rep").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    home = classes.join(linked, classes["rep"] == linked["a"], "left").join(components(links), F.col("rep") == F.col("id"), "left")
    home = home.select("class", "label", "v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked_rows = rows.where("class is not null").join(home, ["class", "label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("class is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
