"""Helpers shared by the training-data operators: scans, shared scratch tables, bounded memos, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time inside an Arrow batch; bounds a worker's memory on long texts.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set where it is unset and the master is local.

    On a cluster each executor has its own disks, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended until no column of ``taken`` has it in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop, so that any shared store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


_open: list[list[DataFrame]] = []
_scratch: dict[str, SparkSession] = {}


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are dropped at the end, but for those given to the yielded function."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _open.pop()
        for df in made:
            if not any(df is k for k in kept):
                release(df)
            elif _open:
                _open[-1].append(df)
        if not _open and made:
            settle(made[0].sparkSession)


def settle(spark: SparkSession) -> None:
    """After an operator of many jobs: the driver's Python and JVM give back what those left behind, and Spark drops the broadcasts and shuffles that nothing refers to."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)

    _scratch[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    if _open:
        _open[-1].append(out)
    return out


def release(df: DataFrame) -> None:
    """Drop a table made by :func:`materialize` that no later plan reads."""
    _scratch.pop(df._siltstone_path, None)
    drop_path(df.sparkSession, df._siltstone_path)


def release_scratch() -> None:
    """Drop all tables that are left: for long sessions, when no result of an operator is to be read any more. Also done when the interpreter ends."""
    while _scratch:
        path, spark = _scratch.popitem()
        try:
            drop_path(spark, path)
        except Exception:  # the session may have ended before the interpreter
            continue


atexit.register(release_scratch)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into at most ``size`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function built once a task; each call sees a bounded slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for part in slices(batches):
            yield f(part)

    return df.mapInArrow(tidy(run), schema)


def trim() -> None:
    """Give freed memory back to the system: an executor's workers stay alive between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def tidy(run: Callable) -> Callable:
    """A task's function over batches that leaves no freed memory behind in its worker."""

    def wrapped(batches):
        yield from run(batches)
        trim()

    return wrapped


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of a group."""

    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        trim()
        return out

    return wrapped


_slot: dict[object, object] = {}


def in_worker(key: object, build: Callable[[], object] = lambda: None) -> object:
    """What an operator keeps in a worker process over its tasks: one thing at a time, so that the memory of an
    operator that ran before in the same process is given back first."""
    if key not in _slot:
        _slot.clear()
        gc.collect()
        trim()
        _slot[key] = build()
    return _slot[key]


class Memo:
    """A bounded cache of results by string: emptied when it is full, and never holding long strings for longer than a batch."""

    def __init__(self, limit: int, longest: int) -> None:
        self.limit, self.longest, self.known = limit, longest, {}

    def join(self, lists: list[list[str] | None], compute: Callable[[list[str]], list[bytes]]) -> list[bytes | None]:
        """For each list the joined results of its strings (None stays None); each unknown string is computed once."""
        known = self.known  # a plain dict, of which set.difference looks up single keys
        if len(known) > self.limit:
            known.clear()
        unknown = list(set().union(*(x for x in lists if x)).difference(known))
        known.update(zip(unknown, compute(unknown), strict=True))
        out = [None if x is None else b"".join(map(known.__getitem__, x)) for x in lists]
        for s in unknown:
            if len(s) > self.longest:
                del known[s]
        return out


U = np.uint64
SPACES = b" \t\n\x0b\x0c\r"
BASE = U(0xD1342543DE82EF95)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], U)
IS_SPACE = np.isin(np.arange(256), list(SPACES))
#: Powers that a worker keeps; longer texts make their own.
KEPT_POWERS = 1 << 19
_powers: list[np.ndarray] = [np.empty(0, U), np.empty(0, U)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread bits over 64-bit keys, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of BASE and of its inverse."""
    if n <= len(_powers[0]):
        return _powers
    size = max(n, KEPT_POWERS)
    made = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b)])) for b in (BASE, BASE_INVERSE)]
    if size <= KEPT_POWERS:
        _powers[:] = made
    return made


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of all bytes, split as by ``bytes.split``; where each text's words begin and the last ends)."""
    data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    space = IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1  # the last byte is a space
    if len(space) and not space[0]:
        edges = np.concatenate([[0], edges])
    start, end = edges[::2], edges[1::2]
    power, inverse = powers(len(data))
    total = BYTE_VALUES[data]
    total *= power[: len(data)]
    np.cumsum(total, out=total)
    word = mixed((total[end - 1] - np.where(start > 0, total[start - 1], U(0))) * inverse[start])
    return word, np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))


def components(nodes_edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list (a, b): rows (id, component), the smallest id reachable.

    Alternating large-star and small-star rounds, each a grouped minimum followed by a join that adaptive
    execution splits for hubs; the edges are written to the shared folder after each round. Empty input gives an empty result; self loops and repeated edges are harmless.
    """
    with temporary() as keep:
        mark = lambda df: df.agg(F.count("*"), *(F.sum(F.xxhash64("u", "v", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2))).first()
        edges = materialize(nodes_edges.where("a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct())
        before = mark(edges)
        while before[0]:
            # large star: every larger neighbour of u is linked to the smallest of u's neighbourhood
            both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # written, so that the join deals both sides itself and a hub's edges can be split
            least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            # small star: every smaller neighbour and u itself are linked to the smallest of them
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            new = materialize(small.where("u <> v").distinct())
            after = mark(new)  # sets of edges are compared by their sizes and two sums of hashes
            edges = new
            if after == before:
                break
            before = after
        keep(edges)
    labelled = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labelled.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
