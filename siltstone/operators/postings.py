"""A BM25 index that is stored once and kept up: blocks of postings by term, read through versioned manifests.

An index is a folder of segments. Each has its documents (length, digest), their postings, changes of document
frequencies, the documents of earlier segments that it replaces or removes, and, if wanted, vectors. Documents are
taken in batches of at most ``BLOCK``; a block is what one batch has of a term, with its largest term frequency and
smallest length. So the bounds of a query's terms in a batch add up to a bound of all scores in it, and a task that
has seen k better documents doesn't open the batch's postings for that query. A manifest names the segments of
a version and the corpus' totals; it is renamed into place when all else is written, so readers see whole versions
and a commit that was cut short is written again. No query reads a text.

Batches are of the tasks that read the documents, so a term that all documents hold is many blocks and never one group.
Most terms are rare, so blocks are stored many to a row: what a batch has of a bucket of terms, some ``PACK`` postings a row.
Documents' own rows come from the same pass over the texts and lie beside them, in buckets below zero. Change sets and
merges take stored batches whole, one task all of a batch, so no posting is a row.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import bm25
from .bm25 import Bm25
from .dense import best_of, vector_lists

#: Documents of a batch; queries that are sent to the tasks at once, and scored together.
BLOCK, QUERY_BLOCK, TILE = 1024, 10_000, 512
#: Documents for each bucket of terms; buckets at most. Segments from which on they are merged.
BUCKET_DOCS, BUCKETS, SEGMENTS = 5_000, 4096, 8
#: Postings of a stored row, up to one block more; scores of (query, document) that are held at once, as far as queries can be parted.
PACK, SHARES = 1024, 2_000_000
#: The form of stored segments. Those of form 2 had their documents in a table of their own, with their terms; those before it also had a row for each block.
FORM = 3
#: What sums of the same parts in another order can differ by, at most.
SLACK = 1e-6

DOCS = "doc_id bigint, dl int, digest bigint, v array<double>"
WITH_TERMS = "doc_id bigint, dl int, digest bigint, terms array<struct<term string, tf int>>, v array<double>"
PACKED = "batch bigint, terms array<string>, ns array<int>, max_tfs array<int>, min_dls array<int>, docs array<bigint>, tfs array<int>, dls array<int>, bucket int"
MADE = f"{DOCS}, {PACKED}"
POSTINGS = "term string, batch bigint, max_tf int, min_dl int, docs array<bigint>, tfs array<int>, dls array<int>, bucket int"
BLOCKS = "segment int, batch bigint, term string, max_tf int, min_dl int, docs array<bigint>, tfs array<int>, dls array<int>"
SEALED = "segment int, batch bigint, blocks binary"
TERMS = "term string, df bigint, bucket int"
GONE = "doc_id bigint"
DEAD = "of int, batch bigint, docs array<bigint>"
#: What is taken of a stored batch: removed documents and, for a merge, its documents and their postings, for a change set the postings' documents.
PARTS = ("docs array<bigint>", DOCS, "terms array<string>, ns array<int>, docs array<bigint>, tfs array<int>")
LOST = ("docs array<bigint>", "terms array<string>, ns array<int>, docs array<bigint>")
VECTORS = "doc_id bigint, vec array<double>"
SCHEMAS = {"docs": WITH_TERMS, "packed": PACKED, "postings": POSTINGS, "terms": TERMS, "gone": GONE, "dead": DEAD, "vectors": VECTORS}


#: No token is empty: under this term a batch has all its documents.
ALL = ""


@dataclass
class Cut:
    """Documents of a batch and their terms: ``row`` and ``at`` are a document and a term of ``terms`` for each token, or, with ``tf``, for each distinct one."""

    ids: pa.Array
    dl: pa.Array
    digests: pa.Array
    v: pa.Array
    terms: pa.Array
    row: np.ndarray
    at: np.ndarray
    tf: np.ndarray | None = None


def cut_texts(docs: pa.Table, buckets: Callable[[pa.Array], np.ndarray] | None = None) -> Cut:
    """Documents (doc_id, digest, lower-case text) cut into terms.

    ``v`` is how many tokens fall into each of the 64 ``buckets`` that a function gives distinct terms; null without one.
    """
    ids, digests, text = (c.combine_chunks() for c in docs.columns)
    row, terms, at = T.cut_lower(text)
    dl = pa.array(np.bincount(row, minlength=len(ids)), pa.int32(), mask=text.is_null().to_numpy(zero_copy_only=False))
    v = pa.nulls(len(ids), pa.list_(pa.float64()))
    if buckets:
        v = vector_lists(np.bincount(row * 64 + buckets(terms)[at], minlength=len(ids) * 64).reshape(len(ids), 64).astype(np.float64))
    return Cut(ids, dl, digests, v, terms, row, at)


def cut_terms(docs: pa.Table) -> Cut:
    """Documents (doc_id, dl, digest, v, terms) whose terms are counted."""
    ids, dl, digests, v, entries = (c.combine_chunks() for c in docs.columns)
    row = np.repeat(np.arange(len(ids)), pc.list_value_length(entries).fill_null(0).to_numpy())
    entries = entries.flatten()
    coded = entries.field("term").dictionary_encode()
    return Cut(ids, dl, digests, v, coded.dictionary, row, coded.indices.to_numpy(), entries.field("tf").to_numpy())


def in_blocks(batches: Iterator[pa.RecordBatch], size: int, cut: Callable[[pa.Table], Cut]) -> Iterator[Cut]:
    """Documents that ``cut`` takes, ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, size - n))
            at, n = at + held[-1].num_rows, n + held[-1].num_rows
            if n == size:
                yield cut(pa.Table.from_batches(held))
                held, n = [], 0
    if held:
        yield cut(pa.Table.from_batches(held))


def remaining(own: pa.Table, dead: np.ndarray, postings: pa.Table) -> Cut:
    """A stored batch without its removed documents."""
    own = own.sort_by([("doc_id", "ascending"), ("digest", "ascending")]).combine_chunks()
    ids = own.column(0).to_numpy()
    live = ~np.isin(ids, dead)
    own = own.filter(pa.array(live)).combine_chunks()
    terms, ns, docs, tfs = (c.combine_chunks().flatten() for c in postings.columns)
    ns, row = ns.to_numpy(), np.searchsorted(ids, docs.to_numpy())
    kept = live[row] & np.repeat(pc.not_equal(terms, ALL).to_numpy(zero_copy_only=False), ns)
    return Cut(*(c.combine_chunks() for c in own.columns), terms, (np.cumsum(live) - 1)[row[kept]], np.repeat(np.arange(len(terms)), ns)[kept], tfs.to_numpy()[kept])


def together(cuts: list[Cut]) -> Cut:
    """Documents of several batches as one, each term once."""
    ids, dl, digests, v, terms = (pa.concat_arrays([getattr(c, name) for c in cuts]) for name in ("ids", "dl", "digests", "v", "terms"))
    coded = terms.dictionary_encode()
    docs_before, terms_before = (np.cumsum([0, *(len(getattr(c, name)) for c in cuts[:-1])]) for name in ("ids", "terms"))
    row, at = (np.concatenate([getattr(c, name) + n for c, n in zip(cuts, before)]) for name, before in (("row", docs_before), ("at", terms_before)))
    return Cut(ids, dl, digests, v, coded.dictionary, row, coded.indices.to_numpy()[at], np.concatenate([c.tf for c in cuts]))


def dealt(parts: list[DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """(segment, batch, blocks, kind): frames (segment, batch, ...) of some columns each, sealed, dealt and sorted by batch."""
    found = None
    for kind, (rows, some) in enumerate(zip(parts, columns)):
        some = f"segment int, batch bigint, {some}"
        sealed = rows.select(*(c.split()[0] for c in some.split(", "))).mapInArrow(partial(seal, columns=some), SEALED).withColumn("kind", F.lit(kind))
        found = sealed if found is None else found.union(sealed)
    return found.repartition("segment", "batch").sortWithinPartitions("segment", "batch")


def parts_of(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[pa.Table]]:
    """The parts of a stored batch at a time, of dealt ones."""
    kinds = [columns_of(x) for x in columns]
    at, held = None, [[] for _ in kinds]
    for batch in batches:
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if key != at and at is not None:
                yield [pa.Table.from_batches(x, k) for x, k in zip(held, kinds)]
                held = [[] for _ in kinds]
            at, kind = key, batch.column(3)[i].as_py()
            held[kind].append(pa.ipc.read_record_batch(pa.py_buffer(batch.column(2)[i].as_py()), kinds[kind]))
    if at is not None:
        yield [pa.Table.from_batches(x, k) for x, k in zip(held, kinds)]


def cut_parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Cut]:
    """What remains of stored batches, of dealt ``PARTS``; neighbours of together at most ``size`` documents become one."""
    few: list[Cut] = []
    for dead, own, postings in parts_of(batches, PARTS):
        one = remaining(own, dead.column(0).combine_chunks().flatten().to_numpy(), postings)
        if sum(len(c.ids) for c in few) + len(one.ids) > size and few:
            yield together(few)
            few = []
        if len(one.ids):
            few.append(one)
    if few:
        yield together(few)


def count_lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, d): how many removed documents of a batch hold a term, below zero, of dealt ``LOST``."""
    for dead, postings in parts_of(batches, LOST):
        terms, ns, docs = (c.combine_chunks().flatten() for c in postings.columns)
        hit = np.isin(docs.to_numpy(), dead.column(0).combine_chunks().flatten().to_numpy())
        n = np.bincount(np.repeat(np.arange(len(terms)), ns.to_numpy())[hit], minlength=len(terms))
        some = pa.array((n > 0) & pc.not_equal(terms, ALL).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([terms.filter(some), pc.negate(pa.array(n, pa.int32())).filter(some)], names=["term", "d"])


def digest(text: Column) -> Column:
    """What tells whether a text has changed."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


#: CRC-32 of each byte.
CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
#: Bytes of a term that are taken a place at a time.
SHORT = 32


def bucket_of(terms: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of each term: its CRC-32, computed for all terms a byte at a time; long ones singly."""
    terms = terms.cast(pa.large_binary())
    n = pc.binary_length(terms).fill_null(0).to_numpy()
    if not len(n):
        return np.empty(0, np.int64)
    ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)
    order = np.argsort(-n, kind="stable")
    starts, alive = ends[:-1][order], np.searchsorted(-n[order], -np.arange(SHORT + 1))  # how many are longer than each place
    crc = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for i in range(SHORT):
        m = alive[i]
        if not m:
            break
        crc[:m] = CRC[(crc[:m] ^ data[starts[:m] + i]) & 0xFF] ^ (crc[:m] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    long = alive[SHORT]
    crc[:long] = [zlib.crc32(data[a : a + k].tobytes()) for a, k in zip(starts[:long].tolist(), n[order[:long]].tolist())]
    out = np.empty(len(n), np.int64)
    out[order] = crc.astype(np.int64) % buckets
    return out


def segment_rows(docs: DataFrame, buckets: int, cuts: Callable[[Iterator[pa.RecordBatch]], Iterator[Cut]]) -> DataFrame:
    """Rows of a segment, made in one pass over rows that ``cuts`` makes batches of: each document's own and packed blocks.

    A packed row has some of a batch's terms of a bucket, in order, and their postings. Batches must come in an order
    that a repeated task sees again, as they are known by their place in it.
    """
    kinds = {c: arrow_type(kind) for c, kind in (x.split() for x in MADE.split(", "))}

    def whole(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(columns["bucket"])
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[c]) for c in kinds], names=list(kinds))

    def made(terms: pa.Array, starts: np.ndarray, bucket: np.ndarray, batch: int, ids: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> pa.RecordBatch:
        """Rows of postings that are sorted by bucket and term; each term's begin at its start."""
        n = np.diff(np.append(starts, len(ids)))
        first = starts[np.searchsorted(bucket, bucket)]  # of the bucket
        piece = (starts - first) // PACK
        at = np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(piece) != 0)))  # first terms of rows
        by_term, by_posting = pa.array(np.append(at, len(terms)), pa.int32()), pa.array(np.append(starts[at], len(ids)), pa.int32())
        of_terms = {"terms": terms, "ns": pa.array(n, pa.int32()), "max_tfs": pa.array(np.maximum.reduceat(tf, starts), pa.int32()), "min_dls": pa.array(np.minimum.reduceat(dl, starts), pa.int32())}
        of_postings = {"docs": pa.array(ids, pa.int64()), "tfs": pa.array(tf, pa.int32()), "dls": pa.array(dl, pa.int32())}
        lists = {c: pa.ListArray.from_arrays(by_term, x) for c, x in of_terms.items()} | {c: pa.ListArray.from_arrays(by_posting, x) for c, x in of_postings.items()}
        return whole({"batch": pa.array(np.full(len(at), batch), pa.int64()), **lists, "bucket": pa.array(bucket[at], pa.int32())})

    def given(c: Cut, batch: int) -> Iterator[pa.RecordBatch]:
        ids, dl = c.ids.to_numpy(), c.dl.fill_null(0).to_numpy()
        below = -1 - ((batch >> 32) + (batch & 0xFFFFFFFF)) % buckets
        yield whole({"doc_id": c.ids, "dl": c.dl, "digest": c.digests, "v": c.v, "batch": pa.array(np.full(len(ids), batch), pa.int64()), "bucket": pa.array(np.full(len(ids), below), pa.int32())})
        all_ = pa.array([ALL])
        yield made(all_, np.zeros(1, np.int64), bucket_of(all_, buckets), batch, ids, np.zeros(len(ids), np.int32), dl)
        if not len(c.row):
            return
        bucket, by_name = bucket_of(c.terms, buckets), pc.sort_indices(c.terms).to_numpy()
        order = by_name[np.argsort(bucket[by_name], kind="stable")]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key = place[c.at] * len(ids) + c.row
        if c.tf is None:
            key, tf = np.unique(key, return_counts=True)
        else:
            by_term = np.argsort(key)
            key, tf = key[by_term], c.tf[by_term]
        at, row = np.divmod(key, len(ids))
        held_ = np.unique(at)  # the empty token is none
        order = order[held_]
        yield made(c.terms.take(pa.array(order)), np.searchsorted(at, held_), bucket[order], batch, ids[row], tf, dl[row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, c in enumerate(cuts(batches), TaskContext.get().partitionId() << 32):
            yield from given(c, number)

    return docs.mapInArrow(run, MADE)


def arrow_type(kind: str) -> pa.DataType:
    """Arrow's type of a column type of this module."""
    return pa.list_(arrow_type(kind[6:-1])) if kind.startswith("array<") else {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[kind]


def columns_of(kinds: str) -> pa.Schema:
    """Arrow's schema of columns of this module."""
    return pa.schema([(c, arrow_type(kind)) for c, kind in (x.split() for x in kinds.split(", "))])


def unpacked(packed: DataFrame, terms: pa.Array | None = None) -> DataFrame:
    """(segment, batch, term, max_tf, min_dl, docs, tfs, dls): a row for each block of the given terms, of all if none are given."""
    shared = packed.sparkSession.sparkContext.broadcast(terms)
    return packed.select("segment", *(c.split()[0] for c in PACKED.split(", ")[:-1])).mapInArrow(lambda batches: unpack(batches, shared.value), BLOCKS)


def unpack(batches: Iterator[pa.RecordBatch], wanted: pa.Array | None) -> Iterator[pa.RecordBatch]:
    """Blocks of packed rows, of the given terms if any are given."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            term, n, most, least, ids, tf, dl = (part.column(c).flatten() for c in range(2, 9))
            at = pa.array(np.arange(len(term)) if wanted is None else np.flatnonzero(pc.is_in(term, value_set=wanted).to_numpy(zero_copy_only=False)))
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy())[at.to_numpy()]
            ends = pa.array(np.append(0, np.cumsum(n.to_numpy())), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x).take(at) for x in (ids, tf, dl)]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in (0, 1)), term.take(at), most.take(at), least.take(at), *lists], names=names)


def seal(blocks: Iterator[pa.RecordBatch], columns: str = BLOCKS) -> Iterator[pa.RecordBatch]:
    """(segment, batch, blocks): blocks of a batch that follow one another are one value, which is copied whole where lists are copied by element."""
    kinds = columns_of(columns.split(", ", 2)[2])
    for b in blocks:
        keys = [b.column(i).to_numpy() for i in (0, 1)]
        ends = np.flatnonzero(np.append((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0), True)[: b.num_rows]) + 1
        starts = np.append(0, ends)[: len(ends)]
        inner = pa.RecordBatch.from_arrays([b.column(i + 2).cast(f.type) for i, f in enumerate(kinds)], schema=kinds)
        values = [inner.slice(i, j - i).serialize().to_pybytes() for i, j in zip(starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0][starts], pa.int32()), pa.array(keys[1][starts], pa.int64()), pa.array(values, pa.binary())], names=["segment", "batch", "blocks"])


def unseal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a batch at a time, sorted by term, of sealed ones that are sorted by segment and batch."""
    kinds = columns_of(BLOCKS.split(", ", 2)[2])
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def whole(key: tuple[int, int], held: list[bytes]) -> pa.RecordBatch:
        each = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(x), kinds) for x in held]).combine_chunks()
        each = each.take(pc.sort_indices(each.column("term"))).combine_chunks().to_batches()[0]
        n = each.num_rows
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0]), pa.int32()), pa.array(np.full(n, key[1]), pa.int64()), *each.columns], names=names)

    at, held = None, []
    for batch in batches:
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if key != at and held:
                yield whole(at, held)
                held = []
            at = key
            held.append(batch.column(2)[i].as_py())
    if held:
        yield whole(at, held)


class PostingIndex:
    """The newest version of an index in a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.path, self.embed = spark, path.rstrip("/"), embed
        self.manifest = self._newest()

    # --- the store --------------------------------------------------------------------------------------------

    def _fs(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _newest(self) -> dict:
        fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        versions = sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not versions:
            return {"version": 0, "segments": [], "n_docs": 0, "texts": 0, "length": 0, "mean_idf": 0.0, "buckets": 1, "vectors": False, "form": FORM}
        stream = fs.open(self._fs(versions[-1])[1])
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, tmp = self._fs("manifest.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(tmp, self._fs(f"manifest-{manifest['version']:08d}.json")[1]):
            raise RuntimeError(f"version {manifest['version']} was written by another session")
        self.manifest = manifest

    def exists(self) -> bool:
        return bool(self.manifest["version"])

    def drop(self) -> None:
        """Remove the index."""
        fs, root = self._fs()
        fs.delete(root, True)
        self.manifest = self._newest()

    def _read(self, name: str, segments: list[int] | None = None) -> DataFrame:
        """A table of the given segments with the column ``segment``."""
        if name == "postings" and self.manifest.get("form", 1) > 1:
            return unpacked(self._read("packed", segments))
        if name == "docs" and self.manifest.get("form") == FORM:
            return self._made(segments).where("bucket < 0").select(*(c.split()[0] for c in DOCS.split(", ")), "segment")
        if name == "packed":
            return self._made(segments).where("bucket >= 0").select(*(c.split()[0] for c in PACKED.split(", ")), "segment")
        return self._stored(name, SCHEMAS[name], segments)

    def _made(self, segments: list[int] | None = None) -> DataFrame:
        """Documents' rows, in buckets below zero, and packed blocks."""
        return self._stored("packed", MADE, segments)

    def _stored(self, name: str, columns: str, segments: list[int] | None) -> DataFrame:
        schema = f"{columns}, segment int"
        paths = [f"{self.path}/{name}/segment={s}" for s in (self.manifest["segments"] if segments is None else segments)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _write(self, name: str, segment: int, rows: DataFrame, by: str | None = None) -> None:
        w = rows.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(f"{self.path}/{name}/segment={segment}")

    # --- writing ----------------------------------------------------------------------------------------------

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, segment, ...) that no later segment replaces or removes."""
        if len(self.manifest["segments"]) < 2:
            return rows
        gone = self._read("gone").select(F.col("doc_id").alias("_id"), F.col("segment").alias("_by"))
        return rows.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_by") > F.col("segment")), "left_anti")

    def documents(self) -> DataFrame:
        """(doc_id, dl, digest, v, segment) of all documents of this version."""
        return self._live(self._read("docs"))

    def _entries(self, docs: DataFrame) -> DataFrame:
        """(segment, doc_id, term, tf) of documents (segment, doc_id); only their batches are opened."""
        keys = docs.select("segment", "doc_id")
        members = self._blocks(pa.array([ALL])).select("segment", "batch", F.explode("docs").alias("doc_id"))
        packed = self._read("packed").join(members.join(keys, ["segment", "doc_id"], "left_semi").select("segment", "batch").distinct(), ["segment", "batch"], "left_semi")
        each = unpacked(packed).where(F.col("term") != ALL).select("segment", "term", F.explode(F.arrays_zip("docs", "tfs")).alias("p"))
        return each.select("segment", F.col("p.docs").alias("doc_id"), "term", F.col("p.tfs").alias("tf")).join(keys, ["segment", "doc_id"], "left_semi")

    def vectors(self) -> DataFrame:
        """(doc_id, vec) of all documents of this version."""
        return self._live(self._read("vectors")).select("doc_id", "vec")

    def build(self, docs: DataFrame) -> PostingIndex:
        """Index documents (doc_id, text) anew; earlier versions are no longer read."""
        return self._commit(partial(self._cut, docs), docs, None, [], docs.count())

    def _cut(self, docs: DataFrame, buckets: int, only: DataFrame | None = None) -> DataFrame:
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartition("doc_id")  # texts are smaller than their terms, and may come in one file
        rows = rows if only is None else rows.join(only, "doc_id", "left_semi")  # dealt by the same key
        lower = rows.select("doc_id", digest(F.col("text")).alias("digest"), F.lower("text").alias("text"))
        return segment_rows(lower.sortWithinPartitions("digest", "doc_id"), buckets, partial(in_blocks, size=BLOCK, cut=partial(cut_texts, buckets=getattr(self.embed, "buckets", None))))

    def sync(self, docs: DataFrame) -> PostingIndex:
        """Make the index that of the documents (doc_id, text): new, changed and missing ones make the next segment.

        Texts are compared by digests, so only new and changed ones are cut into terms; without a change nothing is written.
        """
        if not self.exists():
            return self.build(docs)
        have = self.documents().select("doc_id", F.col("digest").alias("_digest"))
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        marked = docs.select("doc_id", digest(F.col("text")).alias("_now")).join(have, "doc_id", "left")  # no text is shuffled to be compared
        changed = marked.where(~F.col("_digest").eqNullSafe(F.col("_now"))).select("doc_id")
        missing = have.join(docs.select("doc_id"), "doc_id", "left_anti").select("doc_id")
        return self._change(partial(self._cut, docs, only=changed), docs.join(changed, "doc_id", "left_semi"), changed.union(missing))

    def apply(self, changed: DataFrame, removed: DataFrame) -> PostingIndex:
        """The next version: documents (doc_id, text) put in or replaced, others (doc_id) removed."""
        if not self.exists():
            return self.build(changed)
        gone = changed.select(F.col("doc_id").cast("bigint").alias("doc_id")).union(removed.select(F.col("doc_id").cast("bigint")))
        return self._change(partial(self._cut, changed), changed, gone)

    def _change(self, rows: Callable[[int], DataFrame], changed: DataFrame, gone: DataFrame) -> PostingIndex:
        if self.manifest.get("form") != FORM:
            self.compact()
        self._commit(rows, changed, gone.distinct(), self.manifest["segments"])
        return self.compact() if len(self.manifest["segments"]) >= SEGMENTS else self

    def compact(self) -> PostingIndex:
        """Merge all segments into one: a task takes whole batches, leaves out what is gone and puts small ones together."""
        if self.manifest.get("form") == FORM:
            rows = partial(segment_rows, self._parts(), cuts=partial(cut_parts, size=BLOCK))
        else:
            live = self.documents().select("doc_id", "dl", "digest", "v", "terms").repartition("doc_id").sortWithinPartitions("digest", "doc_id")
            rows = partial(segment_rows, live, cuts=partial(in_blocks, size=BLOCK, cut=cut_terms))
        return self._commit(rows, None, None, [], self.manifest["n_docs"])

    def _parts(self) -> DataFrame:
        """``PARTS`` of the stored batches that still have documents."""
        dead, own = self._read("dead").select(F.col("of").alias("segment"), "batch", "docs"), self._made().where("bucket < 0")
        gone = dead.select("segment", "batch", F.explode("docs").alias("doc_id"))
        left = F.broadcast(own.select("segment", "batch", "doc_id").join(gone, ["segment", "batch", "doc_id"], "left_anti").select("segment", "batch").distinct())  # a row for each batch
        return dealt([x.join(left, ["segment", "batch"], "left_semi") for x in (dead, own, self._read("packed"))], PARTS)

    def _lost(self, segment: int) -> DataFrame:
        """(term, d): what the documents that a segment removes take from the frequencies, by batch."""
        dead = self._read("dead", [segment]).select(F.col("of").alias("segment"), "batch", "docs")
        some = F.broadcast(dead.select("segment", "batch"))  # a row for each batch
        return dealt([dead, self._read("packed").join(some, ["segment", "batch"], "left_semi")], LOST).mapInArrow(count_lost, "term string, d int")

    def _commit(self, rows: Callable[[int], DataFrame], docs: DataFrame | None, gone: DataFrame | None, before: list[int], n_rows: int = 0) -> PostingIndex:
        """Write a segment after those of ``before`` and the manifest that names them; rows are a function of the number of buckets."""
        segment = self.manifest["version"] + 1
        wanted = self.manifest["vectors"] if before or docs is None else self.embed is not None
        if wanted and docs is not None and not self.embed:
            raise ValueError("the index has vectors: open it with the function that makes them")
        buckets = self.manifest["buckets"] if before else min(BUCKETS, max(8, -(-n_rows // BUCKET_DOCS)))
        self._write("packed", segment, rows(buckets).repartition("bucket").sortWithinPartitions("bucket", "batch"), "bucket")
        mine = self._made([segment]).where("bucket < 0")
        if wanted:
            if docs is None:
                vectors = self.vectors()
            elif hasattr(self.embed, "of_counts"):
                vectors = self.embed.of_counts(mine.select("doc_id", "v"))
            else:
                vectors = self.embed(docs)
            self._write("vectors", segment, vectors.select("doc_id", F.col("vec").cast("array<double>")))
        dead = None
        if gone is not None:
            have = self.documents()
            self._write("gone", segment, have.join(gone, "doc_id", "left_semi").select("doc_id"))
            removed = self._read("gone", [segment]).select("doc_id")
            dead = have.join(removed, "doc_id", "left_semi")
            members = self._blocks(pa.array([ALL])).select(F.col("segment").alias("of"), "batch", F.explode("docs").alias("doc_id"))
            members = members.join(dead.select(F.col("segment").alias("of"), "doc_id"), ["of", "doc_id"], "left_semi")  # a document is marked once
            held = members.groupBy("of", "batch").agg(F.collect_set("doc_id").alias("docs"))  # at most a batch
            self._write("dead", segment, held)
        else:
            self._write("gone", segment, mine.select("doc_id").limit(0))
            self._write("dead", segment, mine.limit(0).select(F.lit(0).alias("of"), F.col("doc_id").alias("batch"), F.array("doc_id").alias("docs")))
        if gone is not None and not before:
            raise ValueError("there is nothing to remove from")
        sums = (F.count("*").alias("n_docs"), F.count("dl").alias("texts"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"))  # a null text has no length
        totals = mine.agg(*sums).first()
        lost = dead.agg(*sums).first() if dead is not None else None
        if before and lost and not totals.n_docs and not lost.n_docs:
            return self  # no change, no version
        now = {k: totals[k] + (self.manifest[k] - lost[k] if lost else 0) for k in ("n_docs", "texts", "length")}
        n_docs = now["n_docs"]
        held = self._made([segment]).where("bucket >= 0").select(F.explode(F.arrays_zip("terms", "ns")).alias("t"))  # a row for each block, where the documents' terms are one for each posting
        change = held.select(F.col("t.terms").alias("term"), F.col("t.ns").alias("d")).where(F.col("term") != ALL)
        if dead is not None:
            change = change.union(self._lost(segment))
        change = change.groupBy("term").agg(F.sum("d").alias("df")).where("df <> 0")
        bucket = F.pmod(F.xxhash64("term"), F.lit(max(8, buckets // 10))).cast("int")
        self._write("terms", segment, change.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term"), "bucket")
        df = self._read("terms", [*before, segment]).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        shape = df.groupBy("df").agg(F.count("*").alias("terms"))  # idfs depend on the frequency alone
        raw = bm25.raw_idf(F.lit(n_docs), F.col("df"))
        mean = shape.agg((F.sum(raw * F.col("terms")) / F.sum("terms")).alias("mean")).first().mean
        self._publish({"version": segment, "segments": [*before, segment], **now, "mean_idf": mean or 0.0, "buckets": buckets, "vectors": wanted, "form": FORM})
        return self

    # --- reading ----------------------------------------------------------------------------------------------

    def totals(self) -> tuple[int, float]:
        """(documents, mean length of those with a text)."""
        n = self.manifest["texts"]
        return self.manifest["n_docs"], self.manifest["length"] / n if n else 0.0

    def frequencies(self) -> DataFrame:
        """(term, df) of all terms of this version."""
        return self._read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def topk(self, queries: DataFrame, k: int = 10, config: Bm25 = Bm25(), skip: bool = True) -> DataFrame:
        """(query_id, doc_id, score, rank) as :func:`bm25.topk` gives it for the same documents.

        The blocks of the queries' terms are dealt by batch; a task scores one batch after another against a block of
        queries and gives its ``k`` best of each. With ``skip`` it leaves batches out whose bound is too low.
        """
        wanted = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        found = None
        for b in range(n_blocks):
            some = wanted if n_blocks == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
            one = self._block_topk(some, k, config, skip)
            found = one if found is None else found.unionByName(one)
        kind = dict(queries.dtypes)["query_id"]
        return bm25.ranked(found.withColumn("query_id", F.col("query_id").cast(kind)), k)

    def weights(self, wanted: DataFrame, config: Bm25) -> DataFrame:
        """(query_id, term, w) of query terms (query_id, term, qtf) that the index holds."""
        df = self._read("terms").join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = bm25.raw_idf(F.lit(self.manifest["n_docs"]), F.col("df"))
        idf = F.when(raw < 0, config.epsilon * self.manifest["mean_idf"]).otherwise(raw)
        return wanted.join(df, "term").select("query_id", "term", (idf * F.col("qtf")).alias("w"))

    def _blocks(self, terms: pa.Array) -> DataFrame:
        """(segment, batch, term, max_tf, min_dl, docs, tfs, dls) of some terms; folders of other buckets are left out."""
        if self.manifest.get("form", 1) < 2:
            named = F.broadcast(self.spark.createDataFrame(pa.table({"term": terms})))
            return self._read("postings").join(named, "term", "left_semi").select("segment", "batch", "term", "max_tf", "min_dl", "docs", "tfs", "dls")
        return unpacked(self._rows_of(terms), terms)

    def _rows_of(self, terms: pa.Array) -> DataFrame:
        """Packed rows of the buckets that some terms fall into."""
        packed, buckets = self._read("packed"), sorted(set(bucket_of(terms, self.manifest["buckets"]).tolist()))
        return packed.where(F.col("bucket").isin(buckets)) if len(buckets) < self.manifest["buckets"] else packed

    def _sealed(self, terms: pa.Array) -> DataFrame:
        """(segment, batch, blocks) of some terms, and marks of removed documents under ``ALL``."""
        if self.manifest.get("form", 1) < 2:
            found = self._blocks(terms).mapInArrow(seal, SEALED)
        else:
            shared = self.spark.sparkContext.broadcast(terms)
            rows = self._rows_of(terms).select("segment", *(c.split()[0] for c in PACKED.split(", ")[:-1]))
            found = rows.mapInArrow(lambda batches: seal(unpack(batches, shared.value)), SEALED)
        if len(self.manifest["segments"]) < 2:
            return found
        none = F.array().cast("array<int>")
        dead = self._read("dead").select(F.col("of").alias("segment"), "batch", F.lit(ALL).alias("term"), F.lit(0).alias("max_tf"), F.lit(0).alias("min_dl"), "docs", none.alias("tfs"), none.alias("dls"))
        return found.union(dead.mapInArrow(seal, SEALED))

    def _block_topk(self, wanted: DataFrame, k: int, config: Bm25, skip: bool) -> DataFrame:
        rows = self.weights(wanted, config).select(F.col("query_id").cast("string"), "term", "w").toArrow()  # of at most QUERY_BLOCK queries
        blocks = self._sealed(rows.column(1).unique())
        shared, avgdl = self.spark.sparkContext.broadcast(rows), self.totals()[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(shared.value, k, config, avgdl, skip)
            for batch in unseal(batches):
                scorer.add(batch)
            yield scorer.results()

        dealt = blocks.repartition("segment", "batch").sortWithinPartitions("segment", "batch")
        return dealt.mapInArrow(run, "query_id string, doc_id bigint, score double")


class Scorer:
    """Scores batches of documents against queries and keeps each query's best."""

    def __init__(self, weights: pa.Table, k: int, config: Bm25, avgdl: float, skip: bool) -> None:
        self.k, self.config, self.avgdl, self.skip = k, config, avgdl or 1.0, skip
        names = weights.column(0).combine_chunks().dictionary_encode()
        self.names, query = names.dictionary, names.indices.to_numpy()
        terms, w = weights.column(1).to_pylist(), weights.column(2).to_numpy()
        order = sorted(range(len(terms)), key=terms.__getitem__)
        self.of: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for term, places in groupby(order, key=terms.__getitem__):
            at = np.fromiter(places, np.int64)
            self.of[term] = (query[at], w[at])
        n = len(self.names)
        self.score, self.doc = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.held: list[tuple] = []
        self.at: tuple | None = None
        self.seen = self.opened = 0

    def part(self, tf: np.ndarray | int, dl: np.ndarray | int) -> np.ndarray | float:
        """A term's share of a score, without its weight."""
        c = self.config
        return tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * dl / self.avgdl))

    def add(self, batch: pa.RecordBatch) -> None:
        """Take blocks (segment, batch, term, max_tf, min_dl, docs, tfs, dls), sorted by segment and batch."""
        segments, numbers, tfs, dls = (batch.column(i).to_numpy().tolist() for i in (0, 1, 3, 4))
        terms, ends = batch.column(2).to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.list_value_length(batch.column(5)).to_numpy())).tolist()
        n_ends = np.append(0, np.cumsum(pc.list_value_length(batch.column(6)).to_numpy())).tolist()  # marks of removed documents have none
        ids, *of = (batch.column(i).flatten().to_numpy() for i in (5, 6, 7))
        for i in range(batch.num_rows):
            if self.at != (segments[i], numbers[i]):
                self.close()
                self.at = (segments[i], numbers[i])
            self.held.append((terms[i], tfs[i], dls[i], ids[ends[i] : ends[i + 1]], *(x[n_ends[i] : n_ends[i + 1]] for x in of)))

    def close(self) -> None:
        """Score the batch that is held."""
        blocks, dead = [b for b in self.held if b[0] != ALL], [b[3] for b in self.held if b[0] == ALL]
        self.held = []
        if not blocks:
            return
        of = [self.of[b[0]] for b in blocks]
        query, weight = (np.concatenate([x[i] for x in of]) for i in (0, 1))
        block = np.repeat(np.arange(len(blocks)), [len(x[0]) for x in of])
        most = self.part(np.array([b[1] for b in blocks], np.float64), np.array([b[2] for b in blocks]))
        bound, hit = np.bincount(query, np.maximum(weight, 0) * most[block], len(self.names)), np.bincount(query, minlength=len(self.names)) > 0
        self.seen += int(hit.sum())
        if self.skip:
            hit &= bound >= self.score[:, -1] - SLACK
        self.opened += int(hit.sum())
        if not hit.any():
            return
        ids = np.concatenate([b[3] for b in blocks])
        docs = np.unique(ids)
        live = ~np.isin(docs, np.concatenate(dead)) if dead else np.ones(len(docs), bool)
        starts = np.append(0, np.cumsum([len(b[3]) for b in blocks])).tolist()
        at = np.searchsorted(docs, ids)
        part = self.part(np.concatenate([b[4] for b in blocks]).astype(np.float64), np.concatenate([b[5] for b in blocks]))
        kept = hit[query]
        row, weight, block = (np.cumsum(hit) - 1)[query[kept]], weight[kept], block[kept]
        step = min(TILE, max(1, SHARES // len(docs)))
        order = np.argsort(row // step, kind="stable")  # a query's terms stay in order, so equal documents have equal sums
        row, weight, block = row[order], weight[order], block[order]
        tile = row // step
        ends = np.flatnonzero(np.append((np.diff(tile) != 0) | (np.diff(block) != 0), True)) + 1
        firsts = np.append(0, ends[:-1])
        open_, some_below = np.flatnonzero(hit), bool((weight <= 0).any())
        row %= step
        held = None
        for first, end, b, t in zip(firsts.tolist(), ends.tolist(), block[firsts].tolist(), tile[firsts].tolist()):
            if t != held:
                if held is not None:
                    self._keep(open_[held * step : (held + 1) * step], scores, found, live, docs)
                held = t
                shape = (min(step, len(open_) - t * step), len(docs))
                scores, found = np.zeros(shape), np.zeros(shape, bool) if some_below else None
            rows, here, p = row[first:end], at[starts[b] : starts[b + 1]], part[starts[b] : starts[b + 1]]
            if end - first == 1:
                scores[rows[0]][here] += weight[first] * p
            elif 4 * len(here) > len(docs):
                wide = np.zeros(len(docs))  # what isn't held adds nothing
                wide[here] = p
                scores[rows] += weight[first:end, None] * wide
            else:
                scores[rows[:, None], here] += weight[first:end, None] * p
            if some_below:
                found[rows[:, None], here] = True
        self._keep(open_[held * step : (held + 1) * step], scores, found, live, docs)

    def _keep(self, rows: np.ndarray, scores: np.ndarray, found: np.ndarray | None, live: np.ndarray, docs: np.ndarray) -> None:
        """Keep the best of some queries' scores; without ``found`` those above zero were found."""
        scores[~((scores > 0 if found is None else found) & live)] = -np.inf
        self.score[rows], self.doc[rows] = best_of(self.score[rows], self.doc[rows], scores, docs, self.k)

    def results(self) -> pa.RecordBatch:
        """(query_id, doc_id, score) of the best of all batches."""
        self.close()
        q, r = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(q)), pa.array(self.doc[q, r], pa.int64()), pa.array(self.score[q, r])], names=["query_id", "doc_id", "score"])
