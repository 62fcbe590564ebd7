"""Token counts by a SentencePiece model, each distinct pre-token counted once.

A pre-token is a run of spaces with the run of other characters after it (line ends stand alone): no piece of
a model accepted here crosses such a boundary, so a text's count is the sum over its pre-tokens. Frequent
pre-tokens (a bounded list) are counted in one small job and sent to the workers; the others travel, with the
documents' frequencies, to the task that owns their hash, where each distinct one is counted once and joined
to its frequencies. Only counts come back; ids are never made for a document.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, slices

CHUNK = re.compile(r"[ ▁]*[^ ▁\n]+|[ ▁]+|\n")
#: Frequent pre-tokens that are broadcast: their number and greatest length bound the broadcast at some 20 MB.
HOT_WORDS, HOT_CHARS, TASK_WORDS = 262_144, 48, 65_536
#: Documents of a block, whose pre-tokens are dealt into buckets together.
GATHER = 2048


class PieceCounts:
    """Counts of the pieces of single pre-tokens, by the library."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or len(self.sp.encode("\n")) != 2 or len(self.sp.encode("ﬁ x")) != len(self.sp.encode("ﬁ")) + len(self.sp.encode("x")):
            raise ValueError("the model's pieces cross the boundaries of pre-tokens")

    def count(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token as it is inside a text (the library puts a space before a text, which is allowed for)."""
        found = []
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            asked = [w[1:] if w[0] in " ▁" and len(w) > 1 else "\n" + w for w in part]
            found += [len(ids) - (0 if w[0] in " ▁" and len(w) > 1 else 2) for w, ids in zip(part, self.sp.encode(asked, num_threads=1), strict=True)]
        return found


def piece_counts(path: str) -> PieceCounts:
    """One processor for each worker process."""
    return in_worker(("token_counts", path), lambda: PieceCounts(path))


def words_of(text: str) -> list[str]:
    """Pre-tokens of a text, with the space that the library puts before it."""
    return CHUNK.findall(" " + text)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are returned as often as they occur; an empty
    table gives no rows; texts of any length are counted whole; other columns are never read. A document is known
    by its block and place, so ``docs`` must be a scan that gives a task the same rows again when it is repeated.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.select("doc_id").count() // 4096)

    def frequent(batches):
        seen: Counter[str] = Counter()
        for part in slices(batches):
            for t in part.column(0).to_pylist():
                if t:
                    seen.update(words_of(t))
            if len(seen) > 16 * TASK_WORDS:
                seen = Counter(dict(seen.most_common(4 * TASK_WORDS)))
        top = [(w, n) for w, n in seen.most_common(TASK_WORDS) if len(w) <= HOT_CHARS and n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    def counted(batches):
        for part in slices(batches, 8192):
            words = part.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(piece_counts(path).count(words), pa.int64())], names=["word", "pieces"])

    hot = rows.select("text").mapInArrow(frequent, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    hot = hot.orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word").repartition(8).mapInArrow(counted, "word string, pieces bigint")
    known = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in hot.toArrow().columns), strict=True)))

    fields = "bucket int, block bigint, words binary, lengths binary, place binary, freq binary, doc array<bigint>, bytes array<bigint>, total array<bigint>"
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 3]

    def dealt(batches):
        pieces, part, blocks = known.value, TaskContext.get().partitionId(), 0

        def flush(base: list[tuple], found: dict[int, list[tuple]]):
            block = part << 32 | blocks
            lists = list(map(list, zip(*base, strict=True)))
            out = [(block % n_buckets, block, b"", b"", b"", b"", *lists)]
            for b, own in found.items():
                words = [w.encode("utf-8") for w, _, _ in own]
                sizes, place, freq = (np.array(x, k).tobytes() for x, k in (([len(w) for w in words], "<u4"), ([i for _, i, _ in own], "<u2"), ([f for _, _, f in own], "<u4")))
                out.append((b, block, b"".join(words), sizes, place, freq, None, None, None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

        held: dict[int, list[tuple]] = defaultdict(list)
        base: list[tuple] = []
        size = 0
        for piece in slices(batches):
            for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                total = 0
                for w, f in Counter(words_of(text)).items() if text else ():
                    p = pieces.get(w)
                    if p is not None:
                        total += p * f
                    else:
                        held[xxhash.xxh32_intdigest(w) % n_buckets].append((w, len(base), f))
                base.append((doc, len((text or "").encode("utf-8")), total))
                size += base[-1][1]
                if len(base) >= GATHER or size > 1 << 24:
                    yield flush(base, held)
                    held.clear()
                    base, size, blocks = [], 0, blocks + 1
        if base:
            yield flush(base, held)

    partial_fields = "block bigint, place binary, pieces binary, doc array<bigint>, bytes array<bigint>, total array<bigint>"

    def joined(table: pa.Table) -> pa.Table:
        lists = []
        for data, sizes in zip(table.column("words").to_pylist(), table.column("lengths").to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
            lists.append([data[i:j] for i, j in zip([0, *ends], ends)])
        distinct = list(set().union(*lists))
        pieces = dict(zip(distinct, piece_counts(path).count([w.decode("utf-8") for w in distinct]), strict=True))
        places, sums = [], []
        for words, place, freq in zip(lists, table.column("place").to_pylist(), table.column("freq").to_pylist(), strict=True):
            at, which = np.unique(np.frombuffer(place, "<u2"), return_inverse=True)
            n = np.fromiter(map(pieces.__getitem__, words), np.float64, len(words)) * np.frombuffer(freq, "<u4")
            places.append(at.astype("<u2").tobytes())
            sums.append(np.bincount(which, n, len(at)).astype("<u8").tobytes())
        columns = [table.column("block").combine_chunks(), pa.array(places, pa.binary()), pa.array(sums, pa.binary()), *(table.column(c).combine_chunks() for c in ("doc", "bytes", "total"))]
        return pa.table(columns, names=[f.split()[0] for f in partial_fields.split(", ")])

    def merged(table: pa.Table) -> pa.Table:
        rows_ = table.to_pylist()
        base = next(r for r in rows_ if r["doc"] is not None)
        total = np.array(base["total"], np.int64)
        for r in rows_:
            total[np.frombuffer(r["place"], "<u2")] += np.frombuffer(r["pieces"], "<i8")
        return pa.table([pa.array(base["doc"], pa.int64()), pa.array(base["bytes"], pa.int64()), pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    partial = rows.mapInArrow(dealt, fields).groupBy("bucket").applyInArrow(joined, partial_fields)
    return partial.groupBy("block").applyInArrow(merged, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
