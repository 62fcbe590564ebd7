"""Packing documents into fixed-length sequences: first-fit decreasing over a tournament tree.

A document's ids (with the closing id) are cut into full sequences and one remainder. Full ones need no
partner. Remainders are dealt into randomised groups, and each group is packed on its own by first-fit
decreasing: the leftmost bin with room is found by walking down a tournament tree whose inner nodes hold the
larger free capacity of their children. What is shuffled are piece lengths and checksums, never ids.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import CHUNK, MEMO_CHARS
from .common import Memo, in_worker, map_arrow

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Expected remainders in a group; FFD's waste is below a bin or two a group from here on.
GROUP_PIECES = 4096
#: Chunks whose ids a worker remembers; some 250 bytes each.
MEMO_ENTRIES = 1_000_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, grp bigint"


class Capacities:
    """Tournament tree over bins that are opened from left to right; ``place`` is first fit."""

    def __init__(self, capacity: int, most_bins: int) -> None:
        self.capacity, self.opened = capacity, 0
        self.leaves = 1 << max(0, (max(1, most_bins) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece in the leftmost bin with room for it."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        b, offset = node - self.leaves, self.capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        self.opened = max(self.opened, b + 1)
        return b, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each size, in the order given; sizes are placed from the largest to the smallest."""
    tree = Capacities(capacity, len(sizes))
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        placed[i] = tree.place(sizes[i])
    return placed


class LibraryTokens:
    """Ids of whole texts by a ``tokenizers`` file with byte-level pre-tokens; each distinct chunk is encoded once.

    The library cuts a text at its added tokens first; a text that holds one of their strings is given to it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.memo = Memo(MEMO_ENTRIES, MEMO_CHARS)

    def compute(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts, straight from the library."""
        found = []
        for i in range(0, len(texts), 4096):
            found += [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        chunks = [None if not t or (self.special and self.special.search(t)) else CHUNK.findall(t) for t in texts]
        out = self.memo.join(chunks, self.compute)
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.compute([t])[0] if t else b""
        return out


def library_tokens(path: str) -> LibraryTokens:
    """One tokenizer for each worker process."""
    return in_worker(("packing", path), lambda: LibraryTokens(path))


def mix(*values: int) -> int:
    """A 63-bit hash of integers, the same everywhere."""
    h = 0x9E3779B97F4A7C15
    for v in values:
        h = ((h ^ (v & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h >> 1


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, groups: int | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of sequences of ``capacity`` ids.

    Every row of ``docs`` is packed: a null or empty text is its closing id alone; repeated rows are packed
    again, each on its own; a text of any length is cut into full sequences and a remainder; an empty table
    gives no pieces. Groups are randomised by id, checksum and the row's turn among equal rows, so copies and
    repeated ids spread; their number follows the count of rows unless given. Columns other than the two
    named are never read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_groups = groups or max(1, -(-rows.select("doc_id").count() // GROUP_PIECES))

    def make():
        tokens, seen, part = library_tokens(path), {}, TaskContext.get().partitionId()
        closing, full = array("I", [end_id]).tobytes(), [0]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for doc, packed in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                packed += closing
                n = len(packed) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    crc = zlib.crc32(packed[4 * start : 4 * (start + length)])
                    if length == capacity:
                        out.append((doc, start, length, crc, n, part << 36 | full[0], None))
                        full[0] += 1
                    else:
                        key = (doc or 0, n, crc)
                        turn = seen[key] = seen.get(key, -1) + 1
                        out.append((doc, start, length, crc, n, None, mix(seed, *key, turn, part if turn else 0) % n_groups))
            kinds = zip(*out, strict=True) if out else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in kinds], names=[x.split()[0] for x in PIECES.split(", ")])

        return run

    pieces = map_arrow(rows, make, PIECES)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        grp, alone = table.column("grp").to_pylist(), table.column("sequence_id").to_pylist()
        lengths = table.column("length").to_pylist()
        placed = first_fit_decreasing(lengths, capacity) if table.num_rows and grp[0] >= 0 else []
        ids = [(1 << 62) | grp[0] << 32 | b for b, _ in placed] if placed else alone
        offsets = [o for _, o in placed] if placed else [0] * len(alone)
        columns = [table.column(c).combine_chunks() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        return pa.table([*columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # full sequences are in negative groups, as large as the others
    dealt = pieces.withColumn("grp", F.coalesce("grp", -1 - F.floor(F.col("sequence_id") / F.lit(GROUP_PIECES)).cast("bigint")))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("grp").applyInArrow(pack, schema)
