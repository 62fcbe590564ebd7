"""Collocations by Suffix-sigma: truncated suffixes, shuffled by language and first word, sorted, counted by one stack.

Texts are cut into pieces at punctuation and line ends, pieces into words. Every word begins a suffix of at most
``LONGEST`` words of its piece. Two passes over the texts:

1. All n-grams of one to ``SHORT`` words are counted into hash buckets, a saturating count each. A bucket below
   the least frequency holds no frequent n-gram, so a suffix is cut before the first n-gram that can't be frequent.
   One bit of each bucket (2 MB, at any input size) is sent to all tasks. A corpus of many GB of text fills the
   buckets, so ever less is cut there and the second pass sends longer suffixes; results don't depend on it.
2. The cut suffixes, counted first, are dealt by language and first word. Where one first word has more
   than 1/``HOT_PARTS`` of the rows, its suffixes are dealt by two words, and so on; a prefix that is dealt to
   several tasks gets a part of its count in each, and parts are summed.

In each task suffixes are sorted in falling order, so the words of the current suffix form a stack: a prefix's count
is complete when it is popped. Frequent phrases are then joined to their parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUES, U, materialize, mixed, powers, slices, temporary, tidy

#: Words of the longest phrase, of the longest n-gram that is counted into buckets.
LONGEST, SHORT = 5, 3
#: Buckets (a power of two) of the n-gram counts, buckets of a row, largest count of a bucket in a task.
BITS, BLOCK, FULL = 24, 1 << 12, 255
#: n-grams that are gathered before they are added to the buckets.
GATHERED = 1 << 22
#: A prefix with more than this share of the rows is dealt by one word more.
HOT_PARTS = 500
#: Texts turned into words at once; what they share is counted before Spark counts on.
ROWS = 128

TABLE = bytes(0x0A if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Words:
    """The words of some texts: hashes, borders in ``data``, pieces, and the n-grams that begin at each word."""

    def __init__(self, texts: list[bytes], seeds: list[int]) -> None:
        self.data = b"".join(t + b"\n" for t in texts).translate(TABLE)
        raw = np.frombuffer(self.data, np.uint8)
        line = raw == 0x0A
        gap = line | (raw == 0x20)
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1  # the last byte is a line end
        if len(gap) and not gap[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(line)[self.start]
        power, inverse = powers(len(raw))
        total = BYTE_VALUES[raw]
        total *= power[: len(raw)]
        np.cumsum(total, out=total)
        self.word = mixed((total[self.end - 1] - np.where(self.start > 0, total[self.start - 1], U(0))) * inverse[self.start])
        first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
        self.counts = np.diff(first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.seed = np.array(seeds, U)[self.doc] if len(texts) else np.empty(0, U)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to LONGEST words: (hash of the n-gram from each word on, is it within one piece)."""
        h, n = mixed(self.word ^ self.seed), len(self.word)
        yield h, np.ones(n, bool)
        for k in range(1, LONGEST):
            h, inside = h.copy(), np.zeros(n, bool)
            if n > k:
                h[: n - k] = mixed(h[: n - k] * BASE + self.word[k:])
                inside[: n - k] = self.piece[k:] == self.piece[: n - k]
            yield h, inside


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int32)


def texts_of(piece: pa.RecordBatch) -> tuple[list[str], Words]:
    """Languages and words of rows (lang, text as bytes), neither of them null."""
    langs, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
    return langs, Words(texts, [xxhash.xxh64_intdigest(x) for x in langs])


def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, at, n): a task's counts of buckets, by blocks; ``at`` is null where the block's counts are all given."""
    counts = np.zeros(1 << BITS, np.uint8)
    held: list[np.ndarray] = []

    def add() -> None:
        new = np.concatenate(held)
        new.sort()
        first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
        at = new[first]
        counts[at] = np.minimum(counts[at] + np.diff(first, append=len(new)), FULL)
        held.clear()

    for piece in slices(batches, ROWS):
        held += [bucket(h[inside]) for h, inside in islice(texts_of(piece)[1].grams(), SHORT)]
        if sum(map(len, held)) >= GATHERED:
            add()
    if sum(map(len, held)):
        add()
    blocks = counts.reshape(-1, BLOCK)
    full = np.concatenate([np.flatnonzero(b.any(1)) + i for i, b in ((i, blocks[i : i + 1024]) for i in range(0, len(blocks), 1024))])
    for some in np.array_split(full, max(1, len(full) // 512)):
        ats, ns = [], []
        for b in some:
            at = np.flatnonzero(blocks[b])
            few = 3 * len(at) < BLOCK
            ats.append(at.astype(np.uint16).tobytes() if few else None)
            ns.append((blocks[b][at] if few else blocks[b]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(ats, pa.binary()), pa.array(ns, pa.binary())], names=["block", "at", "n"])


def frequent_buckets(rows: DataFrame, least: int) -> bytes:
    """One bit a bucket: do its n-grams occur ``least`` times together, or as often as a task counts?"""

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = counts.setdefault(block, np.zeros(BLOCK, np.uint16))
                some = np.frombuffer(n, np.uint8)
                if at is None:
                    mine += some
                else:
                    mine[np.frombuffer(at, np.uint16)] += some
                np.minimum(mine, 2 * FULL, out=mine)
        blocks = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([np.packbits(counts[b] >= min(least, FULL)).tobytes() for b in blocks], pa.binary())], names=["block", "bits"])

    counted = rows.mapInArrow(tidy(sketch_rows), "block int, at binary, n binary").repartition("block").mapInArrow(tidy(run), "block int, bits binary")
    out = bytearray((1 << BITS) // 8)
    for r in counted.collect():  # at most 4096 rows of 512 bytes
        out[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = r.bits
    return bytes(out)


def suffix_rows(rows: DataFrame, frequent: bytes) -> DataFrame:
    """(lang, s, c): cut suffixes, each word followed by a space, with their counts; an empty ``s`` counts all words.

    Tasks count within a batch, Spark within a task before it shuffles and then over all tasks.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        packed = np.frombuffer(shared.value, np.uint8)
        for piece in slices(batches, ROWS):
            langs, w = texts_of(piece)
            key, length = np.zeros(len(w.word), U), np.zeros(len(w.word), np.int64)
            alive = short = np.ones(len(w.word), bool)
            for k, (h, inside) in enumerate(w.grams()):
                alive = alive & inside
                if k < SHORT:
                    at = bucket(h[alive])
                    alive[alive] = packed[at >> 3] << (at & 7).astype(np.uint8) & 0x80
                else:  # the n-gram of its last words must be frequent too
                    alive &= np.append(short[k - SHORT + 1 :], np.zeros(k - SHORT + 1, bool))[: len(alive)]
                short = alive if k == SHORT - 1 else short
                key[alive] = h[alive]
                length += alive
            at = np.flatnonzero(length)
            _, first, n = np.unique(key[at], return_index=True, return_counts=True)
            at = at[first]
            last = at + length[at] - 1
            suffixes = [w.data[a:b] + b" " for a, b in zip(w.start[at].tolist(), w.end[last].tolist(), strict=True)]
            if len(at):
                odd = np.concatenate([[0], np.cumsum(w.start[1:] - w.end[:-1] != 1)])
                for i in np.flatnonzero(odd[last] != odd[at]).tolist():  # more than a space between words
                    suffixes[i] = b" ".join(filter(None, suffixes[i].split(b" "))) + b" "
            lang = pa.DictionaryArray.from_arrays(np.concatenate([w.doc[at], np.arange(len(langs))]).astype(np.int32), pa.array(langs, pa.string())).dictionary_decode()
            counts = np.concatenate([n, w.counts])
            yield pa.RecordBatch.from_arrays([lang, pa.array(suffixes + [b""] * len(langs), pa.binary()), pa.array(counts, pa.int64())], names=["lang", "s", "c"])

    return rows.mapInArrow(tidy(run), "lang string, s binary, c bigint").groupBy("lang", "s").agg(F.sum("c").alias("c"))


def prefix(k: int) -> Column:
    """Language and the first ``k`` words of a suffix."""
    return F.concat("lang", F.lit(" "), F.substring_index(F.col("s").cast("string"), " ", k))


def hot_prefixes(suffixes: DataFrame) -> list[list[str]]:
    """For 1, 2, ... words: the prefixes with more than 1/HOT_PARTS of the rows, so at most HOT_PARTS of each length."""
    limit = max(64, suffixes.count() // HOT_PARTS)
    found: list[list[str]] = []
    rows = suffixes
    for k in range(1, LONGEST):
        counted = rows.groupBy(prefix(k).alias("p")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
        found.append([r.p for r in counted.collect()])
        if not found[-1]:
            break
        rows = rows.where(prefix(k).isin(found[-1]))
    return found


class Stack:
    """Counts of all prefixes of suffixes that come in falling order."""

    def __init__(self, least: int, parted: set[tuple[str, bytes]]) -> None:
        self.least, self.parted = least, parted
        self.lang: str | None = None
        self.words: list[bytes] = []
        self.counts: list[int] = []
        self.out: list[tuple[str, int, bytes, int]] = []

    def pop(self, depth: int) -> None:
        """Complete all prefixes that are longer than ``depth`` words."""
        while len(self.words) > depth:
            c, k = self.counts.pop(), len(self.words)
            if k > 1:
                self.counts[-1] += c
            phrase = b" ".join(self.words) if c >= self.least or self.parted else b""
            if c >= self.least or (self.lang, phrase) in self.parted:
                self.out.append((self.lang, k, phrase, c))
            self.words.pop()

    def push(self, lang: str, s: bytes, c: int) -> None:
        w = s.split(b" ")[:-1]
        if lang != self.lang:
            self.pop(0)
            self.lang = lang
        same = 0
        for x, y in zip(w, self.words):  # noqa: B905  the shorter one ends it
            if x != y:
                break
            same += 1
        self.pop(same)
        self.words += w[same:]
        self.counts += [0] * (len(w) - same)
        self.counts[-1] += c


def prefix_counts(suffixes: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of k words that occur ``least`` times."""
    hot = hot_prefixes(suffixes)
    key = F.col("s").cast("string")
    key = F.concat("lang", F.lit(" "), key)
    for k in range(len(hot), 0, -1):
        key = F.when(prefix(k).isin(hot[k - 1]), key).otherwise(prefix(k)) if hot[k - 1] else prefix(k)
    parted = {(p.partition(" ")[0], p.partition(" ")[2].encode()) for ps in hot for p in ps}
    names = ["lang", "k", "phrase", "c"]

    def run(batches):
        stack = Stack(least, parted)

        def out() -> pa.RecordBatch:
            columns = list(zip(*stack.out, strict=True)) or [()] * 4
            stack.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=names)

        for batch in slices(batches, 8192):
            for lang, s, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stack.push(lang, s, c)
            yield out()
        stack.pop(0)
        yield out()

    dealt = suffixes.repartition(key).sortWithinPartitions("lang", F.desc("s"))
    parts = dealt.mapInArrow(tidy(run), "lang string, k int, phrase binary, c bigint")
    return parts.groupBy("lang", "k", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("c").alias("f")).where(F.col("f") >= least)


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more that no longer one with as many occurrences holds."""
    w = F.split("phrase", " ", -1)
    part = lambda first, n: F.array_join(F.slice(w, first, n), " ")
    # a longer phrase with an equal count anywhere means one with a word more: counts between them are equal too
    inner = phrases.where("k > 2").select("lang", F.explode(F.array(part(1, F.col("k") - 1), part(2, F.col("k") - 1))).alias("phrase"), F.col("f").alias("a")).distinct()
    own = phrases.where("k > 1").withColumnRenamed("f", "a").join(inner, ["lang", "phrase", "a"], "left_anti")
    cuts = own.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    joined = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products have up to 38 digits
    joined = joined.withColumn("above", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(16,0)") * F.col("n").cast("decimal(16,0)")).withColumn("below", wide("l") * wide("r"))
    best = joined.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each language with ranks, from a global sort: no language meets in one task."""
    order = materialize(rows.orderBy("lang", F.desc("score"), F.desc("a"), "phrase").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    spans = order.groupBy("lang", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    spans = materialize(spans)  # a row a language and task
    before = spans.alias("x").join(spans.alias("y"), F.expr("x.lang = y.lang and y.part < x.part"), "left").groupBy("x.lang", "x.part", "x.first").agg(F.coalesce(F.sum("y.rows"), F.lit(0)).alias("before"))
    placed = order.withColumn("part", part).join(before, ["lang", "part"])
    return placed.withColumn("rank", F.col("at") - F.col("first") + F.col("before") + 1).where(F.col("rank") <= k).drop("at", "first", "before", "part")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to 5 words by association.

    ``a`` occurrences of the phrase, of ``l`` of its first part and ``r`` of the rest at the cut with the lowest score
    (of equal scores the earliest), ``n`` words of the language; score is floor(1000 * a * n / (l * r)). A null text is
    empty, a null language ``und``. Long texts are taken whole; repeated rows count each; tables without words or
    frequent phrases give no rows; other columns are never read. Equal scores go by falling ``a``, then by the
    phrase's bytes. Counts and totals are exact up to 10**16 words.
    """
    with temporary() as keep:
        rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
        found = materialize(suffix_rows(rows, frequent_buckets(rows, least)))
        totals = found.where("s = X''").groupBy("lang").agg(F.sum("c").alias("n")).where("n > 0")
        phrases = materialize(prefix_counts(found.where("s <> X''"), least))
        out = materialize(scored(phrases, totals))
        return keep(materialize(ranked(out, top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")))
