"""Periodic runs of words: lags are counted before anything is looked at.

A run of period q and at least max(6, 4q) words holds at least max(6 - q, 3q) places whose word comes again q words
later. For every text the number of such places is counted exactly for every lag up to a quarter of the text: words
that are frequent in it by the autocorrelation of where they stand (FFT), the others by the differences of their
places. Only lags with enough matches are scanned for islands of matches. Any 3q consecutive places hold three
multiples of q, so islands are sought at multiples of the lag alone; those within a run whose period divides the lag
are that run again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

#: Fewest words of a run, fewest repetitions.
LEAST, TIMES = 6, 4
#: Texts whose lags are counted together, words at which such a batch ends early.
TEXTS, WORDS = 256, 200_000


@dataclass(frozen=True)
class Run:
    """A maximal periodic stretch of words."""

    start: int
    length: int
    period: int


def needed(lag: np.ndarray | int) -> np.ndarray | int:
    """Matches at a lag that a run of this period has at least."""
    return np.maximum(LEAST - lag, (TIMES - 1) * lag)


def smooth(n: int) -> int:
    """The smallest product of twos, threes and fives that is at least ``n``: a good length for an FFT."""
    best, three = 1 << (n - 1).bit_length(), 1
    while three < best:
        five = three
        while five < best:
            best = min(best, five << max(0, (-(-n // five) - 1).bit_length()))
            five *= 5
        three *= 3
    return best


def lag_counts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text (word numbers from 0) the matches at lags 0 to a quarter of its length; entry 0 means nothing."""
    sizes = np.array([len(t) for t in texts], np.int64)
    longest = sizes // TIMES
    base = np.concatenate([[0], np.cumsum(longest + 1)])
    total = np.zeros(base[-1], np.int64)
    words = np.concatenate([[0], np.cumsum([int(t.max(initial=-1)) + 1 for t in texts])])
    key = np.concatenate([t + w for t, w in zip(texts, words, strict=False)]) if texts else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    often = np.bincount(key, minlength=words[-1])
    # an FFT costs some n log n, the differences of a word its count squared
    heavy = often[key] > np.maximum(32, np.sqrt(sizes * np.log2(np.maximum(2, sizes))))[doc]
    order = np.argsort(key, kind="stable")
    order = order[~heavy[order]]
    k, p, d = key[order], place[order], doc[order]
    at, found, held = np.arange(len(k)), [], 0
    for step in range(1, len(k)):
        at = at[at + step < len(k)]
        at = at[k[at + step] == k[at]]
        far = p[at + step] - p[at]
        near = far <= longest[d[at]]  # places of a word rise, so a later one is farther
        at, far = at[near], far[near]
        if not len(at):
            break
        found.append(base[d[at]] + far)
        held += len(at)
        if held > 1 << 21:
            total += np.bincount(np.concatenate(found), minlength=len(total))
            found, held = [], 0
    if found:
        total += np.bincount(np.concatenate(found), minlength=len(total))
    for t in np.unique(doc[heavy]).tolist():
        own, m = texts[t], int(longest[t])
        size = smooth(len(own) + m + 1)
        power = np.zeros(size // 2 + 1)
        for w in np.unique(own[often[own + words[t]] > max(32, np.sqrt(len(own) * np.log2(max(2, len(own)))))]).tolist():
            f = np.fft.rfft((own == w).astype(np.float64), size)
            power += f.real**2 + f.imag**2
        total[base[t] : base[t + 1]] += np.rint(np.fft.irfft(power, size)[: m + 1]).astype(np.int64)
    return [total[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


def matches(w: np.ndarray, lag: int, at: int, step: int) -> int:
    """Matches at the lag from ``at`` on without a gap, to the right or (step -1) to the left."""
    n, size = 0, 64
    last = len(w) - lag
    while True:
        a, b = (at + n, min(last, at + n + size)) if step > 0 else (max(0, at - n - size + 1), at - n + 1)
        if a >= b:
            return n
        same = w[a:b] == w[a + lag : b + lag]
        same = same if step > 0 else same[::-1]
        gap = int(same.argmin())
        if not same[gap]:
            return n + gap
        n, size = n + b - a, size * 4


def islands(w: np.ndarray, counts: np.ndarray) -> list[Run]:
    """All runs of a text, from its matches by lag, by start and period."""
    lags = np.arange(len(counts))
    runs: list[Run] = []
    for q in (np.flatnonzero(counts[1:] >= needed(lags[1:])) + 1).tolist():
        every = w[::q]
        same = every[1:] == every[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q if len(same) > 2 else np.empty(0, np.int64)
        for r in runs if len(at) else ():
            if q % r.period == 0:  # islands within a run of such a period are that run again
                at = at[(at < r.start) | (at + 3 * q >= r.start + r.length)]
        while len(at):
            a = int(at[0])
            start = a + 1 - matches(w, q, a, -1)
            length = a + matches(w, q, a, 1) - start + q
            if length >= max(LEAST, TIMES * q) and not any(q % r.period == 0 and r.start <= start and start + length <= r.start + r.length for r in runs):
                runs.append(Run(start, length, q))
            at = at[at + q >= start + length]
    return sorted(runs, key=lambda r: (r.start, r.period))


def planted(w: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as they are to be searched: of every tenth checksum of an id, from a place on, repeated."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + (w[a : a + p] * (-(-(n - a) // p)))[: n - a]


def best(runs: list[Run]) -> Run | None:
    """The greatest exponent; of equal ones the smallest start, then period."""
    top = None
    for r in runs:  # by start and period
        if top is None or r.length * top.period > top.length * r.period:
            top = r
    return top


def collapsed(w: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without a run's repetitions after its first period."""
    gone = np.zeros(len(w) + 1, np.int64)
    for r in runs:
        gone[r.start + r.period] += 1
        gone[r.start + r.length] -= 1
    return [x for x, out in zip(w, np.cumsum(gone)[:-1].tolist(), strict=True) if not out] if runs else w


def groups(rows: Iterator[tuple[int | None, list[bytes]]]) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Rows in batches of a bounded number of texts and, but for the last text, of words."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1])
        if len(held) >= TEXTS or n >= WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def numbered(w: list[bytes]) -> np.ndarray:
    """Words as numbers in order of first use."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w))


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text."""
    numbers = [numbered(w) for w in texts]
    return [islands(w, c) for w, c in zip(numbers, lag_counts(numbers), strict=True)]


def periodic_runs(docs: DataFrame, plant: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed): the periodic runs of every text.

    ``runs`` lists all of them (start, length, period) by start and period, ``collapsed`` is the text without
    repetitions, words joined by one space; start to exponent_milli are of the run with the greatest exponent, null
    if there is none. With ``plant`` a tenth of the texts is made periodic first, by their ids. Words are parted by
    white space of ASCII. Null and empty texts have no runs and an empty ``collapsed``; a null id plants nothing; long
    texts are taken whole; repeated rows are judged each; an empty table gives no rows; other columns are never read.
    """
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        def rows():
            for piece in slices(batches):
                for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    w = (t or b"").split()
                    yield i, planted(w, i) if plant else w

        for some in groups(rows()):
            found = find_runs([w for _, w in some])
            top = [best(r) for r in found]
            columns = [pa.array([i for i, _ in some], pa.int64()), pa.array(map(len, found), pa.int64())]
            columns += [pa.array([t and getattr(t, name) for t in top], pa.int64()) for name in ("start", "length", "period")]
            columns.append(pa.array([t and 1000 * t.length // t.period for t in top], pa.int64()))
            columns.append(pa.array([[{"start": r.start, "length": r.length, "period": r.period} for r in rs] for rs in found], runs_type))
            columns.append(pa.array([b" ".join(collapsed(w, rs)) for (_, w), rs in zip(some, found, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed binary"
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def digests(found: DataFrame) -> DataFrame:
    """The runs and the collapsed text of :func:`periodic_runs` as SHA-256."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def digest(rows: list[Run]) -> str:
    """What :func:`digests` gives for a list of runs."""
    return hashlib.sha256("".join(f"{r.start},{r.length},{r.period}\n" for r in rows).encode()).hexdigest()
