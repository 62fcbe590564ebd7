"""Exact Jaccard self-join of word-shingle sets by universe partitioning and the pigeonhole principle.

Two sets of sizes s <= r with Jaccard similarity of at least t differ in at most H = (1-t)/(1+t) * (r+s)
shingles. The universe of shingles is hashed into m segments whose number depends on the smaller set's size
band; any H+1 segments of which a pair differs in at most H shingles hold one in which the pair agrees. So every
set is indexed under all segments of its band, and it probes its own band and the next smaller one with the
H+1 segments that cost least: those with the most shingles that aren't common in the corpus. In bands of small
sets, where segments are few, a segment may also be probed for one differing shingle (its neighbourhood of
one-deletion variants is indexed there); that counts for two segments. Candidates are verified exactly.

Groups of copies stay cheap: equal sets are one class. Members of a segment's bucket are first compared with one
of them only; after the links found so far are closed, the remaining pairs of a bucket are compared only if
their components differ, which can't lose a connection between two components, and only if an upper bound of
their overlap, from bitmaps, allows it. Buckets are pre-aggregated in the same way before the shuffle, so no task
meets a hot bucket whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, in_worker, materialize, slices, temporary, tidy, tidy_group

U = np.uint64
WORDS = 5
#: Odd multipliers of a shingle's words and of the mixing steps.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)
MIX_A, MIX_B, MIX_C = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xFF51AFD7ED558CCD)
MEMO_WORDS = 200_000
#: Documents (or bytes of text) whose keys are gathered and pre-aggregated together.
GATHER_DOCS, GATHER_BYTES = 2048, 12 << 20
#: Keys of buckets (17 bytes each) that meet in one reducing group, and bytes of bitmaps compared in one.
PART_KEYS, PART_BYTES = 1 << 20, 16 << 20
#: Sets below this size are in bands whose one-deletion neighbourhoods are indexed.
SMALL = 28
#: Common shingles: share of documents from which one is common, and how many are broadcast at most (8 bytes each).
COMMON_SHARE, COMMON_MOST = 0.0005, 65_536
INDEX, PROBE, GROUP = 1, 2, 4


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of whole texts; word hashes are kept in a bounded memo."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """The text's set: 5-word shingles of the A-Z lowered words, or the whole sequence if it is shorter."""
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.empty(0, U)
        memo = self.memo
        if missing := set(words).difference(memo):
            if len(memo) > MEMO_WORDS:
                memo.clear()
                missing = set(words)
            for w in missing:
                memo[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), U, len(words))
        n = len(words) - WORDS + 1
        if n < 1:
            return mix((h * PLACES[: len(h)]).sum(keepdims=True, dtype=U) + U(len(h)))
        total = h[:n] * PLACES[0]
        for i in range(1, WORDS):
            total += h[i : i + n] * PLACES[i]
        return np.unique(mix(total))


def shingler() -> Shingler:
    """One for each worker process."""
    return in_worker("jaccard_join", Shingler)


def class_id(shingles: np.ndarray) -> int:
    """Signed 64-bit id of a set: equal sets have equal ids, different sets differ but for 64-bit collisions."""
    return int(mix(mix(shingles ^ MIX_C).sum(keepdims=True, dtype=U) + U(len(shingles))).astype(np.int64)[0])


class Plan:
    """Size bands, thresholds and segment numbers for a similarity of ``num / den``."""

    def __init__(self, num: int = 4, den: int = 5, slack: float = 0.05) -> None:
        self.num, self.den = num, den
        lows = [next(s for s in range(1, 1 << 20) if self.most_errors(s, self.largest(s)) > 0)]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 2, -(-3 * lows[-1] // 2)))
        self.lows = np.array(lows, np.int64)
        highs = self.lows[1:] - 1
        need = [self.most_errors(int(h), self.largest(int(h))) + 1 for h in highs]
        self.highs = highs
        self.segments = np.array([n + max(1, int(slack * n)) for n in need], np.int64)

    def largest(self, s: int) -> int:
        """The largest set that can be similar to one of ``s`` shingles."""
        return s * self.den // self.num

    def most_errors(self, s: int, r: int) -> int:
        """Shingles in which similar sets of sizes s and r differ at most."""
        return (self.den - self.num) * (r + s) // (self.den + self.num)

    def bands(self, n: np.ndarray) -> np.ndarray:
        """Band of each size; -1 where only equal sets are similar."""
        return np.searchsorted(self.lows, n, "right") - 1


def segment_of(x: np.ndarray, band: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Segment of each shingle among ``m``; each band has its own hash."""
    h = mix(x + (band.astype(U) + U(1)) * PLACES[1]) >> U(32)
    return ((h * m.astype(U)) >> U(32)).astype(np.int64)


def key_of(space: int, band: np.ndarray, segment: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Bucket key of a segment's content, which is the wrapping sum of its mixed shingles."""
    return mix(content ^ mix(band.astype(U) * PLACES[2] + segment.astype(U) * PLACES[3] + U(space)))


def sums_by(groups: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Wrapping 64-bit sums by group, through two exact sums of halves."""
    low = np.bincount(groups, (values & U(0xFFFFFFFF)).astype(np.float64), size).astype(U)
    high = np.bincount(groups, (values >> U(32)).astype(np.float64), size).astype(U)
    return low + (high << U(32))


def allocate(rare: list[int], full: list[int], credits: int, deletions: bool) -> list[int]:
    """Probe level of each segment (0 none, 1 exact, 2 one deletion) of least cost that earns ``credits``.

    The cost of a level falls with the number of rare shingles in a segment; the second credit of a segment
    never costs less than its first, so taking the cheapest next credit is optimal.
    """
    options = []
    for i, (r, k) in enumerate(zip(rare, full, strict=True)):
        options.append((8.0**-r, -k, 0, i))
        if deletions:
            options.append(((k + 1) * 8.0 ** (1 - r), -k, 1, i))
    levels = [0] * len(rare)
    for _, _, _, i in sorted(options)[:credits]:
        levels[i] += 1
    return levels


def entries(sets: list[np.ndarray], ids: np.ndarray, plan: Plan, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, id, flags) of all sets: index entries of the own band, probes of the own and the next smaller band."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own = plan.bands(sizes)
    keys, owners, flags = [], [], []
    for step in (0, 1):
        band = own - step
        ok = (own >= 0) & (band >= 0)
        if step:  # the next smaller band may hold sets that are similar
            ok &= -(-sizes * plan.num // plan.den) <= plan.highs[np.maximum(band, 0)]
        pick = np.flatnonzero(ok)
        if not len(pick):
            continue
        x = np.concatenate([sets[i] for i in pick])
        n, b = sizes[pick], band[pick]
        m = plan.segments[b]
        errors = (plan.den - plan.num) * (n + np.minimum(n, plan.highs[b])) // (plan.den + plan.num)
        first = np.concatenate([[0], np.cumsum(m)])
        which = np.repeat(np.arange(len(pick)), n)
        seg = segment_of(x, b[which], m[which])
        flat = first[which] + seg
        mixed = mix(x ^ PLACES[4])
        content = sums_by(flat, mixed, first[-1])
        full = np.bincount(flat, minlength=first[-1])
        rare = np.bincount(flat, ~np.isin(x, common), first[-1]).astype(np.int64) if len(common) else full
        of = np.repeat(np.arange(len(pick)), m)
        order = np.lexsort((-full, -rare, of))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - first[of[order]]
        flag = np.where(rank < errors[of] + 1, PROBE, 0) | (0 if step else INDEX)
        small = plan.highs[b] < SMALL
        at = np.arange(first[-1]) - first[of]
        exact = key_of(0, b[of], at, content)
        keep = (flag > 0) & ~small[of]
        keys.append(exact[keep])
        owners.append(ids[pick][of[keep]])
        flags.append(flag[keep].astype(np.uint8))
        for d in np.flatnonzero(small):  # few and tiny sets: neighbourhoods and allocation
            part = slice(first[d], first[d + 1])
            level = allocate(rare[part].tolist(), full[part].tolist(), int(errors[d]) + 1, True)
            mine = which == d
            own_seg, own_mix = seg[mine], mixed[mine]
            bands_ = np.full(len(level), b[d])
            segs = np.arange(len(level))
            base = content[part]
            less_keys = base[own_seg] - own_mix
            lv = np.array(level)
            found = [(exact[part], (INDEX if not step else 0) | np.where(lv > 0, PROBE, 0))]
            if not step:
                found.append((key_of(1, bands_[own_seg], own_seg, less_keys), np.full(len(own_seg), INDEX)))
            found.append((key_of(1, bands_, segs, base), np.where(lv > 1, PROBE, 0)))
            found.append((key_of(0, bands_[own_seg], own_seg, less_keys), np.where(lv[own_seg] > 1, PROBE, 0)))
            for k, f in found:
                keys.append(k[f > 0])
                owners.append(np.full(int((f > 0).sum()), ids[pick][d]))
                flags.append(f[f > 0].astype(np.uint8))
    if not keys:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.uint8)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(flags)


def stars(key: np.ndarray, owner: np.ndarray, flag: np.ndarray):
    """Compare each bucket's members with one of them.

    Returns (pairs a, b with a the centre), (key, owner, flag) of buckets of which pairs remain to be looked at,
    and (key, owner, flag) that stand for the buckets in a later merge: the centres of large ones.
    """
    order = np.lexsort((owner, key))
    key, owner, flag = key[order], owner[order], flag[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    if len(key):
        flag = np.bitwise_or.reduceat(flag, np.flatnonzero(new))
    key, owner = key[new], owner[new]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(head)
    if not len(start):
        none = np.empty(0, np.int64)
        return (none, none), (key, owner, flag), (key, owner, flag)
    group = np.cumsum(head) - 1
    size = np.bincount(group)
    far = np.int64(1 << 62)
    at = np.arange(len(key))
    best = lambda bit: np.minimum.reduceat(np.where((flag & bit) == bit, at, far), start)
    both, probe, index = best(INDEX | PROBE), best(PROBE), best(INDEX)
    useful = (size > 1) & (probe < far) & (index < far)
    centre = np.where(both[group] < far, both[group], np.where(flag & PROBE, index[group], probe[group]))
    pair = useful[group] & (centre != at) & (centre < far)
    a, b = owner[centre[pair]], owner[at[pair]]
    marked = np.bitwise_or.reduceat(flag & GROUP, start) > 0
    rest = (useful & ((size > 2) | marked))[group]
    is_centre = np.zeros(len(key), bool)
    for c in (both, np.where(both < far, far, probe), np.where(both < far, far, index)):
        is_centre[c[c < far]] = True
    large = (useful & (size > 2))[group]
    stay = ~large | is_centre
    later = np.where(large | marked[group], flag | GROUP, flag)
    return (a, b), (key[rest], owner[rest], flag[rest] & 3), (key[stay], owner[stay], later[stay].astype(np.uint8))


BLOB = "part int, key_low binary, key_high binary, ids binary, counts binary, flags binary, pairs binary, rest_key binary, rest_id binary, rest_flag binary"
FOUND = "kind int, a bigint, b bigint, n bigint"


def key_blobs(rows: DataFrame, parts: int, plan: Plan, common) -> DataFrame:
    """Keys of all documents as packed arrays, a row for each gathered batch and target partition."""
    names = [f.split()[0] for f in BLOB.split(", ")]

    def run(batches):
        sh, hot = shingler(), common.value
        seen_docs: dict[int, np.ndarray] = {}
        size = 0

        def flush():
            if not seen_docs:
                return
            ids = np.array(list(seen_docs), np.int64)
            key, owner, flag = entries(list(seen_docs.values()), ids, plan, hot)
            (a, b), rest, (key, owner, flag) = stars(key, owner, flag)
            part = (key % U(parts)).astype(np.int64)
            order = np.lexsort((owner, part))
            part, key, owner, flag = part[order], key[order] // U(parts), owner[order], flag[order]
            rest_part = (rest[0] % U(parts)).astype(np.int64)
            pair_part = (b.view(U) % U(parts)).astype(np.int64) if len(b) else b
            columns: list[list] = [[] for _ in names]
            for p in np.unique(np.concatenate([part, rest_part, pair_part])):
                i, j = np.searchsorted(part, [p, p + 1])
                o = owner[i:j]
                first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if j > i else np.empty(0, np.int64)
                counts = np.diff(np.append(first, j - i)).astype("<u4")
                r, q = rest_part == p, pair_part == p
                values = (
                    int(p), (key[i:j] & U(0xFFFFFFFF)).astype("<u4").tobytes(), ((key[i:j] >> U(32)) & U(0xFFFF)).astype("<u2").tobytes(), o[first].astype("<i8").tobytes(), counts.tobytes(), flag[i:j].tobytes(),
                    np.stack([a[q], b[q]]).astype("<i8").tobytes() if q.any() else b"", (rest[0][r] // U(parts) & U((1 << 48) - 1)).astype("<u8").tobytes(), rest[1][r].astype("<i8").tobytes(), rest[2][r].astype(np.uint8).tobytes(),
                )
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)

        for piece in slices(batches):
            for text in piece.column(0).to_pylist():
                if text:
                    s = sh.shingles(text)
                    if len(s):
                        seen_docs[class_id(s)] = s
                        size += len(text)
                if len(seen_docs) >= GATHER_DOCS or size >= GATHER_BYTES:
                    yield from flush()
                    seen_docs.clear()
                    size = 0
        yield from flush()

    return rows.select("text").mapInArrow(tidy(run), BLOB)


def bucket_pairs(blobs: DataFrame) -> DataFrame:
    """kind 0: star pairs (a, b) with their number of shared buckets; kind 1: members (a = key, b = id, n = flags) of buckets with more to do."""

    def reduce(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        get = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        key = get("key_low", "<u4").astype(U) | get("key_high", "<u2").astype(U) << U(32)
        owner = np.repeat(get("ids", "<i8"), get("counts", "<u4"))
        (a, b), rest, _ = stars(key, owner, get("flags", np.uint8))
        given = [np.frombuffer(p, "<i8").reshape(2, -1) for p in table.column("pairs").to_pylist() if p]
        a, b = np.concatenate([a, *(g[0] for g in given)]), np.concatenate([b, *(g[1] for g in given)])
        pairs, n = np.unique(np.stack([a, b]), axis=1, return_counts=True) if len(a) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
        rest_key = np.concatenate([rest[0], get("rest_key", "<u8")])
        rest_key = (mix(rest_key * U(65_537) + U(part))).view(np.int64)
        rest_id, rest_flag = np.concatenate([rest[1], get("rest_id", "<i8")]), np.concatenate([rest[2], get("rest_flag", np.uint8)]).astype(np.int64)
        kind = np.repeat(np.array([0, 1], np.int32), [len(n), len(rest_key)])
        columns = [np.concatenate(c).astype(np.int64) for c in ((pairs[0], rest_key), (pairs[1], rest_id), (n, rest_flag))]
        return pa.table([pa.array(kind), *map(pa.array, columns)], names=["kind", "a", "b", "n"])

    return blobs.groupBy("part").applyInArrow(tidy_group(reduce), FOUND)


def signatures(texts: DataFrame) -> DataFrame:
    """(id, size, bits): each class's set size and a bitmap of some eight to sixteen bits a shingle, a power of two in all."""

    def run(batches):
        sh = shingler()
        for piece in slices(batches):
            sets = [sh.shingles(t) for t in piece.column(1).to_pylist()]
            bits = []
            for x in sets:
                width = max(256, 1 << (8 * len(x) - 1).bit_length())
                flags = np.zeros(width, np.uint8)
                flags[(mix(x ^ MIX_B) & U(width - 1)).astype(np.int64)] = 1
                bits.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(bits, pa.binary())], names=["id", "size", "bits"])

    return texts.select("id", "text").mapInArrow(tidy(run), "id bigint, size bigint, bits binary")


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of ``width`` bytes; longer ones are folded, which is a bitmap by fewer bits of the same hash."""
    out = np.zeros((len(bits), width), np.uint8)
    for row, b in zip(out, bits, strict=True):
        np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0, out=row)
    return out


def overlaps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common bits of all pairs of rows, by matrix products over slices of the bitmaps."""
    total = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, left.shape[1], 512):
        x, y = (np.unpackbits(side[:, i : i + 512], axis=1, bitorder="little").astype(np.float32) for side in (left, right))
        total += x @ y.T
    return total


def open_groups(star: DataFrame, rest: DataFrame, labels: DataFrame) -> DataFrame:
    """(centre, id, c): members of stars and buckets whose components differ, under one member of each; ``labels`` is (id, component)."""
    label = lambda df, on, name: df.join(labels.select(F.col("id").alias(on), F.col("component").alias(f"_{name}")), on, "left").withColumn(name, F.coalesce(f"_{name}", on)).drop(f"_{name}")
    apart = label(label(star.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb")
    known = label(rest.select("a", "b"), "b", "c")
    mixed = materialize(known.groupBy("a").agg(F.min("b").alias("centre"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("a", "centre"))
    rows = known.join(mixed, "a").select("centre", F.col("b").alias("id"), "c")
    pairs = apart.select(F.col("a").alias("centre"), F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ca").alias("c")), F.struct(F.col("b").alias("id"), F.col("cb").alias("c")))).alias("m"))
    return rows.union(pairs.select("centre", "m.id", "m.c")).distinct()


def possible_pairs(groups: DataFrame, bits: DataFrame, plan: Plan, every: bool) -> DataFrame:
    """(a, b) within a group, of different components, whose bitmaps don't rule the similarity out.

    Two sets share at most as many shingles as their bitmaps share bits, plus the smaller number of shingles that
    fell on a bit already set. Groups are compared in blocks of bounded size. A group's largest component has blocks
    of its own, which meet the others' blocks only, so what one component holds isn't compared with itself. Without
    ``every`` a member names only its likeliest partner, else all that are possible.
    """
    num, den, block = plan.num, plan.den, 1024
    groups = materialize(groups)
    held = groups.groupBy("centre", "c").agg(F.count("*").alias("n")).groupBy("centre")
    held = held.agg(F.sum("n").alias("total"), F.max(F.struct("n", "c")).alias("most")).where(F.col("total") > F.col("most.n"))
    blocks_of = lambda n: F.ceil(n / F.lit(block)).cast("int")
    sizes = materialize(held.select("centre", F.col("most.c").alias("major"), blocks_of(F.col("most.n")).alias("ours"), blocks_of(F.col("total") - F.col("most.n")).alias("others")))
    major, every_block = F.col("c") == F.col("major"), F.col("ours") + F.col("others")
    own = F.when(major, F.pmod(F.xxhash64("id"), F.col("ours"))).otherwise(F.col("ours") + F.pmod(F.xxhash64("id"), F.col("others"))).cast("int")
    rows = groups.join(sizes, "centre").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.when(major, F.col("ours")).otherwise(F.lit(0)), every_block - 1)))
    rows = rows.select("centre", "id", "c", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    total = rows.join(bits.select("id", "size"), "id").agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-2 * total // PART_BYTES))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("centre", "i", "j"), F.lit(parts))).join(bits, "id")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("centre", "ascending"), ("i", "ascending"), ("j", "ascending")])
        key = np.stack([table.column(c).to_numpy() for c in ("centre", "i", "j")])
        head = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        ids, comps, own, size = (table.column(c).to_numpy() for c in ("id", "c", "own", "size"))
        bits_ = table.column("bits").to_pylist()
        found = [np.empty((2, 0), np.int64)]
        for start, stop in zip(head, [*head[1:], table.num_rows], strict=True):
            i, j = key[1, start], key[2, start]
            members = np.arange(start, stop)
            left, right = members[own[start:stop] == i], members[own[start:stop] == j]
            if not len(left) or not len(right) or (comps[members] == comps[start]).all():
                continue
            width = min(len(bits_[m]) for m in members)
            x = folded([bits_[m] for m in left], width)
            y = x if i == j else folded([bits_[m] for m in right], width)
            spare = lambda side, b: size[side] - np.bitwise_count(b).sum(1, dtype=np.int64)
            bound = overlaps(x, y) + np.minimum(spare(left, x)[:, None], spare(right, y)[None])
            bound = np.minimum(bound, np.minimum(size[left][:, None], size[right][None]))
            room = bound - num * (size[left][:, None] + size[right][None]) / (num + den)
            ok = (room > -1e-3) & (comps[left][:, None] != comps[right][None])
            if not every:
                best = np.zeros_like(ok)
                room = np.where(ok, room, -np.inf)
                best[np.arange(len(left)), room.argmax(1)] = True
                best[room.argmax(0), np.arange(len(right))] = True
                ok &= best
            p, q = np.nonzero(ok)
            a, b = ids[left[p]], ids[right[q]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))
        pairs = np.concatenate(found, axis=1)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return rows.groupBy("part").applyInArrow(tidy_group(run), "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose shingle sets are similar: exact, from the whole texts of both."""
    num, den = plan.num, plan.den

    def run(batches):
        sh = shingler()
        kept: dict[int, np.ndarray] = {}
        for piece in slices(batches, 256):
            a, b = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            ok = []
            for i, (x, y, tx, ty) in enumerate(zip(a, b, piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)):
                left = kept.get(x)
                if left is None:
                    if len(kept) > 64:
                        kept.clear()
                    left = kept[x] = sh.shingles(tx)
                right = sh.shingles(ty)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                if den * shared >= num * (len(left) + len(right) - shared):
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], names=["a", "b"])

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def describe(rows: DataFrame) -> DataFrame:
    """(doc_id, n, id, digest) of each row (doc_id, text, digest), and (count, -1, shingle, null) of shingles that are common within a gathered batch."""

    def run(batches):
        sh = shingler()
        held: list[np.ndarray] = []
        size = 0

        def common():
            x, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, U), np.empty(0, np.int64))
            often = n >= max(3, COMMON_SHARE * len(held))
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array(n[often]), pa.array(np.full(k, -1, np.int64)), pa.array(x[often].view(np.int64)), pa.nulls(k, pa.int64())], names=["doc_id", "n", "id", "digest"])

        for piece in slices(batches):
            n, ids = [], []
            for text in piece.column(1).to_pylist():
                s = sh.shingles(text)
                n.append(len(s))
                ids.append(class_id(s) if len(s) else None)
                held.append(s)
                size += len(s)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), piece.column(2)], names=["doc_id", "n", "id", "digest"])
            if size > 1 << 20:
                yield common()
                held, size = [], 0
        yield common()

    return rows.mapInArrow(tidy(run), "doc_id bigint, n bigint, id bigint, digest bigint")


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, digest of the text) of any table: what tells rows with one id apart."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))


def component_rows(docs: DataFrame, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, id, digest, component_id, chosen) of every row, written.

    id is its set's class, null if the set is empty; ``chosen`` marks the row (or equal rows) that stands for its
    component: the smallest id's, ids before nulls, then by class and digest.
    """
    with temporary() as keep:
        return keep(materialize(_component_rows(docs, similarity, id_col, text_col)))


def _component_rows(docs: DataFrame, similarity: tuple[int, int], id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    plan = Plan(*similarity)
    rows = digested(docs, id_col, text_col)
    described = materialize(describe(rows))
    each = described.where("n >= 0")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), "digest"))
    classes = materialize(each.where("n > 0").groupBy("id").agg(first_row.alias("r"), F.max("n").alias("n")).select("id", "r.none", "r.rep", "r.digest", "n"))
    n_docs = each.count()
    # a set has about a key for every second shingle, and some for its neighbourhoods
    n_keys = classes.agg(F.sum(F.col("n") / 2 + 12)).first()[0] or 0
    parts = max(1, -(-int(n_keys) // PART_KEYS))
    often = described.where("n < 0").groupBy("id").agg(F.sum("doc_id").alias("c")).where(F.col("c") >= COMMON_SHARE * n_docs).orderBy(F.desc("c"), "id").limit(COMMON_MOST)
    common = spark.sparkContext.broadcast(np.array([r[0] for r in often.select("id").collect()], np.int64).view(U))
    found = materialize(bucket_pairs(key_blobs(rows, parts, plan, common)))
    common.destroy()
    star = materialize(found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")))
    rest = found.where("kind = 1").select("a", "b", "n")
    # texts of the classes that any candidate names, each once
    named = star.select(F.col("a").alias("id")).union(star.select("b")).union(rest.select("b")).distinct()
    wanted = classes.join(named, "id", "left_semi").select("id", "rep", F.col("digest").alias("of"))
    same = rows["doc_id"].eqNullSafe(wanted["rep"]) & (rows["digest"] == wanted["of"])
    texts = rows.join(wanted, same).select("id", "text")
    repeated = each.where("n > 0").groupBy("doc_id", "digest").count().where("count > 1")
    texts = materialize(texts if repeated.isEmpty() else texts.dropDuplicates(["id"]))
    first = star.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b")
    links = materialize(verified(first, texts, plan))
    labels = materialize(components(links))
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    bits = materialize(signatures(texts))
    for every in (False, True):  # likeliest partners first: what they link needs no further comparison
        pairs = materialize(possible_pairs(open_groups(star, rest, labels), bits, plan, every).join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        more = materialize(verified(pairs, texts, plan)) if not pairs.isEmpty() else None
        if more is not None and not more.isEmpty():
            links = materialize(links.union(more))
            labels = materialize(components(links))
    place = F.struct("none", "rep", "id", "digest")
    grouped = materialize(labels.join(classes, "id").select("id", F.col("component").alias("c"), place.alias("place")))
    smallest = materialize(grouped.groupBy("c").agg(F.min("place").alias("least")))
    moved = grouped.join(smallest, "c").select("id", "least")
    # written, so that the rows of a class of many copies can be split in the join
    placed = materialize(classes.join(moved, "id", "left").select("id", F.coalesce("least", place).alias("p")).select("id", F.col("p.rep").alias("component_id"), F.col("p.id").alias("class"), F.col("p.digest").alias("of")))
    chosen = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("id") == F.col("class")) & (F.col("digest") == F.col("of"))
    linked = each.where("n > 0").join(placed, "id").select("doc_id", "n", "id", "digest", "component_id", chosen.alias("chosen"))
    alone = each.where("n = 0").select("doc_id", "n", "id", "digest", F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen"))
    return linked.unionByName(alone)


def jaccard_components(docs: DataFrame, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of the graph of similar 5-word shingle sets.

    Two sets link when ``den * |A and B| >= num * |A or B|``. Null, empty and wordless texts have an empty set and
    link with nothing; texts under five words are one shingle; repeated rows are in one class; whole texts of any
    length count; an empty table gives no rows; other columns are never read. A shingle and a set are known by
    64-bit hashes.
    """
    return component_rows(docs, similarity, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_representatives(docs: DataFrame, similarity: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that represent their components: the smallest id of each.

    Rows without a shingle (null, empty and wordless texts) all stay. Of rows that repeat a representative's id and
    text one stays; rows with one id, or without, and different texts are told apart by a 64-bit hash of the text.
    An empty table gives no rows; further columns may have any names.
    """
    found = component_rows(docs, similarity, id_col, text_col)
    own_id, own_digest = docs[id_col].cast("bigint"), F.xxhash64(docs[text_col].cast("string"))

    def rows_of(which: DataFrame) -> DataFrame:
        kept = materialize(which.select("doc_id", "digest").distinct())
        return docs.join(kept, own_id.eqNullSafe(kept["doc_id"]) & (own_digest == kept["digest"]), "left_semi")

    chosen = found.where("chosen")
    if found.where("n > 0").groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        return rows_of(chosen)
    names = [fresh("row_id", docs.columns), fresh("row_digest", docs.columns)]
    several = rows_of(chosen.where("n > 0")).withColumns(dict(zip(names, (F.col(f"`{id_col}`").cast("bigint"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))), strict=True)))
    return several.dropDuplicates(names).drop(*names).union(rows_of(chosen.where("n = 0")))
