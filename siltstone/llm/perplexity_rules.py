"""Quality rules with n-gram perplexity: a modified Kneser-Ney model of bytes, counted by Spark, and bands by language.

Every document of the corpus is counted: five-byte windows (from the text's start, padded), each under its
language and one of two folds by the text's hash. The table of windows gives all lower orders, the three discounts of
every order, and interpolated probabilities, all by joins on distinct windows. A document is scored by the other
fold's model, so neither its own counts nor those of its exact copies explain it. As every window that is scored was
counted, the model comes down to one sorted array of 64-bit keys (language hash, fold and bytes) with log
probabilities; it is broadcast while it is small, and joined to the documents' windows beyond a stated size. A
document whose log perplexity per word (words that hold a letter or digit, so that ornaments cost and don't count)
lies outside its language's band around the median, measured in robust deviations over all documents, is rejected.

Five bytes see spelling, not words. So words and pairs of words are counted too, each once a document, and a
document's own counts are left out when it is scored: ``word_surprise`` is the mean negative log of the shares of its
language's other documents that know its words and, given the word before, its pairs. Shares below ``FLOOR`` count
as ``FLOOR``, so only windows in so large a share of documents are needed; their number doesn't grow with the corpus.
They are found exactly: a window that reaches the share over all documents reaches it in at least one chunk of
them, so the chunks' windows of that share are candidates, which a second pass counts. A text may be marked with a
wrong language or mix several, so ``mixed_surprise`` gives each window the largest of its shares in any language. What
is over its language's upper band even so is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, in_worker, materialize, mixed, slices, temporary, tidy, trim, word_hashes

U = np.uint64
ORDER = 5
#: Distinct windows (12 bytes each) up to which the model is broadcast.
BROADCAST_ENTRIES = 8_000_000
#: Base rules: fewest words, greatest percentage of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Bands: robust standard deviations below and above the language's median log perplexity per word, and the least
#: deviation as a share of that median.
LOWER, UPPER, LEAST_SPREAD = 4.0, 6.0, 0.01
#: A text's mean scatters more the shorter it is: bands widen by the root of 1 + SHORT_WORDS / words.
SHORT_WORDS = 800
#: Share of a language's other documents below which a window of words counts as unknown, and the weight of pairs.
FLOOR, PAIR_WEIGHT = 0.01, 0.5
#: Band of the word surprise: robust deviations above the median, least deviation, and its own widening for short texts.
WORD_UPPER, WORD_SPREAD, WORD_SHORT = 4.0, 0.02, 50
#: Candidates (8 bytes each) that are broadcast at once; with more, they are counted in several passes.
CANDIDATE_BLOCK = 4_000_000
BATCH_BYTES = 1 << 20
SYMBOLS = b"#*$%&|<>"
#: A word without letters and digits (all bytes beyond ASCII count as letters).
ORNAMENT = re.compile(rb"(?<!\S)[^\s0-9A-Za-z\x80-\xff]+(?!\S)")
#: The lowest bit above a window's bytes is its document's fold.
FOLD = 1 << 40


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; None counts as no text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8")
    words = data.split()
    chars = len(text) - sum(data.count(bytes([c])) for c in SPACES)
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    lines = Counter(line for line in data.split(b"\n") if line.strip())
    repeated = 0
    if len(words) > 3 and len(set(words)) < len(words):
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        triple = pair[:-1] * len(number) + ids[2:]
        _, which, n = np.unique(triple, return_inverse=True, return_counts=True)
        twice = n[which] > 1
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[i : i + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), chars, symbols, sum(lines.values()) - len(lines), repeated


def language_key(lang: str | None) -> int:
    """The high 24 bits of a language's keys, the last of them left for the fold."""
    return xxhash.xxh32_intdigest(lang or "") >> 8 & ~1


def fold_key(lang: str | None, data: bytes) -> int:
    """The high 24 bits of a text's windows: its language and, by its hash, its fold."""
    return language_key(lang) | xxhash.xxh32_intdigest(data) & 1


def windows(texts: list[bytes], langs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all windows of the texts, and where each text's windows begin; a text of n bytes has n windows."""
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(U)
    if not len(data):
        return np.empty(0, U), np.zeros(len(texts), np.int64)
    key = np.zeros(max(0, len(data) - ORDER + 1), U)
    for i in range(ORDER):
        key |= data[i : i + len(key)] << U(8 * (ORDER - 1 - i))
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]])
    inside = np.repeat(begin, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return key[inside] | np.repeat(np.array(langs, U) << U(40), sizes), np.cumsum(sizes) - sizes


#: Windows of words are known by the high 52 bits of their hashes; the others number a chunk's texts.
CHUNK_TEXTS = 1 << 12
#: Text that is hashed at once: some 60 bytes of memory for each of it.
GROUP_BYTES = 1 << 18
HIGH = ~U(CHUNK_TEXTS - 1)


def word_keys(texts: list[bytes], langs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the texts, keys of their words, keys of their pairs, each word's text): a text's first word is paired with its start.

    Words are split at white space as by ``bytes.split`` and known by hashes of all their bytes. A key is that of the
    window in any language, turned by its language's mask.
    """
    parts, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < GROUP_BYTES):
            size += len(texts[j])
            j += 1
        doc, word, pair, who = group_keys(texts[i:j], langs[i:j])
        parts.append((doc, word, pair, who + i))
        i = j
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (*(np.empty(0, U) for _ in range(3)), np.empty(0, np.int64))


def language_seed(langs) -> np.ndarray:
    """What tells the languages' keys apart; its high bits are a language's mask."""
    return mixed(np.array(langs, U) + U(1))


def group_keys(texts: list[bytes], langs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`word_keys` of some texts at once."""
    seed = language_seed(langs)
    word, first = word_hashes(texts)
    who = np.repeat(np.arange(len(texts)), np.diff(first))
    before = np.concatenate([np.zeros(1, U), word[:-1]])[: len(word)]
    before[first[:-1][np.diff(first) > 0]] = U(0)
    own = (seed & HIGH)[who]
    return mixed(seed ^ U(1)) & HIGH, (mixed(word) & HIGH) ^ own, (mixed(mixed(before + U(1)) ^ word) & HIGH) ^ own, who


def document_counts(texts: list[bytes], langs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, documents with it, documents of its language, its language) of all windows of words of at most CHUNK_TEXTS texts, and of the languages; texts without words don't count."""
    wordy = [i for i, t in enumerate(texts) if t.strip(SPACES)]
    if len(wordy) < len(texts):
        texts, langs = [texts[i] for i in wordy], [langs[i] for i in wordy]
    doc, word, pair, who = word_keys(texts, langs)
    who = who.astype(U)
    both = np.sort(np.concatenate([doc | np.arange(len(texts), dtype=U), word | who, pair | who]))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])[: len(both)]]
    key = both & HIGH
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    lang = np.array(langs, np.int64)
    _, place, size = np.unique(lang, return_inverse=True, return_counts=True)
    text = (both[first] & ~HIGH).astype(np.int64)
    return key[first], np.diff(np.append(first, len(key))), size[place][text], lang[text]


def text_chunks(batches, size: int):
    """(texts, language keys, language and fold keys) of (text, lang) batches in chunks of some ``size`` bytes; empty texts are left out."""
    texts: list[bytes] = []
    langs: list[int] = []
    folds: list[int] = []
    held = 0
    for piece in slices(batches):
        for text, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
            if data := (text or "").encode("utf-8"):
                texts.append(data)
                langs.append(language_key(lang))
                folds.append(fold_key(lang, data))
                held += len(data)
            if held >= size or len(texts) == CHUNK_TEXTS:
                yield texts, langs, folds
                texts, langs, folds, held = [], [], [], 0
    if texts:
        yield texts, langs, folds


class Places:
    """Where each of some distinct keys stands: a table with linear probing, a quarter full at most."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask, self.none = U(64 - bits), (1 << bits) - 1, len(keys)
        self.keys, self.place = np.zeros(1 << bits, U), np.full(1 << bits, self.none, np.int64)
        at, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.place[at[left]] == self.none]
            self.keys[at[free]], self.place[at[free]] = keys[free], free  # of several for one place the last is in
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, the number of keys if it isn't there."""
        at = (keys >> self.shift).astype(np.int64)
        found, place = self.keys[at], self.place[at]
        other = np.flatnonzero((found != keys) & (place < self.none))
        place[found != keys] = self.none
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            found, p = self.keys[at[other]], self.place[at[other]]
            hit = found == keys[other]
            place[other[hit]] = p[hit]
            other = other[~hit & (p < self.none)]
        return place


class Words:
    """Keys of the windows of words that matter, the number of documents with each, and each window's two largest shares among the languages."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, langs: np.ndarray) -> None:
        self.places, self.n = Places(keys), np.append(n, 0)
        seed = language_seed(langs)
        share = n / np.maximum(self.count(mixed(seed ^ U(1)) & HIGH), 1)
        free = keys ^ (seed & HIGH)
        order = np.lexsort((-share, free))
        free, share, langs = free[order], share[order], langs[order]
        first = np.flatnonzero(np.concatenate([[True], free[1:] != free[:-1]])[: len(free)])
        several = np.diff(np.append(first, len(free))) > 1
        self.anywhere = Places(free[first])
        self.best, self.best_lang = np.append(share[first], 0.0), np.append(langs[first], -1)
        self.second = np.append(np.where(several, share[np.minimum(first + 1, len(share) - 1)], 0.0), 0.0)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Documents with each key, 0 if it doesn't matter."""
        return self.n[self.places.find(keys)]

    def elsewhere(self, keys: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """The largest share of each window, by its key in its language, in the other languages; 0 below ``FLOOR``."""
        at = self.anywhere.find(keys ^ (language_seed(langs) & HIGH))
        share = np.where(self.best_lang[at] == langs, self.second[at], self.best[at])
        return np.where(share < FLOOR, 0.0, share)

    def surprise(self, texts: list[bytes], langs: list[int]) -> np.ndarray:
        """Mean negative log share of each text's words and pairs among the other documents of its language; NaN without words."""
        return self.surprises(texts, langs)[0]

    def surprises(self, texts: list[bytes], langs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`surprise`, and the same with each window's largest share in any language, where that is less surprising."""
        doc, word, pair, who = word_keys(texts, langs)
        others = np.maximum(self.count(doc) - 1, 1)[who]
        one, two = (np.maximum(self.count(k) - 1, 0) / others for k in (word, pair))
        one, two = np.where(one < FLOOR, 0.0, one), np.where(two < FLOOR, 0.0, two)
        first = np.concatenate([[True], who[1:] != who[:-1]])[: len(one)]
        own = known(one, two, first)
        lang = np.array(langs, np.int64)[who]
        mixture = np.maximum(own, known(*(np.maximum(x, self.elsewhere(k, lang)) for x, k in ((one, word), (two, pair))), first))
        n = np.bincount(who, minlength=len(texts))
        total = (np.bincount(who, -np.log(np.maximum(share, FLOOR)), minlength=len(texts)) for share in (own, mixture))
        return tuple(np.where(n > 0, t / np.maximum(n, 1), np.nan) for t in total)


def known(one: np.ndarray, two: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The weighted share of words and, given the word before, of pairs; ``first`` marks the texts' first words."""
    before = np.concatenate([[1.0], one[:-1]])[: len(one)]
    before[first] = 1.0
    return (1 - PAIR_WEIGHT) * one + PAIR_WEIGHT * np.minimum(1.0, two / np.maximum(before, FLOOR))


def fit_words(rows: DataFrame, block: int = CANDIDATE_BLOCK, found: DataFrame | None = None):
    """The broadcast :class:`Words` of (text, lang) rows: exact counts of all windows of words in at least ``FLOOR`` of a language's other documents.

    ``found`` is the written table of :func:`count_windows`, which names the candidates.
    """
    spark = rows.sparkSession
    found = (materialize(count_windows(rows)) if found is None else found).where("kind = 1").select("key")
    blocks = max(1, -(-found.count() // block))
    keys, counts, languages = [], [], []
    for b in range(blocks):
        part = found if blocks == 1 else found.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        wanted = spark.sparkContext.broadcast(np.sort(part.toArrow().column("key").to_numpy().view(U)))

        def exact(batches, wanted=wanted):
            in_worker("perplexity_rules")
            have = wanted.value
            total, language = np.zeros(len(have), np.int64), np.zeros(len(have), np.int64)
            for texts, langs, _ in text_chunks(batches, 4 * BATCH_BYTES):
                if not len(have):
                    continue
                key, n, _, lang = document_counts(texts, langs)
                at = np.minimum(np.searchsorted(have, key), len(have) - 1)
                hit = have[at] == key
                total[at[hit]] += n[hit]
                language[at[hit]] = lang[hit]
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(have[seen].view(np.int64)), pa.array(total[seen]), pa.array(language[seen])], names=["key", "n", "lang"])

        # windows of one document only are unknown to all others
        counted = rows.select("text", "lang").mapInArrow(tidy(exact), "key bigint, n bigint, lang bigint").groupBy("key").agg(F.sum("n").alias("n"), F.max("lang").alias("lang")).where("n > 1").toArrow()
        keys.append(counted.column("key").to_numpy().view(U))
        counts.append(counted.column("n").to_numpy())
        languages.append(counted.column("lang").to_numpy())
        wanted.destroy()
    return spark.sparkContext.broadcast(Words(*map(np.concatenate, (keys, counts, languages))))


def count_windows(rows: DataFrame) -> DataFrame:
    """(kind, key, n): how often each byte window occurs in all documents (text, lang) of a language and fold (kind 0), and the windows of words that reach ``FLOOR`` in a chunk of documents (kind 1)."""

    def run(batches):
        in_worker("perplexity_rules")

        def merged(held):
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in held])).astype(np.int64)

        def out(kind, keys, n):
            for i in range(0, len(keys), 1 << 18):
                part = keys[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[i : i + (1 << 18)])], names=["kind", "key", "n"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for texts, langs, folds in text_chunks(batches, 4 * BATCH_BYTES):
            held.append(np.unique(windows(texts, folds)[0], return_counts=True))
            key, n, of, _ = document_counts(texts, langs)
            often = n >= FLOOR * of
            yield from out(1, key[often], n[often])
            if len(held) >= 8:
                held = [merged(held)]
            if len(held[0][0]) > 2_000_000:
                yield from out(0, *merged(held))
                held = []
        if held:
            yield from out(0, *merged(held))

    return rows.select("text", "lang").mapInArrow(tidy(run), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def suffix(order: int):
    """The key without its first byte: language and the last ``order - 1`` bytes of a key of ``order`` bytes."""
    mask = ~(0xFF << (8 * (order - 1)))
    return F.col("key").bitwiseAND(F.lit(mask))


def context(order: int):
    """The key of the bytes before the last, in the same form as a key of one order less."""
    high = F.shiftleft(F.shiftright(F.col("key"), 40), 40)
    return high.bitwiseOR(F.shiftright(F.col("key").bitwiseAND(F.lit((1 << (8 * order)) - 1)), 8))


def cross_scores(counts: DataFrame) -> DataFrame:
    """(key, logp) of every counted window: the log probability of its last byte by the other fold's modified Kneser-Ney model.

    Lower orders count the distinct bytes seen before a window instead of its occurrences. Probabilities are
    interpolated: a window that the other fold lacks has its context's held-out weight times the next lower order's
    probability, or that probability alone if the context is unknown too; below order 1 all bytes are alike. A context
    has at most 256 windows and a window at most 256 that end in it, so no join meets a hot key.
    """
    counted = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        counted[n] = materialize(counted[n + 1].select(suffix(n + 1).alias("key")).groupBy("key").agg(F.count("*").alias("n")))
    of = [F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]
    alike = {n: counted[n].agg(F.lit(n), *of) for n in counted}
    often = {r[0]: r[1:] for r in reduce(DataFrame.union, alike.values()).collect()}
    below = None
    for n in range(1, ORDER + 1):
        n1, n2, n3, n4 = map(float, often[n])
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        cut = [max(0.01, min(i - 0.01, i - (i + 1) * y * b / a if a and b else 0.5 * i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        by_context = counted[n].groupBy(context(n).alias("ctx")).agg(F.sum("n").alias("total"), F.sum(discount).alias("held"))
        gamma = by_context.select("ctx", "total", (F.col("held") / F.col("total")).alias("gamma"))
        asked = counted[n].select(F.col("key").bitwiseXOR(F.lit(FOLD)).alias("key"))
        if n < ORDER:  # windows of both folds, for the next order's joins
            asked = counted[n].select("key", "n").union(asked.withColumn("n", F.lit(None).cast("bigint"))).groupBy("key").agg(F.max("n").alias("n"))
        else:
            asked = asked.join(counted[n], "key", "left")
        joined = asked.withColumn("ctx", context(n)).join(gamma, "ctx", "left")
        if n == 1:
            joined = joined.withColumn("below", F.lit(1 / 256))
        else:
            joined = joined.withColumn("sfx", suffix(n)).join(below.select(F.col("key").alias("sfx"), F.col("p").alias("below")), "sfx")
        own = F.coalesce((F.col("n") - discount) / F.col("total"), F.lit(0.0))
        below = joined.select("key", (own + F.coalesce("gamma", F.lit(1.0)) * F.col("below")).alias("p"))
        if n == 3:  # so far the tables are small
            below = materialize(below)
    return below.select(F.col("key").bitwiseXOR(F.lit(FOLD)).alias("key"), F.log("p").cast("float").alias("logp"))


class Model:
    """Sorted keys of windows with the log probability that scores each."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray) -> None:
        self.keys, self.logp = keys, logp

    @classmethod
    def gathered(cls, scores: DataFrame) -> Model:
        """From a table of checked size: executors sort and pack its key ranges, the driver only lays them end to end."""

        def pack(batches):
            held = list(batches)
            if held:
                table = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_arrays([table.column("key")[:1].combine_chunks(), *(pa.array([table.column(c).to_numpy().tobytes()], pa.binary()) for c in ("key", "logp"))], names=["first", "keys", "logps"])
                trim()

        ranges = max(1, int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        packed = scores.repartitionByRange(ranges, "key").sortWithinPartitions("key").mapInArrow(pack, "first bigint, keys binary, logps binary")
        rows = sorted(packed.collect(), key=lambda r: r[0])
        return cls(np.frombuffer(b"".join(r[1] for r in rows), np.int64), np.frombuffer(b"".join(r[2] for r in rows), np.float32))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """The log probability of each window; one that was never counted is as unlikely as by chance."""
        keys = keys.view(np.int64)
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])
        at = np.minimum(np.searchsorted(self.keys, ordered[first]), max(0, len(self.keys) - 1))
        found = np.where(self.keys[at] == ordered[first], self.logp[at], -np.log(256.0)) if len(self.keys) else np.full(len(first), -np.log(256.0))
        values = np.empty(len(keys))
        values[order] = np.repeat(found, np.diff(np.append(first, len(keys))))
        return values


FEATURES = "doc_id bigint, lang string, digest bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_bytes bigint, n_lexical bigint, word_surprise double, mixed_surprise double"


def features(texts: list[str | None], langs: list[int], words) -> list[pa.Array]:
    """Columns of the base counts, the byte count, the words with letters or digits, and the two word surprises (null without a model or words)."""
    data = [(t or "").encode("utf-8") for t in texts]
    found = [(*(c := base_counts(t)), len(d), c[0] - len(ORNAMENT.findall(d))) for t, d in zip(texts, data, strict=True)]
    surprise = np.full((2, len(texts)), np.nan)
    i = 0
    while words is not None and i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(data[j]) <= BATCH_BYTES):
            size += len(data[j])
            j += 1
        surprise[:, i:j] = words.value.surprises(data[i:j], langs[i:j])
        i = j
    return [*(pa.array([f[i] for f in found], pa.int64()) for i in range(7)), *(pa.array(x, from_pandas=True) for x in surprise)]


def scored(rows: DataFrame, model, words=None) -> DataFrame:
    """FEATURES and ``logp`` (sum over the text's bytes) of each row (doc_id, lang, text), by the broadcast model."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches):
        in_worker("perplexity_rules")
        m: Model = model.value
        for piece in slices(batches):
            texts = piece.column(2).to_pylist()
            data = [(t or "").encode("utf-8") for t in texts]
            langs = [language_key(x) for x in piece.column(1).to_pylist()]
            folds = list(map(fold_key, piece.column(1).to_pylist(), data))
            logp = np.zeros(len(texts))
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(data[j]) <= BATCH_BYTES):
                    size += len(data[j])
                    j += 1
                keys, begin = windows(data[i:j], folds[i:j])
                if len(keys):
                    sums = np.concatenate([[0.0], np.cumsum(m.score(keys))])
                    logp[i:j] = sums[np.append(begin[1:], len(keys))] - sums[begin]
                i = j
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), piece.column(3), *features(texts, langs, words), pa.array(logp)], names=[*names, "logp"])

    return rows.select("doc_id", "lang", "text", "digest").mapInArrow(tidy(run), f"{FEATURES}, logp double")


def scored_by_join(rows: DataFrame, scores: DataFrame, words=None) -> DataFrame:
    """As :func:`scored`, for a model too large to broadcast: the documents' distinct windows are joined to the scores.

    Every window of the counted corpus is in that table. A row is known by a number that the written features keep.
    """

    def with_windows(batches):
        for piece in slices(batches, 64):
            texts = piece.column(2).to_pylist()
            data, langs = [(t or "").encode("utf-8") for t in texts], piece.column(1).to_pylist()
            found = [np.unique(windows([d], [fold_key(x, d)])[0], return_counts=True) for d, x in zip(data, langs, strict=True)]
            langs = list(map(language_key, langs))
            grams = pa.array([[{"key": int(k), "n": int(n)} for k, n in zip(ks.view(np.int64), ns, strict=True)] for ks, ns in found], pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), piece.column(3), *features(texts, langs, words), grams], names=[*(x.split()[0] for x in FEATURES.split(", ")), "grams"])

    wide = rows.select("doc_id", "lang", "text", "digest").mapInArrow(tidy(with_windows), f"{FEATURES}, grams array<struct<key:bigint,n:bigint>>")
    wide = materialize(wide.withColumn("row", F.monotonically_increasing_id()))
    each = wide.select("row", F.explode("grams").alias("g")).select("row", "g.key", "g.n")
    sums = each.join(scores, "key").groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("logp"))
    return wide.drop("grams").join(sums, "row", "left").drop("row").withColumn("logp", F.coalesce("logp", F.lit(0.0)))


def fit(rows: DataFrame, broadcast_entries: int, found: DataFrame | None = None) -> tuple[object | None, DataFrame | None]:
    """The broadcast model of (doc_id, lang, text) rows, or None and the table of scores if it is too large for that; ``found`` as in :func:`fit_words`."""
    with temporary() as keep:
        counts = (materialize(count_windows(rows)) if found is None else found).where("kind = 0").select("key", "n")
        scores = materialize(cross_scores(counts))
        if scores.count() <= broadcast_entries:
            return rows.sparkSession.sparkContext.broadcast(Model.gathered(scores)), None
        return None, keep(scores)


def measured(rows: DataFrame, broadcast_entries: int) -> DataFrame:
    """Written features of (doc_id, lang, text, digest) rows with ``base_failed``, ``log_perplexity`` and the name of the band; the models are given back."""
    with temporary() as keep:
        return keep(_measured(rows, broadcast_entries))


def _measured(rows: DataFrame, broadcast_entries: int) -> DataFrame:
    counted = materialize(count_windows(rows))
    words = fit_words(rows, found=counted)
    model, scores = fit(rows, broadcast_entries, counted)
    found = scored(rows, model, words) if model is not None else scored_by_join(rows, scores, words)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    ppl = F.when(F.col("n_bytes") > 0, -F.col("logp") / F.greatest("n_lexical", F.lit(1)))
    out = materialize(found.select("*", failed.alias("base_failed"), ppl.alias("log_perplexity"), F.coalesce("lang", F.lit("")).alias("band")))
    words.destroy()
    if model is not None:
        model.destroy()
    return out


def with_verdict(found: DataFrame, lower: float, upper: float) -> DataFrame:
    """``found`` with the band's limits and ``kept``."""
    quarters = [F.percentile_approx(c, F.lit(q), F.lit(10_000)).alias(f"{c}{i}") for c in ("log_perplexity", "word_surprise") for i, q in enumerate((0.25, 0.5, 0.75))]
    bands = found.where("not base_failed").groupBy("band").agg(*quarters)
    middle = [F.col(f"{c}1").alias(f"{c}_mid") for c in ("log_perplexity", "word_surprise")]
    spread = [F.greatest((F.col(f"{c}2") - F.col(f"{c}0")) / 1.349, least).alias(f"{c}_spread") for c, least in (("log_perplexity", LEAST_SPREAD * F.col("log_perplexity1")), ("word_surprise", F.lit(WORD_SPREAD)))]
    # a row a language, written: its size is known, so that it is broadcast while small, or else both sides can be split
    out = found.join(materialize(bands.select("band", *middle, *spread)), "band", "left")
    words = F.greatest("n_words", F.lit(1))
    wide = F.col("log_perplexity_spread") * F.sqrt(1 + SHORT_WORDS / words)
    out = out.withColumn("low", F.col("log_perplexity_mid") - lower * wide).withColumn("high", F.col("log_perplexity_mid") + upper * wide)
    out = out.withColumn("word_high", F.col("word_surprise_mid") + WORD_UPPER * F.col("word_surprise_spread") * F.sqrt(1 + WORD_SHORT / words))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")) & (F.col("mixed_surprise") <= F.col("word_high")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def named(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, lang, text, digest of both) of any table."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("digest", F.xxhash64("lang", "text"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lower: float = LOWER, upper: float = UPPER, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity, low, high,
    word_surprise, mixed_surprise, word_high) of every row.

    A null or empty text has zero counts, fails the base rules and has no perplexity. A null language is a
    language of its own. The bands are medians and quartiles of the documents that pass the base rules, over all
    of them; a language with no spread keeps what lies within some hundredths of its median. Repeated rows are
    each judged; an empty table gives no rows; whole texts count; other columns are never read.
    """
    rows = named(docs, id_col, text_col, lang_col)
    return with_verdict(measured(rows, broadcast_entries), lower, upper).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "low", "high", "word_surprise", "mixed_surprise", "word_high")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lower: float = LOWER, upper: float = UPPER, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`judge` keeps.

    Rows are matched by id and by a 64-bit hash of language and text, so rows with one id (also a null one) and
    different texts are judged each on its own; a null or empty text is rejected; an empty table gives no rows.
    """
    rows = named(docs, id_col, text_col, lang_col)
    # written, so that the join deals both sides itself
    kept = materialize(with_verdict(measured(rows, broadcast_entries), lower, upper).where("kept").select("doc_id", "digest").distinct())
    own = F.xxhash64(docs[lang_col].cast("string"), docs[text_col].cast("string"))
    return docs.join(kept, docs[id_col].cast("bigint").eqNullSafe(kept["doc_id"]) & (own == kept["digest"]), "left_semi")
