"""Language identification by compression: the language whose zstandard dictionary makes a text smallest.

Each language's dictionary is raw content: letters of a bounded sample of its labelled texts, its bytes shared out
evenly and taken all over each whole text. A text is reduced to lower-case letters (with their combining marks) and single spaces, cut into blocks (so that the dictionary, not the text itself, explains
most of each), and every block of the whole text is compressed with every dictionary. The smallest sum wins; a
narrow margin is reported as a rejection.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_worker, map_arrow, materialize, slices, temporary, tidy

#: The fit's bounds: labelled texts sampled for each language, bytes of a dictionary, bytes of a piece of a text.
SAMPLE_DOCS, DICTIONARY_BYTES, PIECE_BYTES = 400, 1 << 17, 512
BLOCK = 1500
#: Compression levels of texts longer than a block and of short ones, where every byte counts.
LEVEL, SHORT_LEVEL = 3, 9
#: A best size within this share of the second best is a narrow margin.
MARGIN = 0.01
UNDETERMINED = "und"
NO_LETTER, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """Lower-case letters and marks of a text, other runs as one space; empty without letters."""
    if not text or not LETTER.search(text):
        return b""
    return NO_LETTER.sub(" ", text).strip().lower().encode("utf-8")


def quota(lengths: list[int], budget: int) -> int:
    """The largest number of bytes that each text may give, so that all together give at most ``budget``."""
    left = budget
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) >= left:
            return left // (len(lengths) - k)
        left -= n
    return budget


def spread(data: bytes, size: int) -> bytes:
    """``size`` bytes of a text in pieces that lie evenly over the whole of it, or all of a shorter text."""
    if len(data) <= size:
        return data
    n = max(1, size // PIECE_BYTES)
    piece = size // n
    return b" ".join(data[at : at + piece - 1] for at in ((len(data) - piece) * i // max(1, n - 1) for i in range(n)))


def fit_dictionaries(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, bytes]:
    """Raw-content dictionaries of all languages that label a text with letters in ``docs``, the commonest first.

    Of each language the SAMPLE_DOCS rows with the smallest id hashes are sampled (ties by id, then by text hash; equal
    rows count once): counts by language and by the number of a hash's leading zeros tell below which power of two they
    all lie, so only some SAMPLE_DOCS to twice as many ids of a language are sorted, however many it has; then their
    texts are read and reduced where they are. Null labels and texts teach nothing; nor does a language whose sampled texts hold no letter.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("digest", F.xxhash64("text"))
    # hashes are ordered as signed numbers: with the sign turned, the smaller ones have more leading zeros
    zeros = 64 - F.length(F.bin(F.xxhash64("id").bitwiseXOR(F.lit(-1 << 63))))
    known = known.withColumn("zeros", zeros)
    counts: dict[str, Counter[int]] = {}
    for lang, z, n in known.select("id", "lang", "digest", "zeros").distinct().groupBy("lang", "zeros").count().collect():
        counts.setdefault(lang, Counter())[z] = n
    langs = sorted(counts, key=lambda x: (-counts[x].total(), x))
    least = [(x, max((z for z in c if sum(n for y, n in c.items() if y >= z) >= SAMPLE_DOCS), default=0)) for x, c in counts.items()]
    near = known.join(F.broadcast(docs.sparkSession.createDataFrame(least, "lang string, least int")), "lang").where("zeros >= least")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "digest")
    # equal rows are merged before places are given, so repeats take none and a much repeated text is one row of its language
    wanted = near.select("id", "lang", "digest").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_DOCS)

    def reduced(batches):
        in_worker("language_id")
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(map(letters, piece.column(2).to_pylist()), pa.binary())], names=["lang", "place", "data"])

    with temporary():
        mine = F.broadcast(wanted.select(F.col("id").alias("i"), F.col("lang").alias("l"), F.col("digest").alias("d"), "place"))  # at most SAMPLE_DOCS rows a language
        rows = known.join(mine, F.col("id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")) & (F.col("digest") == F.col("d")))
        once = rows.select("lang", "place", "text").dropDuplicates(["lang", "place"])
        sample = materialize(once.mapInArrow(tidy(reduced), "lang string, place int, data binary").where("length(data) > 0"))
        lengths: dict[str, list[int]] = {}
        for r in sample.select("lang", F.length("data")).collect():
            lengths.setdefault(r[0], []).append(r[1])
        share = {lang: quota(n, DICTIONARY_BYTES) for lang, n in lengths.items()}

        def pieces(batches):
            for piece in slices(batches):
                data = [spread(d, share[x]) for x, d in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(data, pa.binary())], names=["lang", "place", "data"])

        texts: dict[str, list[tuple[int, bytes]]] = {}
        for r in sample.mapInArrow(tidy(pieces), "lang string, place int, data binary").collect():
            texts.setdefault(r[0], []).append((r[1], bytes(r[2])))
    return {x: b" ".join(d for _, d in sorted(texts[x]))[:DICTIONARY_BYTES] for x in langs if x in texts}


class Classifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self.long, self.short = ([self.coder(d, level) for d in dictionaries.values()] for level in (LEVEL, SHORT_LEVEL))

    @staticmethod
    def coder(content: bytes, level: int) -> zstandard.ZstdCompressor:
        """A compressor with the content digested once."""
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def sizes(self, data: bytes) -> list[int]:
        """Compressed bytes of all blocks, by language."""
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in (self.short if len(blocks) < 2 else self.long)]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); the score is the saving over the second best, stretched to 0..1."""
        data = letters(text)
        if not data or not self.langs:
            return UNDETERMINED, 0.0, True
        ranked = sorted(zip(self.sizes(data), self.langs, strict=True), key=lambda x: x[0])
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        margin = 1 - ranked[0][0] / ranked[1][0]
        return ranked[0][1], min(1.0, 2 * margin) ** 0.5, margin < MARGIN


def classifier(items: tuple[tuple[str, bytes], ...]) -> Classifier:
    """One classifier for each worker process."""
    return in_worker(("language_id", items), lambda: Classifier(dict(items)))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row.

    A null, empty or letterless text is ``und`` with score 0, as is every text if no language was learned; equal
    sizes go to the language given first; repeated rows are judged alike; other columns are never read.
    """
    spark = docs.sparkSession
    # at most DICTIONARY_BYTES a language
    shared = spark.sparkContext.broadcast(tuple(dictionaries.items()))

    def make():
        model = classifier(shared.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "rejected"])

        return run

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, make, "doc_id bigint, lang_pred string, score double, rejected boolean")
