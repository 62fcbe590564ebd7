"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes counts of its words and of its four-byte sequences (lower case, each hashed to a fixed number of
terms) and of three-character patterns over sixteen character classes, which tell prose from lists, shouting and
symbols. Weighted, they are projected on the leading singular directions of a bounded labelled sample (latent
semantic analysis, fitted in one task of an executor). The sample's vectors are broadcast; every document takes exact
cosines with all of them, in blocks, and its nearest neighbours vote with their labels, weighted by similarity.
Language, source and ids are no inputs.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_worker, map_arrow, slices, tidy, tidy_group, word_hashes

#: The fit's bounds: sampled texts of label 0 and of label 1 (48 KB of counts each in the fitting task; 200 bytes each are broadcast).
SAMPLE_LOW, SAMPLE_HIGH = 1024, 2048
#: Latent dimensions, voting neighbours, power of the similarity that weighs a vote.
DIMENSIONS, NEIGHBOURS, POWER = 64, 15, 4
#: Score from which a text is predicted to have label 1.
THRESHOLD = 0.3
#: Terms of each kind (a power of two), and the weights of patterns, words and sequences in a text's unit vector.
TERMS, KIND_WEIGHTS = 4096, (1.0, 0.5, 0.5)
#: Texts, and bytes of them, whose counts are held at once.
BLOCK_TEXTS, BLOCK_BYTES = 128, 1 << 18
#: Character classes of bytes: letters (also of other scripts), capitals, digits, white space, and kinds of symbols.
CLASSES = {1: b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), 2: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3: b"0123456789", 4: b" \t", 5: b"\n\r", 7: b".", 8: b",", 9: b"!?", 10: b"|", 11: b"#*", 12: b"$%", 13: b"&<>", 14: b":;\"'()-", 15: b"=/_+@\\"}
CLASS = np.zeros(256, np.uint16)
for _k, _bytes in CLASSES.items():
    CLASS[list(_bytes)] = _k


def sequences(data: bytes) -> np.ndarray:
    """Terms of the four-byte sequences of a lower-case text, set between spaces."""
    b = np.frombuffer(b" " + data + b"   ", np.uint8).astype(np.uint32)
    return ((b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761)) >> np.uint32(20)


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of patterns, words and sequences of whole texts, a row each; a null text counts as empty."""
    data = [(t or "").encode("utf-8") for t in texts]
    out = np.zeros((len(data), 3 * TERMS), np.float32)
    lower = [d.lower() for d in data]
    words, first = word_hashes(lower)
    words = (words >> np.uint64(52)).astype(np.int64)
    for row, d, low, i, j in zip(out, data, lower, first[:-1], first[1:], strict=True):
        c = CLASS[np.frombuffer(b"\n\n" + d + b"\n", np.uint8)]
        row[:TERMS] = np.bincount((c[:-2] << 8) | (c[1:-1] << 4) | c[2:], minlength=TERMS)
        row[TERMS : 2 * TERMS] = np.bincount(words[i:j], minlength=TERMS)
        row[2 * TERMS :] = np.bincount(sequences(low), minlength=TERMS)
    return out


def blocks(texts: list[str | None]):
    """The texts in runs of bounded number and size; a longer text is a run of its own."""
    run: list[str | None] = []
    size = 0
    for t in texts:
        n = len(t or "")
        if run and (len(run) == BLOCK_TEXTS or size + n > BLOCK_BYTES):
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


@dataclass(frozen=True)
class Space:
    """A fitted latent space with its labelled vectors."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Logarithms of rates within each kind of terms, so that length doesn't matter, times the terms' weights; kinds have fixed lengths. Overwrites the counts."""
        for k, share in enumerate(KIND_WEIGHTS):
            part = counts[:, k * TERMS : (k + 1) * TERMS]
            part *= 1000 / np.maximum(part.sum(1, keepdims=True), 1)
            np.log1p(part, out=part)
            part *= weight[k * TERMS : (k + 1) * TERMS]
            part *= share / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
        return counts

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray) -> Space:
        """From the counts of at least one labelled text, which are overwritten."""
        weight = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        a = cls.weighted(counts, weight)
        # leading right singular vectors by subspace iteration: no matrix beyond the sample's own size
        q = np.random.default_rng(0).standard_normal((a.shape[1], min(DIMENSIONS + 16, len(a)))).astype(np.float32)
        for _ in range(12):
            q, _ = np.linalg.qr(a.T @ (a @ q))
        _, _, rotation = np.linalg.svd(a @ q, full_matrices=False)
        basis = (q @ rotation.T)[:, :DIMENSIONS].astype(np.float32)
        return cls(weight, basis, cls.unit(a @ basis), labels.astype(np.float32))

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        """Rows of length one."""
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def cosines(self, texts: list[str | None]) -> np.ndarray:
        """Cosines of texts with all labelled vectors."""
        parts = [self.unit(self.weighted(term_counts(run), self.weight) @ self.basis) @ self.vectors.T for run in blocks(texts)]
        return np.concatenate(parts).astype(np.float64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest neighbours; of equal similarities the first in sample order count."""
        cos = self.cosines(texts)
        k = min(NEIGHBOURS, cos.shape[1])
        least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None]
        near, tied = cos > least, cos == least
        near |= tied & (np.cumsum(tied, axis=1) <= k - near.sum(1, keepdims=True))
        votes = np.where(near, np.maximum(cos, 1e-9) ** POWER, 0.0)
        return np.clip(votes @ self.labels.astype(np.float64) / votes.sum(1), 0.0, 1.0)


def fit_space(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Space | None:
    """A space from a bounded sample of the labelled documents: of each label those with the smallest id hashes.

    Null ids and labels other than 0 and 1 teach nothing; an id with several labels counts once by its least, one with
    several texts by one of them; None if no labelled text is there. Counts are taken where the texts are; one task
    of bounded size fits, and the driver gets the space only.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = known.join(docs.select(F.col(id_col).cast("bigint").alias("id")).distinct(), "id", "left_semi")
    first = [known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most) for label, most in ((0, SAMPLE_LOW), (1, SAMPLE_HIGH))]
    wanted = first[0].union(first[1])  # at most SAMPLE_LOW + SAMPLE_HIGH rows of 12 bytes
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id").select("id", "label", "text")

    def count(batches):
        in_worker("quality_knn")
        for piece in slices(batches):
            counts = []
            for run in blocks(piece.column(2).to_pylist()):
                for c in term_counts(run):
                    at = np.flatnonzero(c)
                    counts.append(at.astype("<u4").tobytes() + c[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(counts, pa.binary())], names=["id", "label", "counts"])

    def fit(table: pa.Table) -> pa.Table:
        in_worker("quality_knn")
        table = table.sort_by("id")
        counts = np.zeros((table.num_rows, 3 * TERMS), np.float32)
        for row, packed in zip(counts, table.column("counts").to_pylist(), strict=True):
            at, n = np.frombuffer(packed, "<u4").reshape(2, -1)
            row[at] = n
        space = Space.fit(counts, table.column("label").to_numpy())
        return pa.table([pa.array([pickle.dumps(space)], pa.binary())], names=["space"])

    counted = rows.mapInArrow(tidy(count), "id bigint, label int, counts binary").groupBy("id").agg(F.min("label").alias("label"), F.min("counts").alias("counts"))
    found = counted.groupBy(F.lit(0).alias("all")).applyInArrow(lambda table: tidy_group(fit)(table.drop_columns([c for c in table.column_names if c not in ("id", "label", "counts")])), "space binary").collect()
    return pickle.loads(found[0][0]) if found else None


def score_documents(docs: DataFrame, space: Space | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; without a space every score is 1.

    Null and empty texts are scored as texts without characters; repeated rows score alike; an empty table gives
    no rows; whole texts of any length count; other columns are never read.
    """
    # the sample's bounds are the broadcast's bounds
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def make():
        in_worker("quality_knn")

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, s = batch.column(1).to_pylist(), shared.value
            scores = np.ones(len(texts)) if s is None or not texts else s.score(texts)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        return run

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, make, "doc_id bigint, score double")


def filter_documents(docs: DataFrame, space: Space | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``threshold``; without a space all rows stay.

    A null text is scored as an empty one; whole texts of any length count; rows are judged by their texts alone, so
    repeated rows share their fate whatever their ids; an empty table gives no rows; other columns pass unread.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(space), docs.columns.index(text_col)

    def run(batches):
        in_worker("quality_knn")
        s = shared.value
        for piece in slices(batches):
            texts = piece.column(at).to_pylist()
            if s is None or not texts:
                yield piece
            else:
                yield piece.filter(pa.array(s.score(texts) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
