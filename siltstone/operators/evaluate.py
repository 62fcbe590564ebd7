"""Graded retrieval metrics: one join and one aggregation for all metrics of all queries.

A run is (query_id, doc_id, rank), qrels are (query_id, doc_id, grade); a grade above 0 is relevant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from .dense import QUERY_BLOCK

# --- fixed values: cut-offs, bands and targets of the reports ---------------------------------------------------
NDCG_CUTS, PRECISION_CUTS, RECALL_CUTS = (1, 3, 5, 10), (1, 3, 5, 10), (5, 10)
NDCG_BANDS = ((0.85, "Excellent"), (0.70, "Good"), (0.55, "Moderate"))
MRR_BANDS = ((0.90, "Excellent"), (0.75, "Good"), (0.60, "Moderate"))
RAG_TARGETS = {"faithfulness": 0.85, "context_precision": 0.75, "context_recall": 0.80, "answer_relevance": 0.80}
WEAK = {"ndcg_at_10": 0.70, "recall_at_10": 0.60, "precision_at_10": 0.50, "mrr": 0.70, "robustness": 80.0, "faithfulness": 0.80}
BM25_BASELINES = {"trec-covid": 0.656, "nfcorpus": 0.325, "fiqa": 0.236, "scifact": 0.665, "arguana": 0.472}
# --- end of fixed values ----------------------------------------------------------------------------------------

AGGREGATED = ("ndcg_at_10", "ndcg_at_5", "mrr", "map_at_10", "precision_at_10", "recall_at_5", "recall_at_10", "hit_rate_at_10")


def gain(grade: Column, rank: Column) -> Column:
    """Discounted gain of a grade at a rank."""
    return F.when(grade > 0, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)).otherwise(0.0)


def ideal(qrels: DataFrame, cuts: tuple[int, ...] = NDCG_CUTS) -> DataFrame:
    """(query_id, n_relevant, idcg_k...) of each query: grades sorted downwards, cut at k; n_relevant counts all its entries."""
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    r = qrels.withColumn("i", F.row_number().over(order))
    return r.groupBy("query_id").agg(F.count("*").alias("n_relevant"), *(F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i"))).otherwise(0.0)).alias(f"idcg_{k}") for k in cuts))


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """All thirteen metrics of every query in ``queries`` (query_id); queries without results or relevant documents are rows of zeros."""
    graded = run.join(qrels, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)).cast("double"))
    before = Window.partitionBy("query_id").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    graded = graded.withColumn("hits", F.sum((F.col("grade") > 0).cast("int")).over(before))
    rel, rank = F.col("grade") > 0, F.col("rank")
    cut = lambda k, value: F.sum(F.when(rank <= k, value).otherwise(0.0))
    hit = rel.cast("double")
    sums = graded.groupBy("query_id").agg(
        *(cut(k, gain(F.col("grade"), rank)).alias(f"dcg_{k}") for k in NDCG_CUTS),
        F.min(F.when(rel & (rank <= 10), rank)).alias("first_hit"),
        *(cut(k, hit).alias(f"hits_{k}") for k in PRECISION_CUTS),
        cut(10, F.when(rel, F.col("hits") / rank).otherwise(0.0)).alias("ap"),
    )
    q = queries.select("query_id").join(sums, "query_id", "left").join(ideal(qrels), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = F.coalesce("n_relevant", F.lit(0))
    return q.select(
        "query_id",
        *(zero(safe(F.col(f"dcg_{k}"), F.col(f"idcg_{k}"))).alias(f"ndcg_at_{k}") for k in NDCG_CUTS),
        zero(1.0 / F.col("first_hit")).alias("mrr"),
        *(zero(F.col(f"hits_{k}") / k).alias(f"precision_at_{k}") for k in PRECISION_CUTS),
        *(zero(safe(F.col(f"hits_{k}"), n)).alias(f"recall_at_{k}") for k in RECALL_CUTS),
        zero(safe(F.col("ap"), F.least(n, F.lit(10)))).alias("map_at_10"),
        F.when(F.coalesce("first_hit", F.lit(0)) > 0, 1.0).otherwise(0.0).alias("hit_rate_at_10"),
    )


def aggregate(scores: DataFrame) -> DataFrame:
    """One row of means over all queries and their number; zeros without queries."""
    return scores.agg(*(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in AGGREGATED), F.count("*").alias("n_queries"))


def band(value: Column, bands: tuple[tuple[float, str], ...], rest: str = "Poor") -> Column:
    """Name of the first band whose bound the value reaches."""
    out = F.lit(rest)
    for bound, name in reversed(bands):
        out = F.when(value >= bound, name).otherwise(out)
    return out


def weaknesses(values: dict[str, Column]) -> Column:
    """Array of the metrics below their bounds; nulls and metrics without a bound say nothing."""
    return F.array_compact(F.array(*(F.when(c < WEAK[m], F.lit(m)) for m, c in values.items() if m in WEAK)))


def leaderboard(experiments: DataFrame, metric: str, corpus: str | None = None, top: int = 20) -> DataFrame:
    """Best experiments (experiment_id, corpus_id, mode, metrics...) by a positive, non-NaN metric."""
    rows = experiments.where((F.col(metric) > 0) & ~F.isnan(metric))
    if corpus is not None:
        rows = rows.where(F.col("corpus_id") == corpus)
    return rows.orderBy(F.desc(metric), "experiment_id").limit(top)


def improvement(ndcg: Column, baseline: Column) -> Column:
    """Percent over a baseline, null without one."""
    return F.when(baseline > 0, (ndcg - baseline) / baseline * 100)


def proxies(pairs: DataFrame) -> DataFrame:
    """Token-overlap proxies (never scores of a judge) over (id, question, context, answer, truth?).

    faithfulness_proxy: share of the answer's tokens in the context; context_precision_proxy: share of the
    context's in the question; context_recall_proxy: share of the truth's in the context, null without truth;
    answer_relevance_proxy: share of the question's in the answer. Empty denominators give null.
    """
    from ..functions import text as T

    sets = pairs.select("id", *(F.array_distinct(T.tokens(F.col(c))).alias(c) for c in ("question", "context", "answer", "truth")))
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))
    return sets.select("id", share("answer", "context").alias("faithfulness_proxy"), share("context", "question").alias("context_precision_proxy"), share("truth", "context").alias("context_recall_proxy"), share("question", "answer").alias("answer_relevance_proxy"))


def answer_targets(means: DataFrame) -> DataFrame:
    """(metric, value, target, met) of one row of answer metrics, under their own names or as proxies; missing values meet nothing."""
    have = {m: c for m in RAG_TARGETS for c in (m, f"{m}_proxy") if c in means.columns}
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(RAG_TARGETS[m]).alias("target"), F.coalesce(F.col(c) >= RAG_TARGETS[m], F.lit(False)).alias("met")) for m, c in have.items()))
    return means.select(F.explode(rows).alias("x")).select("x.*")


def window_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all windows of ``n`` tokens of lower-case texts, of all tokens where a row has fewer; rows without tokens have none."""
    row, terms, at = T.cut_lower(texts)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False)[at]
    lengths = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(lengths)
    left = ends[row] - np.arange(len(row))  # tokens from here to the end of the row
    rows, hashes, h = [], [], np.zeros(len(own), np.uint64)
    for k in range(1, n + 1):  # h: of the k tokens from each place on
        h = h[: len(own) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 :]
        at = np.flatnonzero(left[: len(h)] >= n) if k == n else (ends - lengths)[lengths == k]
        rows.append(row[at])
        hashes.append(h[at])
        if k == len(own):
            break
    return np.concatenate(rows), np.concatenate(hashes).view(np.int64)


def windows(texts: DataFrame, key: str, n: int, among: Broadcast | None = None) -> DataFrame:
    """(key, g): hashes of each text's distinct windows of ``n`` tokens; only those in the sorted array ``among``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = among.value if among is not None else None
        ends = np.zeros(1 << 20, bool)  # the last bits of wanted ones: most others are left out by one look
        if wanted is not None:
            ends[wanted & (len(ends) - 1)] = True
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                ids, lower = batch.slice(i, 1024).columns
                row, g = window_hashes(lower, n)
                if wanted is not None:
                    near = ends[g & (len(ends) - 1)]
                    row, g = row[near], g[near]
                    held = wanted[np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)] == g if len(wanted) else np.zeros(len(g), bool)
                    row, g = row[held], g[held]
                order = np.lexsort((g, row))
                row, g = row[order], g[order]
                first = np.append(True, (np.diff(row) != 0) | (np.diff(g) != 0))[: len(row)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[first])), pa.array(g[first])], names=[key, "g"])

    rows = texts.select(key, F.lower("text").alias("t"))
    return rows.mapInArrow(run, StructType([rows.schema[key], StructField("g", LongType())]))


def window_matches(passages: DataFrame, docs: DataFrame, n: int, share: float) -> DataFrame:
    """(query_id, doc_id, share) of documents that hold at least that share of a passage's distinct windows of ``n`` tokens.

    An equi-join on hashes of windows; both sides are cut up whole. The windows of at most QUERY_BLOCK passages are
    sent to the tasks, which then hand on no other; beyond, all are shuffled.
    """
    cut = windows(passages, "query_id", n)
    sizes = cut.groupBy("query_id").agg(F.count("*").alias("n"))
    among = None
    if passages.count() <= QUERY_BLOCK:
        among = docs.sparkSession.sparkContext.broadcast(np.unique(cut.select("g").toArrow().column(0).to_numpy()))
    hits = windows(docs, "doc_id", n, among).join(cut, "g").groupBy("query_id", "doc_id").agg(F.count("*").alias("k"))
    return hits.join(sizes, "query_id").select("query_id", "doc_id", (F.col("k") / F.col("n")).alias("share")).where(F.col("share") >= share)
