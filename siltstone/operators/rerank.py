"""Reranking and diversification of candidate lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lexical_score(query: Column, text: Column) -> Column:
    """Offline stand-in for a cross encoder: share of the query's distinct tokens that the text holds."""
    q = F.array_distinct(T.tokens(query))
    return F.size(F.array_intersect(q, T.tokens(text))) / F.greatest(F.size(q), F.lit(1))


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """Candidates (query_id, query, doc_id, text, score, rank) with ``rerank_score`` and ``new_rank``; ties keep their order."""
    scored = candidates.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order))


def rank_shift(reranked: DataFrame) -> DataFrame:
    """(query_id, rank_shift): mean absolute move of a query's candidates, two decimals."""
    return reranked.groupBy("query_id").agg(F.bround(F.avg(F.abs(F.col("rank") - F.col("new_rank"))), 2).alias("rank_shift"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def mmr(candidates: DataFrame, k: int = 10, lam: float = 0.7) -> DataFrame:
    """(query_id, doc_id, rank): greedy maximal marginal relevance over candidates (query_id, doc_id, text, score, rank).

    The next pick has the largest lam * score - (1 - lam) * greatest Jaccard similarity of words to a pick; ties
    go to the earlier candidate. Candidates of a query are a bounded pool (a ranking's cut), one group a query.
    """

    def pick(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("rank")
        words = [frozenset(t.lower().split()) for t in pool["text"].fillna("")]
        score, near = pool["score"].to_numpy(), [0.0] * len(pool)
        left, chosen = list(range(len(pool))), []
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (lam * score[i] - (1 - lam) * near[i] if chosen else score[i], -i))
            chosen.append(best)
            left.remove(best)
            for i in left:
                union = len(words[i] | words[best])
                near[i] = max(near[i], len(words[i] & words[best]) / union if union else 0.0)
        return pd.DataFrame({"query_id": pool["query_id"].iloc[chosen].to_numpy(), "doc_id": pool["doc_id"].iloc[chosen].to_numpy(), "rank": range(1, len(chosen) + 1)})

    return candidates.select("query_id", "doc_id", "text", "score", "rank").groupBy("query_id").applyInPandas(pick, "query_id bigint, doc_id bigint, rank int")
