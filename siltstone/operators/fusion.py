"""Fusion, routing and roll-up of rankings; a ranking is (query_id, doc_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of each arm: twice the wanted number, at most this many.
FETCH_CAP = 50


def fetch_size(k: int) -> int:
    """Candidates that a hybrid query takes from each arm."""
    return min(2 * k, FETCH_CAP)


def rrf(sparse: DataFrame, dense: DataFrame, k: int = 10, rrf_k: int = 60, faithful: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank, sparse_rank, dense_rank): the sum of 1 / (rrf_k + rank) over both arms.

    Ties go to the better sparse rank, then dense rank. With ``faithful``, a row of both arms keeps only its
    sparse rank, as the first arm's record wins. A missing arm may be an empty ranking.
    """
    arm = lambda df, name: df.select("query_id", "doc_id", (F.col("rank") if name == "s" else F.lit(None).cast("int")).alias("s"), (F.col("rank") if name == "d" else F.lit(None).cast("int")).alias("d"))
    both = arm(sparse, "s").unionByName(arm(dense, "d")).groupBy("query_id", "doc_id").agg(F.min("s").alias("sparse_rank"), F.min("d").alias("dense_rank"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("sparse_rank") + part("dense_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("sparse_rank"), F.asc_nulls_last("dense_rank"))
    out = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if faithful:
        out = out.withColumn("dense_rank", F.when(F.col("sparse_rank").isNull(), F.col("dense_rank")))
    return out.select("query_id", "doc_id", "score", "rank", "sparse_rank", "dense_rank")


def retrieve(mode: str, sparse: Callable[[int], DataFrame], dense: Callable[[int], DataFrame], k: int = 10, rrf_k: int = 60) -> DataFrame:
    """The ranking of a mode; arms are functions of the number of results."""
    if mode == "sparse":
        return sparse(k)
    if mode == "dense":
        return dense(k)
    if mode == "hybrid":
        n = fetch_size(k)
        return rrf(sparse(n), dense(n), k, rrf_k)
    raise ValueError(f"unknown retrieval mode {mode!r}")


def parts_of(queries: DataFrame) -> DataFrame:
    """(part_id, query_id, part, text) of queries (query_id, text, sub_queries): part 0 is the query itself, the others its sub-queries."""
    every = F.concat(F.array("text"), F.coalesce("sub_queries", F.array().cast("array<string>")))
    rows = queries.select("query_id", F.posexplode(every).alias("part", "text"))
    return rows.select(F.xxhash64("query_id", "part").alias("part_id"), "query_id", "part", "text")


def fan_out(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], k: int = 10, rrf_k: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank, parts) of queries (query_id, text, sub_queries), each part retrieved and the rankings fused.

    ``retrieve`` ranks a frame of queries (query_id, text), all parts of all queries at once. A document's score is the
    sum of 1 / (rrf_k + rank) over the parts that found it; ``parts`` lists them with their ranks. Ties go to the better
    best rank, then to the smaller id. Without sub-queries the order is that of the query's own ranking.
    """
    parts = parts_of(queries)
    found = retrieve(parts.select(F.col("part_id").alias("query_id"), "text")).select(F.col("query_id").alias("part_id"), "doc_id", "rank")
    each = found.join(parts.select("part_id", "query_id", "part"), "part_id")
    where = F.array_sort(F.collect_list(F.struct("part", "rank")))  # a row a part
    fused = each.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"), F.min("rank").alias("best"), where.alias("parts"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "best", "doc_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank", "parts")


def roll_up(chunk_ranking: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Best chunk of each parent document: chunk_ranking (query_id, chunk_id, score), chunks (chunk_id, doc_id)."""
    best = chunk_ranking.join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
