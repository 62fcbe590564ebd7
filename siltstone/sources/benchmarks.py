"""Retrieval benchmarks in the BEIR layout (corpus.jsonl, queries.jsonl, qrels/<split>.tsv), and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus (doc_id, text), queries (query_id, text), qrels (query_id, doc_id, grade)); grades above 0 are kept."""
    c = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    corpus = c.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", "text", "title")).alias("text"))
    q = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    r = spark.read.schema("query_id string, doc_id string, grade double").option("sep", "\t").option("header", True).csv(f"{folder}/qrels/{split}.tsv")
    return corpus, q, r.where("grade > 0")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks partitioned by corpus; only the corpora in ``chunks`` are overwritten."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, corpus_id: str | None = None, embedded: bool = False) -> DataFrame:
    """Chunks in chunk order, of one corpus (partition pruning) and with vectors only, if asked."""
    rows = spark.read.parquet(path)
    rows = rows if corpus_id is None else rows.where(F.col("corpus_id") == corpus_id)
    return (rows.where("embedding is not null") if embedded else rows).orderBy("chunk_index", "doc_id")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """An index as a table: ids, texts and vectors; nothing is pickled."""
    vectors.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """An index that :func:`write_vectors` stored."""
    return spark.read.parquet(path)
