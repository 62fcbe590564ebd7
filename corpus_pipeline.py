"""The corpus pipeline: quality rules, quality classifier, near-duplicate join, secret scan, packing.

Each stage takes all the rows that its predecessor kept and returns the columns of documents; the last returns
pieces of packed sequences. Stages are written as Parquet and read again. Nulls in any column, empty and very
long texts, repeated rows, empty tables and further columns are handled as the operators' docstrings say; rows
are told apart by id and text, so rows with one id and different texts are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import jaccard_join, packing, perplexity_rules, quality_knn, secret_scan
from siltstone.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band keep."""
    return perplexity_rules.filter_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours vote to keep; the labels' table teaches, as far as its documents are here."""
    space = quality_knn.fit_space(docs, table(spark, sf_dir, "labels"))
    return quality_knn.filter_documents(docs, space)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id."""
    return jaccard_join.keep_representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secret_scan.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack_documents(docs, path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("packing", packed),
]

#: The perplexity bands and the classifier can't be expressed in SQL; tests hold each stage against its operator, which has tests of its own.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
