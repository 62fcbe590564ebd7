"""Corpus lifecycle on plain tables: fingerprints, upserts, listings, deletion, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: states and domains ---------------------------------------------------------------------------
STATUSES = ["pending", "ingesting", "chunking", "embedding", "ready", "failed", "deprecated"]
DOMAINS = ["healthcare", "finance", "legal", "manufacturing", "ecommerce", "education", "cybersecurity", "government", "general"]
# --- end of fixed values ----------------------------------------------------------------------------------------


def fingerprint(docs: DataFrame) -> DataFrame:
    """(corpus_id, fingerprint) of documents (corpus_id, source, n_chars): the digest of sources and lengths in source order.

    Lines are sorted by Spark and joined in the aggregate, a few bytes a document of one corpus; use
    :func:`content_fingerprint` for corpora whose listings exceed a task.
    """
    line = F.struct(F.col("source"), F.concat("source", F.col("n_chars").cast("string")).alias("line"))
    return docs.groupBy("corpus_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line))["line"], ""), 256).alias("fingerprint"))


def content_fingerprint(docs: DataFrame) -> DataFrame:
    """(corpus_id, fingerprint) that also follows content, in bounded memory: sums of document hashes, order-free."""
    return docs.groupBy("corpus_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("source", "text").cast("decimal(38,0)")).alias("s")).select("corpus_id", F.sha2(F.concat_ws(":", "n", "s"), 256).alias("fingerprint"))


def skip_unchanged(new: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """(corpus_id, fingerprint, skipped): is the fingerprint known already?"""
    old = known.select("corpus_id", F.col("fingerprint").alias("known"))
    same = F.lit(False) if force else F.coalesce(F.col("fingerprint") == F.col("known"), F.lit(False))
    return new.join(old, "corpus_id", "left").select("corpus_id", "fingerprint", same.alias("skipped"))


def upsert(table: DataFrame, rows: DataFrame, key: str = "corpus_id") -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key; the caller overwrites the stored table with it."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def list_corpora(corpora: DataFrame, domain: str | None = None, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of corpora, newest first; filters ignore case."""
    rows = corpora
    for column, value in (("domain", domain), ("status", status)):
        if value is not None:
            rows = rows.where(F.lower(column) == value.lower())
    return rows.orderBy(F.desc("created_at"), "corpus_id").offset(offset).limit(limit)


def get_corpus(corpora: DataFrame, corpus_id: str) -> DataFrame:
    """One corpus; LookupError if it is missing."""
    found = corpora.where(F.col("corpus_id") == corpus_id)
    if found.isEmpty():
        raise LookupError(f"no corpus {corpus_id!r}")
    return found


def list_chunks(chunks: DataFrame, corpus_id: str | None = None, doc_id: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a corpus' chunks in document and chunk order."""
    rows = chunks if corpus_id is None else chunks.where(F.col("corpus_id") == corpus_id)
    rows = rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)
    return rows.orderBy("chunk_index", "doc_id").offset(offset).limit(limit)


def without(table: DataFrame, removed: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Rows whose key isn't removed: corpora and chunks are cascaded by the same call."""
    return table.join(removed.select(key).distinct(), key, "left_anti")


def statistics(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(corpus_id, doc_count, chunk_count, total_tokens, avg_tokens) of every corpus with documents."""
    d = docs.groupBy("corpus_id").agg(F.count("*").alias("doc_count"))
    c = chunks.groupBy("corpus_id").agg(F.count("*").alias("chunk_count"), F.sum("token_count").alias("total_tokens"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    joined = d.join(c, "corpus_id", "left").select("corpus_id", "doc_count", zero("chunk_count").alias("chunk_count"), zero("total_tokens").alias("total_tokens"))
    return joined.withColumn("avg_tokens", F.bround(F.col("total_tokens") / F.greatest("chunk_count", F.lit(1)), 1))


def display_name(corpus_id: Column) -> Column:
    """Words of an id, capitalised."""
    return F.initcap(F.replace(corpus_id, F.lit("_"), F.lit(" ")))


def ingest_status(loaded: DataFrame) -> DataFrame:
    """(corpus_id, status, documents, failures) of load results (corpus_id, error?): failed without a document."""
    ok = F.sum(F.col("error").isNull().cast("int"))
    return loaded.groupBy("corpus_id").agg(F.when(ok > 0, "ready").otherwise("failed").alias("status"), ok.alias("documents"), F.sum(F.col("error").isNotNull().cast("int")).alias("failures"))


def unembedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks (chunk_id, ...) that have no vector yet: set-based, so nothing is skipped or done twice."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def cached_vectors(texts: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int = 86_400) -> DataFrame:
    """texts (key, ...) with the cached ``vec`` (null: a miss); entries older than the time to live don't count."""
    alive = cache.where(F.unix_timestamp("created_at") > F.unix_timestamp(now) - ttl_seconds)
    latest = Window.partitionBy("key").orderBy(F.desc("created_at"))
    newest = alive.withColumn("i", F.row_number().over(latest)).where("i = 1").select("key", "vec")
    return texts.join(newest, "key", "left")
