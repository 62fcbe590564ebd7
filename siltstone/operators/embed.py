"""Embeddings: providers by model, a cache by content, and the chunks that still lack a vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus, dense

# --- fixed values: models (provider, dimensions, texts a request) ------------------------------------------------
MODELS = {
    "text-embedding-3-small": ("openai", 1536, 2048),
    "text-embedding-3-large": ("openai", 3072, 2048),
    "embed-english-v3.0": ("cohere", 1024, 96),
    "embed-multilingual-v3.0": ("cohere", 1024, 96),
    "BAAI/bge-m3": ("local", 1024, 64),
    "paraphrase-MiniLM-L6-v2": ("local", 384, 256),
    "all-MiniLM-L6-v2": ("local", 384, 256),
}
# --- end of fixed values ----------------------------------------------------------------------------------------

#: A provider maps (key, text) and a dimension to (key, vec). Services plug in here; offline there is the hashing one.
Provider = Callable[[DataFrame, int], DataFrame]
PROVIDERS: dict[str, Provider] = {"local": lambda texts, dim: dense.hashed_vectors(texts, dim, "key", "text").withColumnRenamed("doc_id", "key")}


def register(name: str, provider: Provider) -> None:
    """Add a provider, or replace one."""
    PROVIDERS[name] = provider


def models(spark: SparkSession) -> DataFrame:
    """(model, provider, dimensions, max_batch) of the known models."""
    return spark.createDataFrame([(m, *v) for m, v in MODELS.items()], "model string, provider string, dimensions int, max_batch int")


def embed(texts: DataFrame, model: str = "all-MiniLM-L6-v2", cache: DataFrame | None = None, now=None) -> DataFrame:
    """texts (..., text) with ``key``, ``vec`` and ``cached``: hits from the cache, each distinct miss computed once; empty texts are zero vectors."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {sorted(MODELS)}")
    provider, dim, _ = MODELS[model]
    if provider not in PROVIDERS:
        raise ValueError(f"no provider {provider!r} is registered")
    keyed = texts.withColumn("key", T.embedding_key(model, F.col("text")))
    if cache is None:
        found = keyed.withColumn("hit", F.lit(None).cast("array<double>"))
    else:
        found = corpus.cached_vectors(keyed, cache, F.current_timestamp() if now is None else now).withColumnRenamed("vec", "hit")
    misses = found.where("hit is null").select("key", "text").dropDuplicates(["key"])
    made = PROVIDERS[provider](misses, dim).select("key", F.col("vec").alias("made"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return found.join(made, "key", "left").withColumn("vec", F.coalesce("hit", "made", zero)).withColumn("cached", F.col("hit").isNotNull()).drop("hit", "made")


def summary(embedded: DataFrame) -> DataFrame:
    """(embedded, from_cache) counts of an :func:`embed` result."""
    return embedded.agg(F.count("*").alias("embedded"), F.coalesce(F.sum(F.col("cached").cast("bigint")), F.lit(0)).alias("from_cache"))
