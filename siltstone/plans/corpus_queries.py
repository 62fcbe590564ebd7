"""Corpus lifecycle: a document's source is its corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import corpus, dense, embed, fusion
from .indexes import corpus_index
from .registry import query, table
from .retrieval_queries import RRF_SQL, hashed_arm, questions


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("corpus_id"), F.format_string("%s/%010d", "source", "doc_id").alias("source"), "doc_id", "text", F.length("text").alias("n_chars"))


_FP = "SELECT source AS corpus_id, sha256(string_agg(s || length(text), '' ORDER BY s)) AS fingerprint FROM (SELECT source, printf('%s/%010d', source, doc_id) AS s, text FROM documents) GROUP BY source"


@query(_FP)
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every corpus."""
    return corpus.fingerprint(documents(spark, sf_dir))


@query("SELECT source AS corpus_id, count(*)::BIGINT AS n, count(DISTINCT md5(printf('%s/%010d', source, doc_id) || text))::BIGINT AS n_contents FROM documents GROUP BY source")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and distinct contents of every corpus whose bounded fingerprint is the same when its rows come in another order."""
    d = documents(spark, sf_dir)
    whole = corpus.content_fingerprint(d)
    shuffled = corpus.content_fingerprint(d.repartition(7, "text")).withColumnRenamed("fingerprint", "again")
    return whole.join(shuffled, "corpus_id").where("fingerprint = again").join(d.groupBy("corpus_id").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64("source", "text")).alias("n_contents")), "corpus_id").select("corpus_id", "n", "n_contents")


@query(f"SELECT corpus_id, fingerprint, coalesce(corpus_id NOT LIKE '%3', false) AS skipped FROM ({_FP})")
def idempotent_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora ingested again: those whose stored fingerprint (changed for some) is the same are skipped."""
    new = corpus.fingerprint(documents(spark, sf_dir))
    known = new.select("corpus_id", F.when(F.col("corpus_id").like("%3"), F.lit("old")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return corpus.skip_unchanged(new, known)


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as corpora: names, domains by nation, balances as ages."""
    c = table(spark, sf_dir, "customer")
    domain = F.element_at(F.array(*map(F.lit, corpus.DOMAINS)), (F.pmod(F.col("c_nationkey").cast("bigint"), F.lit(9)) + 1).cast("int"))
    return c.select(F.concat(F.lit("corpus_"), F.col("c_custkey").cast("string")).alias("corpus_id"), domain.alias("domain"), F.when(F.col("c_acctbal") > 0, "ready").otherwise("failed").alias("status"), F.col("c_acctbal").alias("created_at"))


@query(f"SELECT 'corpus_' || c_custkey AS corpus_id, {str(corpus.DOMAINS)}[1 + c_nationkey % 9] AS domain FROM customer WHERE c_acctbal > 0 AND c_nationkey % 9 = 2 ORDER BY c_acctbal DESC, corpus_id LIMIT 20 OFFSET 5")
def list_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ready legal corpora, newest first."""
    return corpus.list_corpora(corpora(spark, sf_dir), domain="LEGAL", status="Ready", limit=20, offset=5).select("corpus_id", "domain")


@query("SELECT source AS corpus_id, doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 50 OFFSET 5")
def list_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one corpus' chunks (here whole documents)."""
    d = documents(spark, sf_dir).select("corpus_id", "doc_id", F.lit(0).alias("chunk_index"), F.col("n_chars").cast("bigint").alias("n_chars"))
    return corpus.list_chunks(d, "src3", limit=50, offset=5).select("corpus_id", "doc_id", "n_chars")


@query("SELECT 'corpus_' || c_custkey AS corpus_id, replace('Corpus_' || c_custkey, '_', ' ') AS display_name FROM customer WHERE 'corpus_' || c_custkey = 'corpus_7'")
def get_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus with its display name."""
    return corpus.get_corpus(corpora(spark, sf_dir), "corpus_7").select("corpus_id", corpus.display_name(F.col("corpus_id")).alias("display_name"))


@query("SELECT source AS corpus_id, count(*)::BIGINT AS n FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source LIKE '%1') GROUP BY source")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left in each corpus after some corpora went."""
    d = documents(spark, sf_dir)
    gone = d.where(F.col("corpus_id").like("%1")).select("corpus_id")
    return corpus.without(d, gone).groupBy("corpus_id").agg(F.count("*").alias("n"))


@query("SELECT source AS corpus_id, CASE WHEN source LIKE '%2' THEN 'new' ELSE 'old' END AS version, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def upsert_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora of which some were replaced."""
    d = documents(spark, sf_dir).groupBy("corpus_id").agg(F.count("*").alias("n"))
    old, new = d.withColumn("version", F.lit("old")), d.where(F.col("corpus_id").like("%2")).withColumn("version", F.lit("new"))
    return corpus.upsert(old, new).select("corpus_id", "version", "n")


@query("SELECT source AS corpus_id, CASE WHEN sum((length(text) >= 100)::INT) > 0 THEN 'ready' ELSE 'failed' END AS status, sum((length(text) >= 100)::INT)::BIGINT AS documents, sum((length(text) < 100)::INT)::BIGINT AS failures FROM documents GROUP BY source")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every corpus if short documents fail."""
    d = documents(spark, sf_dir).select("corpus_id", F.when(F.col("n_chars") < 100, "too short").alias("error"))
    return corpus.ingest_status(d)


@query("SELECT (doc_id % 3 = 0) AS cached, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def embed_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a cache that holds some keys, of which some are too old."""
    d = table(spark, sf_dir, "documents")
    keyed = d.select(F.concat(T.embedding_key("local", F.col("text")), F.lit(":"), F.col("doc_id").cast("string")).alias("key"), "doc_id")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    cache = keyed.where("doc_id % 3 <> 1").select("key", F.array(F.lit(1.0)).alias("vec"), F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-01 12:00:00")).otherwise(F.lit("2023-12-01 00:00:00")).cast("timestamp").alias("created_at"))
    return corpus.cached_vectors(keyed, cache, now).groupBy(F.col("vec").isNotNull().alias("cached")).agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM embeddings WHERE vec_id % 4 <> 0")
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return corpus.unembedded(e, e.where("chunk_id % 4 = 0")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS length, list_sum(c)::BIGINT AS n_tokens FROM (SELECT doc_id, list_transform(range(16), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS c FROM (SELECT doc_id, list_transform(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''), lambda t: ('0x' || substring(sha256(t), 1, 4))::INT % 16) AS b FROM documents))""")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and token number of the offline provider's bucket counts of every document."""
    d = table(spark, sf_dir, "documents")
    counts = dense.bucket_counts(d, 16)
    return counts.select("doc_id", F.round(V.norm(F.col("v")), 6).alias("length"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("n_tokens"))


@query("SELECT 'total' AS level, NULL AS lang, NULL AS source, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'lang', lang, NULL, count(*)::BIGINT FROM documents GROUP BY lang UNION ALL SELECT 'lang_source', lang, source, count(*)::BIGINT FROM documents GROUP BY lang, source")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and corpus, with subtotals."""
    r = table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "lang").otherwise("lang_source")
    return r.select(level.alias("level"), "lang", "source", "n")


_MODELS = "(VALUES ('text-embedding-3-small', 'openai', 1536, 2048), ('text-embedding-3-large', 'openai', 3072, 2048), ('embed-english-v3.0', 'cohere', 1024, 96), ('embed-multilingual-v3.0', 'cohere', 1024, 96), ('BAAI/bge-m3', 'local', 1024, 64), ('paraphrase-MiniLM-L6-v2', 'local', 384, 256), ('all-MiniLM-L6-v2', 'local', 384, 256)) t(model, provider, dimensions, max_batch)"


@query(f"SELECT t.*, n AS n_texts, ceil(n / max_batch)::BIGINT AS n_requests FROM {_MODELS}, (SELECT count(DISTINCT text) AS n FROM documents)")
def embed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known embedding models, and how many requests of each all distinct documents take."""
    n = table(spark, sf_dir, "documents").agg(F.count_distinct("text").alias("n_texts"))
    rows = embed.models(spark).crossJoin(F.broadcast(n))  # one row
    return rows.withColumn("n_requests", F.ceil(F.col("n_texts") / F.col("max_batch")))


_FOUND = " UNION ALL ".join(f"SELECT '{m}' AS mode, '{d}' AS description, count(*)::BIGINT AS n_results, round(avg(score), 6) AS mean_score FROM {r} WHERE rank <= 10" for m, d, r in (("sparse", "BM25 term matching", "bm"), ("dense", "cosine of vectors", "hv"), ("hybrid", "reciprocal rank fusion of both", "h")))


@query(f"{RRF_SQL} {_FOUND}")
def retrieval_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieval modes, with the number and mean score of what each finds for all passages."""
    from .. import api

    q, n, found = questions(spark, sf_dir), fusion.fetch_size(10), None
    sparse, near = corpus_index(spark, sf_dir).topk(q, n).checkpoint(), hashed_arm(spark, sf_dir, q, n).checkpoint()  # each arm is searched once, modes take the first of its rows
    for mode in api.MODES:
        run = fusion.retrieve(mode, lambda k: sparse.where(F.col("rank") <= k), lambda k: near.where(F.col("rank") <= k))
        one = run.agg(F.lit(mode).alias("mode"), F.count("*").alias("n_results"), F.round(F.avg("score"), 6).alias("mean_score"))
        found = one if found is None else found.unionByName(one)
    return api.modes(spark).join(found, "mode")
