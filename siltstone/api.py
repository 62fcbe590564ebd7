"""The engine as a workspace of tables: ingest, list, delete, retrieve, evaluate, answer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import agent, attacks, chunkers, corpus, dense, embed, evaluate, fusion, outcomes
from .operators.chunkers import ChunkConfig
from .operators.postings import PostingIndex
from .operators.registry import IndexRegistry
from .sources import benchmarks, files

# --- fixed values: bounds of requests and descriptions ----------------------------------------------------------
CORPUS_ID = r"^[a-zA-Z0-9_\-]{3,128}$"
BOUNDS = {"query": (1, 2048), "top_k": (1, 100), "rrf_k": (1, 200), "batch": (1, 50), "chunk_size": (64, 2048), "chunk_overlap": (0, 512), "list_limit": (1, 100), "chunk_limit": (1, 200)}
MODEL = "all-MiniLM-L6-v2"
MODES = {"sparse": "BM25 term matching", "dense": "cosine of vectors", "hybrid": "reciprocal rank fusion of both"}
# --- end of fixed values ----------------------------------------------------------------------------------------


def check(name: str, value: int) -> int:
    """The value, or ValueError outside its bounds."""
    low, high = BOUNDS[name]
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def modes(spark: SparkSession) -> DataFrame:
    """(mode, description)."""
    return spark.createDataFrame(list(MODES.items()), "mode string, description string")


def metrics(spark: SparkSession) -> DataFrame:
    """(metric, kind)."""
    rows = [(m, "retrieval") for m in evaluate.AGGREGATED] + [(m, "answer") for m in evaluate.RAG_TARGETS]
    return spark.createDataFrame(rows, "metric string, kind string")


CHUNKS = "chunk_id string, doc_id bigint, chunk_index int, text string, token_count int, strategy string, requested_strategy string, overlap_prev int, embedding array<double>, corpus_id string"
CHUNK_COLUMNS = ["chunk_id", "doc_id", "chunk_index", "text", "token_count", "strategy", "requested_strategy", "overlap_prev", "embedding"]
SHOWN_FAILURES = 100  # of a result's summary; the table has all


class Workspace:
    """Tables under one folder: corpora, chunks partitioned by corpus, and an index of each corpus.

    Writes are whole tables or whole partitions. Ingestion brings the index to the chunks by a change set; a corpus
    without an index (written before there were any) gets one at its first retrieval.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.indexes = spark, path.rstrip("/"), IndexRegistry()

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    CORPORA = "corpus_id string, name string, domain string, status string, strategy string, fingerprint string, doc_count bigint, chunk_count bigint, total_tokens bigint, created_at timestamp"

    def corpora(self) -> DataFrame:
        """All corpora."""
        if not self._exists("corpora"):
            if not self._exists("corpora-old"):
                return self.spark.createDataFrame([], self.CORPORA)
            return self.spark.read.schema(self.CORPORA).parquet(f"{self.path}/corpora-old")  # a swap was cut short
        return self.spark.read.schema(self.CORPORA).parquet(f"{self.path}/corpora")

    def _store(self, rows: DataFrame) -> None:
        """Replace the corpora table, a row a corpus; written aside first, as it is read from itself."""
        new, old, now = (self._path(f"corpora{x}") for x in ("-new", "-old", ""))
        rows.coalesce(1).write.mode("overwrite").parquet(new.toString())
        fs = now.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(old, True)
        if fs.exists(now):
            fs.rename(now, old)
        fs.rename(new, now)
        fs.delete(old, True)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def chunks(self, corpus_id: str) -> DataFrame:
        """A corpus' chunks in order."""
        return benchmarks.read_chunks(self.spark, f"{self.path}/chunks", corpus_id) if self._exists("chunks") else self.spark.createDataFrame([], CHUNKS)

    def ingest(self, corpus_id: str, source: str, domain: str = "general", strategy: str | None = None, config: ChunkConfig | None = None, force: bool = False) -> dict:
        """Load, chunk and store a folder; an unchanged corpus is skipped unless forced; without documents it fails."""
        if not re.match(CORPUS_ID, corpus_id):
            raise ValueError("corpus ids are 3 to 128 letters, digits, _ and -")
        config = config or ChunkConfig()
        check("chunk_size", config.chunk_size)
        check("chunk_overlap", config.chunk_overlap)
        staging = f"{self.path}/staging/{corpus_id}"
        try:
            return self._ingest(corpus_id, source, domain, strategy, config, force, staging)
        finally:
            self._fs().delete(self._path(f"staging/{corpus_id}"), True)

    def _ingest(self, corpus_id, source, domain, strategy, config, force, staging) -> dict:
        # files are read and parsed once, and documents chunked once; rows and failures are two parts of what was written
        loaded, unread = outcomes.store(files.LoaderRegistry().load(self.spark, source).drop("doc_id"), f"{staging}/loaded")
        docs = loaded.where("status = 'ok'").select(F.lit(corpus_id).alias("corpus_id"), "source", F.xxhash64("source").alias("doc_id"), "text", "tables", F.length("text").alias("n_chars"))
        n, failed = docs.count(), unread.select("source", F.lit("load").alias("step"), "error")
        result = lambda status, docs, chunks, skipped, failed: {"corpus_id": corpus_id, "status": status, "documents": docs, "chunks": chunks, "skipped": skipped, "failures": [(r.source, r.error) for r in failed.orderBy("source").limit(SHOWN_FAILURES).collect()]}
        name = strategy or chunkers.DOMAIN_STRATEGY[domain]
        if n == 0:
            self._save(corpus_id, domain, "failed", name, None, 0, 0, 0)
            return result("failed", 0, 0, False, failed)
        fingerprint = corpus.content_fingerprint(docs).first().fingerprint
        known = self.corpora().where(F.col("corpus_id") == corpus_id).first()
        if known is not None and known.fingerprint == fingerprint and not force:
            return result(known.status, known.doc_count, known.chunk_count, True, failed)
        made = chunkers.outcomes(docs, name, config).withColumn("requested_strategy", F.lit(name))
        made = made.withColumn("chunk_id", chunkers.chunk_key(F.col("doc_id"), F.col("strategy"), F.col("chunk_index"))).withColumn("embedding", F.lit(None).cast("array<double>"))
        _, uncut = outcomes.store(made.select(*CHUNK_COLUMNS, "error"), f"{staging}/chunked")
        uncut = uncut.select("doc_id", F.concat(F.lit("Chunking failed: "), "error").alias("error")).join(docs.select("doc_id", "source"), "doc_id")
        failed = failed.unionByName(uncut.select("source", F.lit("chunk").alias("step"), "error"))
        failed.write.mode("overwrite").parquet(f"{self.path}/failures/corpus_id={corpus_id}")
        self._move(f"staging/{corpus_id}/chunked/failed=false", f"chunks/corpus_id={corpus_id}")
        self.index(corpus_id).sync(self.units(corpus_id))
        s = chunkers.statistics(self.chunks(corpus_id)).first()
        self._save(corpus_id, domain, "ready", name, fingerprint, n, s.n_chunks, s.total_tokens)
        return result("ready", n, s.n_chunks, False, self.failures(corpus_id))

    FAILURES = "source string, step string, error string"

    def failures(self, corpus_id: str) -> DataFrame:
        """(source, step, error) of all files and documents of a corpus that its last ingestion couldn't load or chunk."""
        if not self._exists(f"failures/corpus_id={corpus_id}"):
            return self.spark.createDataFrame([], self.FAILURES)
        return self.spark.read.schema(self.FAILURES).parquet(f"{self.path}/failures/corpus_id={corpus_id}")

    def _fs(self):
        return self._path("corpora").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _move(self, source: str, target: str) -> None:
        """A written folder in place of another; without it, none."""
        fs, old, new = self._fs(), self._path(target), self._path(source)
        fs.delete(old, True)
        if fs.exists(new):
            fs.mkdirs(old.getParent())
            fs.rename(new, old)

    def _save(self, corpus_id, domain, status, strategy, fingerprint, docs, chunks, tokens) -> None:
        row = self.spark.createDataFrame([(corpus_id, None, domain, status, strategy, fingerprint, docs, chunks, tokens, None)], self.CORPORA)
        row = row.withColumn("name", corpus.display_name(F.col("corpus_id"))).withColumn("created_at", F.current_timestamp())
        self._store(corpus.upsert(self.corpora(), row))

    def list(self, domain: str | None = None, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        """A page of corpora."""
        return corpus.list_corpora(self.corpora(), domain, status, check("list_limit", limit), offset)

    def delete(self, corpus_id: str) -> None:
        """Remove a corpus and its chunks; LookupError if it is missing."""
        gone = corpus.get_corpus(self.corpora(), corpus_id)
        self._store(corpus.without(self.corpora(), gone))
        self.index(corpus_id).drop()
        for part in ("chunks", "failures"):
            self._fs().delete(self._path(f"{part}/corpus_id={corpus_id}"), True)

    def index(self, corpus_id: str) -> PostingIndex:
        """The stored postings and vectors of a corpus' chunks, in their newest version."""
        return PostingIndex(self.spark, f"{self.path}/index/{corpus_id}", lambda texts: embed.embed(texts, MODEL).select("doc_id", "vec"))

    def retrieve(self, corpus_id: str, queries: DataFrame, mode: str = "hybrid", top_k: int = 10, rrf_k: int = 60, model: str = MODEL) -> DataFrame:
        """(query_id, doc_id, score, rank, ...) for a query frame (query_id, text); doc_id numbers the corpus' chunks.

        No chunk is cut into terms or embedded again, but for a model whose vectors aren't stored.
        """
        check("top_k", top_k)
        check("rrf_k", rrf_k)
        index = self.index(corpus_id)
        if not index.exists():
            index.build(self.units(corpus_id))
        embedded = lambda df, i: embed.embed(df, model).select(F.col(i), "vec")
        vectors = lambda: index.vectors() if model == MODEL else embedded(self.units(corpus_id), "doc_id")
        near = lambda k: dense.exact_topk(vectors(), embedded(queries, "query_id"), k)
        return fusion.retrieve(mode, lambda k: index.topk(queries, k), near, top_k, rrf_k)

    def units(self, corpus_id: str) -> DataFrame:
        """(doc_id, text, chunk_id): chunks under a numeric id."""
        return self.chunks(corpus_id).select(F.xxhash64("chunk_id").alias("doc_id"), "text", "chunk_id")

    def score(self, run: DataFrame, qrels: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(metrics of each query, their means)."""
        each = evaluate.per_query(run, qrels, queries)
        return each, evaluate.aggregate(each)

    def robustness(self, corpus_id: str, queries: DataFrame, qrels: DataFrame, mode: str = "sparse") -> DataFrame:
        """The report of all transforms: clean and altered queries are retrieved in one plan."""
        variants = attacks.attacked(queries).withColumn("vid", F.xxhash64("query_id", "attack"))
        run = self.retrieve(corpus_id, variants.select(F.col("vid").alias("query_id"), "text"), mode)
        named = variants.select(F.col("vid").alias("query_id"), F.col("query_id").alias("qid"), "attack")
        wanted = named.join(qrels.withColumnRenamed("query_id", "qid"), "qid").select("query_id", "doc_id", "grade")
        each = evaluate.per_query(run.select("query_id", "doc_id", "rank"), wanted, named.select("query_id"))
        return attacks.report(each.join(named, "query_id").select("attack", F.col("ndcg_at_10").alias("ndcg")))

    def answer(self, corpus_id: str, queries: DataFrame, top_k: int = 10, mode: str = "hybrid", expand: Callable[[Column], Column] | None = None, decompose: Callable[[Column, Column], Column] = agent.sub_queries) -> DataFrame:
        """Analysis, extractive answer, citations and confidence of every query; models that rewrite or cut up queries plug in as expressions.

        A query's text, as rewritten, and its sub-queries are all retrieved in one plan and their rankings fused.
        Scores, and with them the confidence, are those of the query's own ranking where there are no sub-queries, else the fused ones.
        """
        asked = agent.expanded(queries, expand).select("query_id", F.col("text").alias("asked"))
        cut = queries.withColumn("sub_queries", decompose(F.col("text"), agent.query_type(F.col("text")))).join(asked, "query_id")
        parts = cut.select("query_id", F.col("asked").alias("text"), "sub_queries")
        whole = F.coalesce(F.size("sub_queries"), F.lit(0)) == 0
        own = self.retrieve(corpus_id, parts.where(whole).select("query_id", "text"), mode, top_k).select("query_id", "doc_id", "score", "rank")
        fused = fusion.fan_out(parts.where(~whole), lambda q: self.retrieve(corpus_id, q, mode, top_k), top_k).select("query_id", "doc_id", "score", "rank")
        return agent.answer_queries(queries, own.unionByName(fused).join(self.units(corpus_id), "doc_id"), decompose)
