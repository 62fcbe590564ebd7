"""Sparse, dense and fused retrieval over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import agent, bm25, dense, fusion, quantized, rerank
from ..operators.postings import PostingIndex
from ..session import forget_at_end, shared_dir
from .indexes import corpus_index
from .registry import query, table
from .text_queries import TOKENS_SQL

K = 10
#: Cells that the registered index search looks into.
PROBES = 9
#: Candidates that are sent to the tasks that read documents; if there are more, texts are dealt out by document.
SENT = 1_000_000


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of vector searches: ids divisible by 100, against all rows."""
    return vectors(spark, sf_dir).where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def ranking(df: DataFrame) -> DataFrame:
    return rounded(df.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank")), "score")


TERMS_SQL = f"SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents"
BM25_SQL = f"""t AS ({TERMS_SQL}), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, len({TOKENS_SQL.format("text")}) AS dl FROM documents),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, tot), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS_SQL.format("text")}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT query_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, tot GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""
Q_SQL = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
NORM_SQL = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"
VEC_SQL = f"v AS (SELECT vec_id, label, v, {NORM_SQL} AS n FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings))"
DENSE_SQL = f"""{VEC_SQL}, dn AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id))"""


@query(f"WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM ({TERMS_SQL}) GROUP BY ALL) SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency of every term."""
    return bm25.term_counts(corpus(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("bigint").alias("cf"))


@query(f"SELECT count(*)::BIGINT AS n_docs, round(avg(len({TOKENS_SQL.format('text')})), 6) AS avgdl FROM documents")
def bm25_corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and mean length of documents."""
    return rounded(bm25.corpus_totals(corpus(spark, sf_dir)), "avgdl")


@query(f"WITH {Q_SQL}, {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark passage."""
    return ranking(corpus_index(spark, sf_dir).topk(questions(spark, sf_dir), K))


@query(f"WITH t AS ({TERMS_SQL}) SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM t GROUP BY term")
def stored_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and document frequencies of the stored index, which the first query of a session builds."""
    return corpus_index(spark, sf_dir).frequencies()


@query(f"WITH {Q_SQL}, {BM25_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm WHERE rank <= 10")
def bm25_after_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents by an index of other texts, brought to those of the table by change sets.

    At first every document holds another text or is one that is gone later; two change sets and a merge make it the
    index of the table, whose rows it must give.
    """
    docs = corpus(spark, sf_dir)
    path = f"{shared_dir(spark)}/upkeep-{uuid.uuid4().hex}"
    forget_at_end(spark, path)
    first = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0))).first()[0]
    leaves = F.col("doc_id") % 3 == 0  # under an id below all others
    other = docs.select(F.when(leaves, first - 1 - (F.col("doc_id") - first)).otherwise(F.col("doc_id")).alias("doc_id"), F.when(leaves, F.col("text")).otherwise(F.concat_ws(" ", F.reverse("text"), F.lit("before"))).alias("text"))
    index = PostingIndex(spark, path).build(other)
    index.apply(docs.where("doc_id % 3 = 1"), other.where((F.col("doc_id") < first) & (F.col("doc_id") % 2 == 0)).select("doc_id"))
    return ranking(index.sync(docs).compact().topk(questions(spark, sf_dir), K))


@query(f"""WITH q AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'zzqx unknownword' ELSE text END AS text FROM benchmark), {BM25_SQL}, a AS (SELECT q.query_id, d.doc_id, coalesce(b.score, 0) AS score FROM q CROSS JOIN documents d LEFT JOIN bm b ON b.query_id = q.query_id AND b.doc_id = d.doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM a) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM p WHERE rank <= 10""")
def bm25_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents for every query, also where none holds its terms: zero scores fill up by id."""
    unknown = F.when(F.col("query_id") % 3 == 0, F.lit("zzqx unknownword")).otherwise(F.col("text"))
    asked = questions(spark, sf_dir).withColumn("text", unknown)
    return ranking(bm25.padded(corpus_index(spark, sf_dir).topk(asked, K), corpus(spark, sf_dir), asked, K))


@query(f"SELECT vec_id, round({NORM_SQL}, 6) AS norm, array_to_string(list_transform(v, lambda x: round(x / {NORM_SQL} * 1000000)::BIGINT), ',') AS millionths FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and all normalised components of every vector, in millionths."""
    v = V.doubles(F.col("embedding"))
    parts = F.transform(V.normalized(v), lambda x: F.round(x * 1_000_000).cast("bigint").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.array_join(parts, ",").alias("millionths"))


@query(f"WITH {DENSE_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dn WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every stated query, exactly."""
    return ranking(dense.exact_topk(vectors(spark, sf_dir), probes(spark, sf_dir), K, exclude_self=True))


@query(f"WITH {DENSE_SQL} SELECT query_id, doc_id, round(1 - (1 - score), 6) AS score, rank FROM dn WHERE rank <= 10")
def dense_distance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cosine distance: the score is one minus the distance."""
    near = dense.exact_topk(vectors(spark, sf_dir), probes(spark, sf_dir), K, exclude_self=True)
    return ranking(near.withColumn("distance", 1 - F.col("score")).withColumn("score", 1 - F.col("distance")))


def label_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of each label: fixed centroids that SQL can express."""
    e = table(spark, sf_dir, "embeddings").where("label is not null").select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return means.groupBy(F.col("label").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("centre"))


@query(f"""WITH {VEC_SQL}, c AS (SELECT label AS cell, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS i, unnest(v) AS x FROM v) GROUP BY label, i) GROUP BY label),
cn AS (SELECT cell, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM c),
near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_dot_product(v, c) / (v.n * cn.n + 1e-9), 9) DESC, cell) AS r FROM v, cn),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM near a JOIN near b USING (cell) WHERE a.vec_id % 100 = 0 AND a.r <= 9 AND b.r = 1 AND a.vec_id <> b.vec_id),
s AS (SELECT query_id, doc_id, list_dot_product(a.v, b.v) / (a.n * b.n + 1e-9) AS score FROM p JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors within the nine nearest of the ten labels' cells, which hold nine tenths of the true neighbours on all given tables."""
    return ranking(dense.ivf_topk(vectors(spark, sf_dir), probes(spark, sf_dir), label_centres(spark, sf_dir), K, PROBES, exclude_self=True))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, vec): the given vectors drawn towards their label's mean, and there towards one of eight vectors of the label.

    The given ones have no clusters to speak of, which no index of cells can search well.
    """
    e = table(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", "label", V.doubles(F.col("embedding")).alias("vec"))
    mean = label_centres(spark, sf_dir).select(F.col("cell").alias("label"), "centre")
    first = e.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("vec_id"), "vec_id"))).where("r <= 8").select("label", "r", F.col("vec").alias("anchor"))
    home = e.withColumn("r", (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(8)) + 1).cast("int")).join(first, ["label", "r"]).join(mean, "label")
    drawn = F.transform(F.arrays_zip("vec", "anchor", "centre"), lambda x: 0.35 * x["vec"] + x["anchor"] + x["centre"])
    return home.select(F.col("vec_id").alias("doc_id"), drawn.alias("vec"))


@query()
def quantized_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of clustered vectors by compressed cells, as many cells as a sample says."""
    v = clustered(spark, sf_dir)
    book = quantized.fit(v, 32)
    coded = quantized.encode(v, book)
    q = v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return ranking(quantized.search(v, coded, q, book, K, quantized.calibrated(v, book), exclude_self=True))


def hashed_arm(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int) -> DataFrame:
    """Dense arm over texts: cosines of the offline provider's vectors, stored for documents, with those of queries, exactly."""
    q = dense.hashed_vectors(queries.select(F.col("query_id").alias("doc_id"), "text"))
    return dense.exact_topk(corpus_index(spark, sf_dir).vectors(), q.withColumnRenamed("doc_id", "query_id"), k)


_BUCKETS = "SELECT {key}, b, count(*)::DOUBLE AS n FROM (SELECT {key}, ('0x' || substring(sha256(term), 1, 4))::INT % 64 AS b FROM (SELECT {key}, unnest({tokens}) AS term FROM {relation})) GROUP BY ALL"
HASHED_SQL = f"""hd AS MATERIALIZED ({_BUCKETS.format(key="doc_id", tokens=TOKENS_SQL.format("text"), relation="documents")}), hq AS MATERIALIZED ({_BUCKETS.format(key="query_id", tokens=TOKENS_SQL.format("text"), relation="q")}),
hdn AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM hd GROUP BY doc_id), hqn AS (SELECT query_id, sqrt(sum(n * n)) AS l FROM hq GROUP BY query_id),
hs AS (SELECT query_id, doc_id, dot / (hqn.l * hdn.l) / (1 + 1e-9) AS score FROM (SELECT hq.query_id, hd.doc_id, sum(hq.n * hd.n) AS dot FROM hq JOIN hd USING (b) GROUP BY ALL) JOIN hqn USING (query_id) JOIN hdn USING (doc_id)),
hv AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hs)"""
RRF_SQL = f"""WITH {Q_SQL}, {BM25_SQL}, {HASHED_SQL}, arms AS (SELECT query_id, doc_id, rank AS s, NULL AS d FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, NULL, rank FROM hv WHERE rank <= 20),
f AS (SELECT query_id, doc_id, min(s) AS s, min(d) AS d FROM arms GROUP BY ALL), g AS (SELECT *, coalesce(1.0::DOUBLE / (60 + s), 0) + coalesce(1.0::DOUBLE / (60 + d), 0) AS score FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, s NULLS LAST, d NULLS LAST) AS rank FROM g)"""


def hybrid(spark: SparkSession, sf_dir: str, faithful: bool = False) -> DataFrame:
    q, n = questions(spark, sf_dir), fusion.fetch_size(K)
    return fusion.rrf(corpus_index(spark, sf_dir).topk(q, n), hashed_arm(spark, sf_dir, q, n), K, faithful=faithful)


@query(f"{RRF_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM h WHERE rank <= 10")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark passage by fused rankings."""
    return ranking(hybrid(spark, sf_dir))


@query(f"{RRF_SQL} SELECT query_id, doc_id, rank, coalesce(s, 0)::BIGINT AS sparse_rank, coalesce(CASE WHEN s IS NULL THEN d END, 0)::BIGINT AS dense_rank FROM h WHERE rank <= 10")
def rrf_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where fused results come from, the sparse arm's record winning; 0 stands for no rank."""
    big = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return hybrid(spark, sf_dir, faithful=True).select("query_id", "doc_id", big("rank"), big("sparse_rank"), big("dense_rank"))


_PAIRED = "paired AS (SELECT item_id AS query_id, 'compare ' || text || ' versus ' || lead(text, 1, '') OVER (ORDER BY item_id) AS text FROM benchmark)"
_CUT = r"list_filter(list_transform(regexp_split_to_array(text, '(?i)\s+(?:and|versus|vs)\s+'), lambda x: trim(x)), lambda x: x <> '')"
_PARTS = f"""{_PAIRED}, cut AS (SELECT query_id, text, {_CUT} AS c FROM paired), parts AS (SELECT query_id AS whole, 0 AS part, text FROM cut UNION ALL SELECT query_id, unnest(range(1, len(c) + 1)), unnest(c) FROM cut WHERE len(c) > 1), q AS (SELECT whole || ':' || part AS query_id, text FROM parts)"""
FAN_SQL = f"""{RRF_SQL.replace(Q_SQL, _PARTS, 1)}, r AS (SELECT split_part(query_id, ':', 1)::BIGINT AS whole, split_part(query_id, ':', 2)::INT AS part, doc_id, rank FROM h WHERE rank <= 20),
u AS (SELECT whole AS query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best, count(*) AS n_parts, string_agg(part || ':' || rank, ',' ORDER BY part) AS parts FROM r GROUP BY ALL)"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of each passage with the next: queries that are cut into parts."""
    q = questions(spark, sf_dir)
    following = F.lead("text", 1, "").over(Window.orderBy("query_id"))  # the passages are few
    return q.select("query_id", F.concat(F.lit("compare "), F.col("text"), F.lit(" versus "), following).alias("text"))


@query(f"{FAN_SQL} SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, doc_id) AS rank, n_parts, parts FROM u QUALIFY rank <= 10")
def sub_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of comparisons by hybrid retrieval of the whole query and of its parts, fused again."""
    n = fusion.fetch_size(K)
    arm = lambda q: fusion.rrf(corpus_index(spark, sf_dir).topk(q, n), hashed_arm(spark, sf_dir, q, n), n)
    asked = compared(spark, sf_dir)
    found = fusion.fan_out(asked.withColumn("sub_queries", agent.sub_queries(F.col("text"), agent.query_type(F.col("text")))), arm, K)
    shown = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["part"], p["rank"])), ",")
    return ranking(found).join(found.select("query_id", "doc_id", F.size("parts").cast("bigint").alias("n_parts"), shown.alias("parts")), ["query_id", "doc_id"])


@query(f"WITH {Q_SQL}, {BM25_SQL}, {DENSE_SQL} SELECT 'sparse' AS mode, query_id, doc_id, rank FROM bm WHERE rank <= 5 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dn WHERE rank <= 5")
def batch_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all queries in two modes, five results each."""
    sparse = fusion.retrieve("sparse", lambda k: corpus_index(spark, sf_dir).topk(questions(spark, sf_dir), k), lambda k: None, 5)
    near = fusion.retrieve("dense", lambda k: None, lambda k: dense.exact_topk(vectors(spark, sf_dir), probes(spark, sf_dir), k, True), 5)
    part = lambda df, m: df.select(F.lit(m).alias("mode"), "query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"))
    return part(sparse, "sparse").unionByName(part(near, "dense"))


@query(f"""WITH {DENSE_SQL}, c AS (SELECT query_id, vec.label AS parent, max(score) AS score FROM dn JOIN v vec ON vec.vec_id = doc_id WHERE rank <= 50 GROUP BY ALL)
SELECT query_id, parent::BIGINT AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, parent) AS rank FROM c QUALIFY rank <= 10""")
def doc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty nearest vectors rolled up to their labels as parents, best chunk first."""
    near = dense.exact_topk(vectors(spark, sf_dir), probes(spark, sf_dir), 50, exclude_self=True)
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("doc_id"))
    return ranking(fusion.roll_up(near.select("query_id", F.col("doc_id").alias("chunk_id"), "score"), chunks))


def candidates(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """(query_id, query, doc_id, text, score, rank) of the twenty best by BM25; texts are joined for them only, and no others are shuffled."""
    d, q = corpus(spark, sf_dir), questions(spark, sf_dir)
    best = corpus_index(spark, sf_dir).topk(q, k).checkpoint()  # some rows a query
    if q.count() * k <= SENT:
        best = F.broadcast(best)
    return best.join(d, "doc_id").join(q.withColumnRenamed("text", "query"), "query_id")


_RERANK_SQL = f"""WITH {Q_SQL}, {BM25_SQL}, c AS (SELECT b.query_id, b.doc_id, b.rank, round(len(list_intersect(qq.t, list_distinct({TOKENS_SQL.format("d.text")}))) / greatest(len(qq.t), 1), 9) AS s
FROM bm b JOIN documents d ON d.doc_id = b.doc_id JOIN (SELECT query_id, list_distinct({TOKENS_SQL.format("text")}) AS t FROM q) qq ON qq.query_id = b.query_id WHERE b.rank <= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS new_rank FROM c)"""


@query(f"{_RERANK_SQL} SELECT query_id, doc_id, rank, new_rank, round(s, 6) AS rerank_score FROM r")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates reranked by shared tokens."""
    r = rerank.rerank(candidates(spark, sf_dir))
    return r.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.col("new_rank").cast("bigint").alias("new_rank"), F.round("rerank_score", 6).alias("rerank_score"))


@query(f"{_RERANK_SQL} SELECT query_id, round_even(avg(abs(rank - new_rank)), 2) AS rank_shift FROM r GROUP BY query_id")
def rank_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean move of the candidates by reranking."""
    return rerank.rank_shift(rerank.rerank(candidates(spark, sf_dir)))


@query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten diverse results of twenty candidates."""
    return rerank.mmr(candidates(spark, sf_dir), K)


@query(f"""WITH {Q_SQL}, {BM25_SQL}, t5 AS (SELECT b.query_id, b.doc_id, list_distinct({TOKENS_SQL.format("d.text")}) AS t FROM bm b JOIN documents d ON d.doc_id = b.doc_id WHERE b.rank <= 5)
SELECT a.query_id, a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM t5 a JOIN t5 b ON a.query_id = b.query_id AND a.doc_id < b.doc_id""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word similarity of the pairs within each query's five best."""
    from ..functions import text as T

    c = candidates(spark, sf_dir, 5).select("query_id", "doc_id", T.tokens(F.col("text")).alias("t"))
    b = c.select("query_id", F.col("doc_id").alias("b"), F.col("t").alias("u"))
    return c.join(b, "query_id").where("doc_id < b").select("query_id", F.col("doc_id").alias("a"), "b", F.round(rerank.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))
