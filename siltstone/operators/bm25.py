"""BM25 over a document frame: statistics, and top-k for a whole query frame in one plan.

Only postings of query terms are scored: the corpus is tokenised in the scan, exploded and filtered by the
distinct query terms before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Bm25:
    """Parameters; ``epsilon`` times the mean idf replaces negative idfs."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, dl, term): a row for every token, with its document's length."""
    t = docs.select(F.col(doc_id).alias("doc_id"), T.tokens(F.col(text)).alias("t"))
    return t.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, dl, term, tf): postings of all terms, or of those in ``terms`` (term), which are filtered before the shuffle if few."""
    rows = occurrences(docs, doc_id, text)
    rows = rows if terms is None else rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_totals(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row (n_docs, avgdl) over all documents, empty ones included."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(T.tokens(F.col(text)))).alias("avgdl"))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): documents that hold each term; distinct within the row, so one shuffle with partial counts."""
    return docs.select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def raw_idf(n: Column, df: Column) -> Column:
    """Okapi idf, negative for terms in more than half of the documents."""
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def scores(docs: DataFrame, queries: DataFrame, config: Bm25 = Bm25()) -> DataFrame:
    """(query_id, doc_id, score) of every document that holds a query term; queries are (query_id, text).

    A repeated query term counts repeatedly. The corpus is tokenised twice: for frequencies, of which all terms'
    are needed for the mean idf, and for the postings of query terms.
    """
    wanted = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    totals = corpus_totals(docs)
    idf = document_frequencies(docs).crossJoin(F.broadcast(totals)).withColumn("raw", raw_idf(F.col("n_docs"), F.col("df")))  # one row
    mean = idf.agg(F.avg("raw").alias("mean"))  # one row
    query_terms = wanted.join(idf, "term").crossJoin(F.broadcast(mean))
    weight = F.when(F.col("raw") < 0, config.epsilon * F.col("mean")).otherwise(F.col("raw"))
    query_terms = query_terms.select("query_id", "term", "avgdl", (weight * F.col("qtf")).alias("w"))
    joined = term_counts(docs, terms=wanted).join(query_terms, "term")
    length = 1 - config.b + config.b * F.col("dl") / F.col("avgdl")
    part = F.col("w") * F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * length)
    return joined.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def ranked(scored: DataFrame, k: int, digits: int = 9, score: str = "score") -> DataFrame:
    """The best ``k`` of each query with ranks; equal scores (rounded, so sums in any order agree) go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, digits)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(docs: DataFrame, queries: DataFrame, k: int = 10, config: Bm25 = Bm25(), pad: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank). With ``pad``, documents without a query term fill up to k with score 0, by id."""
    found = ranked(scores(docs, queries, config), k)
    return padded(found, docs, queries, k) if pad else found


def padded(found: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """A ranking filled up to ``k`` with documents of score 0, by id."""
    first = docs.select("doc_id").orderBy("doc_id").limit(2 * k)  # zero scores among the first ids suffice
    have = found.groupBy("query_id").agg(F.collect_set("doc_id").alias("have"), F.count("*").alias("n"))
    short = queries.select("query_id").join(have, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
    fill = short.crossJoin(F.broadcast(first)).where(~F.coalesce(F.array_contains("have", F.col("doc_id")), F.lit(False)))
    fill = fill.select("query_id", "doc_id", F.lit(0.0).alias("score"))
    return ranked(found.select("query_id", "doc_id", "score").unionByName(fill), k)
