"""Query analysis, answers and confidence: what surrounds retrieval for one question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: vocabularies, weights and texts --------------------------------------------------------------
QUERY_TYPES = {
    "factoid": ["what is", "who is", "when did", "how many", "define", "what are"],
    "analytical": ["why does", "how does", "explain", "analyze", "compare", "what causes"],
    "comparative": ["difference between", "compare", "versus", "vs", "better than", "advantages"],
    "exploratory": ["tell me about", "overview of", "summarize", "what should i know"],
}
DOMAIN_WORDS = {
    "healthcare": ["diagnosis", "treatment", "patient", "clinical", "drug", "symptom", "disease", "medical", "therapy", "glucose", "cardiac"],
    "finance": ["revenue", "profit", "ebitda", "margin", "earnings", "investment", "portfolio", "dividend", "stock", "debt", "yield"],
    "legal": ["contract", "agreement", "liability", "clause", "statute", "court", "plaintiff", "defendant", "regulation", "compliance"],
    "manufacturing": ["supply chain", "production", "quality", "defect", "tolerance", "assembly", "specification", "material"],
    "education": ["curriculum", "learning", "student", "assessment", "pedagogy", "course", "lecture", "exam"],
}
CONFIDENCE_WEIGHTS = {"top": 0.40, "gap": 0.25, "coverage": 0.20, "rerank": 0.15}
STATED_CONFIDENCE = {"high": 0.85, "medium": 0.55, "low": 0.25}
SCORE_BANDS, CONFIDENCE_BANDS = ((0.85, "excellent"), (0.70, "good"), (0.55, "fair")), ((0.85, "high"), (0.60, "medium"))
ANSWER_HEADER, NO_ANSWER = "Based on retrieved documents:", "No relevant documents were found."
# --- end of fixed values ----------------------------------------------------------------------------------------


def holds(text: Column, phrase: str) -> Column:
    """Substring test."""
    return F.contains(text, F.lit(phrase))


def query_type(query: Column) -> Column:
    """The first type one of whose phrases the lower-case query holds; factoid without any."""
    q, out = F.lower(query), F.lit("factoid")
    for name, phrases in reversed(QUERY_TYPES.items()):
        found = F.lit(False)
        for p in phrases:
            found = found | holds(q, p)
        out = F.when(found, name).otherwise(out)
    return out


def detect_domain(query: Column) -> Column:
    """The domain with most keywords in the lower-case query, the earlier one on ties; general without any."""
    q = F.lower(query)
    hits = {name: sum((holds(q, w).cast("int") for w in words), F.lit(0)) for name, words in DOMAIN_WORDS.items()}
    best, out = F.greatest(*hits.values()), F.lit("general")
    for name, n in reversed(hits.items()):
        out = F.when((n == best) & (best > 0), name).otherwise(out)
    return out


def sub_queries(query: Column, kind: Column) -> Column:
    """Offline stand-in for decomposition: an analytical or comparative query is cut at its conjunctions."""
    parts = F.filter(F.transform(F.split(query, r"(?i)\s+(?:and|versus|vs)\s+"), F.trim), lambda x: x != "")
    return F.when(kind.isin("analytical", "comparative") & (F.size(parts) > 1), parts).otherwise(F.array().cast("array<string>"))


def sigmoid(x: Column) -> Column:
    """Logistic function."""
    return 1 / (1 + F.exp(-x))


def confidence(scores: Column) -> Column:
    """Confidence of an array of scores in rank order: top, gap, coverage of the first ten, reranked top; three decimals."""
    s = F.transform(scores, sigmoid)
    top, second = F.get(s, F.lit(0)), F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))
    ten = F.slice(s, 1, 10)
    cover = F.size(F.filter(ten, lambda x: x >= 0.5)) / F.size(ten)
    w = CONFIDENCE_WEIGHTS
    value = w["top"] * top + w["gap"] * F.greatest(top - second, F.lit(0.0)) + w["coverage"] * cover + w["rerank"] * top
    return F.when(F.size(scores) == 0, 0.0).otherwise(F.bround(F.least(value, F.lit(1.0)), 3))


def stated_confidence(answer: Column) -> Column:
    """What an answer says of its own confidence, null if nothing."""
    said = F.lower(F.regexp_extract(answer, r"(?i)confidence:\s*(high|medium|low)", 1))
    out = F.lit(None).cast("double")
    for word, value in STATED_CONFIDENCE.items():
        out = F.when(said == word, value).otherwise(out)
    return out


def hallucination_risk(found: Column, stated: Column) -> Column:
    """Do both confidences exist and differ by more than 0.3?"""
    return F.coalesce(F.abs(found - stated) > 0.3, F.lit(False))


def result_arrays(results: DataFrame) -> DataFrame:
    """(query_id, r): each query's results (doc_id, text, score, rank) as an array in rank order; k rows a query."""
    return results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text", "score"))).alias("r"))


def context(r: Column) -> Column:
    """The first eight results as numbered sources."""
    block = lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("]\n"), F.substring(x["text"], 1, 500))
    return F.array_join(F.transform(F.slice(r, 1, 8), block), "\n\n---\n\n")


def extractive_answer(r: Column) -> Column:
    """The first three results' beginnings as bullets."""
    bullets = F.transform(F.slice(r, 1, 3), lambda x: F.concat(F.lit("• "), F.substring(x["text"], 1, 200), F.lit("...")))
    return F.when(F.size(r) == 0, F.lit(NO_ANSWER)).otherwise(F.array_join(F.concat(F.array(F.lit(ANSWER_HEADER)), bullets), "\n\n"))


def citations(r: Column) -> Column:
    """The first ten results as citation lines."""
    line = lambda x: F.format_string("[%d] %s — score: %.4f", x["rank"], F.coalesce(x["doc_id"].cast("string"), F.lit("Document")), x["score"])
    return F.transform(F.slice(r, 1, 10), line)


def bands(value: Column, limits: tuple[tuple[float, str], ...], rest: str) -> Column:
    """Display label."""
    out = F.lit(rest)
    for bound, name in reversed(limits):
        out = F.when(value >= bound, name).otherwise(out)
    return out


def sources(r: Column) -> Column:
    """The first ten results as structs of id, rank, beginning of the text and score."""
    return F.transform(F.slice(r, 1, 10), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["rank"].alias("rank"), F.substring(x["text"], 1, 300).alias("text"), F.round(x["score"], 4).alias("score")))


def expanded(queries: DataFrame, expand: Callable[[Column], Column] | None) -> DataFrame:
    """Queries (query_id, text) with the text that is to be retrieved: ``expand`` stands for a model that rewrites it; nulls and no model leave it."""
    return queries if expand is None else queries.withColumn("text", F.coalesce(expand(F.col("text")), F.col("text")))


def answer_queries(queries: DataFrame, results: DataFrame, decompose: Callable[[Column, Column], Column] = sub_queries) -> DataFrame:
    """One row a query (query_id, text): analysis, sources, answer, confidence and trace; queries without results too.

    ``decompose`` gives the sub-queries of a text and its type, as a model would.
    """
    kind = query_type(F.col("text"))
    q = queries.select("query_id", "text", kind.alias("query_type"), detect_domain(F.col("text")).alias("domain"), decompose(F.col("text"), kind).alias("sub_queries"))
    r = F.coalesce("r", F.expr("array()").cast("array<struct<rank:int,doc_id:bigint,text:string,score:double>>"))
    joined = q.join(result_arrays(results), "query_id", "left").withColumn("r", r)
    out = joined.withColumn("answer", extractive_answer(F.col("r"))).withColumn("confidence", confidence(F.transform("r", lambda x: x["score"])))
    out = out.withColumn("model_confidence", stated_confidence(F.col("answer")))
    trace = F.array(F.concat(F.lit("analyze type="), "query_type", F.lit(" domain="), "domain"), F.concat(F.lit("retrieve n="), F.size("r").cast("string")), F.concat(F.lit("format confidence="), F.col("confidence").cast("string")))
    return out.select("query_id", "query_type", "domain", "sub_queries", context(F.col("r")).alias("context"), "answer", citations(F.col("r")).alias("citations"), sources(F.col("r")).alias("sources"), "confidence", "model_confidence", hallucination_risk(F.col("confidence"), F.col("model_confidence")).alias("hallucination_risk"), trace.alias("trace"))
