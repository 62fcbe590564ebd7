"""Query analysis, answers and confidence over conversations and retrieval runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agent, evaluate
from .registry import query, table
from .retrieval_queries import BM25_SQL, Q_SQL, candidates, questions
from .text_queries import TOKENS_SQL

PHRASES = ["What is the treatment of ", "Explain and compare revenue: ", "difference between contract and statute vs ", "Tell me about the curriculum ", "Why does supply chain quality ", "plain words "]
_PHRASE_SQL = "['What is the treatment of ', 'Explain and compare revenue: ', 'difference between contract and statute vs ', 'Tell me about the curriculum ', 'Why does supply chain quality ', 'plain words '][1 + (conv_id + turn) % 6]"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns with a phrase before them, by conversation and turn."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(phrase, "text").alias("text"))


def _type_sql() -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(q, '{p}')" for p in ps) + f" THEN '{name}'" for name, ps in agent.QUERY_TYPES.items())
    return f"CASE {cases} ELSE 'factoid' END"


_ASKED = f"SELECT conv_id, turn, lower({_PHRASE_SQL} || text) AS q FROM conversations WHERE role = 'user'"


@query(f"SELECT conv_id, turn, {_type_sql()} AS query_type FROM ({_ASKED})")
def query_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of every user turn."""
    return asked(spark, sf_dir).select("conv_id", "turn", agent.query_type(F.col("text")).alias("query_type"))


def _domain_sql() -> str:
    hits = {name: " + ".join(f"contains(q, '{w}')::INT" for w in ws) for name, ws in agent.DOMAIN_WORDS.items()}
    cols = ", ".join(f"{h} AS {name}" for name, h in hits.items())
    best = f"greatest({', '.join(hits)})"
    cases = " ".join(f"WHEN {name} = {best} THEN '{name}'" for name in hits)
    return f"SELECT conv_id, turn, CASE WHEN {best} = 0 THEN 'general' {cases} END AS domain FROM (SELECT conv_id, turn, {cols} FROM ({_ASKED}))"


@query(_domain_sql())
def detect_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain of every user turn."""
    return asked(spark, sf_dir).select("conv_id", "turn", agent.detect_domain(F.col("text")).alias("domain"))


def stated(text: Column, turn: Column) -> Column:
    """Answers that state a confidence, by turn."""
    return F.concat(text, F.element_at(F.array(F.lit(" Confidence: High - yes"), F.lit(" confidence:  low"), F.lit(""), F.lit("CONFIDENCE: Medium")), (F.pmod(turn, F.lit(4)) + 1).cast("int")))


@query("""SELECT conv_id, turn, c AS model_confidence, coalesce(abs((conv_id % 11) / 10.0::DOUBLE - c) > 0.3, false) AS hallucination_risk FROM (SELECT conv_id, turn, CASE lower(regexp_extract(a, '(?i)confidence:\\s*(high|medium|low)', 1)) WHEN 'high' THEN 0.85::DOUBLE WHEN 'medium' THEN 0.55 WHEN 'low' THEN 0.25 END AS c FROM (SELECT conv_id, turn, text || [' Confidence: High - yes', ' confidence:  low', '', 'CONFIDENCE: Medium'][1 + turn % 4] AS a FROM conversations WHERE role = 'assistant'))""")
def model_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every assistant turn says of its confidence, and whether that departs from a made one."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = agent.stated_confidence(stated(F.col("text"), F.col("turn")))
    return c.select("conv_id", "turn", said.alias("model_confidence"), agent.hallucination_risk((F.col("conv_id") % 11) / F.lit(10.0), said).alias("hallucination_risk"))


_TOP = f"WITH {Q_SQL}, {BM25_SQL}, r AS (SELECT b.query_id, b.rank, b.doc_id, d.text, b.score FROM bm b JOIN documents d ON d.doc_id = b.doc_id WHERE b.rank <= 20)"


@query(f"{_TOP} SELECT q.query_id, coalesce('Based on retrieved documents:' || chr(10) || chr(10) || a, 'No relevant documents were found.') AS answer FROM q LEFT JOIN (SELECT query_id, string_agg('• ' || substring(text, 1, 200) || '...', chr(10) || chr(10) ORDER BY rank) AS a FROM r WHERE rank <= 3 GROUP BY query_id) x ON x.query_id = q.query_id")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all passages from their best documents."""
    return agent.answer_queries(questions(spark, sf_dir), candidates(spark, sf_dir)).select("query_id", "answer")


@query(f"{_TOP} SELECT query_id, md5(string_agg('[Source ' || rank || ']' || chr(10) || substring(text, 1, 500), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM r WHERE rank <= 8 GROUP BY query_id")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of all passages."""
    a = agent.result_arrays(candidates(spark, sf_dir))
    return a.select("query_id", F.md5(agent.context(F.col("r"))).alias("digest"))


@query(f"{_TOP} SELECT query_id, rank, '[' || rank || '] ' || doc_id || ' — score: ' || printf('%.4f', round(score + 1e-9, 4)) AS citation FROM r WHERE rank <= 10")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation lines of all passages' best documents."""
    a = agent.result_arrays(candidates(spark, sf_dir).withColumn("score", F.round(F.col("score") + 1e-9, 4)))
    return a.select("query_id", F.posexplode(agent.citations(F.col("r"))).alias("i", "citation")).select("query_id", (F.col("i") + 1).cast("bigint").alias("rank"), "citation")


@query(f"""{_TOP}, s AS (SELECT query_id, rank, 1 / (1 + exp(-score)) AS s FROM r), a AS (SELECT query_id, max(CASE WHEN rank = 1 THEN s END) AS t, coalesce(max(CASE WHEN rank = 2 THEN s END), 0) AS t2, avg(CASE WHEN s >= 0.5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (rank <= 10) AS cov FROM s GROUP BY query_id)
SELECT q.query_id, coalesce(round_even(least(0.40 * t + 0.25 * greatest(t - t2, 0) + 0.20 * cov + 0.15 * t, 1.0), 3), 0)::DOUBLE AS confidence FROM q LEFT JOIN a ON a.query_id = q.query_id""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of every passage's ranking."""
    return agent.answer_queries(questions(spark, sf_dir), candidates(spark, sf_dir)).select("query_id", "confidence")


@query()
def agent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole agent on all passages: analysis, answer, citations, confidence, trace."""
    return agent.answer_queries(questions(spark, sf_dir), candidates(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, context, answer, truth) from user turns and the assistant turns that follow them."""
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = u.join(a, ["conv_id", "turn"])
    w = F.split("answer", " ")
    second_half = F.array_join(F.slice(w, (F.size(w) / 2).cast("int") + 1, F.size(w)), " ")  # the context supports half of each answer
    return both.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "question", F.concat("question", F.lit(" "), second_half).alias("context"), "answer", F.when(F.col("turn") % 2 == 0, F.col("answer")).alias("truth"))


_SHARE = lambda a, b: f"CASE WHEN len({a}) > 0 THEN round(len(list_intersect({a}, {b}))::DOUBLE / len({a}), 6) END"
_PAIRS = f"""WITH p AS (SELECT u.conv_id || ':' || u.turn AS id, u.text AS question, u.text || ' ' || array_to_string(list_slice(string_split(a.text, ' '), 1 + len(string_split(a.text, ' ')) // 2, len(string_split(a.text, ' '))), ' ') AS context, a.text AS answer, CASE WHEN u.turn % 2 = 0 THEN a.text END AS truth FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
t AS (SELECT id, {", ".join(f"list_distinct({TOKENS_SQL.format(c)}) AS {c}" for c in ("question", "context", "answer", "truth"))} FROM p),
s AS (SELECT id, {_SHARE("answer", "context")} AS faithfulness_proxy, {_SHARE("context", "question")} AS context_precision_proxy, {_SHARE("truth", "context")} AS context_recall_proxy, {_SHARE("question", "answer")} AS answer_relevance_proxy FROM t)"""
_PROXIES = ["faithfulness_proxy", "context_precision_proxy", "context_recall_proxy", "answer_relevance_proxy"]


@query(f"{_PAIRS} SELECT * FROM s")
def ragas_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-overlap proxies of every question and answer."""
    p = evaluate.proxies(pairs(spark, sf_dir))
    return p.select("id", *(F.round(c, 6).alias(c) for c in _PROXIES))


@query(f"{_PAIRS} SELECT {', '.join(f'round(avg({c}), 5) AS {c}' for c in _PROXIES)}, count(*)::BIGINT AS n FROM s")
def ragas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the proxies; missing ones don't count."""
    p = evaluate.proxies(pairs(spark, sf_dir))
    return p.select(*(F.round(c, 6).alias(c) for c in _PROXIES)).agg(*(F.round(F.avg(c), 5).alias(c) for c in _PROXIES), F.count("*").alias("n"))


_TARGETS = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}_proxy), 5) AS value, {t}::DOUBLE AS target, coalesce(round(avg({m}_proxy), 5) >= {t}, false) AS met FROM s" for m, t in evaluate.RAG_TARGETS.items())


@query(f"{_PAIRS} {_TARGETS}")
def ragas_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proxies' means against the targets of answers."""
    return evaluate.answer_targets(ragas_aggregate(spark, sf_dir))
