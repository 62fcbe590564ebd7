"""The registered queries of the training-data operators, thin layers over the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, jaccard_join, language_id, packing, perplexity_rules, quality_knn, secret_scan, site_style, token_counts, topk_search, vector_dedup, word_runs
from .common import table


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, cut by its host's style tree."""
    return site_style.extract_pages(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the multilingual ranks and decoded again."""
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), path("byte_bpe_multi_50k.tiktoken"), PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1024 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of its language's perplexity band."""
    return perplexity_rules.judge(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the 32k piece model."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of four fifths of the ids."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    space = quality_knn.fit_space(docs.where(fold != 0).select("doc_id", "text"), labels.where(fold != 0).select("doc_id", "quality"))
    scored = quality_knn.score_documents(docs, space)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= quality_knn.THRESHOLD).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of the ids."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    dictionaries = language_id.fit_dictionaries(docs.where(remainder != 2).select("doc_id", "text", "lang"))
    found = language_id.identify(docs, dictionaries)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; its source owns it, and each document is a repository of its own."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors among equal labels, from a cosine of 0.98."""
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 most associated phrases over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of them made periodic by their ids."""
    return word_runs.digests(word_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector."""
    return topk_search.exact_topk(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    own = (op1_site_style, op2_byte_bpe, op3_packing, op4_jaccard_join, op5_perplexity_rules, op6_token_counts, op7_quality_knn, op8_language_id, op9_secret_scan, op10_vector_dedup, op11_collocations, op12_word_runs, op13_topk_search)
    return {f.__name__: f for f in own}


REACH_SQL = "r(x, y) AS (SELECT id, id FROM nodes UNION SELECT r.x, e.b FROM r JOIN edges e ON e.a = r.y), c AS (SELECT x AS id, min(y) AS component_id FROM r GROUP BY x)"

JACCARD_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, max(a.n) + max(b.n) AS t FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), nodes AS (SELECT doc_id AS id FROM documents), {REACH_SQL}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c ON c.id = s.doc_id"""

VECTOR_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS MATERIALIZED (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
edges AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {REACH_SQL}
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN (SELECT a, count(*) AS k FROM edges GROUP BY a) d ON d.a = vec_id"""


COLLOCATION_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p), t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) x(k)), f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT DISTINCT q.lang, q.f, array_to_string(string_split(q.phrase, ' ')[i:i + m - 1], ' ') AS phrase FROM f q, range(2, 5) y(m), range(1, 5) z(i) WHERE m < q.k AND i + m - 1 <= q.k),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND NOT EXISTS (FROM inside x WHERE x.lang = f.lang AND x.phrase = f.phrase AND x.f = f.f)),
s AS (SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score, cut FROM c JOIN range(1, 5) x(cut) ON cut < c.k JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM b QUALIFY rank <= 2000"""

TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the operator."""
    return {"op4_jaccard_join": JACCARD_SQL, "op10_vector_dedup": VECTOR_SQL, "op11_collocations": COLLOCATION_SQL, "op13_topk_search": TOPK_SQL}
