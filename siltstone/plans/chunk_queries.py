"""Chunkers over the whole document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunkers, dense
from ..operators.chunkers import ChunkConfig
from .registry import query, table
from .text_queries import SENTENCES_SQL, WORDS_SQL

CONFIG = ChunkConfig(chunk_size=128, chunk_overlap=16, min_chunk_size=10, max_chunk_size=1024)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def digested(chunks: DataFrame) -> DataFrame:
    """Chunks with their texts as digests."""
    return chunks.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("token_count").cast("bigint").alias("token_count"), F.md5("text").alias("digest"))


_FIXED = f"""SELECT doc_id, i AS chunk_index, array_to_string(list_slice(w, i * 112 + 1, i * 112 + 128), ' ') AS text, len(list_slice(w, i * 112 + 1, i * 112 + 128)) AS token_count FROM (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, ceil((len(w) - 128) / 112.0)::INT))) AS i FROM (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents) WHERE len(w) > 0)"""


@query(f"SELECT doc_id, chunk_index::BIGINT AS chunk_index, token_count::BIGINT AS token_count, md5(text) AS digest FROM ({_FIXED}) WHERE token_count BETWEEN 10 AND 1024")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 words with 16 of overlap."""
    return digested(chunkers.chunk(docs(spark, sf_dir), "fixed", CONFIG))


@query(f"SELECT count(*)::BIGINT AS n_chunks, sum(token_count)::BIGINT AS total_tokens, round_even(sum(token_count) / count(*), 1) AS avg_tokens FROM ({_FIXED}) WHERE token_count BETWEEN 10 AND 1024")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and mean size of the fixed chunks."""
    s = chunkers.statistics(chunkers.chunk(docs(spark, sf_dir), "fixed", CONFIG))
    return s.select("n_chunks", "total_tokens", "avg_tokens")


@query(f"""SELECT doc_id, (i - 1)::BIGINT AS chunk_index, n::BIGINT AS token_count, md5(t) AS digest, md5(s[i]) AS anchor, (greatest(i - 3, 1) - 1)::BIGINT AS window_start, (least(i + 3, len(s)) - 1)::BIGINT AS window_end FROM (SELECT *, len({WORDS_SQL.format("t")}) AS n FROM (SELECT doc_id, s, i, array_to_string(list_slice(s, greatest(i - 3, 1), least(i + 3, len(s))), ' ') AS t FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTENCES_SQL.format("text")} AS s FROM documents)))) WHERE n BETWEEN 10 AND 1024""")
def chunk_sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of three sentences to each side of every sentence."""
    c = chunkers.chunk(docs(spark, sf_dir), "sentence_window", CONFIG)
    return c.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("token_count").cast("bigint").alias("token_count"), F.md5("text").alias("digest"), F.md5("anchor").alias("anchor"), F.col("window_start").cast("bigint").alias("window_start"), F.col("window_end").cast("bigint").alias("window_end"))


_HEADS = ["# Alpha", "SECTION TWO", "1. Intro duction", "Chapter 4 x", "II. Roman"]


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading before every line that starts with a capital T or D, by id."""
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % 5 + 1).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike("^[TD]"), F.concat(head, F.lit("\n"), x)).otherwise(x))
    return docs(spark, sf_dir).select("doc_id", F.array_join(lines, "\n").alias("text"))


_HEADING_SQL = T.HEADING_PATTERN.replace("'", "''")


@query(rf"""WITH d AS (SELECT doc_id, string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^[TD]') THEN ['# Alpha', 'SECTION TWO', '1. Intro duction', 'Chapter 4 x', 'II. Roman'][1 + doc_id % 5] || chr(10) || x ELSE x END), chr(10)), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
h AS (SELECT *, regexp_matches(regexp_replace(line, '^\s+|\s+$', '', 'g'), '{_HEADING_SQL}') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM h),
g AS (SELECT doc_id, sec, coalesce(max(CASE WHEN head THEN regexp_replace(line, '^\s+|\s+$', '', 'g') END), 'Introduction') AS heading, regexp_replace(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS body FROM s GROUP BY doc_id, sec)
SELECT doc_id, heading, count(*)::BIGINT AS n_sections, sum(length(body))::BIGINT AS n_chars FROM g WHERE body <> '' GROUP BY doc_id, heading""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by heading of every document with headings put in."""
    s = chunkers.section_rows(_structured(spark, sf_dir))
    return s.groupBy("doc_id", "heading").agg(F.count("*").alias("n_sections"), F.sum(F.length("body")).cast("bigint").alias("n_chars"))


@query()
def chunk_document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section chunks; long sections are cut recursively."""
    return digested(chunkers.chunk(_structured(spark, sf_dir), "document_structure", CONFIG))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at the coarsest separators that keep them within 128 words."""
    return digested(chunkers.chunk(docs(spark, sf_dir), "recursive", CONFIG))


_PARAGRAPHS = f"SELECT doc_id, pos, p, {WORDS_SQL.format('p')} AS w FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(p) <> ''"
_CLAIMS = f"list_filter(flatten(list_transform({SENTENCES_SQL.format('p')}, lambda s: list_transform(string_split(s, ';'), lambda c: trim(c)))), lambda c: c <> '')"


@query(rf"""WITH para AS ({_PARAGRAPHS}), c AS (SELECT doc_id, pos, unnest(range(len(x))) AS k, unnest(x) AS t FROM (SELECT doc_id, pos, CASE WHEN len(w) < 30 THEN [trim(p)] ELSE {_CLAIMS} END AS x FROM para)),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS i, t, len({WORDS_SQL.format('t')}) AS w FROM c)
SELECT doc_id, i::BIGINT AS chunk_index, w::BIGINT AS token_count, md5(t) AS digest FROM n WHERE w BETWEEN 10 AND 1024""")
def chunk_propositional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every paragraph (a line is a paragraph here), by the offline clause splitter."""
    d = docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return digested(chunkers.chunk(d, "propositional", CONFIG))


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of similar sentences by hashed vectors."""
    v = dense.hashed_sentences(docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("sentences")), dim=16)
    return digested(chunkers.size_filter(chunkers.semantic_rows(v, ChunkConfig(min_chunk_size=10, breakpoint=0.5)), CONFIG))


WHOLE = ChunkConfig(chunk_size=1_000_000, chunk_overlap=0, min_chunk_size=1, max_chunk_size=1_000_000)


@query(rf"""WITH p AS (SELECT doc_id, regexp_replace(replace(text, '[TABLE]', ''), '^\s+|\s+$', '', 'g') AS t FROM documents), c AS (SELECT doc_id, 0 AS i, t FROM p WHERE len({WORDS_SQL.format("t")}) > 0
UNION ALL SELECT d.doc_id, (len({WORDS_SQL.format("p.t")}) > 0)::INT, 'TABLE 1:' || chr(10) || 'Headers: doc | lang' || chr(10) || d.doc_id || ' | ' || coalesce(d.lang, '-') FROM documents d JOIN p ON p.doc_id = d.doc_id
UNION ALL SELECT d.doc_id, (len({WORDS_SQL.format("p.t")}) > 0)::INT + 1, 'TABLE 3:' || chr(10) || 'Headers: source' || chr(10) || coalesce(d.source, '-') FROM documents d JOIN p ON p.doc_id = d.doc_id WHERE d.doc_id % 2 = 0)
SELECT doc_id, i::BIGINT AS chunk_index, len({WORDS_SQL.format("t")})::BIGINT AS token_count, md5(t) AS digest FROM c""")
def chunk_table_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose and tables of every document: table blocks are put before and after its text, of its three tables the second is empty, and for odd ids the third."""
    d = table(spark, sf_dir, "documents")
    block = "[TABLE]\nsome | cells\n[/TABLE]"
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    none = F.array().cast("array<array<string>>")
    first = F.array(F.array(F.lit("doc"), F.lit("lang")), F.array(cell("doc_id"), cell("lang")))
    third = F.when(F.col("doc_id") % 2 == 0, F.array(F.array(F.lit("source")), F.array(cell("source")))).otherwise(none)
    made = d.select("doc_id", F.concat(F.lit(block), F.replace("text", F.lit("[TABLE]"), F.lit("")), F.lit(block)).alias("text"), F.array(first, none, third).alias("tables"))
    return digested(chunkers.chunk(made, "table_aware", WHOLE))


@query("SELECT source AS corpus_id, count(*)::BIGINT AS doc_count, sum(n)::BIGINT AS chunk_count, sum(t)::BIGINT AS total_tokens, round_even(sum(t) / greatest(sum(n), 1), 1) AS avg_tokens FROM (SELECT d.doc_id, source, count(c.doc_id) AS n, coalesce(sum(token_count), 0) AS t FROM documents d LEFT JOIN (SELECT * FROM (" + _FIXED + ") WHERE token_count BETWEEN 10 AND 1024) c ON c.doc_id = d.doc_id GROUP BY d.doc_id, source) GROUP BY source")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, chunks and tokens of every corpus (a document's source)."""
    from ..operators import corpus

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("corpus_id"))
    chunks = chunkers.chunk(d.select("doc_id", "text"), "fixed", CONFIG).join(d.select("doc_id", "corpus_id"), "doc_id")
    return corpus.statistics(d, chunks)
