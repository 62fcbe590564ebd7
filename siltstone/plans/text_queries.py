"""Sources and text clean-up over the whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sentences
from ..sources import files
from .registry import query, table

TOKENS_SQL = r"list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> '')"
WORDS_SQL = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({TOKENS_SQL.format('text')})::BIGINT AS n_tokens, len(list_distinct({TOKENS_SQL.format('text')}))::BIGINT AS n_distinct, length(text)::BIGINT AS n_chars FROM documents")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, distinct tokens and characters of every document."""
    t = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"), F.length("text").cast("bigint").alias("n_chars"))


@query(f"SELECT doc_id, len({SENTENCES_SQL.format('text')})::BIGINT AS n_sentences, md5(array_to_string({SENTENCES_SQL.format('text')}, '|')) AS digest FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    s = T.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.md5(F.array_join(s, "|")).alias("digest"))


_TYPES_SQL = r"""w AS (SELECT unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents), b AS (SELECT CASE WHEN w LIKE '%.' THEN left(w, length(w) - 1) ELSE w END AS type, w LIKE '%.' AS stop FROM w),
c AS (SELECT type, count(*) FILTER (stop) AS stopped, count(*) FILTER (NOT stop) AS bare FROM b WHERE regexp_full_match(type, '\p{L}[\p{L}.]*') GROUP BY type), p AS (SELECT sum(stopped) / sum(stopped + bare) AS p FROM c),
a AS (SELECT type, stopped, bare, length(replace(type, '.', '')) AS letters, 2 * (stopped * ln(0.99) + bare * ln(0.01) - stopped * ln(p) - bare * ln(1 - p)) * exp(-length(replace(type, '.', ''))) * (length(type) - length(replace(type, '.', '')) + 1) * pow(length(replace(type, '.', '')), -bare) AS score FROM c, p WHERE stopped >= 2 AND p > 0 AND p < 1)"""


@query(f"WITH {_TYPES_SQL} SELECT type, stopped::BIGINT AS stopped, bare::BIGINT AS bare, round(score, 6) + 0.0 AS score, score >= 0.3 AS abbreviation FROM a")
def sentence_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word types that occur with a full stop, and which of them are abbreviations."""
    found = sentences.abbreviations(sentences.type_counts(table(spark, sf_dir, "documents")))
    return found.select("type", "stopped", "bare", F.round("score", 6).alias("score"), (F.col("score") >= sentences.ABBREVIATION).alias("abbreviation"))


@query()
def sentence_split_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document by boundaries learned from all of them."""
    d = table(spark, sf_dir, "documents")
    s = sentences.sentences(F.col("text"), sentences.fit(d))
    return d.select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


def _messy(text: Column, key: Column) -> Column:
    """Documents whose clean-up isn't empty: decomposed accents, line ends, empty lines and NULs by id."""
    extra = F.element_at(F.array(F.lit("é x\r\ny\r"), F.lit("\n\n\n\nÅ\n"), F.lit("a\x00b"), F.lit(" \t")), (F.pmod(key, F.lit(4)) + 1).cast("int"))
    return F.concat(extra, text, extra)


_MESSY_SQL = "[('e' || chr(769) || ' x' || chr(13) || chr(10) || 'y' || chr(13)), (chr(10)||chr(10)||chr(10)||chr(10)||'A'||chr(778)||chr(10)), ('a' || chr(0) || 'b'), (' ' || chr(9))][1 + (doc_id % 4)]"


@query(rf"""SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n_chars FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(m || text || m, chr(0), '')), '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, text, {_MESSY_SQL} AS m FROM documents))""")
def preprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean-up of every document with composed accents, line ends, empty lines and NULs put in by id."""
    t = T.preprocess(_messy(F.col("text"), F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


_PDF = "ﬁrst pa-\nge\n12\ntext ﬂow\n"


@query("""SELECT doc_id, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(p, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '-\\n([a-z])', '\\1', 'g'), '(?m)^\\d+\\s*$', '', 'g') AS t FROM (SELECT doc_id, 'ﬁrst pa-' || chr(10) || 'ge' || chr(10) || '12' || chr(10) || 'text ﬂow' || chr(10) || text || chr(10) || (doc_id % 7) AS p FROM documents))""".replace("\\\\", "\\"))
def pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligatures, hyphens and page numbers of pages made from every document."""
    page = F.concat(F.lit(_PDF), "text", F.lit("\n"), (F.col("doc_id") % 7).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_pdf(page)).alias("digest"))


_MD = "---\ntitle: x\n---\n# Head one\n\n![pic](a.png) and [link](http://x) **bold** _it_ ~~old~~\n> quoted\n- item\n3. third\n| a | b |\n## Two\n```py\ncode\n```\n"


def _markdown_sql() -> str:
    sql = "'" + _MD.replace("'", "''") + "' || text"
    for pattern, to in T.MARKDOWN_STEPS:
        sql = f"regexp_replace({sql}, '{pattern}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return f"SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n_chars FROM (SELECT doc_id, {sql} AS t FROM documents)"


@query(_markdown_sql())
def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of every document (front matter, headings, links, emphasis, lists, tables put before it) as plain text."""
    t = T.strip_markdown(F.concat(F.lit(_MD), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


@query(
    r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(h, '(?is)<meta\s+name="description"\s+content="([^"]*)', 1) AS description
FROM (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN replace(html, '<head>', '<head><meta name="description" content="page ' || page_id || '">') ELSE html END AS h FROM pages)"""
)
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of every page, and the description that every third is given."""
    given = F.concat(F.lit('<head><meta name="description" content="page '), F.col("page_id").cast("string"), F.lit('">'))
    h = F.when(F.col("page_id") % 3 == 0, F.replace(F.col("html"), F.lit("<head>"), given)).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), T.html_description(h).alias("description"))


def _html_sql() -> str:
    h = "html"
    for tag in T.HTML_NOISE_TAGS:
        h = f"regexp_replace({h}, '(?is)<{tag}\\b.*?</{tag}>', '', 'g')"
    t = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(a, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    t = f"array_to_string({t}, chr(10))"
    for entity, letter in T.ENTITIES:
        t = f"replace({t}, '{entity}', '{letter.replace(chr(39), chr(39) * 2)}')"
    article = r"regexp_extract(h, '(?is)<article\b[^>]*>(.*?)(?:</article>|\z)', 1)"
    return f"SELECT page_id, md5(t) AS digest, length(t)::BIGINT AS n_chars FROM (SELECT page_id, regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM (SELECT page_id, {article} AS a FROM (SELECT page_id, {h} AS h FROM pages)))"


@query(_html_sql())
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("t")).select("page_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


_EXT = [".pdf", ".DOCX", ".htm", ".md", ".log", ".xyz", ""]


@query("""SELECT page_id, CASE lower(e) WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.htm' THEN 'html' WHEN '.md' THEN 'markdown' WHEN '.log' THEN 'text' END AS loader FROM (SELECT page_id, ['.pdf', '.DOCX', '.htm', '.md', '.log', '.xyz', ''][1 + page_id % 7] AS e FROM pages)""")
def loader_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loader of a path made for every page."""
    e = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat(F.lit("/data/p"), F.col("page_id").cast("string"), e)
    return table(spark, sf_dir, "pages").select("page_id", files.LoaderRegistry().route(path).alias("loader"))


@query("SELECT doc_id, substring(sha256(source || ':' || doc_id), 1, 16) AS hashed, 'embed:' || sha256('local:' || text) AS cache_key FROM documents")
def doc_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids from sources, and embedding cache keys from texts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.document_id(F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("hashed"), T.embedding_key("local", F.col("text")).alias("cache_key"))


@query("""SELECT r_regionkey AS region, 'TABLE ' || (r_regionkey + 1) || ':' || chr(10) || 'Headers: name | key' || string_agg(chr(10) || n_name || ' | ' || n_nationkey, '' ORDER BY n_nationkey) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def table_linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's nations as a table in lines."""
    n = table(spark, sf_dir, "nation")
    cells = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.array("n_name", F.col("n_nationkey").cast("string")).alias("c"))))["c"]
    rows = n.groupBy(F.col("n_regionkey").alias("region")).agg(F.concat(F.array(F.array(F.lit("name"), F.lit("key"))), cells).alias("rows"))
    return rows.select("region", T.table_lines(F.col("region") + 1, F.col("rows")).alias("text"))


@query("""SELECT source, array_to_string(list(text ORDER BY doc_id) FILTER (length(trim(text)) >= 50), chr(10) || chr(10)) IS NOT NULL AS has_text, count(*)::BIGINT AS page_count, sum(CASE WHEN length(trim(text)) < 50 THEN 1 ELSE 0 END)::BIGINT AS n_scanned FROM documents GROUP BY source""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents as pages of one file: pages and scanned pages."""
    d = table(spark, sf_dir, "documents")
    out = files.pdf_documents(d.select("source", F.col("doc_id").alias("page_no"), "text"))
    return out.select("source", F.col("text").isNotNull().alias("has_text"), F.col("page_count").cast("bigint").alias("page_count"), F.col("n_scanned").cast("bigint").alias("n_scanned"))
