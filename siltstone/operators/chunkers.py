"""Chunkers: documents in, chunks out. Sizes are counted in white-space tokens.

A document frame has doc_id and text; a chunk frame has doc_id, chunk_index, text, token_count, strategy and
overlap_prev. Chunkers leave size limits to :func:`size_filter`, which keeps the original indices.

Splitters run in Python over whole texts and may fail on one. :func:`chunk` lets such an exception end the job;
:func:`outcomes` makes it a row with ``error`` in the same pass, in place of that document's chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..functions import text as T
from ..functions import vector as V
from . import sentences as learned
from .sentences import SentenceModel


#: A splitter maps a text to its pieces.
Splitter = Callable[[str, "ChunkConfig"], Iterable[str]]


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in tokens, and the parameters of single strategies."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    min_chunk_size: int = 50
    max_chunk_size: int = 1024
    breakpoint: float = 0.85
    window: int = 3
    sentences: SentenceModel | None = None  # learned boundaries for the sentence windows, the fixed rule without
    splitter: Splitter | None = None  # cuts long texts in place of the separators' hierarchy
    failures: bool = False  # a splitter's exception is a row, and doesn't end the job

    def __post_init__(self) -> None:
        if min(self.chunk_size, self.min_chunk_size, self.window + 1) < 1 or self.chunk_overlap < 0:
            raise ValueError("sizes must be positive")


CHUNK_FIELDS = "doc_id bigint, chunk_index int, text string, token_count int, strategy string, overlap_prev int"


def chunk_key(doc: Column, strategy: Column, index: Column) -> Column:
    """Deterministic chunk id."""
    return F.sha2(F.concat_ws(":", doc.cast("string"), strategy, index.cast("string")), 256)


def shaped(df: DataFrame, strategy: str, overlap: int = 0) -> DataFrame:
    """doc_id, chunk_index and text completed to a chunk frame; an ``error`` column stays."""
    error = ["error"] if "error" in df.columns else []
    nominal = F.when(F.col("chunk_index") > 0, F.lit(overlap)).otherwise(F.lit(0))
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "text", T.token_count(F.col("text")).alias("token_count"), F.lit(strategy).alias("strategy"), nominal.alias("overlap_prev"), *error)


def size_filter(chunks: DataFrame, config: ChunkConfig) -> DataFrame:
    """Non-blank chunks between the least and the greatest size, and failures; indices are not renumbered."""
    fits = (F.trim("text") != "") & F.col("token_count").between(config.min_chunk_size, config.max_chunk_size)
    return chunks.where(fits | F.col("error").isNotNull() if "error" in chunks.columns else fits)


def fixed(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """Windows of ``chunk_size`` tokens that advance by size minus overlap; an overlap above the size gives no windows."""
    step = config.chunk_size - config.chunk_overlap
    if step == 0:
        raise ValueError("the overlap equals the chunk size")
    rows = docs.select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    if step < 0:
        rows, step = rows.limit(0), 1
    count = 1 + F.greatest(F.lit(0), F.ceil((F.size("w") - config.chunk_size) / F.lit(step))).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice("w", k * step + 1, config.chunk_size), " "))
    return shaped(rows.select("doc_id", F.posexplode(windows).alias("chunk_index", "text")), "fixed", config.chunk_overlap)


SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", " ", "")


def split_recursively(text: str, config: ChunkConfig, depth: int = 0) -> list[str]:
    """Pieces of at most ``chunk_size`` tokens cut at the coarsest separators that do, short ones merged with overlap."""
    size = config.chunk_size
    if len(text.split()) <= size:
        return [text] if text.strip() else []
    if depth == len(SEPARATORS):  # words parted by other white space than the separators
        w = text.split()
        return [" ".join(w[i : i + size]) for i in range(0, len(w), size)]
    sep = SEPARATORS[depth]
    parts = text.split(sep) if sep else [text[: len(text) // 2], text[len(text) // 2 :]]
    return merge_short([p for run in packed(parts, sep, size) for p in split_recursively(run, config, depth + 1)], config)


def packed(parts: list[str], sep: str, size: int) -> Iterator[str]:
    """Runs of parts joined again as long as they hold at most ``size`` tokens; token counts are carried along."""
    held, n = "", 0
    for part in parts:
        own = len(part.split())
        if held:
            joined = f"{held}{sep}{part}".strip()
            # a separator ends the last word of what is held, unless white space already has
            both = n + own if sep and not held[-1].isspace() else len(joined.split())
            if both <= size:
                held, n = joined, both
                continue
            yield held
        held, n = part, own
    if held:
        yield held


def merge_short(pieces: list[str], config: ChunkConfig) -> list[str]:
    """Pieces below the least size take in the next; every other hands its last ``chunk_overlap`` tokens on. No overlap means none."""
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1].split()) < config.min_chunk_size:
            out[-1] = f"{out[-1]} {piece}"
        elif out and config.chunk_overlap:
            out.append(" ".join([*out[-1].split()[-config.chunk_overlap :], piece]))
        else:
            out.append(piece)
    return out


def cut_texts(rows: DataFrame, config: ChunkConfig, fits: bool = False) -> DataFrame:
    """(keys..., part, text, error?) of rows (keys..., text): the non-blank pieces of each text, numbered before blank ones go.

    A text whose splitter raises has no pieces; if failures are rows, it gives one with the error. With ``fits`` the column
    before the text tells which ones stay as they are.
    """
    n, split = len(rows.columns) - 1 - fits, config.splitter or split_recursively

    def pieces(text: str | None) -> list[tuple[int, str | None, str | None]]:
        try:
            return [(k, p.strip(), None) for k, p in enumerate(split(text or "", config)) if p.strip()]
        except Exception as e:
            if not config.failures:
                raise
            return [(0, None, f"{type(e).__name__}: {e}")]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                some = batch.slice(i, 128)
                stays = some.column(n).to_pylist() if fits else [False] * some.num_rows
                found = [(r, *x) for r, text in enumerate(some.column(n + fits).to_pylist()) for x in ([(0, text, None)] if stays[r] else pieces(text))]
                at, part, texts, errors = zip(*found, strict=True) if found else [()] * 4
                columns = [c.take(pa.array(at, pa.int64())) for c in some.columns[:n]] + [pa.array(part, pa.int32()), pa.array(texts, pa.string())]
                names = [*batch.schema.names[:n], "part", "text"]
                if config.failures:
                    columns, names = [*columns, pa.array(errors, pa.string())], [*names, "error"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = StructType(rows.schema.fields[:n]).add("part", IntegerType()).add("text", StringType())
    return rows.mapInArrow(run, schema.add("error", StringType()) if config.failures else schema)


def recursive(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """Separator hierarchy from paragraphs to characters; sequential within a document, parallel over documents."""
    out = cut_texts(docs.select(F.col("doc_id").cast("bigint"), "text"), config).withColumnRenamed("part", "chunk_index")
    return shaped(out, "recursive", config.chunk_overlap)


def per_document(name: str, splitter: Splitter) -> Callable[[DataFrame, ChunkConfig], DataFrame]:
    """A strategy from a plain function of one text, for :func:`register`."""
    return lambda docs, config: recursive(docs, replace(config, splitter=splitter)).withColumn("strategy", F.lit(name)).withColumn("overlap_prev", F.lit(0))


def sentence_window(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """A chunk around every sentence, ``window`` sentences to each side; windows below the least size are skipped."""
    w = config.window
    cut = T.sentences(F.col("text")) if config.sentences is None else learned.sentences(F.col("text"), config.sentences)
    rows = docs.select("doc_id", cut.alias("s"))

    def around(anchor: Column, i: Column) -> Column:
        first, last = F.greatest(i - w, F.lit(0)), F.least(i + w, F.size("s") - 1)
        return F.struct(i.alias("chunk_index"), F.array_join(F.slice("s", first + 1, last - first + 1), " ").alias("text"), anchor.alias("anchor"), first.alias("window_start"), last.alias("window_end"))

    out = rows.select("doc_id", F.explode(F.transform("s", around)).alias("x")).select("doc_id", "x.*")
    out = out.withColumn("token_count", T.token_count(F.col("text"))).where(F.col("token_count") >= config.min_chunk_size)
    return out.withColumn("strategy", F.lit("sentence_window")).withColumn("overlap_prev", F.lit(0))


def section_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, section, heading, body) of every section that has a body; text before the first heading is an introduction.

    A document's lines stay in one row and are cut at the places of its headings, so nothing is shuffled and no text is
    copied more than once.
    """
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    rows = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    places = F.transform("lines", lambda x, i: F.when(trimmed(x).rlike(T.HEADING_PATTERN), i))
    rows = rows.select("doc_id", "lines", F.concat(F.array(F.lit(-1)), F.array_compact(places)).alias("at"))

    def section(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("at", k + 1), F.size("lines"))
        heading = F.when(at < 0, "Introduction").otherwise(trimmed(F.get("lines", at)))
        return F.struct(heading.alias("heading"), trimmed(F.array_join(F.slice("lines", at + 2, end - at - 1), "\n")).alias("body"))

    sections = rows.select("doc_id", F.posexplode(F.transform("at", section)).alias("section", "s"))
    return sections.select("doc_id", "section", F.col("s.heading").alias("heading"), F.col("s.body").alias("body")).where("body <> ''")


def document_structure(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """A chunk for every section, heading first; sections above the size are cut recursively, without their heading."""
    rows = section_rows(docs).withColumn("whole", F.concat("heading", F.lit("\n"), "body"))
    fits = T.token_count(F.col("whole")) <= config.chunk_size
    marked = rows.select(F.col("doc_id").cast("bigint"), "section", "heading", fits.alias("fits"), "whole", "body")
    both = cut_texts(marked.select("doc_id", "section", "heading", "fits", F.when(F.col("fits"), F.col("whole")).otherwise(F.col("body")).alias("text")), config, fits=True)  # one pass: sections are found once
    order = Window.partitionBy("doc_id").orderBy("section", "part")
    out = both.withColumn("chunk_index", F.row_number().over(order) - 1)
    error = []
    if config.failures:  # a document with a failed section fails as a whole, with the first error
        first = F.first("error", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("section", "part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn("error", first).where("error is null or chunk_index = 0").withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
        error = ["error"]
    return out.select("doc_id", "chunk_index", "text", T.token_count(F.col("text")).alias("token_count"), F.lit("document_structure").alias("strategy"), F.lit(0).alias("overlap_prev"), "heading", *error)


def semantic(sentence_vectors: DataFrame, config: ChunkConfig) -> DataFrame:
    """Runs of sentences whose neighbours are similar; input (doc_id, pos, sentence, vec).

    A break stands before a sentence whose cosine to the one before is below the threshold. The last run of a
    document is kept if it isn't blank, others only above the least size.
    """
    s = F.array_sort(F.collect_list(F.struct("pos", "sentence", "vec")))
    rows = sentence_vectors.groupBy("doc_id").agg(s.alias("s"))
    return semantic_rows(rows.select("doc_id", F.col("s.sentence").alias("sentences"), F.col("s.vec").alias("vecs")), config)


def semantic_rows(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """The same from documents' rows (doc_id, sentences, vecs), arrays in the order of the text: nothing is shuffled."""
    similar = lambda x, i: V.cosine(F.get("vecs", i - 1), x)
    breaks = F.transform("vecs", lambda x, i: F.when((i > 0) & (similar(x, i) < config.breakpoint), i))
    rows = docs.select("doc_id", "sentences", F.concat(F.array(F.lit(0)), F.array_compact(breaks)).alias("at"))

    def run(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("at", k + 1), F.size("sentences"))
        return F.struct(F.array_join(F.slice("sentences", at + 1, end - at), " ").alias("text"), (k + 1 == F.size("at")).alias("last"))

    runs = rows.select("doc_id", F.transform("at", run).alias("runs"))
    kept = F.filter("runs", lambda r: F.when(r["last"], T.trim(r["text"]) != "").otherwise(T.token_count(r["text"]) > config.min_chunk_size))
    return shaped(runs.select("doc_id", F.posexplode(kept["text"]).alias("chunk_index", "text")), "semantic")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text) of paragraphs."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("pos", "text")).where(T.trim(F.col("text")) != "")


def clauses(text: Column) -> Column:
    """Offline stand-in for a language model's claims: sentences cut at semicolons."""
    return F.flatten(F.transform(T.sentences(text), lambda s: F.filter(F.transform(F.split(s, ";"), T.trim), lambda c: c != "")))


def propositional(docs: DataFrame, config: ChunkConfig, claims: Callable[[Column], Column] = clauses, short: int = 30) -> DataFrame:
    """Claims of every paragraph; paragraphs below ``short`` tokens stay as they are. ``claims`` is the pluggable model."""
    para = paragraphs(docs)
    found = F.when(T.token_count(F.col("text")) < short, F.array(T.trim(F.col("text")))).otherwise(claims(F.col("text")))
    rows = para.select("doc_id", "pos", F.posexplode(found).alias("k", "text"))
    out = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "k")) - 1)
    return shaped(out.select("doc_id", "chunk_index", "text"), "propositional")


TABLE_BLOCK = r"(?s)\[TABLE\].*?\[/TABLE\]"


def table_aware(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    """Recursive chunks of the prose outside table blocks, then one chunk for each non-empty table of the ``tables`` column.

    A document whose prose fails has no table chunks either.
    """
    prose = recursive(docs.select("doc_id", F.regexp_replace("text", TABLE_BLOCK, "").alias("text")), config)
    tables = docs.select("doc_id", F.posexplode("tables").alias("t", "rows")).where(F.size("rows") > 0)
    failed = F.max(F.col("error").isNotNull()) if config.failures else F.lit(False)
    n_prose = prose.groupBy("doc_id").agg((F.max("chunk_index") + 1).alias("n"), failed.alias("failed"))
    numbered = tables.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("t")) - 1).join(n_prose, "doc_id", "left").where("not coalesce(failed, false)")
    text = T.table_lines(F.col("t") + 1, F.col("rows"))
    blocks = shaped(numbered.select("doc_id", (F.coalesce("n", F.lit(0)) + F.col("k")).alias("chunk_index"), text.alias("text")), "table_aware")
    return prose.withColumn("strategy", F.lit("table_aware")).unionByName(blocks, allowMissingColumns=True)


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunks, tokens, mean tokens (one decimal, half even; 0 without chunks)."""
    n, total = F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0))
    return chunks.agg(n.alias("n_chunks"), total.alias("total_tokens"), F.bround(total / F.greatest(n, F.lit(1)), 1).alias("avg_tokens"))


STRATEGIES: dict[str, Callable[[DataFrame, ChunkConfig], DataFrame]] = {
    "fixed": fixed, "recursive": recursive, "sentence_window": sentence_window, "document_structure": document_structure, "propositional": propositional, "table_aware": table_aware, "semantic": semantic,
}

# --- fixed values: the default strategy of a domain ------------------------------------------------------------
DOMAIN_STRATEGY = {"healthcare": "sentence_window", "finance": "recursive", "legal": "document_structure", "manufacturing": "table_aware", "ecommerce": "recursive", "education": "semantic", "cybersecurity": "recursive", "government": "document_structure", "general": "recursive"}
# --- end of fixed values ---------------------------------------------------------------------------------------


def register(name: str, strategy: Callable[[DataFrame, ChunkConfig], DataFrame]) -> None:
    """Add a strategy, or replace one."""
    STRATEGIES[name] = strategy


def _strategy(docs: DataFrame, strategy: str | None, config: ChunkConfig, domain: str) -> DataFrame:
    name = strategy or DOMAIN_STRATEGY[domain]
    if name not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {name!r}; registered: {sorted(STRATEGIES)}")
    return size_filter(STRATEGIES[name](docs, config), config)


def chunk(docs: DataFrame, strategy: str | None = None, config: ChunkConfig | None = None, domain: str = "general", **sizes) -> DataFrame:
    """Chunks of all documents by a registered strategy (None: the domain's), within the size limits."""
    return _strategy(docs, strategy, replace(config or ChunkConfig(), failures=False, **sizes), domain)


def outcomes(docs: DataFrame, strategy: str | None = None, config: ChunkConfig | None = None, domain: str = "general", **sizes) -> DataFrame:
    """The rows of :func:`chunk` with a null ``error``, and one row with an error for each document that a splitter failed on.

    Such a document has no other row. Strategies made of expressions fail on no single document. Keep the frame with
    ``outcomes.store`` to use both kinds of rows without a second pass.
    """
    made = _strategy(docs, strategy, replace(config or ChunkConfig(), failures=True, **sizes), domain)
    return made if "error" in made.columns else made.withColumn("error", F.lit(None).cast("string"))
