"""File sources: whole folders of text, Markdown, HTML, DOCX and PDF files as document frames.

Files are read by Spark's binary source, so any store works; routing goes by extension and priority. Errors are
a column, never an exception: a bad file doesn't stop the rest.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import pdf_layout

# --- fixed values: extensions, priorities, limits ---------------------------------------------------------------
MAX_FILE_BYTES = 50 * 1024 * 1024
EXTENSIONS = {"pdf": (100, [".pdf"]), "docx": (90, [".docx"]), "html": (80, [".html", ".htm"]), "markdown": (70, [".md", ".markdown", ".mdx"]), "text": (60, [".txt", ".text", ".log"])}
MIN_PAGE_CHARS = 50
# --- end of fixed values ----------------------------------------------------------------------------------------


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid, else as Latin-1."""
    utf8 = F.decode(content, "UTF-8")
    return F.when(F.is_valid_utf8(F.try_validate_utf8(content.cast("string"))), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def parse_docx(content: Column) -> Column:
    """(text, tables, error) of a DOCX column, in Arrow batches."""
    return F.pandas_udf(docx_rows, "text string, tables array<array<array<string>>>, error string")(content)


def docx_rows(content: pd.Series) -> pd.DataFrame:
    """Paragraphs and tables of a DOCX file; cells that repeat their neighbour (merged ones) are dropped."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(data: bytes) -> tuple:
        try:
            body = ElementTree.parse(zipfile.ZipFile(io.BytesIO(data)).open("word/document.xml")).getroot().find(f"{ns}body")
            said = lambda e: "".join(t.text or "" for t in e.iter(f"{ns}t"))
            parts, tables = [], []
            for e in body:
                if e.tag == f"{ns}p" and said(e).strip():
                    parts.append(said(e))
                elif e.tag == f"{ns}tbl":
                    rows = []
                    for r in e.iter(f"{ns}tr"):
                        cells = [said(c).strip() for c in r.iter(f"{ns}tc")]
                        rows.append([c for i, c in enumerate(cells) if i == 0 or c != cells[i - 1]])
                    tables.append(rows)
                    parts.append("[TABLE]\n" + "\n".join(" | ".join(r) for r in rows) + "\n[/TABLE]")
            return "\n".join(parts), tables, None
        except Exception as e:  # the error is the row's result
            return None, None, f"{type(e).__name__}: {e}"

    return pd.DataFrame([one(c) for c in content], columns=["text", "tables", "error"])


def pdf_documents(pages: DataFrame) -> DataFrame:
    """Documents (source, text, tables, page_count, n_scanned, error) from pages (source, page_no, text; tables and error if there are any).

    Pages under a least length count as scanned; a document of scanned pages alone has an empty text and an error.
    """
    given = lambda name, kind: F.col(name) if name in pages.columns else F.lit(None).cast(kind)
    cleaned = pages.select("source", "page_no", T.clean_pdf(F.col("text")).alias("text"), given("tables", "array<array<array<string>>>").alias("tables"), given("error", "string").alias("failed"))
    scanned = F.length(F.trim("text")) < MIN_PAGE_CHARS
    parts = F.array_sort(F.collect_list(F.when(~scanned, F.struct("page_no", "text"))))
    tables = F.flatten(F.array_sort(F.collect_list(F.when(F.size("tables") > 0, F.struct("page_no", "tables"))))["tables"])
    docs = cleaned.groupBy("source").agg(F.array_join(parts["text"], "\n\n").alias("text"), tables.alias("tables"), F.count("*").alias("page_count"), F.sum(scanned.cast("int")).alias("n_scanned"), F.max("failed").alias("failed"))
    return docs.withColumn("error", F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("page_count") == F.col("n_scanned"), F.lit("all pages are scanned"))).drop("failed")


@dataclass(frozen=True)
class Loader:
    """A format: extensions, priority, and a function of the binary-file frame that adds text, tables, error."""

    name: str
    extensions: tuple[str, ...]
    priority: int
    parse: Callable[[DataFrame], DataFrame]


def _plain(transform: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    none = F.lit(None)
    return lambda df: df.withColumn("text", transform(decoded(F.col("content")))).withColumn("tables", none.cast("array<array<array<string>>>")).withColumn("error", none.cast("string"))


def _docx(df: DataFrame) -> DataFrame:
    return df.withColumn("_d", parse_docx(F.col("content"))).withColumn("text", F.col("_d.text")).withColumn("tables", F.col("_d.tables")).withColumn("error", F.col("_d.error")).drop("_d")


def _pdf(df: DataFrame) -> DataFrame:
    """Files are read page by page; a file's pages, of at most MAX_FILE_BYTES, meet again in one row."""
    return pdf_documents(pdf_layout.read_pages(df)).withColumnRenamed("source", "path").withColumn("loader", F.lit("pdf"))


def standard_loaders() -> list[Loader]:
    """The built-in formats."""
    parse = {"pdf": _pdf, "docx": _docx, "html": _plain(T.html_text), "markdown": _plain(T.strip_markdown), "text": _plain(lambda c: c)}
    return [Loader(n, tuple(e), p, parse[n]) for n, (p, e) in EXTENSIONS.items()]


class LoaderRegistry:
    """Loaders by falling priority; the first that supports an extension takes the file."""

    def __init__(self, loaders: list[Loader] | None = None) -> None:
        self.loaders = standard_loaders() if loaders is None else list(loaders)

    def register(self, loader: Loader) -> None:
        """Add a loader; a higher priority takes files from others."""
        self.loaders.append(loader)

    def ordered(self) -> list[Loader]:
        """By falling priority, earlier registrations first."""
        return sorted(self.loaders, key=lambda x: -x.priority)

    def extensions(self) -> list[str]:
        """All supported extensions."""
        return sorted({e for x in self.loaders for e in x.extensions})

    def route(self, path: Column) -> Column:
        """Name of the loader of a path, null if none supports it."""
        ext, out = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)), F.lit(None).cast("string")
        for x in reversed(self.ordered()):
            out = F.when(ext.isin(*x.extensions), x.name).otherwise(out)
        return out

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        """(source, doc_id, loader, text, tables, error, status) of all supported files under a path, sorted by source.

        status is ok, failed (with an error), or skipped (blank after clean-up; files of 0 bytes give no row). Unknown extensions in a folder are
        ignored; a missing path gives one failed row.
        """
        schema = "source string, doc_id string, loader string, text string, tables array<array<array<string>>>, error string, status string"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return spark.createDataFrame([(path, None, None, None, None, "FileNotFoundError: no such path", "failed")], schema)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        if fs.getFileStatus(hadoop).isFile() and not any(path.lower().endswith(e) for e in self.extensions()):
            ext = re.search(r"(\.[^./\\]+)?$", path)[0]
            return spark.createDataFrame([(path, None, None, None, None, f"No loader for extension {ext}", "failed")], schema)
        return self.parse(files).orderBy("source")

    def parse(self, files: DataFrame) -> DataFrame:
        """What :meth:`load` returns, unsorted, for the supported files of a binary-file frame."""
        files = files.withColumn("loader", self.route(F.col("path"))).where("loader is not null")
        columns = [F.col("path").alias("source"), T.document_id(F.col("path")).alias("doc_id"), "loader", "text", "tables", "error"]
        large = F.col("length") > MAX_FILE_BYTES
        out = files.where(large).select(F.col("path").alias("source"), T.document_id(F.col("path")).alias("doc_id"), "loader", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<array<array<string>>>").alias("tables"), F.format_string("ValueError: file of %d bytes is too large", "length").alias("error"))
        for x in self.ordered():
            out = out.unionByName(x.parse(files.where(~large & (F.col("loader") == x.name))).select(*columns))
        out = out.withColumn("text", T.preprocess(F.col("text")))
        status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce(F.length("text"), F.lit(0)) == 0, "skipped").otherwise("ok")
        return out.withColumn("status", status)


def load_summary(loaded: DataFrame) -> DataFrame:
    """One row: total_files, success_count, failure_count, success_rate (0 without files)."""
    n = F.count("*")
    ok, bad = F.sum((F.col("status") == "ok").cast("int")), F.sum((F.col("status") == "failed").cast("int"))
    return loaded.agg(n.alias("total_files"), F.coalesce(ok, F.lit(0)).alias("success_count"), F.coalesce(bad, F.lit(0)).alias("failure_count"), F.coalesce(ok / n, F.lit(0.0)).alias("success_rate"))
