"""The stored index of a data folder's documents, built once a session and kept up with its files."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from ..operators import dense
from ..operators.postings import PostingIndex
from ..session import forget_at_end, shared_dir
from .registry import table

_open: dict[tuple[str, str], PostingIndex] = {}


def stamp(spark: SparkSession, path: str) -> str:
    """What tells whether the files under a path are still the same: names, sizes and times."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def corpus_index(spark: SparkSession, sf_dir: str) -> PostingIndex:
    """The index of ``documents`` with the offline provider's vectors; built at its first use, and anew when the files change."""
    key = (spark.sparkContext.applicationId, stamp(spark, f"{sf_dir}/documents.parquet"))
    if key not in _open:
        path = f"{shared_dir(spark)}/index-{key[1]}"
        index = PostingIndex(spark, path, dense.hashed_vectors)
        if not index.exists():
            forget_at_end(spark, path)
            index.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
        _open[key] = index
    return _open[key]
