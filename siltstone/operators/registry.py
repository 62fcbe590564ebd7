"""Named indexes: vectors of a corpus under a backend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import benchmarks
from . import dense

#: Backend name to a function that fits its centroids (None: search is exact). Others plug in by :func:`register`.
BACKENDS: dict[str, Callable[[DataFrame, int], DataFrame | None]] = {"flat": lambda vectors, cells: None, "ivf": lambda vectors, cells: dense.fit_centroids(vectors, cells)}


def register(name: str, fit: Callable[[DataFrame, int], DataFrame | None]) -> None:
    """Add a backend, or replace one: ``fit`` gives (cell, centre) rows of vectors and a number of cells, or None for exact search."""
    BACKENDS[name] = fit


class IndexRegistry:
    """Indexes are DataFrames (doc_id, vec) under ``corpus:backend``; search is exact or by inverted file."""

    def __init__(self) -> None:
        self.indexes: dict[str, tuple[DataFrame, DataFrame | None]] = {}
        self.probes: dict[str, int] = {}

    def build(self, corpus: str, vectors: DataFrame, backend: str = "flat", cells: int = 100) -> str:
        """Register vectors; the inverted file's centroids and its number of probes are fitted on bounded samples."""
        if backend not in BACKENDS:
            raise ValueError(f"unknown backend {backend!r}; known: {sorted(BACKENDS)}")
        have = vectors.where("vec is not null")
        centroids = BACKENDS[backend](have, cells)
        self.indexes[f"{corpus}:{backend}"] = (have, centroids)
        if centroids is not None:
            self.probes[f"{corpus}:{backend}"] = dense.calibrated_probes(have, centroids)
        return f"{corpus}:{backend}"

    def get(self, corpus: str, backend: str = "flat") -> tuple[DataFrame, DataFrame | None]:
        """The index; KeyError if there is none."""
        return self.indexes[f"{corpus}:{backend}"]

    def search(self, corpus: str, queries: DataFrame, k: int = 10, backend: str = "flat", n_probe: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank); an inverted file looks into ``n_probe`` cells, by default as many as its build measured to be needed."""
        vectors, centroids = self.get(corpus, backend)
        if centroids is None:
            return dense.exact_topk(vectors, queries, k)
        return dense.ivf_topk(vectors, queries, centroids, k, self.probes[f"{corpus}:{backend}"] if n_probe is None else n_probe)

    def save(self, corpus: str, backend: str, path: str) -> None:
        """Store an index as tables: vectors, centroids and the number of probes."""
        vectors, centroids = self.get(corpus, backend)
        benchmarks.write_vectors(vectors, f"{path}/vectors")
        if centroids is not None:
            benchmarks.write_vectors(centroids.selectExpr("*", f"{self.probes[f'{corpus}:{backend}']} n_probe"), f"{path}/centroids")

    def load(self, spark: SparkSession, corpus: str, backend: str, path: str) -> str:
        """Register a stored index again, without fitting; backends with centroids have a second table."""
        key, centroids = f"{corpus}:{backend}", None
        stored = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/centroids")
        if stored.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(stored):
            rows = benchmarks.read_vectors(spark, f"{path}/centroids")
            self.probes[key] = rows.first()["n_probe"]
            centroids = rows.drop("n_probe")
        self.indexes[key] = (benchmarks.read_vectors(spark, f"{path}/vectors"), centroids)
        return key
