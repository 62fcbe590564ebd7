"""Incremental ingestion: drops of files become chunks, each version once, by a stream with keyed state.

A source folder holds drops, ``<source>/<drop>/<name>``; drops are ordered by their names, files without a drop come
first. A file stream reads no path twice, so a changed file arrives under a later drop. The state keeps the newest drop
and the digest of every name, which decides: an equal file is nothing, another one is a change, an older drop that comes
late is nothing, and a file ``<name>.gone`` of any content takes the name away (a file of that name in the same drop
wins). Files of 0 bytes are nothing, as Spark's file scan passes over them: the mark needs a byte.

Only names and digests pass through the state; contents are read again for changed files alone, of which a micro-batch
has at most ``max_files``. A micro-batch owns one folder of each output table and replaces it when Spark repeats it, and
its changes are published last, by a rename: readers see whole batches, and each of them once.

    changes/batch=N   name, drop, path, digest, kind (new, changed, gone)
    chunks/batch=N    chunk rows with name; doc_id is the hash of the name
    failures/batch=N  name, step (load, chunk), error; a version that fails has no chunks, nor have its predecessors
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import chunkers, outcomes
from ..operators.chunkers import ChunkConfig
from ..sources.files import LoaderRegistry

FILES = "path string, modificationTime timestamp, length bigint, content binary"
CHANGES = "name string, drop string, path string, digest string, kind string"
CHUNKS = f"name string, {chunkers.CHUNK_FIELDS}"
FAILURES = "name string, step string, error string"
GONE = ".gone"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def net_change(old: tuple[str, str | None] | None, arrived: list[tuple[str, str, str | None]]) -> tuple[tuple[str, str | None] | None, tuple[str, str, str | None, str] | None]:
    """New state (drop, digest) of a name and its change (drop, path, digest, kind), if any, after arrivals (drop, path, digest).

    A digest of None says that the name is gone; several arrivals at once count with the newest drop alone.
    """
    drop, path, digest = max(arrived, key=lambda x: (x[0], x[2] is not None, x[1]))
    if old is not None and (drop, digest is not None) < (old[0], old[1] is not None):
        return old, None
    before = None if old is None else old[1]
    if digest == before:
        return (drop, digest), None
    kind = "gone" if digest is None else "new" if before is None else "changed"
    return (drop, digest), (drop, path, digest, kind)


class NewestVersions(StatefulProcessor):
    """The newest drop and digest of each name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "drop string, digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = [x for part in rows for x in part[["drop", "path", "digest"]].itertuples(index=False, name=None)]
        old = self.newest.get() if self.newest.exists() else None
        new, change = net_change(None if old is None else (old[0], old[1]), [(d, p, g if isinstance(g, str) else None) for d, p, g in arrived])
        if new is not None:
            self.newest.update(new)
        if change is not None:
            yield pd.DataFrame([(key[0], *change)], columns=["name", "drop", "path", "digest", "kind"])

    def close(self) -> None:
        """Nothing to release."""


def arrivals(files: DataFrame, root: str) -> DataFrame:
    """(name, drop, path, digest) of a binary-file frame under a folder; the digest of a name that goes is null."""
    rest = F.expr("substring(path, {})".format(len(root) + 2))
    at = F.instr(rest, "/")
    drop, name = F.when(at > 0, F.substring_index(rest, "/", 1)).otherwise(""), F.when(at > 0, F.substr(rest, at + 1)).otherwise(rest)
    gone = name.endswith(GONE)
    return files.select(F.when(gone, F.substr(name, F.lit(1), F.length(name) - len(GONE))).otherwise(name).alias("name"), drop.alias("drop"), "path", F.when(~gone, F.sha2("content", 256)).alias("digest"))


class IncrementalIngest:
    """The stream from a source folder to the tables under an output folder."""

    def __init__(self, spark: SparkSession, source: str, out: str, strategy: str = "recursive", config: ChunkConfig | None = None, registry: LoaderRegistry | None = None, max_files: int = 10_000) -> None:
        self.spark, self.out, self.strategy, self.config, self.registry, self.max_files = spark, out.rstrip("/"), strategy, config or ChunkConfig(), registry or LoaderRegistry(), max_files
        p = self._path(source.rstrip("/"))
        self.root = self._fs(p).makeQualified(p).toString()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def changes(self) -> DataFrame:
        """The stream of changes."""
        files = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", self.max_files).load(self.root)
        return arrivals(files, self.root).groupBy("name").transformWithStateInPandas(NewestVersions(), CHANGES, "Append", "None")

    def write(self, changes: DataFrame, batch: int) -> None:
        """One micro-batch: its chunks and failures, and then its changes."""
        staged = f"{self.out}/staging/batch={batch}"
        changes.write.mode("overwrite").parquet(f"{staged}/changes")
        known = self.spark.read.schema(CHANGES).parquet(f"{staged}/changes")
        paths = [r.path for r in known.where("digest is not null").select("path").collect()]  # max_files at most
        if paths:
            files = self.spark.read.format("binaryFile").load(paths)
            loaded, unread = outcomes.store(self.registry.parse(files).drop("doc_id"), f"{staged}/loaded")
            named = known.select("name", F.col("path").alias("source"), F.xxhash64("name").alias("doc_id"))
            docs = loaded.where("status = 'ok'").join(named, "source").select("doc_id", "text", "tables")
            made, uncut = outcomes.store(chunkers.outcomes(docs, self.strategy, self.config), f"{staged}/chunked")
            made.join(named, "doc_id").select("name", "doc_id", "chunk_index", "text", "token_count", "strategy", "overlap_prev").write.mode("overwrite").parquet(f"{self.out}/chunks/batch={batch}")
            failed = unread.join(named, "source").select("name", F.lit("load").alias("step"), "error")
            failed.unionByName(uncut.join(named, "doc_id").select("name", F.lit("chunk").alias("step"), "error")).write.mode("overwrite").parquet(f"{self.out}/failures/batch={batch}")
        target = self._path(f"{self.out}/changes/batch={batch}")
        fs = self._fs(target)
        fs.delete(target, True)  # of a run that ended between this rename and Spark's own record
        fs.mkdirs(target.getParent())
        fs.rename(self._path(f"{staged}/changes"), target)
        fs.delete(self._path(staged), True)

    def start(self, **trigger) -> StreamingQuery:
        """The running query; without a trigger it takes what is there and ends. State is kept under ``<out>/checkpoint``."""
        before = self.spark.conf.get(STATE_STORE[0], None)
        self.spark.conf.set(*STATE_STORE)  # a query takes the setting with it when it starts
        try:
            stream = self.changes().writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.out}/checkpoint")
            return stream.trigger(**(trigger or {"availableNow": True})).start()
        finally:
            if before is None:
                self.spark.conf.unset(STATE_STORE[0])
            else:
                self.spark.conf.set(STATE_STORE[0], before)

    def run(self) -> None:
        """Take all that is there."""
        self.start().awaitTermination()

    def _table(self, name: str, schema: str) -> DataFrame:
        p = self._path(f"{self.out}/{name}")
        if not self._fs(p).exists(p):
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.out}/{name}")

    def versions(self) -> DataFrame:
        """(name, batch, drop, digest, kind) of every name's newest published change; names that are gone too."""
        newest = self._table("changes", CHANGES).groupBy("name").agg(F.max_by(F.struct("batch", "drop", "digest", "kind"), "batch").alias("v"))
        return newest.select("name", "v.*")

    def _live(self, name: str, schema: str) -> DataFrame:
        return self._table(name, schema).join(self.versions().where("kind <> 'gone'").select("name", "batch"), ["name", "batch"])

    def chunks(self) -> DataFrame:
        """Chunks of the newest version of every name that isn't gone."""
        return self._live("chunks", CHUNKS).drop("batch")

    def failures(self) -> DataFrame:
        """Failures of newest versions."""
        return self._live("failures", FAILURES).drop("batch")
