"""What the package needs of a session that was started elsewhere: its code on the executors, a shared folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the session's Python workers, once for each application; Spark's own file server carries it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return spark
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="siltstone-"), "siltstone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; under a local master that names none a temporary one, removed at the end."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="siltstone-"))
    return sc._jsc.sc().getCheckpointDir().get()


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder of derived data when the driver ends."""
    if path in _own:
        return
    _own.add(path)

    def gone() -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before the interpreter
            return

    atexit.register(gone)
