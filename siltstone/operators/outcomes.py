"""Two outputs of one pass: rows and the failures of single documents, told apart by an ``error`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t


def store(found: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write (..., error) once, parted by whether a row failed; returns both parts, each read from its own folder.

    The frame is computed once, however often the parts are used; rows without an error come back without that column.
    An earlier content of the folder is replaced, an empty frame gives two empty parts.
    """
    found.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("failed").parquet(path)
    whole = found.sparkSession.read.schema(t.StructType([*found.schema.fields, t.StructField("failed", t.BooleanType())])).parquet(path)
    return whole.where("not failed").drop("failed", "error"), whole.where("failed").drop("failed")
