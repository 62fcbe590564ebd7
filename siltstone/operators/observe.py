"""Observability in batch: histograms, counters, gauges, percentiles, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: bucket bounds --------------------------------------------------------------------------------
LATENCY_MS = [10, 25, 50, 100, 250, 500, 1000, 2500, 5000]
RESULT_COUNT = [1, 5, 10, 20, 50, 100]
AGENT_NODE_MS = [10, 50, 100, 500, 1000, 3000]
RERANK_SHIFT = [0, 0.5, 1, 2, 3, 5, 10, 20]
# --- end of fixed values ----------------------------------------------------------------------------------------


def histogram(rows: DataFrame, value: Column, by: list[str], bounds: list[float]) -> DataFrame:
    """(by..., le, n): how many values lie at or below each bound; one aggregation with a column a bound, then a narrow unpivot."""
    sums = rows.groupBy(*by).agg(*(F.sum((value <= b).cast("bigint")).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("total"))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return sums.select(*by, F.explode(cells).alias("c")).select(*by, F.col("c.le").alias("le"), F.coalesce("c.n", F.lit(0)).alias("n"))


def counters(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n): events by labels."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, by: list[str], value: str, at: str, tie: str) -> DataFrame:
    """(by..., value): the latest value by time, the larger ``tie`` among equal times."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def percentiles(rows: DataFrame, value: str, by: list[str], q: float = 0.95, exact: bool = True) -> DataFrame:
    """(by..., p): the interpolated percentile; ``exact=False`` is a mergeable sketch for unbounded groups."""
    p = F.percentile(value, q) if exact else F.percentile_approx(value, q, 10_000)
    return rows.groupBy(*by).agg(p.alias("p"))


#: Size of a quantile sketch, and the share of a group's rows by which a rank that it gives may be off (with 99 % confidence).
SKETCH, RANK_ERROR = 800, 0.01


def sketches(rows: DataFrame, value: str, by: list[str], size: int = SKETCH) -> DataFrame:
    """(by..., n, sketch): quantile sketches of bounded size, made by partial aggregation; they can be stored, and merged by :func:`merged`.

    Nulls don't count; a group of nulls alone has an ``n`` of 0 and no sketch.
    """
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch")).withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merged(sketched: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, sketch) of coarser groups, from the sketches of finer ones: windows to days, modes to all; the values aren't read again."""
    return sketched.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketched: DataFrame, qs: list[float]) -> DataFrame:
    """(..., q, value) of sketches (..., n, sketch): a row for each wanted quantile, null where there are no values."""
    value = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    rows = sketched.withColumn("x", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), value(q).alias("value")) for q in qs))))
    return rows.withColumn("q", F.col("x.q")).withColumn("value", F.col("x.value")).drop("sketch", "x")


def health(rows: DataFrame) -> DataFrame:
    """(service, status): unhealthy if any check is, else degraded if any is, else healthy."""
    any_ = lambda s: F.bool_or(F.col("status") == s)
    return rows.groupBy("service").agg(F.when(any_("unhealthy"), "unhealthy").when(any_("degraded"), "degraded").otherwise("healthy").alias("status"))
