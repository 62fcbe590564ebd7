"""Observability over the event table: event types stand for modes, values for latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import observe
from ..streaming import latency
from .registry import query, table

BOUNDS = observe.LATENCY_MS


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _histogram_sql(bounds: list[float]) -> str:
    values = ", ".join(f"({float(b)}::DOUBLE)" for b in bounds)
    return f"SELECT event_type, le, count(*) FILTER (value <= le)::BIGINT AS n FROM events, (VALUES {values}, ('inf'::DOUBLE)) b(le) GROUP BY ALL"


@query(_histogram_sql(BOUNDS))
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative latency buckets by mode."""
    return observe.histogram(events(spark, sf_dir), F.col("value"), ["event_type"], BOUNDS)


@query(_histogram_sql(observe.RERANK_SHIFT))
def shift_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets of rank shifts by mode."""
    return observe.histogram(events(spark, sf_dir), F.col("value"), ["event_type"], observe.RERANK_SHIFT)


@query("SELECT event_type, (event_type = 'error') AS failed, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by mode and outcome."""
    return observe.counters(events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error"), ["event_type", "failed"])


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latest_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value of each mode."""
    return observe.latest(events(spark, sf_dir).where("value is not null"), ["event_type"], "value", "ts", "event_id")


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p FROM events GROUP BY event_type")
def p95_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile by mode."""
    return observe.percentiles(events(spark, sf_dir), "value", ["event_type"]).withColumn("p", F.round("p", 6))


_QS = [0.5, 0.95, 0.99]


@query(f"SELECT event_type, q::DOUBLE AS q, count(value)::BIGINT AS n, true AS near FROM events, (VALUES {', '.join(f'({q})' for q in _QS)}) t(q) GROUP BY ALL")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by mode from sketches of each hour merged, held against exact ranks of all values: are they off by the stated share at most?"""
    e = events(spark, sf_dir)
    hourly = observe.sketches(e.withColumn("hour", F.date_trunc("hour", "ts")), "value", ["event_type", "hour"])
    found = observe.quantiles(observe.merged(hourly, ["event_type"]), _QS)
    held = F.broadcast(found.select("event_type", "q", "n", F.col("value").alias("at")))  # three rows a mode
    ranks = e.join(held, "event_type").where("value is not null").groupBy("event_type", "q", "n").agg(F.avg((F.col("value") < F.col("at")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("at")).cast("int")).alias("up_to"))
    near = (F.col("below") - observe.RANK_ERROR <= F.col("q")) & (F.col("q") <= F.col("up_to") + observe.RANK_ERROR)
    return ranks.select("event_type", "q", "n", near.alias("near"))


@query("SELECT user_id AS service, CASE WHEN bool_or(event_type = 'error') THEN 'unhealthy' WHEN bool_or(event_type = 'signup') THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY user_id")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of every user's events."""
    status = F.when(F.col("event_type") == "error", "unhealthy").when(F.col("event_type") == "signup", "degraded").otherwise("healthy")
    return observe.health(events(spark, sf_dir).select(F.col("user_id").alias("service"), status.alias("status")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly events and sums by mode: the batch form of the stream."""
    w = latency.windowed(events(spark, sf_dir).where("ts is not null"), watermark=None)
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
