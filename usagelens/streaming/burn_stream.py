"""Live cost per minute and sliding burn rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions import exact as X
from usagelens.schema import enrich


def _timed(usage: DataFrame, delay: str) -> DataFrame:
    e = enrich(usage).withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return e.withWatermark("event_time", delay)


def stream_minute_costs(usage: DataFrame, *, keys=("source", "device", "model"), delay: str = "10 minutes") -> DataFrame:
    """Closed one-minute windows per key."""
    g = _timed(usage, delay).groupBy(F.window("event_time", "1 minute"), *keys)
    sums = g.agg(F.sum("cost_nano").alias("cost_nano"), F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("records"))
    return sums.select(F.col("window.start").alias("minute"), *keys, X.usd4("cost_nano").alias("cost"), "tokens", "records")


def stream_burn(usage: DataFrame, *, hours_e4: int = 20_000, slide: str = "5 minutes", keys=("source", "device"), delay: str = "10 minutes") -> DataFrame:
    """Closed sliding windows of one look-back length, as $/h per key."""
    seconds = hours_e4 * 36 // 100
    sums = _timed(usage, delay).groupBy(F.window("event_time", f"{seconds} seconds", slide), *keys).agg(F.sum("cost_nano").alias("cost_nano"))
    rate = X.scaled(X.per_hour_cents("cost_nano", F.lit(hours_e4)), 2)
    return sums.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, rate.alias("cost_per_hour"))
