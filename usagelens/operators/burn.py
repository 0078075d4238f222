"""Burn rates over look-back windows and what is running now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions import exact as X, text as S
from usagelens.operators import common as C
from usagelens.schema import enrich

# Look-back windows of the live panel, in minutes.
LIVE_MINUTES = (1, 5, 15, 60, 300, 1440)
LIVE_SECONDS = 120


def _window_sums(usage: DataFrame, as_of, keys) -> DataFrame:
    """Cost per key and look-back window from one pass of conditional sums. Without keys
    only the longest window is read; with keys idle ones keep their zero rows."""
    e = enrich(usage)
    e = C.until(e, as_of) if keys else C.since(e, as_of, max(h for _, h in C.BURN_WINDOWS))
    aggs = [C.sum_when("cost_nano", C.recent(as_of, h), f"b_{h}") for _, h in C.BURN_WINDOWS]
    wide = e.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[F.struct(F.lit(l).alias("window_hours"), F.lit(h).cast("bigint").alias("hours_e4"), F.col("b_" + str(h)).alias("nano")) for l, h in C.BURN_WINDOWS]
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def burn_rates_by_hours(usage: DataFrame, *, as_of, keys=()) -> DataFrame:
    out = _window_sums(usage, as_of, keys)
    return out.select(*keys, "window_hours", X.scaled(X.per_hour_cents("nano", "hours_e4"), 2).alias("cost_per_hour"))


def burn_by_model(usage: DataFrame, *, as_of, keys=()) -> DataFrame:
    """Burn per model and look-back window with its share; below one cent per hour drops out."""
    longest = max(h for _, h in C.BURN_WINDOWS)
    recent = C.since(enrich(usage), as_of, longest)
    sums = _window_sums(recent.withColumn("model_id", S.or_unknown("model")), as_of, [*keys, "model_id"])
    total = F.sum("nano").over(Window.partitionBy(*keys, "window_hours"))
    kept = sums.withColumn("_total", total).where(F.col("nano") * 10_000 >= F.col("hours_e4") * F.lit(X.NANO_PER_CENT))
    return kept.select(
        *keys, "window_hours", "model_id", X.usd2("nano").alias("cost_total"),
        X.scaled(X.per_hour_cents("nano", "hours_e4"), 2).alias("cost_per_hour"),
        X.ratio("nano", "_total", 3).alias("share"),
    )


def recent_costs(usage: DataFrame, *, as_of, keys=(), hours: int = 6) -> DataFrame:
    recent = C.since(enrich(usage), as_of, hours * 10_000)
    minute = F.date_trunc("minute", "timestamp").cast("timestamp_ntz").alias("minute")
    return recent.groupBy(*keys, minute).agg(X.usd4(F.sum("cost_nano")).alias("cost"))


def live_burn_rate(costs: DataFrame, *, as_of, keys=(), hours: str = "2") -> DataFrame:
    """Rate from per-minute costs at the reader's own clock."""
    h = dict(C.BURN_WINDOWS)[hours]
    e4 = F.round(F.col("cost") * 10_000).cast("bigint")
    inside = (F.col("minute") >= C.hours_before(as_of, h)) & (F.col("minute") <= C.as_ts(as_of))
    g = costs.groupBy(*keys).agg(F.coalesce(F.sum(F.when(inside, e4)), F.lit(0)).alias("_e4"))
    return g.select(*keys, F.lit(hours).alias("window_hours"), X.scaled(X.round_div(X.wide("_e4") * 100, h), 2).alias("cost_per_hour"))


def _minutes(m: int):
    """Minutes in 1e-4 hours."""
    return m * 10_000 / 60


def live_active_models(usage: DataFrame, *, as_of, keys=(), minutes=LIVE_MINUTES) -> DataFrame:
    """Models active per look-back window and device.

    Windows are nested, so each record is summed into the smallest window it is in, and
    only those sums are copied to the wider windows.
    """
    cuts = sorted(minutes)
    recent = C.since(enrich(usage), as_of, _minutes(cuts[-1]))
    ring = F.expr("CASE " + " ".join(f"WHEN {C.recent(as_of, _minutes(m))} THEN {i}" for i, m in enumerate(cuts)) + " END")
    latest = ("project_label", "project_dir", "session_id")
    rings = (
        recent.withColumn("_ring", ring)
        .groupBy(*keys, S.or_unknown("model").alias("model_id"), "device", "_ring")
        .agg(
            F.sum("billable_tokens").alias("billable_tokens"),
            F.sum("cost_nano").alias("cost_nano"),
            F.count(F.lit(1)).alias("messages"),
            F.max(C.record_order()).alias("_at"),
            F.max_by(F.struct(*latest), C.record_order()).alias("_latest"),
        )
    )
    table = F.array(*[F.lit(m) for m in cuts])
    spread = rings.withColumn("_w", F.explode(F.sequence("_ring", F.lit(len(cuts) - 1))))
    out = (
        spread.withColumn("window_minutes", F.get(table, "_w"))
        .groupBy(*keys, "window_minutes", "model_id", "device")
        .agg(
            *[F.sum(c).alias(c) for c in ("billable_tokens", "cost_nano", "messages")],
            F.max("_at").getField("timestamp").alias("last_seen"),
            F.max_by("_latest", "_at").alias("_latest"),
        )
    )
    age_us = S.micros(C.as_ts(as_of)) - S.micros("last_seen")
    return out.select(
        *keys, "window_minutes", "model_id", "device",
        F.col("_latest.project_label").alias("project"),
        F.col("_latest.project_dir").alias("project_dir"),
        F.col("_latest.session_id").alias("session_id"),
        F.col("billable_tokens").alias("billable_tokens_recent"),
        X.round_div("billable_tokens", "window_minutes").alias("tokens_per_min"),
        "messages",
        X.usd2("cost_nano").alias("cost_recent"),
        X.scaled(X.round_div(X.wide("cost_nano") * 60, X.wide("window_minutes") * X.NANO_PER_CENT), 2).alias("cost_per_hour"),
        "last_seen",
        X.idiv(age_us, 1_000_000).alias("seconds_since_last"),
    )


def live_now(live: DataFrame, *, as_of=None, keys=(), seconds: int = LIVE_SECONDS) -> DataFrame:
    """Rows of the five-minute window seen within the last two minutes, without placeholders."""
    return live.where(
        (F.col("window_minutes") == 5) & ~F.startswith("model_id", F.lit("<")) & (F.col("seconds_since_last") < seconds)
    )
