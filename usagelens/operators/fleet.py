"""Many devices: per-device summaries and what adds up over them.

Summaries hold one row per (device, source) and more; nothing here collects rows of a
device except the bounded lists of a snapshot, which are cut to size first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions import exact as X, text as S
from usagelens.operators import aggregates as A, billing as B, burn as U, common as C, trends as T
from usagelens.schema import enrich

DEVICE = ("device", "source")

# Sizes of the lists in a snapshot, and the age limit of its live rows.
RECENT_MAX, PROJECTS_MAX, LIVE_MAX, DAILY_MAX = 25, 12, 4, 14
LIVE_MAX_AGE = 900
ONLINE_SECONDS, IDLE_SECONDS = 360, 86_400
LIVE_WINDOWS = (1, 5, 15, 60, 300, 1440)


def _cents(c):
    return F.round(F.col(c) * 100).cast("bigint")


def _e4(c):
    return F.round(F.col(c) * 10_000).cast("bigint")


def device_summary(usage: DataFrame, *, as_of, keys=DEVICE) -> DataFrame:
    """Scalars of one device and source."""
    keys = list(keys)
    e = C.until(enrich(usage), as_of)
    tot = e.groupBy(*keys).agg(
        *C.totals_aggs(), C.sum_when("cost_nano", C.recent(as_of, 20_000), "_two"), F.max("timestamp").alias("last_seen")
    )
    tot = tot.select(
        *keys, F.col("messages").alias("record_count"),
        X.scaled(X.per_hour_cents("_two", F.lit(20_000)), 2).alias("burn_rate_per_hour"),
        X.scaled(X.round_div(X.cost_e4("cost_nano"), 100), 2).alias("lifetime_cost"),
        F.col("total_tokens").alias("lifetime_tokens"), C.hit_rate().alias("cache_hit_rate"), "last_seen",
    )
    p = T.projections(T.forecast_base(e, as_of=as_of, keys=keys), as_of, keys)
    return tot.join(
        p.select(
            *keys, X.scaled("today_so_far_c", 2).alias("today_cost"), X.scaled("month_so_far_c", 2).alias("month_so_far"),
            X.scaled("month_projected_eom_c", 2).alias("month_projected"),
        ),
        keys,
    )


def live_rows(usage: DataFrame, *, as_of, keys=("source",), cap: int | None = None) -> DataFrame:
    """Real models seen in the last quarter hour per device; `cap` keeps the newest ones."""
    live = U.live_active_models(usage, as_of=as_of, keys=keys, minutes=(15,)).drop("window_minutes")
    live = live.where(~F.startswith("model_id", F.lit("<")) & (F.col("seconds_since_last") <= LIVE_MAX_AGE))
    return live if cap is None else C.top_n(live, [*keys, "device"], [F.asc("seconds_since_last"), F.asc("model_id")], cap)


def device_snapshot(usage: DataFrame, *, as_of, keys=DEVICE, titles: DataFrame | None = None) -> DataFrame:
    """Metadata-only summary per device and source with bounded lists."""
    keys = list(keys)
    e = C.until(enrich(usage), as_of)

    def listed(df, name, fields, order):
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *fields))).alias(name))

    recent = A.recent_turns(e, keys=keys, limit=RECENT_MAX)
    recent = recent.join(titles.select("session_id", F.col("title").alias("chat")), "session_id", "left") if titles is not None else recent.withColumn("chat", F.lit(None).cast("string"))
    recent = recent.withColumn("_age", -S.micros("timestamp"))
    projects = A.by_project(e, keys=keys, top=PROJECTS_MAX).withColumn("_rank", -F.col("cost_usd"))
    live = live_rows(e, as_of=as_of, keys=[k for k in keys if k != "device"], cap=LIVE_MAX)
    burn = U.burn_rates_by_hours(e, as_of=as_of, keys=keys)
    days = A.daily_base(e, keys).withColumns({"cost": X.scaled(X.round_div("cost_e4", 100), 2)})
    days = C.top_n(days, keys, [F.desc("date")], DAILY_MAX)
    cache = A.cache_efficiency(e, keys=keys).select(*keys, "usd_saved", "usd_on_cache", "full_equiv_usd", "discount_pct")
    lists = [
        listed(recent, "recent", ["timestamp", "project_label", "project_dir", "chat", "model", "total_tokens", "cost_usd"], ["_age", "turn_id"]),
        listed(projects, "by_project", ["project_label", "project_dir", "cost_usd", "total_tokens", "messages"], ["_rank", F.col("project_dir").alias("_tie")]),
        listed(live, "live", ["model_id", "tokens_per_min", "messages", "cost_per_hour", "last_seen", "project", "project_dir"], ["seconds_since_last"]),
        listed(days, "daily", ["date", "cost"], []),
        burn.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("window_hours", "cost_per_hour")))).alias("burn_rates_by_hours")),
        cache,
    ]
    out = device_summary(e, as_of=as_of, keys=keys).withColumn("generated_at", C.as_ts(as_of))
    for part in lists:
        out = out.join(part, keys, "left")
    return out


def fleet_totals(summary: DataFrame, zones: DataFrame | None = None, *, as_of=None, keys=("source",)) -> DataFrame:
    """Sums over devices, hit rate weighted by records, zones times the active devices.

    `zones` is one device's zone row per key (see burn_rate_zones)."""
    keys = list(keys)
    g = summary.groupBy(*keys).agg(
        F.count_distinct("device").alias("devices"),
        F.count_if(_cents("burn_rate_per_hour") > 1).alias("active_devices"),
        *[F.sum(_cents(c)).alias("_" + c) for c in ("burn_rate_per_hour", "today_cost", "month_so_far", "lifetime_cost")],
        F.sum("lifetime_tokens").alias("lifetime_tokens"), F.sum("record_count").alias("record_count"),
        F.sum(X.wide(_e4("cache_hit_rate")) * F.col("record_count")).alias("_hit"),
    )
    out = g
    scale = F.greatest(F.col("active_devices"), F.lit(1))
    cols = [
        *keys, "devices", "active_devices",
        *[X.scaled("_" + c, 2).alias(c) for c in ("burn_rate_per_hour", "today_cost", "month_so_far", "lifetime_cost")],
        "lifetime_tokens", "record_count", X.scaled(X.round_div("_hit", "record_count"), 4).alias("cache_hit_rate"),
    ]
    if zones is not None:
        z = zones.select(*keys, *[_cents(c).alias("z_" + c) for c in B.ZONES])
        out = C.null_safe_join(g, z, keys)
        cols += [X.scaled(F.col("z_" + c) * scale, 2).alias("zone_" + c) for c in B.ZONES]
    return out.select(*cols)


def fleet_burn_windows(usage: DataFrame, *, as_of, keys=("source",)) -> DataFrame:
    """Burn at every look-back window, summed over devices."""
    per_device = A.by_device_burn(usage, as_of=as_of, keys=keys)
    return per_device.groupBy(*keys, "window_hours").agg(
        X.scaled(F.sum(_cents("cost_per_hour")), 2).alias("cost_per_hour"), F.count_if(_cents("cost_per_hour") > 1).alias("active_devices")
    )


def fleet_cache(usage: DataFrame, *, as_of=None, keys=("source",)) -> DataFrame:
    """Cache savings summed over devices; the discount is taken from the sums."""
    per_device = A.cache_efficiency(usage, as_of=as_of, keys=[*keys, "device"])
    g = per_device.groupBy(*keys).agg(*[F.sum(_cents(c)).alias("_" + c) for c in ("usd_saved", "usd_on_cache", "full_equiv_usd")])
    return g.select(
        *keys, *[X.scaled("_" + c, 2).alias(c) for c in ("usd_saved", "usd_on_cache", "full_equiv_usd")],
        X.ratio("_usd_saved", "_full_equiv_usd", 4).alias("discount_pct"),
    )


def fleet_daily(usage: DataFrame, *, as_of=None, keys=(), last: int = 30) -> DataFrame:
    """Cost per date over devices, newest dates."""
    per_device = A.daily_base(C.until(usage, as_of), [*keys, "device"])
    days = per_device.groupBy(*keys, "date").agg(F.sum("cost_e4").alias("_e4"), F.count_distinct("device").alias("devices"))
    return C.top_n(days, list(keys), [F.desc("date")], last).select(*keys, "date", X.scaled("_e4", 4).alias("cost_usd"), "devices")


def fleet_recent(usage: DataFrame, *, as_of=None, keys=(), limit: int = 20) -> DataFrame:
    """Newest turns over all devices."""
    per_device = A.recent_turns(usage, as_of=as_of, keys=[*keys, "device"], limit=limit)
    return C.top_n(per_device, list(keys), [F.desc("timestamp"), F.asc("turn_id"), F.asc("device")], limit)


def fleet_live(usage: DataFrame, *, as_of, keys=("source",), cap: int | None = None, windows=LIVE_WINDOWS) -> DataFrame:
    """Real models of all devices, each window from its own records. With `cap` the rows that
    snapshots carry (that many per device, of the last quarter hour) are shown by their age instead."""
    if cap is None:
        wide = U.live_active_models(usage, as_of=as_of, keys=keys, minutes=windows).where(~F.startswith("model_id", F.lit("<")))
    else:
        live = live_rows(usage, as_of=as_of, keys=keys, cap=cap)
        wide = live.withColumn("window_minutes", F.explode(F.array(*[F.lit(w) for w in windows])))
    return wide.where(F.greatest("seconds_since_last", F.lit(0).cast("bigint")) <= F.col("window_minutes") * 60).select(
        *keys, "window_minutes", "model_id", "device", "project", "tokens_per_min", "messages", "cost_per_hour", "last_seen", "seconds_since_last"
    )


def fleet_projects(usage: DataFrame, *, as_of=None, keys=(), top: int | None = 12) -> DataFrame:
    """Projects by label over devices; the directory shows only when it is unambiguous."""
    per_device = A.by_project(usage, as_of=as_of, keys=[*keys, "device"])
    g = per_device.groupBy(*keys, "project_label").agg(
        F.sum(_e4("cost_usd")).alias("_e4"), F.sum("total_tokens").alias("tokens"), F.sum("messages").alias("messages"),
        F.count_distinct("device").alias("devices"), F.min("project_dir").alias("_a"), F.max("project_dir").alias("_z"),
    )
    out = C.top_n(g, list(keys), [F.desc("_e4"), F.asc("project_label")], top)
    same = F.when(F.col("_a") == F.col("_z"), F.col("_a"))
    return out.select(*keys, "project_label", X.scaled("_e4", 4).alias("cost_usd"), "tokens", "messages", "devices", same.alias("project_dir"))


def device_share(summary: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    """Month cost per device and its share of the total."""
    g = summary.groupBy(*keys, "device").agg(F.sum(_cents("month_so_far")).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(*keys))
    return g.withColumn("_t", total).select(*keys, "device", X.scaled("_c", 2).alias("month_cost"), X.ratio("_c", "_t", 4).alias("share"))


def device_freshness(summary: DataFrame, *, as_of, keys=("device",), seen: str = "last_seen") -> DataFrame:
    """Online, idle or offline by the age of the newest sign of life."""
    g = summary.groupBy(*keys).agg(F.max(seen).alias("last_seen"))
    age = S.micros(C.as_ts(as_of)) - S.micros("last_seen")
    state = F.when(age < ONLINE_SECONDS * 1_000_000, "online").when(age < IDLE_SECONDS * 1_000_000, "idle").otherwise("offline")
    return g.select(*keys, "last_seen", X.idiv(age, 1_000_000).alias("age_seconds"), state.alias("state"))


def both_sources(summary: DataFrame, *, as_of=None, keys=("device",), sources=("agent_a", "agent_b")) -> DataFrame:
    """Sources side by side per device, and their month cost together."""
    p = summary.groupBy(*keys).pivot("source", list(sources)).agg(
        F.sum("record_count").alias("records"), F.sum(_cents("month_so_far")).alias("month")
    )
    zero = F.lit(0).cast("bigint")
    month = [F.coalesce(F.col(s + "_month"), zero) for s in sources]
    total = month[0]
    for m in month[1:]:
        total = total + m
    return p.select(
        *keys, *[F.coalesce(F.col(s + "_records"), zero).alias(s + "_records") for s in sources],
        *[X.scaled(m, 2).alias(s + "_month") for s, m in zip(sources, month)], X.scaled(total, 2).alias("month_cost"),
    )
