"""Alert levels, crossings, status line, budgets and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions import exact as X, text as S
from usagelens.operators import aggregates as A, billing as B, common as C, normalize as N, trends as T
from usagelens.plans.carry import carry_forward
from usagelens.schema import enrich

# Limit percentages, burn over the heavy zone, week over the heaviest weeks.
LIMIT_WARN, LIMIT_CRIT = 85, 95
BURN_HEAVY_X10 = 16
WEEK_OVER_P95_X10 = 12
LIMIT_SOURCE = "agent_b"


def _money(cents) -> Column:
    return F.concat(F.lit("$"), F.format_number(X.round_div(cents, 100), 0))


def _level_parts(usage: DataFrame, limits: DataFrame, as_of, keys, limit_keys, preferred_device) -> DataFrame:
    e = C.until(enrich(usage), as_of)
    zones = B.zones_from_state(B.window_state(e, as_of=as_of, keys=keys), keys).select(*keys, "heavy_c")
    burn = B.burn_cents(e, as_of, keys, 20_000)
    daily = A.daily_base(e, keys)
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    week = T.weekly_cap(e, as_of=as_of, keys=keys, daily=daily).select(*keys, cents("rolling_7day_cost").alias("week_c"), cents("p95_7row_cost").alias("p95_c"))
    month = T.projections(T.forecast_base(e, as_of=as_of, keys=keys, daily=daily), as_of, keys).select(*keys, F.col("month_projected_eom_c").alias("eom_c"))
    newest = N.latest_rate_limits(limits, as_of=as_of, keys=(*limit_keys, "device"))
    if preferred_device:
        newest = newest.where(F.col("device") == preferred_device)
    used = newest.groupBy(*limit_keys).agg(F.max(F.greatest("primary_pct", "secondary_pct")).alias("used_pct"))
    out = zones
    for part in (burn, week, month):
        out = C.null_safe_join(out, part, keys)
    return out.join(used, list(limit_keys), "left")


def alert_level(
    usage: DataFrame, limits: DataFrame, *, as_of, keys=("source",), limit_keys=("source",), limit_source: str = LIMIT_SOURCE, preferred_device: str | None = None
) -> DataFrame:
    """Level 0, 2 or 3 per key, which includes `source`. Account limits decide where the
    source has them, burn against the heavy zone elsewhere; a week far above the own
    heaviest weeks raises either to 2. All devices count unless one is preferred."""
    s = _level_parts(usage, limits, as_of, list(keys), list(limit_keys), preferred_device)
    limited = F.col("source") == limit_source
    pct = F.coalesce("used_pct", F.lit(0))
    hot = F.col("rate_c") * 10 >= F.col("heavy_c") * BURN_HEAVY_X10
    first = F.when(limited & (pct >= LIMIT_CRIT), 3).when(limited & (pct >= LIMIT_WARN), 2).when(~limited & hot & (F.col("heavy_c") > 0), 2).otherwise(0)
    s = s.withColumn("_first", first)
    pace = (F.col("p95_c") > 0) & (F.col("week_c") * 10 >= F.col("p95_c") * WEEK_OVER_P95_X10)
    over = X.round_div(F.col("week_c") * 100, "p95_c") - 100
    pace_text = F.concat(
        F.lit("pace: "), _money("week_c"), F.lit(" in 7 days, "), over.cast("string"), F.lit("% above the heaviest week ("), _money("p95_c"), F.lit(")"),
        F.when(F.col("eom_c") > 0, F.concat(F.lit("; "), _money("eom_c"), F.lit(" by month end"))).otherwise(""),
    )
    text = (
        F.when((F.col("_first") > 0) & limited, F.concat(F.lit("limit at "), X.round_div(pct, 1).cast("string"), F.lit("%")))
        .when(F.col("_first") > 0, F.concat(F.lit("burn at "), _money("rate_c"), F.lit("/h")))
        .when(pace, pace_text)
        .otherwise("")
    )
    return s.select(*keys, F.when(pace & (F.col("_first") < 2), 2).otherwise(F.col("_first")).alias("level"), text.alias("message"))


def limit_level(pct) -> Column:
    return F.when(pct >= LIMIT_CRIT, 3).when(pct >= LIMIT_WARN, 2).otherwise(0)


def alert_crossings(levels: DataFrame, *, as_of=None, keys=("source",), order=("checked_at",)) -> DataFrame:
    """Checks that fire: level 2 or more and above the level of the check before.

    Checks are ordered inside days and the last level of a day is carried to the next,
    so a busy key is not one task."""
    day = levels.withColumn("_day", F.to_date(order[0]))
    prev = carry_forward(day, keys, "_day", order, ahead=["level"])
    return prev.where((F.col("level") >= 2) & (F.col("level") > F.coalesce("level_prev", F.lit(0)))).drop("_day").withColumnRenamed("level_prev", "previous_level")


def status_fields(usage: DataFrame, errors: DataFrame, *, as_of, keys=()) -> DataFrame:
    """The one-line status: zone, model, rate, time left, errors, cache, today's cost."""
    keys = list(keys)
    e = C.until(enrich(usage), as_of)
    state = B.window_state(e, as_of=as_of, keys=keys)
    zones = B.zones_from_state(state, keys)
    zones = B._with_progress(zones, as_of)
    eta_ready = F.col("_burning") & (F.col("w_cost_e4") > 0) & (F.col("cost_p90_c") > 0)
    past = F.coalesce(eta_ready & (F.col("w_cost_e4") >= F.col("cost_p90_c") * 100), F.lit(False))
    left = F.when(F.col("active"), X.idiv("remaining_s", 60)).otherwise(F.lit(0).cast("bigint"))
    z = zones.select(*keys, *[c + "_c" for c in B.ZONES], past.alias("block_past_p90"), left.alias("block_remaining_min"))
    tot = e.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("cache_read_tokens", "input_tokens", "cache_creation_tokens")],
        C.sum_when("cost_nano", C.recent(as_of, 20_000), "_two"),
        C.sum_when("cost_nano", f"date = DATE '{C.moment(as_of).date()}'", "_today"),
    )
    newest = A.by_session(e, as_of=as_of, keys=keys, limit=1).select(*keys, F.try_element_at("models", F.lit(-1)).alias("_model"))
    err = A.errors_summary(errors, as_of=as_of, keys=keys).select(*keys, F.col("total").alias("errors_24h"))
    out = z
    for part in (tot, newest, err):
        out = C.null_safe_join(out, part, keys)
    out = out.withColumn("rate_c", X.per_hour_cents("_two", F.lit(20_000)))
    zone = F.when(F.col("rate_c") >= F.col("heavy_c"), "heavy").when(F.col("rate_c") >= F.col("busy_c"), "busy").when(F.col("rate_c") >= F.col("typical_c"), "typical").otherwise("calm")
    hit_e4 = F.round(C.hit_rate() * 10_000).cast("bigint")
    return out.select(
        *keys, zone.alias("verdict"), S.active_model_name("_model").alias("active_model"), X.scaled("rate_c", 2).alias("burn_rate_per_hour"),
        "block_remaining_min", "block_past_p90", F.coalesce("errors_24h", F.lit(0)).cast("bigint").alias("errors_24h"),
        X.scaled(X.round_div(hit_e4, 10), 1).alias("cache_hit_pct"),
        X.scaled(X.round_div(X.cost_e4("_today"), 100), 2).alias("today_cost"),
    )


def today_vs_baseline(usage: DataFrame, *, as_of, keys=()) -> DataFrame:
    """Today's cost against the daily P50 and P90; needs three days."""
    daily = A.daily_base(C.until(usage, as_of), keys)
    base = T.baseline(usage, keys=keys, daily=daily)
    today = daily.groupBy(*keys).agg(F.sum(F.when(F.col("date") == C.as_date(as_of), F.col("cost_e4"))).alias("today_e4"))
    s = C.null_safe_join(base, today, keys)
    p50, p90 = [F.round(F.col(c) * 10_000).cast("bigint") for c in ("cost_p50", "cost_p90")]
    t = F.col("today_e4")
    verdict = (
        F.when(t.isNull(), "no activity").when(F.col("samples") < 3, "no baseline").when(t > p90, "high")
        .when((p50 > 0) & (t * 2 >= p50 * 3), "elevated").when((p50 <= 0) | (t * 2 <= p50), "light").otherwise("normal")
    )
    return s.select(*keys, "samples", X.scaled(t, 4).alias("today_cost"), "cost_p50", "cost_p90", X.ratio(t, p50, 2).alias("ratio"), verdict.alias("verdict"))


def budget_status(usage: DataFrame, budgets: DataFrame, *, as_of, keys=("source",)) -> DataFrame:
    """Monthly budget per key (column budget_usd) against spend and projection."""
    p = T.projections(T.forecast_base(usage, as_of=as_of, keys=keys), as_of, keys)
    b = budgets.where(F.col("budget_usd") > 0).select(*keys, F.round(F.col("budget_usd") * 100).cast("bigint").alias("budget_c"))
    s = p.join(b, list(keys))
    so_far, eom, budget, left = F.col("month_so_far_c"), F.col("month_projected_eom_c"), F.col("budget_c"), F.col("month_days_left")
    daily = F.when(left > 0, X.round_div(F.greatest(eom - so_far, F.lit(0)), left)).otherwise(F.lit(0).cast("bigint"))
    kind = F.when(eom > budget, "bad").when(so_far * 10 > budget * 9, "warn").otherwise("good")
    return s.select(
        *keys, X.scaled("budget_c", 2).alias("budget_usd"), X.scaled("month_so_far_c", 2).alias("month_so_far"), X.scaled("month_projected_eom_c", 2).alias("month_projected_eom"),
        X.ratio(so_far * 100, budget, 1).alias("used_pct"), X.ratio(eom * 100, budget, 1).alias("projected_pct"),
        X.scaled(eom - budget, 2).alias("over_usd"), kind.alias("kind"), left.alias("days_left"), X.scaled(daily, 2).alias("daily_rate"),
    )


def limit_severity(limits: DataFrame, *, as_of, keys=("device",), order=("timestamp", "line_no")) -> DataFrame:
    """Severity and time to reset of the newest primary and secondary limits, long form."""
    newest = N.latest_rate_limits(limits, as_of=as_of, keys=keys, order=order)
    rows = F.array(*[F.struct(F.lit(k).alias("limit"), F.col(k + "_pct").alias("used_pct"), F.col(k + "_resets_at").alias("resets_at")) for k in ("primary", "secondary")])
    r = newest.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    pct = F.coalesce("used_pct", F.lit(0))
    now_s = F.unix_seconds(C.as_ts(as_of).cast("timestamp"))
    rest = F.greatest(F.col("resets_at") - now_s, F.lit(0).cast("bigint"))
    h, m = F.call_function("div", rest, F.lit(3600)), F.call_function("div", rest % 3600, F.lit(60))
    text = F.when(F.coalesce("resets_at", F.lit(0)) == 0, "").when(h >= 1, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m")))
    return r.select(*keys, "limit", "used_pct", F.when(pct >= 90, "bad").when(pct >= 70, "warn").otherwise("good").alias("severity"), text.alias("resets_in"))
