"""Anchored five-hour windows and what follows from them: plan, baseline, current window,
burn-rate zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions import exact as X, text as S
from usagelens.operators import common as C
from usagelens.plans.anchored import FOLD_LIMIT, WINDOW_US, assign_windows
from usagelens.schema import enrich

# Tokens per five-hour window by plan.
PLAN_LIMITS = {"pro": 44_000, "max5": 88_000, "max20": 220_000}

# Cold-start burn zones in $/h by plan.
MARKET_ZONES = {
    "pro": {"typical": 8, "busy": 18, "heavy": 35, "max": 60},
    "max5": {"typical": 15, "busy": 35, "heavy": 70, "max": 120},
    "max20": {"typical": 30, "busy": 70, "heavy": 140, "max": 240},
}
ZONES = ("typical", "busy", "heavy", "max")
MIN_BASELINE_WINDOWS = 8


def windows_base(usage: DataFrame, keys=(), fold_limit: int = FOLD_LIMIT) -> DataFrame:
    rows = assign_windows(enrich(usage), keys, fold_limit)
    family = F.when(F.coalesce("model", F.lit("")) != "", F.col("family"))
    return (
        rows.groupBy(*keys, "start_us")
        .agg(
            *C.totals_aggs(),
            F.max("timestamp").alias("last_activity_at"),
            F.sum("billable_tokens").alias("billable_tokens"),
            F.array_sort(F.collect_set(family)).alias("models"),
        )
        .withColumn("cost_e4", X.cost_e4("cost_nano"))
    )


def billing_windows(
    usage: DataFrame, *, as_of=None, keys=(), last_n: int | None = None, fold_limit: int = FOLD_LIMIT, windows: DataFrame | None = None
) -> DataFrame:
    """The windows of the records up to as_of, or `windows` as given."""
    base = windows_base(C.until(usage, as_of), keys, fold_limit) if windows is None else windows
    if last_n:
        base = C.top_n(base, keys, [F.desc("start_us")], last_n)
    return base.select(
        *keys,
        S.from_micros("start_us").alias("started_at"),
        S.from_micros(F.col("start_us") + WINDOW_US).alias("ends_at"),
        "last_activity_at",
        F.col("total_tokens").alias("window_tokens"),
        "billable_tokens",
        "models",
        *C.totals_out(),
    )


def window_state(usage: DataFrame, *, as_of, keys=(), plan: str | None = None, lookback_days: int = 8, windows=None) -> DataFrame:
    """One row per key: inferred plan, past-window percentiles, the last window.

    The arrays hold one entry per five-hour window of a key, which calendar time bounds.
    `windows` as given are those of the records up to as_of.
    """
    base = windows_base(C.until(usage, as_of), keys) if windows is None else windows
    cutoff = S.micros(C.hours_before(as_of, lookback_days * 240_000))
    last_fields = ("start_us", "total_tokens", "billable_tokens", "cost_e4", "models")
    g = base.groupBy(*keys).agg(
        F.max_by(F.struct(*last_fields), "start_us").alias("_last"),
        F.sort_array(F.collect_list(F.struct("start_us", "billable_tokens", "cost_e4"))).alias("_ws"),
        X.sorted_list("total_tokens", F.col("start_us") >= cutoff).alias("_recent"),
    )
    past = F.slice("_ws", F.lit(1), F.greatest(F.size("_ws") - 1, F.lit(0)))

    def positive(field):
        return F.array_sort(F.filter(F.transform(past, lambda w: w[field]), lambda v: v > 0))

    g = g.withColumns({"_b": positive("billable_tokens"), "_c": positive("cost_e4")})
    enough = F.size("_b") >= MIN_BASELINE_WINDOWS
    p90 = X.percentile_x100(F.col("_recent"), 90)
    guess = (
        F.when(F.size("_recent") == 0, "unknown")
        .when(p90 <= PLAN_LIMITS["pro"] * 100, "pro")
        .when(p90 <= PLAN_LIMITS["max5"] * 100, "max5")
        .otherwise("max20")
    )

    def billable(q):
        return F.when(enough, X.idiv(X.percentile_x100(F.col("_b"), q), 100))

    def cost_cents(q):
        return F.when(enough, F.coalesce(X.round_div(X.percentile_x100(F.col("_c"), q), 10_000), F.lit(0).cast("bigint")))

    return g.select(
        *keys,
        guess.alias("guess"),
        F.coalesce(X.idiv(p90, 100), F.lit(0).cast("bigint")).alias("p90_window_tokens"),
        F.size("_recent").alias("plan_samples"),
        (F.lit(plan) if plan else guess).alias("plan"),
        F.size("_b").alias("samples"),
        billable(50).alias("billable_p50"),
        billable(90).alias("billable_p90"),
        cost_cents(50).alias("cost_p50_c"),
        cost_cents(90).alias("cost_p90_c"),
        *[F.col("_last." + f).alias("w_" + f) for f in last_fields],
    )


def plan_inference(usage: DataFrame, *, as_of, keys=(), lookback_days: int = 8, windows=None) -> DataFrame:
    s = window_state(usage, as_of=as_of, keys=keys, lookback_days=lookback_days, windows=windows)
    return s.select(*keys, "guess", "p90_window_tokens", F.col("plan_samples").alias("samples"))


def window_baseline(usage: DataFrame, *, as_of, keys=(), windows=None) -> DataFrame:
    s = window_state(usage, as_of=as_of, keys=keys, windows=windows)
    return s.select(
        *keys, "samples", "billable_p50", "billable_p90",
        X.scaled("cost_p50_c", 2).alias("cost_p50"), X.scaled("cost_p90_c", 2).alias("cost_p90"),
        F.col("billable_p50").alias("typical_billable_per_window"),
    )


def _with_progress(state: DataFrame, as_of) -> DataFrame:
    """Add elapsed and remaining time of the last window; negative elapsed counts as 0."""
    since = S.micros(C.as_ts(as_of)) - F.col("w_start_us")          # NULL without any window
    s = state.withColumn("elapsed_us", F.when(since < 0, F.lit(0).cast("bigint")).otherwise(since))
    s = s.withColumn("active", F.coalesce(F.col("elapsed_us") < WINDOW_US, F.lit(False)))
    remaining = X.idiv(F.lit(WINDOW_US) - F.col("elapsed_us"), 1_000_000)
    # Rates need more than a minute of data.
    burning = F.col("active") & (F.col("elapsed_us") > 60_000_000)
    return s.withColumns({"remaining_s": remaining, "_burning": burning})


def _projected(field: str):
    """used + rate * remaining as numerator over elapsed_us; plain `used` without a rate."""
    el = X.wide("elapsed_us")
    return X.wide(field) * (el + X.wide("remaining_s") * 1_000_000)


def current_window(usage: DataFrame, *, as_of, keys=(), plan: str | None = None, windows=None) -> DataFrame:
    s = _with_progress(window_state(usage, as_of=as_of, keys=keys, plan=plan, windows=windows), as_of)
    limits = F.create_map(*[F.lit(x) for kv in PLAN_LIMITS.items() for x in kv])
    name = F.lower("plan")
    s = s.withColumn("plan_limit", F.coalesce(F.try_element_at(limits, name), F.lit(PLAN_LIMITS["max5"])).cast("bigint"))
    burn, el = F.col("_burning"), F.col("elapsed_us")
    zero = F.lit(0).cast("bigint")

    def rate(field, num, den):
        return F.when(burn, X.round_div(X.wide(field) * num, X.wide(el) * den)).otherwise(zero)

    def close(field):
        return F.when(burn, X.idiv(_projected(field), el)).otherwise(F.col(field))

    close_total = close("w_total_tokens")
    # Projected billable over the own median, as one fraction.
    vs_n = F.when(burn, _projected("w_billable_tokens")).otherwise(X.wide("w_billable_tokens"))
    vs_d = F.when(burn, X.wide("billable_p50") * X.wide(el)).otherwise(X.wide("billable_p50"))
    known = F.col("billable_p50") > 0
    verdict = (
        F.when(~F.coalesce(known, F.lit(False)), "neutral")
        .when(vs_n >= vs_d * 3, "bad")
        .when(vs_n * 2 >= vs_d * 3, "warn")
        .when(vs_n * 2 <= vs_d, "neutral")
        .otherwise("good")
    )
    close_cents = F.when(burn, X.round_div(_projected("w_cost_e4"), X.wide(el) * 100)).otherwise(X.round_div("w_cost_e4", 100))
    out = {
        "started_at": S.from_micros("w_start_us"),
        "ends_at": S.from_micros(F.col("w_start_us") + WINDOW_US),
        "elapsed_seconds": X.idiv(el, 1_000_000),
        "remaining_seconds": F.col("remaining_s"),
        "tokens_used": F.col("w_total_tokens"),
        "billable_tokens_used": F.col("w_billable_tokens"),
        "plan": name,
        "plan_limit": F.col("plan_limit"),
        "utilization": X.scaled(X.round_div(X.wide("w_total_tokens") * 10_000, "plan_limit"), 4),
        "burn_tokens_per_min": X.scaled(rate("w_total_tokens", 600_000_000, 1), 1),
        "burn_billable_per_min": X.scaled(rate("w_billable_tokens", 600_000_000, 1), 1),
        "projected_close_tokens": close_total,
        "projected_close_billable": close("w_billable_tokens"),
        "projected_overage": F.greatest(zero, close_total - F.col("plan_limit")),
        "baseline_billable_p50": F.col("billable_p50"),
        "baseline_billable_p90": F.col("billable_p90"),
        "baseline_cost_p50": X.scaled("cost_p50_c", 2),
        "baseline_cost_p90": X.scaled("cost_p90_c", 2),
        "vs_baseline_ratio": F.when(known, X.scaled(X.round_div(vs_n * 100, vs_d), 2)),
        "cost_per_hour": X.scaled(rate("w_cost_e4", C.US_PER_HOUR, 100), 2),
        "projected_close_cost": X.scaled(close_cents, 2),
        "verdict_kind": verdict,
        "models": F.col("w_models"),
        "cost_usd": X.scaled(X.round_div("w_cost_e4", 100), 2),
    }
    active = F.col("active")
    return s.select(*keys, active, *[F.when(active, c).alias(n) for n, c in out.items()])


def block_eta(usage: DataFrame, *, as_of, keys=(), windows=None) -> DataFrame:
    """When the current window reaches the usual (P50) and the busy (P90) window cost."""
    s = _with_progress(window_state(usage, as_of=as_of, keys=keys, windows=windows), as_of)
    used, el = X.wide("w_cost_e4"), X.wide("elapsed_us")
    running = F.col("_burning") & (F.col("w_cost_e4") > 0)
    cols = []
    for p in ("p50", "p90"):
        target = X.wide(F.col(f"cost_{p}_c")) * 100
        valid = F.coalesce(running & (target > 0), F.lit(False))
        past = valid & (used >= target)
        num = (target - used) * el
        hit = valid & ~past & (num <= used * X.wide("remaining_s") * 1_000_000)
        eta = S.from_micros(S.micros(C.as_ts(as_of)) + X.round_div(num, used))
        cols += [
            past.alias(f"already_past_{p}"),
            hit.alias(f"will_hit_{p}"),
            F.when(hit, eta).alias(f"eta_{p}"),
            F.when(hit, X.idiv(num, used * 60_000_000)).alias(f"minutes_to_{p}"),
        ]
    return s.select(*keys, *cols)


def zones_from_state(state: DataFrame, keys=()) -> DataFrame:
    """Zone bounds in cents: market values blending into the own ones over windows 8 to 16."""
    g = F.lower(F.coalesce("guess", F.lit("")))
    tier = F.when(F.contains(g, F.lit("20")), "max20").when(F.contains(g, F.lit("max")) | F.contains(g, F.lit("5")), "max5").otherwise("pro")
    s = state.withColumn("_tier", tier)
    own = F.coalesce(F.col("cost_p90_c") > 0, F.lit(False))
    weight = F.least(F.greatest(F.col("samples") - 8, F.lit(0)), F.lit(8))
    # Personal values times five: window cost / 5 h, doubled for heavy, tripled (at least $1) for max.
    personal = {
        "typical": F.col("cost_p50_c"),
        "busy": F.col("cost_p90_c"),
        "heavy": F.col("cost_p90_c") * 2,
        "max": F.greatest(F.col("cost_p90_c") * 3, F.lit(500)),
    }
    cols = []
    for z in ZONES:
        market = None
        for t, v in MARKET_ZONES.items():
            cond, value = F.col("_tier") == t, F.lit(v[z] * 100).cast("bigint")
            market = F.when(cond, value) if market is None else market.when(cond, value)
        blended = X.round_div((8 - weight) * market * 5 + weight * personal[z], 40)
        cols.append(F.when(own, blended).otherwise(market).alias(z + "_c"))
    return s.select(
        "*", *cols, own.alias("_own"),
        F.when(own, X.scaled(X.round_div(weight * 100, 8), 2)).alias("blend_ratio"),
    )


def burn_rate_zones(usage: DataFrame, *, as_of, keys=(), windows=None) -> DataFrame:
    z = zones_from_state(window_state(usage, as_of=as_of, keys=keys, windows=windows), keys)
    return z.select(
        *keys, *[X.scaled(c + "_c", 2).alias(c) for c in ZONES],
        (~F.col("_own")).alias("insufficient_history"), "blend_ratio", F.col("guess").alias("plan_basis"),
    )


def burn_cents(usage: DataFrame, as_of, keys, hours_e4: int, alias: str = "rate_c") -> DataFrame:
    """Cents per hour over one look-back window; every key keeps a row."""
    e = enrich(usage)
    e = C.until(e, as_of) if keys else C.since(e, as_of, hours_e4)
    sums = e.groupBy(*keys).agg(C.sum_when("cost_nano", C.recent(as_of, hours_e4), "_nano"))
    return sums.select(*keys, X.per_hour_cents("_nano", F.lit(hours_e4)).alias(alias))


def gauge_zone(usage: DataFrame, *, as_of, keys=(), hours: str = "2", windows=None) -> DataFrame:
    """Burn rate of one look-back window against the zones."""
    h = dict(C.BURN_WINDOWS)[hours]
    z = zones_from_state(window_state(usage, as_of=as_of, keys=keys, windows=windows), keys)
    out = C.null_safe_join(z, burn_cents(usage, as_of, keys, h), keys)
    hot = F.when(F.col("rate_c") >= F.col("heavy_c"), "heavy").when(F.col("rate_c") >= F.col("busy_c"), "busy")
    zone = hot.when(F.col("rate_c") >= F.col("typical_c"), "above normal").otherwise("calm")
    kind = F.when(zone == "heavy", "bad").when(zone == "calm", "good").otherwise("warn")
    return out.select(*keys, X.scaled("rate_c", 2).alias("rate"), X.scaled("max_c", 2).alias("gauge_max"), zone.alias("zone"), kind.alias("kind"))
