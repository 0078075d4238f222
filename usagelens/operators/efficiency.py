"""The user against their own history: unit costs, verdicts, direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions import exact as X
from usagelens.operators import common as C, joins as J
from usagelens.operators.aggregates import daily_base
from usagelens.operators.trends import active_hours_base, hourly_cents, hours_per_day_x10
from usagelens.schema import enrich

# Bands without own history ($/h) and per turn ($), cache targets.
DEFAULT_HOUR_CENTS = (400, 1200, 2500)
TURN_BAND_E4 = (1_000, 5_000)
CACHE_TARGETS_E4 = (4_000, 7_000, 8_500)


def _bounds(as_of):
    today = C.as_date(as_of)
    return F.date_sub(today, 7), F.date_sub(today, 30)


def _day_stats(daily: DataFrame, as_of, keys) -> DataFrame:
    """Sums and counts of active days, recent and before, and the last 30 days' costs."""
    cut7, cut30 = _bounds(as_of)
    d, cost = F.col("date"), F.col("cost_e4")
    active = cost >= C.ACTIVE_DAY_E4
    recent, prior = active & (d >= cut7), active & (d < cut7) & (d >= cut30)

    def total(cond):
        return F.coalesce(F.sum(F.when(cond, cost)), F.lit(0))

    return daily.groupBy(*keys).agg(
        total(recent).alias("day_sum"), F.count_if(recent).alias("day_n"),
        total(prior).alias("prior_sum"), F.count_if(prior).alias("prior_n"),
        X.sorted_list("cost_e4", active & (d >= cut30)).alias("day_costs"),
    )


def fuel_state(usage: DataFrame, commits: DataFrame | None, *, as_of, keys=(), prior_days: int = 23, commit_days: int = 14) -> DataFrame:
    """One wide row per key with everything the efficiency rows need."""
    keys = list(keys)
    cut7, cut30 = _bounds(as_of)
    e = C.until(enrich(usage), as_of)
    tot = e.groupBy(*keys).agg(
        F.sum("cost_nano").alias("cost_nano"), F.count(F.lit(1)).alias("messages"),
        *[F.sum(c).alias(c) for c in ("cache_read_tokens", "input_tokens", "cache_creation_tokens")],
    )
    tot = tot.select(*keys, X.cost_e4("cost_nano").alias("cost_e4"), "messages", F.round(C.hit_rate() * 10_000).cast("bigint").alias("hit_e4"))
    hours = active_hours_base(e, as_of=as_of, keys=keys)
    before = active_hours_base(e, as_of=as_of, keys=keys, days=prior_days, where=(F.col("date") < cut7) & (F.col("date") >= cut30))

    def hours_cols(df, p):
        return df.select(
            *keys, F.col("slots").alias(p + "slots"), F.col("active_days").alias(p + "days"), F.col("cost_nano").alias(p + "nano"),
            hourly_cents("cost_nano", "slots").alias(p + "hour_c"), hours_per_day_x10("slots", "active_days").alias(p + "hpd"),
        )

    out = tot
    for part in (hours_cols(hours, "h_"), hours_cols(before, "b_"), _day_stats(daily_base(e, keys), as_of, keys)):
        out = C.null_safe_join(out, part, keys)
    if commits is not None:
        matched = J.commit_cost(e, commits, as_of=as_of, keys=keys, since_days=commit_days)
        s = J.commit_summary(matched, keys=keys)
        s = s.select(
            *keys, F.col("total_commits_matched").alias("commits"),
            F.round(F.col("mean_cost_usd") * 10_000).cast("bigint").alias("commit_mean"),
            F.round(F.col("median_cost_usd") * 10_000).cast("bigint").alias("commit_median"),
        )
        out = C.null_safe_join(out, s, keys)
    else:
        out = out.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("commits", "commit_mean", "commit_median")])
    numbers = [c for c in out.columns if c not in (*keys, "day_costs")]
    return out.fillna(0, numbers)


def fuel_efficiency(usage: DataFrame, commits: DataFrame | None = None, *, as_of, keys=(), prior_days: int = 23) -> DataFrame:
    """Rows (metric, you, band_low, band_high, band_heavy, samples, verdict) per key, plus a headline."""
    s = fuel_state(usage, commits, as_of=as_of, keys=keys, prior_days=prior_days)
    anchored = F.col("b_hour_c") > 0
    band = [F.when(anchored, X.round_div(F.col("b_hour_c") * m, 10)).otherwise(F.lit(d)) for m, d in zip((7, 13, 20), DEFAULT_HOUR_CENTS)]
    s = s.withColumns({"low_c": band[0], "high_c": band[1], "heavy_c": band[2]})
    you = F.col("h_hour_c")
    # Half an hour of activity is six slots.
    hour = (
        F.when(F.col("h_slots") < 6, "neutral").when(~anchored, "neutral")
        .when(you < F.col("high_c"), "good").when(you < F.col("heavy_c"), "warn").otherwise("bad")
    )
    # recent mean / prior mean as a fraction of sums and counts.
    rn, rd = X.wide("day_sum") * F.col("prior_n"), X.wide("prior_sum") * F.col("day_n")
    day = (
        F.when((F.col("day_n") == 0) | (F.col("prior_n") < 3), "neutral")
        .when(rn * 10 < rd * 13, "good").when(rn < rd * 2, "warn").otherwise("bad")
    )
    n = F.size("day_costs")
    rank = F.bround((n - 1) * F.lit(9) / F.lit(10.0)).cast("int")
    day_p90 = F.when(n >= 5, F.get("day_costs", rank)).otherwise(F.lit(0).cast("bigint"))
    day_mean = X.round_div("day_sum", F.col("day_n") * 100)
    anchor = F.when(F.col("prior_n") >= 3, X.round_div("prior_sum", F.col("prior_n") * 100))
    hit = F.col("hit_e4")
    cache = F.when(hit >= CACHE_TARGETS_E4[1], "good").when(hit >= CACHE_TARGETS_E4[0], "warn").otherwise("bad")
    cost, msgs = F.col("cost_e4"), F.col("messages")
    turn = (
        F.when((msgs == 0) | (cost <= msgs * TURN_BAND_E4[1]), "good")
        .when(cost < msgs * TURN_BAND_E4[1] * 2, "warn").otherwise("bad")
    )
    s = s.withColumns({"hour_kind": hour, "day_kind": day, "cache_kind": cache, "turn_kind": turn})
    unit_good = (F.col("cache_kind") == "good") & (F.col("turn_kind") == "good")
    heavy = F.col("hour_kind").isin("warn", "bad")
    headline = (
        F.when(unit_good & heavy & (F.col("h_hpd") >= 60), "heavy use, efficient")
        .when(unit_good & ~heavy, "efficient, usual volume")
        .when(~unit_good & heavy, "high spend, high unit cost")
        .when(~unit_good, "unit cost could drop")
        .otherwise("inconclusive")
    )
    headline_kind = (
        F.when(unit_good & heavy & (F.col("h_hpd") >= 60), "good").when(unit_good & ~heavy, "good")
        .when(~unit_good & heavy, "bad").when(~unit_good, "warn").otherwise("neutral")
    )
    none = F.lit(None).cast("double")

    def row(metric, you, low, high, heavy, samples, kind, note=None):
        return F.struct(
            F.lit(metric).alias("metric"), you.alias("you"), low.alias("band_low"), high.alias("band_high"),
            heavy.alias("band_heavy"), samples.cast("bigint").alias("samples"), kind.alias("verdict"),
            (F.lit(None).cast("string") if note is None else note).alias("note"),
        )

    zero = F.lit(0).cast("bigint")
    rows = F.array(
        row("per_active_hour", X.scaled(you, 2), X.scaled("low_c", 2), X.scaled("high_c", 2), X.scaled("heavy_c", 2), F.col("h_slots"), F.col("hour_kind")),
        row("per_active_day", X.scaled(F.coalesce(day_mean, zero), 2), none, X.scaled(F.coalesce(anchor, zero), 2), X.scaled(X.round_div(day_p90, 100), 2), F.col("day_n"), F.col("day_kind")),
        row("per_commit", X.scaled(X.round_div("commit_mean", 100), 2), none, X.scaled(X.round_div("commit_median", 100), 2), none, F.col("commits"), F.lit("neutral"),
            F.when(F.col("commits") < 3, "too few commits").otherwise("no comparison")),
        row("cache_hit_rate", X.scaled("hit_e4", 4), *[X.scaled(F.lit(v), 4) for v in CACHE_TARGETS_E4], msgs, F.col("cache_kind")),
        row("per_turn", X.scaled(F.coalesce(X.round_div("cost_e4", "messages"), zero), 4), X.scaled(F.lit(TURN_BAND_E4[0]), 4), X.scaled(F.lit(TURN_BAND_E4[1]), 4), none, msgs, F.col("turn_kind")),
        row("hours_per_active_day", X.scaled("h_hpd", 1), none, X.scaled("b_hpd", 1), none, F.col("h_days"), F.lit("neutral")),
        row("headline", none, none, none, none, msgs, headline_kind, headline),
    )
    return s.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def trend(usage: DataFrame, *, as_of, keys=()) -> DataFrame:
    """Last seven days against the days before, back to 30: cost per active day and cache hits."""
    keys = list(keys)
    cut7, cut30 = _bounds(as_of)
    e = C.until(enrich(usage), as_of)
    d = F.col("date")
    recent, prior = d >= cut7, (d < cut7) & (d >= cut30)
    read = F.col("cache_read_tokens")
    side = read + F.col("input_tokens") + F.col("cache_creation_tokens")
    hits = e.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(n) for n, c, v in (("r_read", recent, read), ("r_side", recent, side), ("p_read", prior, read), ("p_side", prior, side))]
    )
    s = C.null_safe_join(_day_stats(daily_base(e, keys), as_of, keys), hits, keys)
    # Cost: relative change of two means; hits: difference of two rates.
    rn, pn = X.wide("day_sum") * F.col("prior_n"), X.wide("prior_sum") * F.col("day_n")
    dn = rn - pn
    cross_r, cross_p = X.wide("r_read") * F.col("p_side"), X.wide("p_read") * F.col("r_side")
    both = X.wide("r_side") * F.col("p_side")
    dh = cross_r - cross_p

    def direction(n, den, share):
        return F.when(n * share > den, "up").when(n * share < -den, "down").otherwise("flat")

    cost_ok = (F.col("day_n") > 0) & (F.col("prior_n") > 0)
    hit_ok = (F.col("r_read") > 0) & (F.col("p_read") > 0)
    rows = F.array(
        F.struct(
            F.lit("daily_cost").alias("metric"), cost_ok.alias("_ok"),
            X.scaled(X.round_div("day_sum", F.col("day_n") * 100), 2).alias("recent"),
            X.scaled(X.round_div("prior_sum", F.col("prior_n") * 100), 2).alias("prior"),
            X.scaled(X.round_div(dn * 1000, pn, signed=True), 1).alias("delta_pct"), direction(dn, pn, 20).alias("direction"),
        ),
        F.struct(
            F.lit("cache_hit_rate").alias("metric"), hit_ok.alias("_ok"),
            X.ratio("r_read", "r_side", 4).alias("recent"), X.ratio("p_read", "p_side", 4).alias("prior"),
            X.scaled(X.round_div(dh * 1000, both, signed=True), 1).alias("delta_pct"), direction(dh, both, 100).alias("direction"),
        ),
    )
    return s.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where("_ok").drop("_ok")
