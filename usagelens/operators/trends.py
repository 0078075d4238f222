"""Day-shaped analytics: caps, anomalies, baselines, active hours, time series, forecasts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions import exact as X, text as S
from usagelens.operators import common as C
from usagelens.operators.aggregates import daily_base
from usagelens.operators.billing import burn_cents
from usagelens.schema import enrich

ACTIVE_SLOT_US = 300_000_000          # five minutes of activity
SERIES_WIDTHS = (1, 4, 6, 12, 24)     # hours per bar
SERIES_BARS = 120
DAY_US = 24 * C.US_PER_HOUR


def _daily(usage: DataFrame, keys, daily: DataFrame | None) -> DataFrame:
    """`daily` as given holds records up to as_of only, as `usage` does here."""
    return daily_base(usage, keys) if daily is None else daily


def _sum_when(cond, value):
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0).cast("bigint"))


def weekly_cap(usage: DataFrame, *, as_of, keys=(), daily: DataFrame | None = None) -> DataFrame:
    """Last seven calendar days against the seven before and against all sums over
    seven active rows (days without data do not count towards those)."""
    d = _daily(C.until(usage, as_of), keys, daily)
    w7 = Window.partitionBy(*keys).orderBy("date").rowsBetween(-6, 0)
    d = d.withColumns({"_sum7": F.sum("cost_e4").over(w7), "_n7": F.count("cost_e4").over(w7)})
    today = C.as_date(as_of)
    day = F.col("date")
    g = d.groupBy(*keys).agg(
        _sum_when((day >= F.date_sub(today, 6)) & (day <= today), F.col("cost_e4")).alias("_now"),
        _sum_when((day >= F.date_sub(today, 13)) & (day <= F.date_sub(today, 7)), F.col("cost_e4")).alias("_prev"),
        X.sorted_list("_sum7", (F.col("_n7") == 7) & (F.col("_sum7") > C.ACTIVE_DAY_E4)).alias("_hist"),
    )
    zero = F.lit(0).cast("bigint")
    g = g.withColumns({
        "_p95": F.coalesce(X.percentile_x100(F.col("_hist"), 95), zero),
        "_med": F.coalesce(X.percentile_x100(F.col("_hist"), 50), zero),
    })
    now, p95 = X.wide("_now"), X.wide("_p95")
    pct = now * 10_000                       # over _p95: percent of the heaviest weeks

    def at_least(percent):
        return (F.col("_p95") > 0) & (pct >= p95 * percent)

    return g.select(
        *keys,
        X.scaled(X.round_div("_now", 100), 2).alias("rolling_7day_cost"),
        X.scaled(X.round_div("_prev", 100), 2).alias("prev_7day_cost"),
        X.ratio((F.col("_now") - F.col("_prev")) * 100, "_prev", 1, signed=True).alias("delta_pct"),
        X.scaled(X.round_div("_p95", 10_000), 2).alias("p95_7row_cost"),
        X.scaled(X.round_div("_med", 10_000), 2).alias("median_7row_cost"),
        F.size("_hist").alias("samples"),
        X.ratio(pct, "_p95", 1).alias("pct_of_p95"),
        F.when(at_least(100), "bad").when(at_least(75), "warn").otherwise("good").alias("verdict_kind"),
        F.when(at_least(100), "heaviest").when(at_least(75), "near heaviest").when(at_least(40), "typical").otherwise("low").alias("verdict"),
    )


def daily_anomalies(usage: DataFrame, *, as_of=None, keys=(), daily: DataFrame | None = None) -> DataFrame:
    """Days whose tokens (z-score) or cost (ratio to median) stand out from the up to
    seven rows before them; at least three are needed."""
    prior = Window.partitionBy(*keys).orderBy("date").rowsBetween(-7, -1)
    x = X.wide("total_tokens")
    d = _daily(C.until(usage, as_of), keys, daily).withColumns({
        "_n": F.count(F.lit(1)).over(prior),
        "_s": F.sum("total_tokens").over(prior),
        "_q": F.sum(x * x).over(prior),
        "_costs": F.sort_array(F.collect_list("cost_e4").over(prior)),
    }).where(F.col("_n") >= 3)
    n = X.wide("_n")
    dev = n * x - X.wide("_s")                               # n * (x - mean)
    var = n * X.wide("_q") - X.wide("_s") * X.wide("_s")     # (n * pstdev)^2
    root = F.when(var > 0, F.sqrt(var.cast("double"))).otherwise(F.col("_n").cast("double"))
    d = d.withColumn("_z", dev.cast("double") / root)
    # Twice the median, in e4; a zero median counts as one cent.
    med2 = F.call_function("div", X.percentile_x100(F.col("_costs"), 50), F.lit(50))
    d = d.withColumn("_m2", F.when(med2 > 0, med2).otherwise(F.lit(200)))
    by_z, by_cost = F.col("_z") >= 2.0, F.col("cost_e4") >= F.col("_m2")
    return d.where(by_z | by_cost).select(
        *keys, "date", F.col("total_tokens").alias("tokens"), X.scaled("cost_e4", 4).alias("cost_usd"),
        (F.floor(F.col("_z") * 100 + 0.5) / 100.0).alias("z_score"),
        X.ratio(F.col("cost_e4") * 2, "_m2", 2).alias("cost_ratio"),
        F.concat_ws(",", F.when(by_z, "z-score"), F.when(by_cost, "cost")).alias("flags"),
    )


def baseline(usage: DataFrame, *, as_of=None, keys=(), daily: DataFrame | None = None) -> DataFrame:
    """Percentiles over days; the arrays are bounded by the number of days."""
    g = _daily(C.until(usage, as_of), keys, daily).groupBy(*keys).agg(
        X.sorted_list("cost_e4").alias("_c"), X.sorted_list("total_tokens").alias("_t")
    )
    return g.select(
        *keys,
        F.size("_c").alias("samples"),
        *[X.scaled(X.round_div(X.percentile_x100(F.col("_c"), q), 100), 4).alias(f"cost_p{q}") for q in (50, 90, 99)],
        *[X.idiv(X.percentile_x100(F.col("_t"), q), 100).alias(f"tokens_p{q}") for q in (50, 90, 99)],
    )


def _active_slots(usage: DataFrame, keys) -> DataFrame:
    """One row per key and active five-minute slot: later distinct counts become plain ones."""
    us = S.micros("timestamp")
    slot = F.call_function("div", us - F.pmod(us, F.lit(ACTIVE_SLOT_US)), F.lit(ACTIVE_SLOT_US))
    return (
        enrich(usage)
        .groupBy(*keys, "date", slot.alias("slot"))
        .agg(F.sum("cost_nano").alias("cost_nano"), F.sum("total_tokens").alias("total_tokens"))
    )


def active_hours_base(usage: DataFrame, *, as_of, keys=(), days: int = 7, where=None) -> DataFrame:
    recent = C.since(usage, as_of, days * 240_000)
    if where is not None:
        recent = recent.where(where)
    slots = _active_slots(recent, keys)
    per_day = slots.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_n"), F.sum("cost_nano").alias("_cost"))
    return per_day.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("slots"),
        F.count(F.lit(1)).alias("active_days"),
        F.coalesce(F.sum("_cost"), F.lit(0)).alias("cost_nano"),
    )


def hourly_cents(nano, slots):
    """Cost per active hour in cents; a slot is a twelfth of an hour."""
    return F.coalesce(X.round_div(X.wide(nano) * 12, X.wide(slots) * X.NANO_PER_CENT), F.lit(0).cast("bigint"))


def hours_per_day_x10(slots, active_days):
    return F.coalesce(X.round_div(X.wide(slots) * 10, X.wide(active_days) * 12), F.lit(0).cast("bigint"))


def active_hours(usage: DataFrame, *, as_of, keys=(), days: int = 7) -> DataFrame:
    b = active_hours_base(usage, as_of=as_of, keys=keys, days=days)
    return b.select(
        *keys,
        X.scaled(X.round_div(F.col("slots") * 10, 12), 1).alias("active_hours"),
        "active_days",
        X.usd2("cost_nano").alias("cost_usd"),
        X.scaled(hourly_cents("cost_nano", "slots"), 2).alias("cost_per_hour"),
        X.scaled(hours_per_day_x10("slots", "active_days"), 1).alias("hours_per_active_day"),
    )


def daily_burn_rates(usage: DataFrame, *, as_of, keys=(), days_back: int = 90) -> DataFrame:
    """Cost per active hour of each day."""
    recent = C.until(enrich(usage), as_of).where(F.col("date") >= F.date_sub(C.as_date(as_of), days_back))
    g = _active_slots(recent, keys).groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("slots"), F.sum("cost_nano").alias("cost_nano"), F.sum("total_tokens").alias("tokens")
    )
    return g.select(
        *keys, "date", X.usd2("cost_nano").alias("cost_usd"),
        X.scaled(X.round_div(F.col("slots") * 100, 12), 2).alias("active_hours"),
        X.scaled(hourly_cents("cost_nano", "slots"), 2).alias("cost_per_hour"),
        "tokens",
    ).orderBy(*keys, "date")


def burn_rate_timeseries(usage: DataFrame, *, as_of, keys=(), widths=SERIES_WIDTHS, bars: int = SERIES_BARS) -> DataFrame:
    """Zero-filled bars ending at as_of for every width. Records are summed once into
    hours counted from as_of; every width is a roll-up of those hours."""
    end_us = S.micros(C.as_ts(as_of))
    hours = max(widths) * bars
    age = end_us - S.micros("timestamp")
    # The bar edges belong to the later bar, except as_of itself, which closes the last one.
    back = F.when(age == 0, 0).otherwise(F.call_function("div", age - 1, F.lit(C.US_PER_HOUR)))
    recent = C.since(enrich(usage), as_of, hours * 10_000)
    hourly = recent.groupBy(*keys, back.cast("int").alias("_back")).agg(
        F.sum("cost_nano").alias("cost_nano"), F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("records")
    )
    width = F.explode(F.array(*[F.lit(w) for w in widths])).alias("width_hours")
    bar = (F.lit(bars - 1) - F.call_function("div", F.col("_back"), F.col("width_hours"))).cast("int")
    rolled = (
        hourly.select("*", width)
        .withColumn("bar", bar)
        .where(F.col("bar") >= 0)
        .groupBy(*keys, ((F.col("width_hours") * bars + F.col("bar"))).cast("int").alias("_cell"))
        .agg(*[F.sum(c).alias(c) for c in ("cost_nano", "tokens", "records")])
    )
    cells = F.array(*[F.lit(w * bars + b) for w in widths for b in range(bars)])
    if keys:
        frame = C.until(usage, as_of).select(*keys).distinct().select(*keys, F.explode(cells).alias("_cell"))
    else:
        frame = usage.sparkSession.range(1).select(F.explode(cells).alias("_cell"))
    out = frame.join(rolled, [*keys, "_cell"], "left").fillna(0, ["cost_nano", "tokens", "records"])
    out = out.withColumns({
        "width_hours": F.call_function("div", F.col("_cell"), F.lit(bars)).cast("int"),
        "bar": F.col("_cell") % bars,
    })
    start_us = end_us - (F.lit(bars) - F.col("bar")).cast("bigint") * F.col("width_hours") * C.US_PER_HOUR
    return out.select(
        *keys, "width_hours", "bar",
        S.from_micros(start_us).alias("start"),
        S.from_micros(start_us + F.col("width_hours").cast("bigint") * C.US_PER_HOUR).alias("end"),
        X.usd4("cost_nano").alias("cost"),
        "tokens", "records",
        X.scaled(X.per_hour_cents("cost_nano", F.col("width_hours") * 10_000), 2).alias("cost_per_hour"),
    )


def moving_average(series: DataFrame, *, n: int, value: str = "cost_per_hour", keys=("width_hours",), order: str = "bar", places: int = 2) -> DataFrame:
    """Average over the last n bars, fewer at the start. `value` has `places` decimals."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    units = F.round(F.col(value) * 10 ** places).cast("bigint")
    mean = X.scaled(X.round_div(F.sum(units).over(w) * 100, F.count(units).over(w)), places + 2)
    return series.select(*keys, order, value, mean.alias("moving_average"))


def _calendar(as_of):
    """Dates and counts around as_of; weeks start on Monday."""
    now = C.moment(as_of)
    today = now.date()
    month = today.replace(day=1)
    return {
        "today": today,
        "week_start": today - timedelta(days=today.weekday()),
        "week_left": 6 - today.weekday(),
        "month_start": month,
        "month_left": (month + timedelta(days=32)).replace(day=1).toordinal() - today.toordinal() - 1,
        "left_us": (datetime.combine(today, datetime.min.time()) + timedelta(days=1) - now) // timedelta(microseconds=1),
    }


def forecast_base(usage: DataFrame, *, as_of, keys=(), daily: DataFrame | None = None) -> DataFrame:
    """Sums so far in e4 and twice the median of the last seven active days."""
    cal = _calendar(as_of)
    d = _daily(C.until(usage, as_of), keys, daily)
    def total(start, alias):
        return C.sum_when("cost_e4", f"date >= DATE '{cal[start]}' AND date <= DATE '{cal['today']}'", alias)

    active = F.when(F.col("cost_e4") > C.ACTIVE_DAY_E4, F.struct("date", "cost_e4"))
    g = d.groupBy(*keys).agg(
        total("today", "today_e4"), total("week_start", "week_e4"), total("month_start", "month_e4"),
        F.slice(F.sort_array(F.collect_list(active), asc=False), 1, 7).alias("_active"),
    )
    values = F.array_sort(F.transform("_active", lambda a: a["cost_e4"]))
    med2 = F.call_function("div", X.percentile_x100(values, 50), F.lit(50))
    return g.withColumn("typical_x2", F.coalesce(med2, F.lit(0).cast("bigint"))).drop("_active")


def _project(so_far: str, days: int):
    """so_far + typical * days, in cents, with typical held twofold in e4."""
    return X.round_div(X.wide(so_far) * 2 + X.wide("typical_x2") * days, 200)


def projections(base: DataFrame, as_of, keys=()) -> DataFrame:
    cal = _calendar(as_of)
    week, month = cal["week_left"], cal["month_left"]
    rest = X.wide("typical_x2") * cal["left_us"]
    return base.select(
        *keys,
        X.round_div("today_e4", 100).alias("today_so_far_c"),
        X.round_div(rest + X.wide("today_e4") * (2 * DAY_US), 200 * DAY_US).alias("today_projected_eod_c"),
        X.round_div(rest, 200 * DAY_US).alias("today_remaining_c"),
        F.lit((cal["left_us"] * 20 + C.US_PER_HOUR) // (2 * C.US_PER_HOUR)).alias("hours_left_x10"),
        X.round_div("week_e4", 100).alias("week_so_far_c"),
        _project("week_e4", week).alias("week_projected_eow_c"),
        X.round_div(X.wide("typical_x2") * week, 200).alias("week_remaining_c"),
        F.lit(week).alias("week_days_left"),
        X.round_div("typical_x2", 200).alias("typical_daily_c"),
        X.round_div("month_e4", 100).alias("month_so_far_c"),
        _project("month_e4", month).alias("month_projected_eom_c"),
        X.round_div(X.wide("typical_x2") * month, 200).alias("month_remaining_c"),
        F.lit(month).alias("month_days_left"),
    )


def forecast(usage: DataFrame, *, as_of, keys=(), daily: DataFrame | None = None) -> DataFrame:
    """End of day, week and month at the pace of a typical active day, plus the 2 h burn rate."""
    p = projections(forecast_base(usage, as_of=as_of, keys=keys, daily=daily), as_of, keys)
    out = C.null_safe_join(p, burn_cents(usage, as_of, keys, 20_000), keys)

    def usd(name):
        return X.scaled(name + "_c", 2)

    return out.select(
        *keys,
        X.scaled("rate_c", 2).alias("burn_rate_per_hour_recent"),
        usd("today_so_far").alias("today_so_far"),
        usd("today_projected_eod").alias("today_projected_eod"),
        usd("today_remaining").alias("today_remaining_projection"),
        X.scaled("hours_left_x10", 1).alias("today_hours_left"),
        usd("week_so_far").alias("week_so_far"),
        usd("week_projected_eow").alias("week_projected_eow"),
        usd("week_remaining").alias("week_remaining_projection"),
        "week_days_left",
        usd("typical_daily").alias("typical_daily"),
        usd("month_so_far").alias("month_so_far"),
        usd("month_projected_eom").alias("month_projected_eom"),
        usd("month_remaining").alias("month_remaining_projection"),
        "month_days_left",
    )
