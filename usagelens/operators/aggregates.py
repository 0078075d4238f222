"""Grouped totals: days, models, projects, sessions, tools, devices, turns, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions import exact as X, pricing as P, text as S
from usagelens.operators import common as C
from usagelens.plans.newest import only_newest
from usagelens.schema import enrich


def totals(usage: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    return C.until(enrich(usage), as_of).groupBy(*keys).agg(*C.totals_aggs()).select(*keys, *C.totals_out())


def daily_base(usage: DataFrame, keys=()) -> DataFrame:
    """One row per key and UTC day; everything day-shaped builds on the rounded cost_e4."""
    return (
        enrich(usage)
        .groupBy(*keys, "date")
        .agg(*C.totals_aggs())
        .withColumn("cost_e4", X.cost_e4("cost_nano"))
    )


def daily(usage: DataFrame, *, as_of=None, keys=(), daily: DataFrame | None = None) -> DataFrame:
    """Totals per day; `daily` as given is `daily_base` of the records up to as_of."""
    return (daily_base(C.until(usage, as_of), keys) if daily is None else daily).select(*keys, "date", *C.totals_out()).orderBy(*keys, "date")


def by_model(usage: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    out = C.until(enrich(usage), as_of).groupBy(*keys, F.col("family").alias("model_family")).agg(*C.totals_aggs())
    return out.select(*keys, "model_family", *C.totals_out()).orderBy(*keys, "model_family")


def _by_model_full(usage: DataFrame, keys) -> DataFrame:
    return enrich(usage).groupBy(*keys, S.or_unknown("model").alias("model_id")).agg(*C.totals_aggs())


def by_model_full(usage: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    out = _by_model_full(C.until(usage, as_of), keys).select(*keys, "model_id", *C.totals_out())
    return out.orderBy(*keys, F.desc("cost_usd"), "model_id")


def by_project(usage: DataFrame, *, as_of=None, keys=(), top: int | None = None) -> DataFrame:
    project = F.coalesce(
        F.nullif("project_dir", F.lit("")), F.nullif("project_label", F.lit("")), F.lit("unknown")
    )
    out = (
        C.until(enrich(usage), as_of)
        .withColumn("_project", project)
        .groupBy(*keys, "_project")
        .agg(*C.totals_aggs(), F.max_by("project_label", C.record_order()).alias("_label"))
        .select(
            *keys,
            F.col("_project").alias("project_dir"),
            F.coalesce(F.nullif("_label", F.lit("")), "_project").alias("project_label"),
            *C.totals_out(),
        )
    )
    order = [F.desc("cost_usd"), F.asc("project_dir")]
    return C.top_n(out, keys, order, top) if top else out.orderBy(*keys, *order)


def by_session(
    usage: DataFrame,
    *,
    as_of,
    keys=(),
    intents: DataFrame | None = None,
    titles: DataFrame | None = None,
    recent_hours: int = 2,
    limit: int | None = 200,
) -> DataFrame:
    """Session totals, the recent slice and the last turn; zero-token sessions drop out
    before the newest `limit` are kept. Intents and titles join the survivors only.

    Of a table by date, without keys, the newest sessions are found in the newest days first, so that only
    their rows are summed; with keys some key may be idle since long, and one aggregation takes all."""
    recent = C.recent(as_of, recent_hours * 10_000)
    last_fields = (
        "timestamp", "model", "input_tokens", "output_tokens", "cache_creation_tokens",
        "cache_read_tokens", "total_tokens", "cost_nano", "effective_tokens",
    )
    first_fields = ("project_label", "project_dir", "git_branch")
    rows = C.until(enrich(usage), as_of).withColumn("session_id", S.or_unknown("session_id"))
    if not keys and "date" in usage.columns:
        # Tokens are not negative, so a session with some in the newest days has some in all.
        rows = only_newest(rows, "session_id", as_of=as_of, limit=limit, certain=F.sum("total_tokens") > 0)
    grouped = (
        rows.groupBy(*keys, "session_id")
        .agg(
            *C.totals_aggs(),
            *C.totals_aggs(recent, "r_"),
            F.min("timestamp").alias("started_at"),
            F.max("timestamp").alias("ended_at"),
            F.array_sort(F.collect_set(F.nullif("model", F.lit("")))).alias("models"),
            F.min_by(F.struct(*first_fields), C.record_order()).alias("_first"),
            F.max_by(F.struct(*last_fields), C.record_order()).alias("_last"),
        )
        .where(F.col("total_tokens") > 0)
    )
    out = C.top_n(grouped, keys, [F.desc("ended_at"), F.asc("session_id")], limit)
    out = out.select("*", *[F.col("_last." + c).alias("l_" + c) for c in last_fields])
    out = out.select(
        *keys,
        "session_id",
        *[F.col("_first." + c).alias(c) for c in first_fields],
        "started_at",
        "ended_at",
        X.idiv(S.micros("ended_at") - S.micros("started_at"), 1_000_000).alias("duration_seconds"),
        "models",
        F.col("l_model").alias("model_latest"),
        *C.totals_out(),
        F.col("r_total_tokens").alias("recent_window_tokens"),
        X.usd4("r_cost_nano").alias("recent_window_cost_usd"),
        F.col("r_messages").alias("recent_window_messages"),
        C.hit_rate("r_").alias("recent_window_cache_hit_rate"),
        (F.col("l_input_tokens") + F.col("l_output_tokens")).alias("last_turn_tokens"),
        F.col("l_total_tokens").alias("last_turn_total_tokens"),
        F.col("l_effective_tokens").alias("last_turn_effective_tokens"),
        X.usd4("l_cost_nano").alias("last_turn_cost_usd"),
        C.hit_rate("l_").alias("last_turn_cache_hit_rate"),
        F.col("l_timestamp").alias("last_turn_at"),
    )
    if intents is not None:
        shared = [k for k in keys if k in intents.columns]
        out = out.join(intents.select(*shared, "session_id", "intent"), [*shared, "session_id"], "left").fillna("", ["intent"])
    if titles is not None:
        shared = [k for k in keys if k in titles.columns]
        out = out.join(titles.select(*shared, "session_id", F.col("title").alias("chat")), [*shared, "session_id"], "left")
    return out


_LIMB = 1_000_000_000


def tool_sums(usage: DataFrame, keys=()) -> DataFrame:
    """Calls and output tokens per tool, a record's output split evenly over its calls.

    Records collapse to distinct tool lists before the lists are exploded, so the
    explode and the second shuffle grow with the number of lists, not of records.
    """
    no_tool = F.array(F.lit("(no tool)"))
    names = F.coalesce(F.col("tool_names"), F.array().cast("array<string>"))
    lists = (
        usage.withColumn("_tools", F.when(F.size(names) > 0, names).otherwise(no_tool))
        .groupBy(*keys, "_tools")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("output_tokens").alias("_out"))
    )
    per_size = (
        lists.select(*keys, "_n", "_out", F.size("_tools").alias("_size"), F.explode("_tools").alias("tool"))
        .groupBy(*keys, "tool", "_size")
        .agg(F.sum("_n").alias("_n"), F.sum("_out").alias("_out"))
    )
    # floor(sum(out/size)) by long division in base 1e9: the whole part, three limbs of 9 digits, and one unit of the last limb for
    # what is left. That unit carries a sum such as 1/3 + 2/3 up to the whole number it is; it cannot carry any other sum there
    # as long as the least common multiple of the sizes is below 1e27 / (number of sizes), as it is for all lists of up to 60 calls.
    limbs = per_size.selectExpr(*keys, "tool", "_n", "CAST(_size AS BIGINT) AS _size", "_out div _size AS _w", "_out % _size AS _r")
    for limb in ("_d1", "_d2", "_d3"):
        limbs = limbs.selectExpr(*[c for c in limbs.columns if c != "_r"], f"_r * {_LIMB}L div _size AS {limb}", f"_r * {_LIMB}L % _size AS _r")
    sums = limbs.groupBy(*keys, "tool").agg(
        F.sum("_n").alias("calls"), F.sum("_w").alias("_w"), F.sum("_d1").alias("_d1"), F.sum("_d2").alias("_d2"), F.expr("sum(_d3 + IF(_r > 0, 1L, 0L)) AS _d3")
    )
    carried = f"(_d1 + (_d2 + _d3 div {_LIMB}L) div {_LIMB}L) div {_LIMB}L"
    return sums.selectExpr(*keys, "tool", "calls", f"_w + {carried} AS approx_output_tokens")


def by_tool(usage: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    return tool_sums(C.until(usage, as_of), keys).orderBy(*keys, F.desc("approx_output_tokens"), "tool")


def tool_labels(usage: DataFrame, *, as_of=None, keys=(), top: int = 8) -> DataFrame:
    """Top tools with short labels, and the share of MCP and browser tools over all tools."""
    all_tools = tool_sums(C.until(usage, as_of), keys).where(~F.col("tool").isin("(no tool)", "")).withColumn("is_mcp", S.is_mcp_tool("tool"))
    w = Window.partitionBy(*keys)
    tokens = F.col("approx_output_tokens")
    mcp = F.sum(F.when(F.col("is_mcp"), tokens).otherwise(0)).over(w)
    all_tools = all_tools.withColumns({"total_tool_tokens": F.sum(tokens).over(w), "_mcp": mcp})
    out = C.top_n(all_tools, keys, [F.desc("approx_output_tokens"), F.asc("tool")], top)
    return out.select(
        *keys, "tool", S.tool_label("tool").alias("label"), "is_mcp", "calls", "approx_output_tokens",
        "total_tool_tokens",
        X.ratio(F.col("_mcp") * 100, F.col("total_tool_tokens"), 1).alias("mcp_share_pct"),
    )


def by_device(usage: DataFrame, *, as_of, keys=()) -> DataFrame:
    """Lifetime, today and last-hour totals per device, one row per scope, in one pass."""
    device = S.or_unknown("device", "pc").alias("device")
    scopes = {
        "lifetime": "true",
        "today": f"timestamp >= TIMESTAMP_NTZ '{C.moment(as_of).date()}'",
        "h1": C.recent(as_of, 10_000),
    }
    aggs = [a for s, cond in scopes.items() for a in C.totals_aggs(cond, s + "_")]
    wide = C.until(enrich(usage), as_of).groupBy(*keys, device).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), *C.totals_out(s + "_")) for s in scopes])
    return wide.select(*keys, "device", F.explode(rows).alias("r")).select(*keys, "device", "r.*")


def by_device_burn(usage: DataFrame, *, as_of, keys=()) -> DataFrame:
    """Burn in $/h per device over each look-back window; idle devices show 0."""
    device = S.or_unknown("device", "pc").alias("device")
    aggs = [C.sum_when("cost_nano", C.recent(as_of, h), f"b_{h}") for _, h in C.BURN_WINDOWS]
    wide = C.until(enrich(usage), as_of).groupBy(*keys, device).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias("window_hours"),
                X.scaled(X.per_hour_cents("b_" + str(h), F.lit(h)), 2).alias("cost_per_hour"),
            )
            for label, h in C.BURN_WINDOWS
        ]
    )
    return wide.select(*keys, "device", F.explode(rows).alias("r")).select(*keys, "device", "r.*")


def recent_turns(usage: DataFrame, *, as_of=None, keys=(), limit: int | None = 30) -> DataFrame:
    """Newest turns. Placeholder models go before the cut, so they never take a slot. Of a table by
    date, without keys, the newest turns are found in the newest days first, and only their rows are summed."""
    turn = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("turn_id", "message_id", "uuid")])
    first_fields = ("session_id", "project_label", "project_dir", "device")
    rows = (
        C.until(enrich(usage), as_of)
        .where((F.coalesce("model", F.lit("")) != "") & ~F.startswith("model", F.lit("<")))
        .withColumn("turn_id", turn)
        .where(F.col("turn_id").isNotNull())
    )
    if not keys and "date" in usage.columns:
        rows = only_newest(rows, "turn_id", as_of=as_of, limit=limit)
    out = (
        rows.groupBy(*keys, "turn_id")
        .agg(
            *C.totals_aggs(),
            F.sum("effective_tokens").alias("effective_tokens"),
            F.max("timestamp").alias("last_ts"),
            F.max_by("model", C.record_order()).alias("model"),
            F.min_by(F.struct(*first_fields), C.record_order()).alias("_first"),
        )
    )
    out = C.top_n(out, keys, [F.desc("last_ts"), F.asc("turn_id")], limit)
    return out.select(
        *keys,
        F.col("last_ts").alias("timestamp"),
        "turn_id",
        *[F.col("_first." + c).alias(c) for c in first_fields if c not in keys],
        "model",
        "effective_tokens",
        *[c for c in C.totals_out()],
    ).withColumnRenamed("messages", "assistant_record_count")


def usage_heatmap(usage: DataFrame, *, as_of=None, keys=(), tz: str = "UTC") -> DataFrame:
    """Tokens per weekday (Monday = 0) and hour in `tz`, all 168 cells, with a 0-4 level."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col("timestamp"))
    cells = (
        C.until(enrich(usage), as_of)
        .groupBy(*keys, (F.weekday(local) * 24 + F.hour(local)).alias("cell"))
        .agg(F.sum("total_tokens").alias("tokens"))
    )
    grid = C.with_grid(cells, keys, "cell", 168, ["tokens"])
    peak = F.max("tokens").over(Window.partitionBy(*keys))
    v = F.col("tokens")
    level = F.when(v == 0, 0)
    for cut, lvl in ((66, 4), (33, 3), (12, 2)):
        level = level.when(v * 100 > F.col("max_cell") * cut, lvl)
    return grid.withColumn("max_cell", peak).select(
        *keys,
        F.call_function("div", F.col("cell"), F.lit(24)).cast("int").alias("weekday"),
        (F.col("cell") % 24).alias("hour"),
        "tokens",
        level.otherwise(1).alias("level"),
        "max_cell",
    )


def cache_efficiency(usage: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    """What cache reads cost and what they saved against the plain input price."""
    read, fresh = F.col("cache_read_tokens"), F.col("input_tokens")
    per_family = C.until(enrich(usage), as_of).groupBy(*keys, "family").agg(F.sum(read).alias("cache_read_tokens"), F.sum(fresh).alias("input_tokens"))
    rate_in, rate_read = P.price_milli("family", "input"), P.price_milli("family", "cache_read")
    out = per_family.groupBy(*keys).agg(
        F.coalesce(F.sum(read), F.lit(0)).alias("cached_tokens"),
        F.coalesce(F.sum(fresh), F.lit(0)).alias("fresh_input_tokens"),
        F.coalesce(F.sum(read * rate_read), F.lit(0)).alias("_on"),
        F.coalesce(F.sum(read * (rate_in - rate_read)), F.lit(0)).alias("_saved"),
    )
    full = F.col("_on") + F.col("_saved")
    return out.select(
        *keys,
        X.ratio("cached_tokens", F.col("cached_tokens") + F.col("fresh_input_tokens"), 4).alias("hit_rate"),
        "cached_tokens",
        "fresh_input_tokens",
        X.usd2("_on").alias("usd_on_cache"),
        X.usd2("_saved").alias("usd_saved"),
        X.ratio("_saved", full, 4).alias("discount_pct"),
        X.usd2(full).alias("full_equiv_usd"),
    )


def top_models(usage: DataFrame, *, as_of=None, keys=(), top: int = 8) -> DataFrame:
    """Most expensive real models with their share of the cost shown."""
    real = _by_model_full(C.until(usage, as_of), keys).where(~F.startswith("model_id", F.lit("<"))).withColumn("cost_e4", X.cost_e4("cost_nano"))
    shown = C.top_n(real, keys, [F.desc("cost_e4"), F.asc("model_id")], top)
    total = F.sum("cost_e4").over(Window.partitionBy(*keys))
    return shown.withColumn("_total", total).select(
        *keys, "model_id", S.model_display("model_id").alias("display"), "messages", "total_tokens",
        X.scaled("cost_e4", 4).alias("cost_usd"), X.ratio("cost_e4", "_total", 4).alias("share"),
    )


def _recent_errors(errors: DataFrame, as_of, hours: int) -> DataFrame:
    return C.since(errors, as_of, hours * 10_000)


def errors_summary(errors: DataFrame, *, as_of, keys=(), lookback_hours: int = 24) -> DataFrame:
    return C.until(errors, as_of).groupBy(*keys).agg(
        F.lit(lookback_hours).alias("lookback_hours"),
        F.expr(f"count_if({C.recent(as_of, lookback_hours * 10_000)})").alias("total"),
        F.count(F.lit(1)).alias("total_lifetime"),
    )


def errors_by_category(errors: DataFrame, *, as_of, keys=(), lookback_hours: int = 24) -> DataFrame:
    out = _recent_errors(errors, as_of, lookback_hours).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*keys))
    out = out.withColumn("share", X.ratio("count", total, 3))
    return out.orderBy(*keys, F.desc("count"), "category")


def errors_by_session(errors: DataFrame, *, as_of, keys=(), lookback_hours: int = 24) -> DataFrame:
    recent = _recent_errors(errors, as_of, lookback_hours).where(F.coalesce("session_id", F.lit("")) != "")
    return recent.groupBy(*keys, "session_id").agg(F.count(F.lit(1)).alias("error_count"))


def errors_recent(errors: DataFrame, *, as_of, keys=(), lookback_hours: int = 24, limit: int = 8) -> DataFrame:
    order = [F.desc("timestamp"), F.asc("session_id"), F.asc("category"), F.asc("snippet")]
    recent = _recent_errors(errors, as_of, lookback_hours)
    return C.top_n(recent, keys, order, limit).select(*keys, "category", "snippet", "session_id", "timestamp")
