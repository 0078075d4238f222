"""All sections of a report as named DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from usagelens.operators import aggregates as A, billing as B, burn as U, common as C, efficiency as E, joins as J, trends as T
from usagelens.schema import enrich
from usagelens.session import cut_lineage

#: Sections made of the windows, and of the day totals.
ON_WINDOWS = ("windows", "plan_inference", "window_baseline", "current_window", "block_eta", "burn_rate_zones")
ON_DAYS = ("daily", "weekly_cap", "anomalies", "baseline", "forecast")


def build_report(
    usage: DataFrame,
    *,
    as_of,
    keys=(),
    errors: DataFrame | None = None,
    commits: DataFrame | None = None,
    intents: DataFrame | None = None,
    titles: DataFrame | None = None,
    plan: str | None = None,
    sections=None,
) -> dict[str, DataFrame]:
    """Section name -> lazy DataFrame. Persist `usage` before writing many sections. What several of the wanted sections are made
    of, the day totals and the windows, is written once to the shared folder; those sections do not read `usage` again for it."""
    e = enrich(usage)
    p = {"as_of": as_of, "keys": keys}
    known = C.until(e, as_of)

    def base(users, made):
        shared = [name for name in users if sections is None or name in sections]
        return cut_lineage(made()) if len(shared) > 1 else None

    windows = base(ON_WINDOWS, lambda: B.windows_base(known, keys))
    daily = base(ON_DAYS, lambda: A.daily_base(known, keys))
    w, d = {"windows": windows}, {"daily": daily}

    def titled(df):
        return J.enrich_titles(df, titles) if titles is not None else df

    makers = {
        "totals": lambda: A.totals(e, **p),
        "daily": lambda: A.daily(e, **d, **p),
        "by_model": lambda: A.by_model(e, **p),
        "by_model_full": lambda: A.by_model_full(e, **p),
        "by_project": lambda: A.by_project(e, **p),
        "by_session": lambda: A.by_session(e, intents=intents, titles=titles, **p),
        "by_tool": lambda: A.by_tool(e, **p),
        "by_device": lambda: A.by_device(e, **p),
        "by_device_burn": lambda: A.by_device_burn(e, **p),
        "recent_turns": lambda: titled(A.recent_turns(e, **p)),
        "usage_heatmap": lambda: A.usage_heatmap(e, **p),
        "cache_efficiency": lambda: A.cache_efficiency(e, **p),
        "windows": lambda: B.billing_windows(e, last_n=30, **w, **p),
        "plan_inference": lambda: B.plan_inference(e, **w, **p),
        "window_baseline": lambda: B.window_baseline(e, **w, **p),
        "current_window": lambda: B.current_window(e, plan=plan, **w, **p),
        "block_eta": lambda: B.block_eta(e, **w, **p),
        "burn_rate_zones": lambda: B.burn_rate_zones(e, **w, **p),
        "weekly_cap": lambda: T.weekly_cap(e, **d, **p),
        "anomalies": lambda: T.daily_anomalies(e, **d, **p),
        "baseline": lambda: T.baseline(e, **d, **p),
        "daily_burn_rates": lambda: T.daily_burn_rates(e, **p),
        "burn_rate_timeseries": lambda: T.burn_rate_timeseries(e, **p),
        "forecast": lambda: T.forecast(e, **d, **p),
        "burn_rates_by_hours": lambda: U.burn_rates_by_hours(e, **p),
        "burn_by_model": lambda: U.burn_by_model(e, **p),
        "recent_costs": lambda: U.recent_costs(e, **p),
        "live_active_models": lambda: titled(U.live_active_models(e, **p)),
        "fuel_efficiency": lambda: E.fuel_efficiency(e, commits, **p),
        "trend": lambda: E.trend(e, **p),
    }
    if commits is not None:
        makers["commit_cost"] = lambda: J.commit_cost(e, commits, top=12, **p)
        makers["commit_summary"] = lambda: J.commit_summary(J.commit_cost(e, commits, **p), keys=keys)
    if errors is not None:
        makers["errors_summary"] = lambda: A.errors_summary(errors, **p)
        makers["errors_by_category"] = lambda: A.errors_by_category(errors, **p)
        makers["errors_by_session"] = lambda: A.errors_by_session(errors, **p)
        makers["errors_recent"] = lambda: A.errors_recent(errors, **p)
    wanted = list(makers) if sections is None else list(sections)
    return {name: makers[name]() for name in wanted}
