"""Rows after as_of change no figure of an operator that answers for that moment."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import NOW, usage
from usagelens.operators import aggregates as A, billing as B, burn as U, efficiency as E, fleet as M, joins as J, normalize as N, status as L, trends as T
from usagelens.sources.side_tables import commits_source

ON_USAGE = [
    A.totals, A.daily, A.by_model, A.by_model_full, A.by_project, A.by_tool, A.tool_labels, A.usage_heatmap, A.cache_efficiency, A.top_models,
    T.daily_anomalies, T.baseline, M.fleet_cache, M.fleet_projects, A.by_session, A.by_device, A.by_device_burn, A.recent_turns, B.billing_windows, B.plan_inference, B.window_baseline, B.current_window, B.block_eta,
    B.burn_rate_zones, B.gauge_zone, T.weekly_cap, T.active_hours, T.daily_burn_rates, T.burn_rate_timeseries, T.forecast, U.burn_rates_by_hours,
    U.burn_by_model, U.recent_costs, U.live_active_models, E.fuel_efficiency, E.trend, M.fleet_daily, M.fleet_recent, L.today_vs_baseline,
]
BY_DEVICE = [M.device_summary, M.device_snapshot, M.live_rows, M.fleet_live, M.fleet_burn_windows, M.fleet_cache, M.fleet_projects]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    ago = [timedelta(minutes=rng.randrange(60_000)) for _ in range(150)] + [timedelta(0), timedelta(minutes=2), timedelta(minutes=40)]
    later = [-timedelta(microseconds=1), -timedelta(minutes=3), -timedelta(hours=7), -timedelta(days=3)]
    made = [
        {"ago": x, "account": f"a{i % 2}", "source": f"agent_{'ab'[i % 2]}", "device": f"d{i % 3}", "session_id": f"s{i % 20}", "input_tokens": 900_000 + i, "output_tokens": 70_000}
        for i, x in enumerate(ago + later)
    ]
    # A key that is not there before as_of.
    made.append({**made[-1], "account": "late", "source": "late", "device": "late", "ago": -timedelta(hours=1)})
    all_rows = usage(spark, made).cache()
    return all_rows, all_rows.where(F.col("timestamp") <= F.lit(NOW))


def same(got, want):
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("op", ON_USAGE, ids=lambda f: f.__name__)
@pytest.mark.parametrize("keys", [[], ["account"]], ids=["all", "account"])
def test_usage(rows, op, keys):
    got, want = rows
    same(op(got, as_of=NOW, keys=keys), op(want, as_of=NOW, keys=keys))


@pytest.mark.parametrize("op", BY_DEVICE, ids=lambda f: f.__name__)
def test_devices(rows, op):
    got, want = rows
    same(op(got, as_of=NOW), op(want, as_of=NOW))


def test_side_tables(spark, rows):
    got, want = rows
    times = [NOW - timedelta(hours=1), NOW, NOW + timedelta(microseconds=1), NOW + timedelta(days=1)]
    at = "timestamp timestamp_ntz, "
    commits = spark.createDataFrame([(t, "/p", f"c{i}", "m", "x") for i, t in enumerate(times)], at + "project_dir string, sha string, message string, author string")
    errors = spark.createDataFrame([(t, f"s{i}", "timeout", "x") for i, t in enumerate(times)], at + "session_id string, category string, snippet string")
    limits = spark.createDataFrame(
        [(t, s, "d0", i, 10 * i, 5 * i, 0, 0) for i, t in enumerate(times) for s in ("agent_a", "agent_b")],
        at + "source string, device string, line_no long, primary_pct long, secondary_pct long, primary_resets_at long, secondary_resets_at long",
    )
    known = [x.where(F.col("timestamp") <= F.lit(NOW)) for x in (commits, errors, limits)]
    ops = [
        lambda u, c, e, q: commits_source(c, as_of=NOW),
        lambda u, c, e, q: J.commit_cost(u, c, as_of=NOW),
        lambda u, c, e, q: E.fuel_efficiency(u, c, as_of=NOW),
        lambda u, c, e, q: J.sessions_with_errors(u, e, as_of=NOW),
        lambda u, c, e, q: A.errors_summary(e, as_of=NOW),
        lambda u, c, e, q: A.errors_by_category(e, as_of=NOW),
        lambda u, c, e, q: A.errors_recent(e, as_of=NOW),
        lambda u, c, e, q: L.status_fields(u, e, as_of=NOW),
        lambda u, c, e, q: L.alert_level(u, q, as_of=NOW),
        lambda u, c, e, q: L.limit_severity(q, as_of=NOW),
        lambda u, c, e, q: N.latest_rate_limits(q, as_of=NOW),
    ]
    for op in ops:
        same(op(got, commits, errors, limits), op(want, *known))
    costs = U.recent_costs(got, as_of=NOW + timedelta(days=4), hours=200)
    same(U.live_burn_rate(costs, as_of=NOW), U.live_burn_rate(costs.where(F.col("minute") <= F.lit(NOW)), as_of=NOW))
