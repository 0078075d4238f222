import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import NOW, minutes, usage
from usagelens.functions import pricing as P
from usagelens.operators import aggregates as A, billing as B, burn as U, fleet as M, joins as J, status as L, trends as T
from usagelens.operators.percentiles import exact_percentiles
from usagelens.plans.anchored import window_starts
from usagelens.plans.carry import carry_forward, running_index
from usagelens.schema import enrich


def test_price_constants(spark):
    m = 1_000_000
    rows = [
        {"model": "claude-sonnet-4-5", "input_tokens": m}, {"model": "claude-opus-4-8", "output_tokens": m},
        {"model": "claude-haiku-4-5", "cache_read_tokens": m}, {"model": "other", "input_tokens": m},
    ]
    got = enrich(usage(spark, rows)).orderBy("line_no").select((F.col("cost_nano") / 1e9).alias("usd")).collect()
    assert [r.usd for r in got] == [3.0, 25.0, 0.1, 0.0]


def test_own_price_table(spark):
    prices = spark.createDataFrame([("opus", 1000, 2000, 100, 1500, 1600)], "family string, " + ", ".join(f"{f} bigint" for f in P.PRICE_FIELDS))
    u = usage(spark, [{"input_tokens": 10, "cache_creation_tokens": 2}, {"model": "claude-sonnet-4-5", "input_tokens": 10}])
    got = P.cost_per_record(u, "1h", prices).orderBy("line_no").collect()
    assert [r.cost_nano for r in got] == [13_200, 0]


def test_effective_tokens_are_exact(spark):
    # Ten cache reads at a tenth of the input price are one token.
    got = enrich(usage(spark, [{"model": "claude-sonnet-4-5", "cache_read_tokens": 10}, {"model": "?", "input_tokens": 3, "output_tokens": 4, "cache_read_tokens": 9}]))
    assert [r.effective_tokens for r in got.orderBy("line_no").collect()] == [1, 7]


def sequential_starts(times):
    starts = []
    for t in sorted(set(times)):
        if not starts or t >= starts[-1] + timedelta(hours=5):
            starts.append(t)
    return starts


@pytest.mark.parametrize("seed", range(4))
def test_anchored_windows_equal_sequential_walk(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for a in range(6):
        t, times = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(90_000)), []
        for _ in range(rng.choice((1, 40, 120))):
            # Exact multiples of five hours, five minutes and cells are the edge cases.
            t += rng.choice((timedelta(hours=5), timedelta(hours=1), timedelta(minutes=5), timedelta(microseconds=1), timedelta(seconds=rng.randrange(30_000)), timedelta(0)))
            times.append(t)
        rows += [{"account": f"a{a}", "timestamp": x, "input_tokens": 1} for x in times]
        want[f"a{a}"] = sequential_starts(times)
    rng.shuffle(rows)
    u = usage(spark, rows).cache()
    us = lambda x: (x - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    for limit in (200_000, 30, 0):             # all folded, some chased, all chased
        got = {}
        for r in window_starts(u, ["account"], fold_limit=limit).collect():
            got.setdefault(r.account, []).append(r.start_us)
        assert {k: sorted(v) for k, v in got.items()} == {k: [us(x) for x in v] for k, v in want.items()}, limit
    wins = B.billing_windows(u, keys=["account"], fold_limit=0).collect()
    assert sum(w.window_tokens for w in wins) == len(rows)


@pytest.mark.parametrize(("seed", "broadcast"), [(0, 20_000), (1, 0), (2, 3)])
def test_commit_cost_by_definition(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(J, "BROADCAST_COMMITS", broadcast)
    rng = random.Random(seed)
    base = NOW - timedelta(days=3)
    commits, rows = [], []
    for p in range(3):
        for i in range(12):
            commits.append((f"/w/p{p}", base + timedelta(minutes=rng.randrange(0, 3000, 5)), f"sha{p}-{i:02d}", "m", "x"))
        for _ in range(200):
            rows.append({"project_dir": f"/w/p{p}", "timestamp": base + timedelta(minutes=rng.randrange(-300, 3000, 5)), "input_tokens": rng.randrange(3), "session_id": f"s{rng.randrange(5)}"})
    # A record belongs to the first commit of its project at or after it, unless that is four hours away or more.
    given = {}
    for r in rows:
        at, sha = min(((c[1], c[2]) for c in commits if c[0] == r["project_dir"] and c[1] >= r["timestamp"]), default=(None, None))
        if sha and at - r["timestamp"] < timedelta(hours=4):
            given.setdefault(sha[:8], []).append(r)
    want = {sha: (sum(r["input_tokens"] for r in rs), len({r["session_id"] for r in rs})) for sha, rs in given.items()}
    want = {sha: v for sha, v in want.items() if v[0]}
    cdf = spark.createDataFrame(commits, "project_dir string, timestamp timestamp_ntz, sha string, message string, author string")
    got = J.commit_cost(usage(spark, rows), cdf, as_of=NOW).collect()
    assert {r.sha: (r.tokens, r.sessions) for r in got} == want


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_commit_cost_of_a_hot_project(spark, monkeypatch, broadcast):
    """All records in one project, half of them in one quarter hour with many commits: no record is sorted."""
    monkeypatch.setattr(J, "BROADCAST_COMMITS", broadcast)
    base = datetime(2024, 5, 14, 9)
    span = "IF(id % 2 = 0, id % 900, id % 86400)"
    rows = spark.range(60_000).selectExpr(
        f"TIMESTAMP_NTZ '{base}' + make_dt_interval(0, 0, 0, {span}) AS timestamp", "'/w/hot' AS project_dir", "concat('s', id % 7) AS session_id", "id % 5 AS total_tokens", "id % 11 * 1000000 AS cost_nano")
    u = rows.selectExpr("*", "'x' AS family", "total_tokens AS billable_tokens", "1L AS effective_tokens", "to_date(timestamp) AS date")
    commits = spark.range(400).selectExpr(
        f"TIMESTAMP_NTZ '{base}' + make_dt_interval(0, 0, 0, IF(id < 300, id * 3, id * 211)) AS timestamp", "'/w/hot' AS project_dir", "concat('c', lpad(id, 6, '0')) AS sha", "'m' AS message", "'a' AS author")
    got = J.commit_cost(u, commits, as_of=base + timedelta(days=2))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan
    at = sorted(r.timestamp for r in commits.collect())
    want = {}
    for r in rows.collect():
        i = bisect.bisect_left(at, r.timestamp)
        if i < len(at) and at[i] - r.timestamp < timedelta(hours=4):
            t, s = want.setdefault(at[i], [0, set()]), r.session_id
            t[0] += r.total_tokens
            t[1].add(s)
    assert {str(r.timestamp): (r.tokens, r.sessions) for r in got.collect()} == {str(k): (v[0], len(v[1])) for k, v in want.items() if v[0]}


def test_exact_percentiles(spark):
    rng = random.Random(1)
    data = {k: [rng.randrange(-10**6, 10**9) if k else 7 for _ in range(n)] for k, n in ((0, 50), (1, 1), (2, 1001))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k int, v bigint")
    for r in exact_percentiles(df, "v", (0, 50, 90, 99, 100), keys=["k"], bucket_bits=8).collect():
        s = sorted(data[r.k])
        for p in (0, 50, 90, 99, 100):
            pos = p * (len(s) - 1)
            lo, fr = pos // 100, pos % 100
            assert r[f"p{p}_x100"] == s[lo] * (100 - fr) + s[min(lo + 1, len(s) - 1)] * fr
        assert r.samples == len(s)


def test_carried_state_across_chunks(spark):
    rng = random.Random(2)
    rows = [(f"f{k}", i, rng.choice((None, None, i))) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, v bigint").withColumn("_chunk", F.floor(F.col("line_no") / 7))
    got = carry_forward(df, ["file"], "_chunk", ["line_no"], upto=["v"]).collect()
    prev = {(r.file, r.line_no): r.v_prev for r in carry_forward(df, ["file"], "_chunk", ["line_no"], ahead=["v"]).collect()}
    state = {}
    for r in sorted(got, key=lambda r: (r.file, r.line_no)):
        assert prev[r.file, r.line_no] == state.get(r.file)
        state[r.file] = r.v if r.v is not None else state.get(r.file)
        assert r.v_carried == state[r.file]
    idx = running_index(df, ["file"], "_chunk", ["line_no"], "idx").collect()
    assert all(r.idx == r.line_no for r in idx)


def test_recent_turns_skip_placeholders(spark):
    rows = [{"ago": timedelta(days=d, minutes=10 * i + 1), "input_tokens": 5000} for d in range(3) for i in range(5)]
    rows += [{"ago": timedelta(seconds=i), "model": "<synthetic>"} for i in range(5)]
    got = A.recent_turns(usage(spark, rows), as_of=NOW, limit=10).collect()
    assert len(got) == 10 and all(r.total_tokens > 0 and not r.model.startswith("<") for r in got)


def test_tool_split_keeps_fractions(spark):
    rows = [{"output_tokens": 10, "tool_names": ["a", "b", "c"]}, {"output_tokens": 11, "tool_names": ["a", "a"]}, {"output_tokens": 5}, {"output_tokens": 100, "tool_names": ["z"] + [f"t{i}" for i in range(11)]}]
    got = {r.tool: (r.calls, r.approx_output_tokens) for r in A.by_tool(usage(spark, rows)).collect()}
    assert got["a"] == (3, 14) and got["b"] == (1, 3) and got["(no tool)"] == (1, 5) and got["z"] == (1, 8)


def test_heatmap_time_zone(spark):
    u = usage(spark, [{"timestamp": datetime(2024, 1, 1, 1, 30), "input_tokens": 7}])      # Monday, 01:30 UTC
    got = [r for r in A.usage_heatmap(u, tz="America/New_York").collect() if r.tokens]
    assert [(r.weekday, r.hour, r.level) for r in got] == [(6, 20, 4)]


def test_anomalous_day_is_flagged(spark):
    rows = [{"timestamp": datetime(2024, 5, d, 9), "input_tokens": 100_000 + d % 3 * 20_000} for d in range(1, 12) if d != 9]
    rows.append({"timestamp": datetime(2024, 5, 9, 9), "input_tokens": 2_000_000})
    got = T.daily_anomalies(usage(spark, rows)).collect()
    assert [str(r.date) for r in got] == ["2024-05-09"] and got[0].flags == "z-score,cost"


def test_billing_window_of_one_record(spark):
    u = usage(spark, [{"ago": minutes(30), "input_tokens": 1000}])
    w = B.current_window(u, as_of=NOW).first()
    assert w.active and w.elapsed_seconds == 1800 and w.remaining_seconds == 16200 and w.projected_close_tokens == 10_000 and w.verdict_kind == "neutral"
    assert not B.current_window(u, as_of=NOW + timedelta(hours=5)).first().active
    # A record after as_of is not known yet.
    assert B.current_window(u, as_of=NOW - timedelta(hours=2)).first() is None or not B.current_window(u, as_of=NOW - timedelta(hours=2)).first().active


def test_no_records(spark):
    u = usage(spark, []).limit(0)
    assert A.totals(u).first().messages == 0
    assert B.current_window(u, as_of=NOW).first().active is False
    assert T.forecast(u, as_of=NOW).first().month_so_far == 0
    assert B.burn_rate_zones(u, as_of=NOW).first().insufficient_history


# --- alerts -----------------------------------------------------------------------------


def level_rows(spark, week_now, usual, source="agent_a", limit=None):
    """Ten quiet weeks of `usual` dollars a day, then one of `week_now` in total."""
    day = lambda n, usd: {"timestamp": NOW - timedelta(days=n, hours=3), "input_tokens": int(usd * 200_000), "source": source}
    rows = [day(n, usual) for n in range(7, 77)] + [day(n, week_now / 7) for n in range(7)]
    schema = "source string, device string, timestamp timestamp_ntz, line_no bigint, primary_pct double, secondary_pct double"
    limits = spark.createDataFrame([(source, "mac", NOW, 1, *limit)] if limit else [], schema)
    return L.alert_level(usage(spark, rows), limits, as_of=NOW).first()


def test_pace_needs_a_week_far_above_the_heaviest(spark):
    r = level_rows(spark, 14_000, 10)
    assert r.level == 2 and r.message.startswith("pace: $14,000 in 7 days")
    r = level_rows(spark, 70, 10)
    assert (r.level, r.message) == (0, "")


def test_limit_beats_pace(spark):
    r = level_rows(spark, 14_000, 10, "agent_b", (96.0, 10.0))
    assert r.level == 3 and "96%" in r.message
    r = level_rows(spark, 14_000, 10, "agent_b", (10.0, 5.0))
    assert r.level == 2 and r.message.startswith("pace")
    assert level_rows(spark, 70, 10, "agent_b", (86.0, 5.0)).level == 2
    # Limits of a source without account limits do not count.
    assert level_rows(spark, 70, 10, "agent_a", (99.0, 99.0)).level == 0


def test_crossings_fire_once_escalate_and_rearm(spark):
    seq = [0, 2, 2, 3, 3, 0, 2, 3, 2, 3]
    df = spark.createDataFrame([("s", NOW + timedelta(hours=5 * i), v) for i, v in enumerate(seq)], "source string, checked_at timestamp_ntz, level int")
    got = L.alert_crossings(df).orderBy("checked_at").collect()
    assert [(r.level, r.previous_level) for r in got] == [(2, 0), (3, 2), (2, 0), (3, 2), (3, 2)]


# --- fleet -------------------------------------------------------------------------------


def test_live_row_age_decides_the_window(spark):
    u = usage(spark, [{"ago": minutes(10), "device": "pc", "input_tokens": 5}, {"ago": minutes(2), "device": "mac", "input_tokens": 5}])
    got = {(r.window_minutes, r.device) for r in M.fleet_live(u, as_of=NOW).collect()}
    assert (5, "pc") not in got and (15, "pc") in got and (5, "mac") in got and (1, "mac") not in got
    old = {(r.window_minutes, r.device) for r in M.fleet_live(usage(spark, [{"ago": minutes(30), "device": "pc"}]), as_of=NOW).collect()}
    assert old == {(60, "pc"), (300, "pc"), (1440, "pc")}
    now = U.live_now(U.live_active_models(usage(spark, [{"ago": timedelta(seconds=50)}, {"ago": timedelta(seconds=150), "device": "pc"}]), as_of=NOW))
    assert [r.device for r in now.collect()] == ["mac"]


def test_fleet_sums_devices(spark):
    read = lambda usd: int(usd / 4.5 * 1_000_000)
    rows = [{"device": "a", "ago": minutes(5), "cache_read_tokens": read(90)}, {"device": "b", "ago": minutes(5), "cache_read_tokens": read(45)}]
    r = M.fleet_cache(usage(spark, rows)).first()
    assert r.usd_saved == 135.0 and r.discount_pct == 0.9
    rows = [{"device": "a", "ago": minutes(5), "input_tokens": 1_400_000}, {"device": "b", "ago": minutes(9), "input_tokens": 800_000}]
    assert M.fleet_daily(usage(spark, rows)).first().cost_usd == 11.0
    combined = {r.window_hours: r.cost_per_hour for r in M.fleet_burn_windows(usage(spark, rows), as_of=NOW).collect()}
    single = {r.window_hours: r.cost_per_hour for r in U.burn_rates_by_hours(usage(spark, rows), as_of=NOW).collect()}
    assert all(abs(combined[w] - single[w]) <= 0.011 for w in single)


def test_snapshot_is_bounded_and_has_no_message_bodies(spark):
    rows = [{"ago": minutes(i), "input_tokens": 10, "project_dir": f"/p{i % 20}", "project_label": f"p{i % 20}", "model": f"claude-opus-4-{i % 9}"} for i in range(14)]
    rows += [{"ago": timedelta(days=i), "input_tokens": 10} for i in range(1, 40)]
    s = M.device_snapshot(usage(spark, rows), as_of=NOW).first()
    assert len(s.recent) == 25 and len(s.live) == 4 and len(s.daily) == 14 and len(s.by_project) <= 12 and len(s.burn_rates_by_hours) == 6
    assert "text" not in s.recent[0].asDict() and [str(d.date) for d in s.daily] == sorted(str(d.date) for d in s.daily)
    assert [r["_age"] for r in s.recent] == sorted(r["_age"] for r in s.recent)
