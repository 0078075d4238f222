"""Windows, baselines, burn rates, forecasts."""

from __future__ import annotations

from checks import views as V
from checks.q_core import burn_rows, rate
from checks.registry import on_usage, reg
from checks.sqlkit import (
    BURN, NOW, TODAY, big, from_us, g, group, idiv, part, pct, q, ratio, rd, sc, sorted_list, tout, ts, us, usd2, usd4,
)
from usagelens.operators import billing as B, burn as U, trends as T

KEYED = (("", []), ("_by_account", ["account"]))


def gsel(keys):
    return "g AS account, " if keys else ""


def close(f):
    return f"({f}::HUGEINT * (el + rem*1000000))"


for sfx, keys in KEYED:
    t = "_acc" if keys else ""
    a = gsel(keys)
    reg("billing_windows" + sfx, on_usage(B.billing_windows, keys=keys), q(
        f"""SELECT {a} {ts('started')} AS started_at, {ts("started + INTERVAL 5 HOUR")} AS ends_at, {ts('last_at')} AS last_activity_at, total_tokens AS window_tokens,
          billable_tokens, array_to_string(models, ',') AS models, {tout()} FROM wins{t}"""))
    reg("plan_inference" + sfx, on_usage(B.plan_inference, keys=keys), q(
        f"SELECT {a} guess, coalesce({idiv('p90x', 100)}, 0) AS p90_window_tokens, {big('len(recent)')} AS samples FROM wstate{t}"))
    reg("window_baseline" + sfx, on_usage(B.window_baseline, keys=keys), q(
        f"SELECT {a} {big('len(b)')} AS samples, billable_p50, billable_p90, {sc('c50',2)} AS cost_p50, {sc('c90',2)} AS cost_p90, billable_p50 AS typical_billable_per_window FROM wstate{t}"))

    lim = "CASE guess WHEN 'pro' THEN 44000 WHEN 'max20' THEN 220000 ELSE 88000 END"
    vn = f"CASE WHEN burning THEN {close('w_bill')} ELSE w_bill END"
    vd = "CASE WHEN burning THEN billable_p50::HUGEINT*el ELSE billable_p50 END"

    def r(f, num, den):
        return f"CASE WHEN burning THEN {rd(f'{f}::HUGEINT*{num}', f'el*{den}')} ELSE 0 END"

    def c(f):
        return f"CASE WHEN burning THEN {big(close(f) + ' // el')} ELSE {f} END"

    fields = {
        "started_at": ts("w_start"), "ends_at": ts("w_start + INTERVAL 5 HOUR"), "elapsed_seconds": big("el // 1000000"),
        "remaining_seconds": big("rem"), "tokens_used": "w_total", "billable_tokens_used": "w_bill", "plan": "guess", "plan_limit": big(lim),
        "utilization": sc(rd("w_total::HUGEINT*10000", lim), 4),
        "burn_tokens_per_min": sc(r("w_total", 600000000, 1), 1), "burn_billable_per_min": sc(r("w_bill", 600000000, 1), 1),
        "projected_close_tokens": c("w_total"), "projected_close_billable": c("w_bill"),
        "projected_overage": big(f"greatest(0, {c('w_total')} - {lim})"),
        "baseline_billable_p50": "billable_p50", "baseline_billable_p90": "billable_p90", "baseline_cost_p50": sc("c50", 2), "baseline_cost_p90": sc("c90", 2),
        "vs_baseline_ratio": f"CASE WHEN billable_p50 > 0 THEN {sc(rd(f'100*({vn})', vd), 2)} END",
        "cost_per_hour": sc(r("w_cost", 3600000000, 100), 2),
        "projected_close_cost": sc(f"CASE WHEN burning THEN {rd(close('w_cost'), 'el*100')} ELSE {rd('w_cost', 100)} END", 2),
        "verdict_kind": f"""CASE WHEN coalesce(billable_p50,0) <= 0 THEN 'neutral' WHEN ({vn}) >= 3*({vd}) THEN 'bad' WHEN 2*({vn}) >= 3*({vd}) THEN 'warn'
          WHEN 2*({vn}) <= ({vd}) THEN 'neutral' ELSE 'good' END""",
        "models": "array_to_string(w_models, ',')", "cost_usd": sc(rd("w_cost", 100), 2),
    }
    # Array columns print as '' and not NULL when joined, on both sides.
    inner = ", ".join(f"CASE WHEN active THEN {v} {'ELSE chr(0)[1:0]' if n == 'models' else ''} END AS {n}" for n, v in fields.items())
    reg("current_window" + sfx, on_usage(B.current_window, keys=keys), q(f"SELECT {a} active, {inner} FROM wprog{t}"))

    eta = []
    for p, col in (("p50", "c50"), ("p90", "c90")):
        ok = f"(burning AND w_cost > 0 AND coalesce({col},0) > 0)"
        past = f"({ok} AND w_cost >= {col}*100)"
        num = f"(({col}*100 - w_cost)::HUGEINT*el)"
        hit = f"({ok} AND w_cost < {col}*100 AND {num} <= w_cost::HUGEINT*rem*1000000)"
        at = from_us(f"({us(NOW)} + {rd(num, 'w_cost')})")
        eta.append(f"{past} AS already_past_{p}, {hit} AS will_hit_{p}, CASE WHEN {hit} THEN {ts(at)} END AS eta_{p}, CASE WHEN {hit} THEN {big(f'{num} // (w_cost::HUGEINT*60000000)')} END AS minutes_to_{p}")
    reg("block_eta" + sfx, on_usage(B.block_eta, keys=keys), q(f"SELECT {a} {', '.join(eta)} FROM wprog{t}"))

    reg("burn_rate_zones" + sfx, on_usage(B.burn_rate_zones, keys=keys), q(
        f"""SELECT {a} {', '.join(f"{sc('z_' + z, 2)} AS {z}" for z in ('typical', 'busy', 'heavy', 'max'))}, coalesce(c90,0) <= 0 AS insufficient_history,
          CASE WHEN coalesce(c90,0) > 0 THEN {sc(rd('w8*100', 8), 2)} END AS blend_ratio, guess AS plan_basis FROM zones{t}"""))
    two = f"(SELECT {keys[0] if keys else '0'} AS gg, coalesce(sum(cost_nano) FILTER (WHERE timestamp >= {NOW} - INTERVAL 2 HOUR),0) AS nano FROM u GROUP BY gg)"
    rc = rd("10000::HUGEINT*nano", "20000::HUGEINT*10000000")
    reg("gauge_zone" + sfx, on_usage(B.gauge_zone, keys=keys), q(
        f"""SELECT {a} {sc('rc', 2)} AS rate, {sc('z_max', 2)} AS gauge_max,
          CASE WHEN rc >= z_heavy THEN 'heavy' WHEN rc >= z_busy THEN 'busy' WHEN rc >= z_typical THEN 'above normal' ELSE 'calm' END AS zone,
          CASE WHEN rc >= z_heavy THEN 'bad' WHEN rc >= z_typical THEN 'warn' ELSE 'good' END AS kind
          FROM (SELECT *, {rc} AS rc FROM zones{t} JOIN {two} ON gg = g)"""))

    k = g(keys)
    reg("weekly_cap" + sfx, on_usage(T.weekly_cap, keys=keys), q(
        f"""SELECT {k} {sc(rd('now_e4', 100), 2)} AS rolling_7day_cost, {sc(rd('prev_e4', 100), 2)} AS prev_7day_cost, {ratio('(now_e4-prev_e4)*100', 'prev_e4', 1)} AS delta_pct,
          {sc(rd('p95', 10000), 2)} AS p95_7row_cost, {sc(rd('med', 10000), 2)} AS median_7row_cost, {big('len(hist)')} AS samples, {ratio('now_e4*10000', 'p95', 1)} AS pct_of_p95,
          CASE WHEN p95 > 0 AND now_e4*10000 >= 100*p95 THEN 'bad' WHEN p95 > 0 AND now_e4*10000 >= 75*p95 THEN 'warn' ELSE 'good' END AS verdict_kind,
          CASE WHEN p95 > 0 AND now_e4*10000 >= 100*p95 THEN 'heaviest' WHEN p95 > 0 AND now_e4*10000 >= 75*p95 THEN 'near heaviest'
            WHEN p95 > 0 AND now_e4*10000 >= 40*p95 THEN 'typical' ELSE 'low' END AS verdict FROM cap{t}"""))
    reg("daily_anomalies" + sfx, on_usage(T.daily_anomalies, keys=keys), q(
        f"""SELECT {k} CAST(date AS VARCHAR) AS date, total_tokens AS tokens, {sc('cost_e4', 4)} AS cost_usd, floor(z*100+0.5)/100.0 AS z_score, {ratio('2*cost_e4', 'm2', 2)} AS cost_ratio,
          concat_ws(',', CASE WHEN z >= 2.0 THEN 'z-score' END, CASE WHEN 2*cost_e4 >= 2*m2 THEN 'cost' END) AS flags
          FROM (SELECT *, (n*total_tokens::HUGEINT - s)::DOUBLE / CASE WHEN n*sq - s*s > 0 THEN sqrt((n*sq - s*s)::DOUBLE) ELSE n::DOUBLE END AS z,
              CASE WHEN med2 > 0 THEN med2 ELSE 200 END AS m2
            FROM (SELECT *, count(*) OVER w AS n, sum(total_tokens) OVER w AS s, sum(total_tokens::HUGEINT*total_tokens) OVER w AS sq, ({pct('list_sort(list(cost_e4) OVER w)', 50)}) // 50 AS med2
              FROM daily{t} WINDOW w AS ({part(keys)} ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) WHERE n >= 3)
          WHERE z >= 2.0 OR cost_e4 >= m2"""))
    reg("baseline" + sfx, on_usage(T.baseline, keys=keys), q(
        f"""SELECT {k} {big('len(c)')} AS samples, {', '.join(f"{sc(rd(pct('c', p), 100), 4)} AS cost_p{p}, {big(f'({pct("t", p)}) // 100')} AS tokens_p{p}" for p in (50, 90, 99))}
          FROM (SELECT {k} {sorted_list('cost_e4')} AS c, {sorted_list('total_tokens')} AS t FROM daily{t} {group(keys)})"""))
    reg("active_hours" + sfx, on_usage(T.active_hours, keys=keys), q(
        f"""SELECT {k} {sc(rd('n*10', 12), 1)} AS active_hours, days AS active_days, {usd2('nano')} AS cost_usd, {sc(rd('nano::HUGEINT*12', 'n::HUGEINT*10000000'), 2)} AS cost_per_hour,
          {sc(rd('n*10', '12*days'), 1)} AS hours_per_active_day
          FROM (SELECT {k} count(DISTINCT {us('timestamp')} // 300000000) AS n, count(DISTINCT date) AS days, sum(cost_nano) AS nano FROM u WHERE timestamp >= {NOW} - INTERVAL 7 DAY {group(keys)})"""))
    reg("daily_burn_rates" + sfx, on_usage(T.daily_burn_rates, keys=keys), q(
        f"""SELECT {k} CAST(date AS VARCHAR) AS date, {usd2('nano')} AS cost_usd, {sc(rd('n*100', 12), 2)} AS active_hours, {sc(rd('nano::HUGEINT*12', 'n::HUGEINT*10000000'), 2)} AS cost_per_hour, tokens
          FROM (SELECT {k} date, count(DISTINCT {us('timestamp')} // 300000000) AS n, sum(cost_nano) AS nano, sum(total_tokens)::BIGINT AS tokens FROM u WHERE date >= {TODAY} - 90 {group(keys, 'date')})"""))
    frame = f"(SELECT DISTINCT {', '.join(keys)} FROM u)" if keys else "(SELECT 0 AS one)"
    on = " AND ".join([f"f.{x} = b.{x}" for x in keys] + ["b.w = wd.w", "b.bar = bb.bar"])
    series = f"""SELECT {''.join(f'f.{x}, ' for x in keys)} wd.w AS width_hours, bb.bar AS bar, coalesce(nano, 0) AS nano, coalesce(tokens, 0) AS tokens, coalesce(records, 0) AS records
      FROM {frame} f CROSS JOIN (SELECT unnest([1,4,6,12,24])::BIGINT AS w) wd CROSS JOIN (SELECT range AS bar FROM range(120)) bb
      LEFT JOIN (SELECT {k} w, least(({us('timestamp')} - ({us(NOW)} - w*120*3600000000)) // (w*3600000000), 119) AS bar, sum(cost_nano) AS nano, sum(total_tokens)::BIGINT AS tokens, count(*) AS records
        FROM u CROSS JOIN (SELECT unnest([1,4,6,12,24])::BIGINT AS w) WHERE timestamp <= {NOW} AND {us('timestamp')} >= {us(NOW)} - w*120*3600000000 {group(keys, 'w', '2' if not keys else '3')}) b ON {on}"""
    wrate = sc(rd("nano", "width_hours*10000000"), 2)
    reg("burn_rate_timeseries" + sfx, on_usage(T.burn_rate_timeseries, keys=keys), q(
        f"""SELECT {k} width_hours, bar, {ts(from_us(f"{us(NOW)} - (120-bar)*width_hours*3600000000"))} AS start, {ts(from_us(f"{us(NOW)} - (119-bar)*width_hours*3600000000"))} AS "end",
          {usd4('nano')} AS cost, tokens, records, {wrate} AS cost_per_hour FROM ({series})"""))
    if not keys:
        reg("moving_average", lambda spark, sf: T.moving_average(T.burn_rate_timeseries(V.usage(spark, sf), as_of=V.AS_OF), n=7), q(
            f"""SELECT width_hours, bar, {sc('cents', 2)} AS cost_per_hour, {sc(rd('100*(sum(cents) OVER w)', 'count(*) OVER w'), 4)} AS moving_average
              FROM (SELECT width_hours, bar, {rd('nano', 'width_hours*10000000')} AS cents FROM ({series})) WINDOW w AS (PARTITION BY width_hours ORDER BY bar ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""))

    nano2 = f"(SELECT {k} coalesce(sum(cost_nano) FILTER (WHERE timestamp >= {NOW} - INTERVAL 2 HOUR),0) AS nano, 20000 AS h FROM u {group(keys)}) b"
    join = f"JOIN {nano2} USING ({keys[0]})" if keys else f"CROSS JOIN {nano2}"
    d2 = "172800000000::HUGEINT"
    reg("forecast" + sfx, on_usage(T.forecast, keys=keys), q(
        f"""SELECT {k} {rate()} AS burn_rate_per_hour_recent, {sc(rd('today_e4', 100), 2)} AS today_so_far, {sc(rd(f'(t2::HUGEINT*left_us + today_e4::HUGEINT*{d2})', f'({d2}*100)'), 2)} AS today_projected_eod,
          {sc(rd('t2::HUGEINT*left_us', f'({d2}*100)'), 2)} AS today_remaining_projection, {sc(rd('left_us*10', 3600000000), 1)} AS today_hours_left,
          {sc(rd('week_e4', 100), 2)} AS week_so_far, {sc(rd('(2*week_e4 + t2*wleft)', 200), 2)} AS week_projected_eow, {sc(rd('t2*wleft', 200), 2)} AS week_remaining_projection, {big('wleft')} AS week_days_left,
          {sc(rd('t2', 200), 2)} AS typical_daily, {sc(rd('month_e4', 100), 2)} AS month_so_far, {sc(rd('(2*month_e4 + t2*mleft)', 200), 2)} AS month_projected_eom,
          {sc(rd('t2*mleft', 200), 2)} AS month_remaining_projection, {big('mleft')} AS month_days_left FROM fc{t} {join}"""))
    reg("burn_rates_by_hours" + sfx, on_usage(U.burn_rates_by_hours, keys=keys), q(f"SELECT {k} window_hours, {rate()} AS cost_per_hour FROM ({burn_rows(keys)})"))
    reg("burn_by_model" + sfx, on_usage(U.burn_by_model, keys=keys), q(
        f"""SELECT {k} window_hours, model_id, {usd2('nano')} AS cost_total, {rate()} AS cost_per_hour, {ratio('nano', 'total', 3)} AS share
          FROM (SELECT *, sum(nano) OVER (PARTITION BY {k} window_hours) AS total FROM ({burn_rows([*keys, 'model_id'])})) WHERE 10000*nano >= h::BIGINT*10000000"""))
    reg("recent_costs" + sfx, on_usage(U.recent_costs, keys=keys), q(
        f"SELECT {k} {ts('minute')} AS minute, {usd4('sum(cost_nano)')} AS cost FROM (SELECT *, date_trunc('minute', timestamp) AS minute FROM u WHERE timestamp >= {NOW} - INTERVAL 6 HOUR) {group(keys, 'minute')}"))

MINUTES = (1, 5, 15, 60, 300, 1440)
reg(
    "live_burn_rate",
    lambda spark, sf: U.live_burn_rate(U.recent_costs(V.usage(spark, sf), as_of=V.AS_OF), as_of="2024-01-30 18:07:30", hours="1"),
    q(f"""SELECT '1' AS window_hours, {sc(rd('100*sum(e4)', 10000), 2)} AS cost_per_hour FROM (SELECT date_trunc('minute', timestamp) AS minute, (sum(cost_nano)+50000)//100000 AS e4
      FROM u WHERE timestamp >= {NOW} - INTERVAL 6 HOUR GROUP BY minute) WHERE minute >= TIMESTAMP '2024-01-30 18:07:30' - INTERVAL 1 HOUR"""),
)


def live_sql(minutes, extra=""):
    return " UNION ALL ".join(
        f"""SELECT {m}::BIGINT AS window_minutes, model_id, device, arg_max(project_label, (timestamp, event_id)) AS project, arg_max(project_dir, (timestamp, event_id)) AS project_dir,
          arg_max(session_id, (timestamp, event_id)) AS session_id, sum(billable_tokens)::BIGINT AS billable_tokens_recent, {rd('sum(billable_tokens)', m)} AS tokens_per_min, count(*) AS messages,
          {usd2('sum(cost_nano)')} AS cost_recent, {sc(rd('sum(cost_nano)*60', m * 10_000_000), 2)} AS cost_per_hour, {ts('max(timestamp)')} AS last_seen,
          {big(f"({us(NOW)} - {us('max(timestamp)')}) // 1000000")} AS seconds_since_last FROM u WHERE timestamp >= {NOW} - INTERVAL {m} MINUTE {extra} GROUP BY model_id, device"""
        for m in minutes
    )


reg("live_active_models", on_usage(U.live_active_models), q(live_sql(MINUTES)))
reg(
    "live_now",
    lambda spark, sf: U.live_now(U.live_active_models(V.usage(spark, sf), as_of=V.AS_OF)),
    q(f"SELECT * FROM ({live_sql([5], chr(65) + 'ND model_id NOT LIKE ' + repr('<%'))}) WHERE seconds_since_last < 120"),
)
