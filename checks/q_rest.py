"""Errors, joins, efficiency, status, fleet, sinks, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import loglines as L, views as V
from checks.q_core import CACHE, CACHE_OUT, SESSIONS, burn_rows, rate
from checks.q_sources import ASSISTANT, FILE
from checks.q_time import live_sql
from checks.registry import on_usage, reg
from checks.sqlkit import (
    NOW, TODAY, big, cte, from_us, hit, idiv, pct, q, ratio, rd, sc, sorted_list, tout, ts, tsums, us, usd2, usd4,
)
from usagelens.operators import (
    aggregates as A, billing as B, efficiency as E, fleet as M, joins as J, normalize as N, status as L_, trends as T,
)
from usagelens.session import shared_dir
from usagelens.sources import agent_a as SA, sinks as SK
from usagelens.streaming import alert_stream as RA, burn_stream as RB, usage_stream as RU

AS_OF = V.AS_OF


def errors(spark, sf):
    return N.with_category(V.view(spark, sf, "error_texts"))


def commits(spark, sf):
    return V.view(spark, sf, "commits")


def limits(spark, sf):
    v = V.view(spark, sf, "rate_limits")
    reset = "unix_seconds(CAST(timestamp AS TIMESTAMP)) + event_id % 18000"
    return v.withColumns({
        "line_no": F.col("event_id"), "source": F.lit("agent_b"),
        "primary_resets_at": F.expr(reset), "secondary_resets_at": F.expr(f"CASE WHEN event_id % 3 = 0 THEN 0 ELSE {reset} + 86400 END"),
    })


cte("limits_known", f"SELECT * FROM rate_limits WHERE timestamp <= {NOW}")

# --- errors ------------------------------------------------------------------------------

DAY = f"timestamp >= {NOW} - INTERVAL 24 HOUR"
reg("errors_summary", lambda s, d: A.errors_summary(errors(s, d), as_of=AS_OF), q(f"SELECT 24::BIGINT AS lookback_hours, count(*) FILTER (WHERE {DAY}) AS total, count(*) AS total_lifetime FROM error_rows"))
reg(
    "errors_by_category",
    lambda s, d: A.errors_by_category(errors(s, d), as_of=AS_OF),
    q(f"SELECT category, n AS count, {ratio('n', 'sum(n) OVER ()', 3)} AS share FROM (SELECT category, count(*) AS n FROM error_rows WHERE {DAY} GROUP BY category)"),
)
reg("errors_by_session", lambda s, d: A.errors_by_session(errors(s, d), as_of=AS_OF), q(f"SELECT session_id, count(*) AS error_count FROM error_rows WHERE {DAY} GROUP BY session_id"))
reg(
    "errors_recent",
    lambda s, d: A.errors_recent(errors(s, d), as_of=AS_OF),
    q(f"SELECT category, substr(text, 1, 160) AS snippet, session_id, {ts('timestamp')} AS timestamp FROM error_rows WHERE {DAY} ORDER BY error_rows.timestamp DESC, session_id, category, snippet LIMIT 8"),
)

# --- joins --------------------------------------------------------------------------------

# Intervals (previous commit, commit], cut at four hours; one commit per project and instant.
cte("spans", f"""SELECT *, greatest(coalesce(lag(timestamp) OVER (PARTITION BY project_dir ORDER BY timestamp), TIMESTAMP '1970-01-01'), timestamp - INTERVAL 4 HOUR) AS lo
  FROM (SELECT project_dir, timestamp, min(sha) AS sha, arg_min(message, sha) AS message, arg_min(author, sha) AS author FROM commits WHERE timestamp >= {NOW} - INTERVAL 14 DAY AND timestamp <= {NOW} GROUP BY project_dir, timestamp)""")
cte("matched", """SELECT *, (nano+50000)//100000 AS e4 FROM (SELECT s.project_dir, s.timestamp, any_value(s.sha) AS sha, any_value(s.message) AS message, any_value(s.author) AS author,
    sum(u.total_tokens)::BIGINT AS tokens, sum(u.cost_nano) AS nano, count(DISTINCT u.session_id) AS sessions
  FROM spans s JOIN u ON u.project_dir = s.project_dir AND u.timestamp > s.lo AND u.timestamp <= s.timestamp GROUP BY s.project_dir, s.timestamp) WHERE tokens > 0""")
COMMIT = f"SELECT project_dir, string_split(project_dir, '/')[-1] AS project_label, substr(sha, 1, 8) AS sha, {ts('timestamp')} AS timestamp, message, author, tokens, {sc('e4', 4)} AS cost_usd, sessions FROM matched"
reg("commit_cost", lambda s, d: J.commit_cost(V.usage(s, d), commits(s, d), as_of=AS_OF), q(COMMIT))
reg("commit_cost_top", lambda s, d: J.commit_cost(V.usage(s, d), commits(s, d), as_of=AS_OF, top=12), q(f"SELECT * FROM ({COMMIT}) ORDER BY cost_usd DESC, sha, project_dir LIMIT 12"))
cte("commit_stats", f"SELECT {rd('sum(e4)', 'count(*)')} AS mean_e4, count(*) AS n, count(DISTINCT project_dir) AS projects, {sorted_list('e4')} AS costs, {sorted_list('tokens')} AS toks FROM matched")
reg(
    "commit_summary",
    lambda s, d: J.commit_summary(J.commit_cost(V.usage(s, d), commits(s, d), as_of=AS_OF)),
    q(f"SELECT {sc(rd(pct('costs', 50), 100), 4)} AS median_cost_usd, {idiv(pct('toks', 50), 100)} AS median_tokens, {sc('mean_e4', 4)} AS mean_cost_usd, n AS total_commits_matched, projects AS projects_matched FROM commit_stats"),
)
TURNS3 = f"""SELECT *, row_number() OVER (PARTITION BY account ORDER BY last_ts DESC, turn_id) AS rn FROM (SELECT account, turn_id, {tsums()}, max(timestamp) AS last_ts FROM u WHERE model <> '' AND model NOT LIKE '<%' GROUP BY account, turn_id)"""
reg(
    "enrich_titles",
    lambda s, d: J.enrich_titles(
        A.recent_turns(V.usage(s, d), as_of=AS_OF, keys=["account"], limit=3).select("account", "turn_id", "timestamp", "total_tokens", "cost_usd"),
        V.view(s, d, "chat_titles_raw"), keys=["account"]),
    q(f"SELECT t.account, turn_id, {ts('last_ts')} AS timestamp, total_tokens, {usd4('cost_nano')} AS cost_usd, c.title AS chat FROM ({TURNS3}) t LEFT JOIN chat_titles_raw c ON c.account = t.account WHERE rn <= 3"),
)
reg(
    "sessions_with_errors",
    lambda s, d: J.sessions_with_errors(V.usage(s, d), errors(s, d), as_of=AS_OF).select("session_id", "total_tokens", "cost_usd", "error_count"),
    q(f"SELECT session_id, total_tokens, cost_usd, coalesce(n, 0) AS error_count FROM ({SESSIONS}) LEFT JOIN (SELECT session_id, count(*) AS n FROM error_rows WHERE {DAY} GROUP BY session_id) USING (session_id)"),
)

# --- efficiency -----------------------------------------------------------------------------

C7, C30 = f"({TODAY} - 7)", f"({TODAY} - 30)"


def hours_sql(p, where):
    return f"SELECT count(DISTINCT {us('timestamp')} // 300000000) AS {p}n, count(DISTINCT date) AS {p}d, coalesce(sum(cost_nano), 0) AS {p}c FROM u WHERE {where}"


cte("fuel", f"""SELECT *, {rd('h_c::HUGEINT*12', 'h_n::HUGEINT*10000000')} AS you_c, coalesce({rd('b_c::HUGEINT*12', 'b_n::HUGEINT*10000000')}, 0) AS anchor_c,
    coalesce({rd('h_n*10', '12*h_d')}, 0) AS h_hpd, coalesce({rd('b_n*10', '12*b_d')}, 0) AS b_hpd
  FROM (SELECT (cost_nano+50000)//100000 AS e4, messages, {rd('cache_read_tokens::HUGEINT*10000', '(cache_read_tokens+input_tokens+cache_creation_tokens)')} AS hit_e4 FROM (SELECT {tsums()} FROM u))
  CROSS JOIN ({hours_sql('h_', f"timestamp >= {NOW} - INTERVAL 7 DAY")}) CROSS JOIN ({hours_sql('b_', f"timestamp >= {NOW} - INTERVAL 23 DAY AND date < {C7} AND date >= {C30}")})
  CROSS JOIN (SELECT coalesce(sum(cost_e4) FILTER (WHERE date >= {C7}), 0) AS rs, count(*) FILTER (WHERE date >= {C7}) AS rn, coalesce(sum(cost_e4) FILTER (WHERE date < {C7} AND date >= {C30}), 0) AS ps,
    count(*) FILTER (WHERE date < {C7} AND date >= {C30}) AS pn, {sorted_list('cost_e4', f'date >= {C30}')} AS dc FROM daily WHERE cost_e4 >= 5000) CROSS JOIN commit_stats""")
cte("fuel2", f"""SELECT *, CASE WHEN anchor_c > 0 THEN {rd('anchor_c*7', 10)} ELSE 400 END AS lo, CASE WHEN anchor_c > 0 THEN {rd('anchor_c*13', 10)} ELSE 1200 END AS hi, CASE WHEN anchor_c > 0 THEN {rd('anchor_c*20', 10)} ELSE 2500 END AS hv FROM fuel""")
cte("fuel3", f"""SELECT *, CASE WHEN h_n < 6 OR anchor_c <= 0 THEN 'neutral' WHEN you_c < hi THEN 'good' WHEN you_c < hv THEN 'warn' ELSE 'bad' END AS hk,
  CASE WHEN hit_e4 >= 7000 THEN 'good' WHEN hit_e4 >= 4000 THEN 'warn' ELSE 'bad' END AS ck, CASE WHEN e4 <= messages*5000 THEN 'good' WHEN e4 < messages*10000 THEN 'warn' ELSE 'bad' END AS tk FROM fuel2""")
NUL = "NULL::DOUBLE"
# round(0.9 * (n - 1)) with ties to even, zero-based.
RANK = "((9*(len(dc)-1))//10 + CASE WHEN (9*(len(dc)-1))%10 > 5 OR ((9*(len(dc)-1))%10 = 5 AND ((9*(len(dc)-1))//10)%2 = 1) THEN 1 ELSE 0 END)"


def fuel_row(metric, you, low, high, heavy, samples, verdict, note="NULL::VARCHAR"):
    return f"SELECT '{metric}' AS metric, {you} AS you, {low} AS band_low, {high} AS band_high, {heavy} AS band_heavy, {big(samples)} AS samples, {verdict} AS verdict, {note} AS note FROM fuel3"


FUEL = [
    fuel_row("per_active_hour", sc("you_c", 2), sc("lo", 2), sc("hi", 2), sc("hv", 2), "h_n", "hk"),
    fuel_row("per_active_day", sc(f"coalesce({rd('rs', 'rn*100')}, 0)", 2), NUL, sc(f"CASE WHEN pn >= 3 THEN {rd('ps', 'pn*100')} ELSE 0 END", 2),
             sc(f"CASE WHEN len(dc) >= 5 THEN {rd(f'dc[{RANK}+1]', 100)} ELSE 0 END", 2), "rn",
             "CASE WHEN rn = 0 OR pn < 3 THEN 'neutral' WHEN 10*rs*pn < 13*ps*rn THEN 'good' WHEN rs*pn < 2*ps*rn THEN 'warn' ELSE 'bad' END"),
    fuel_row("per_commit", sc(rd("mean_e4", 100), 2), NUL, sc(rd(rd(pct("costs", 50), 100), 100), 2), NUL, "n", "'neutral'", "CASE WHEN n < 3 THEN 'too few commits' ELSE 'no comparison' END"),
    fuel_row("cache_hit_rate", sc("hit_e4", 4), "0.4::DOUBLE", "0.7::DOUBLE", "0.85::DOUBLE", "messages", "ck"),
    fuel_row("per_turn", sc(rd("e4", "messages"), 4), "0.1::DOUBLE", "0.5::DOUBLE", NUL, "messages", "tk"),
    fuel_row("hours_per_active_day", sc("h_hpd", 1), NUL, sc("b_hpd", 1), NUL, "h_d", "'neutral'"),
    fuel_row("headline", NUL, NUL, NUL, NUL, "messages",
             "CASE WHEN ck = 'good' AND tk = 'good' AND hk IN ('warn','bad') AND h_hpd >= 60 THEN 'good' WHEN ck = 'good' AND tk = 'good' AND hk NOT IN ('warn','bad') THEN 'good' WHEN NOT (ck = 'good' AND tk = 'good') AND hk IN ('warn','bad') THEN 'bad' WHEN NOT (ck = 'good' AND tk = 'good') THEN 'warn' ELSE 'neutral' END",
             "CASE WHEN ck = 'good' AND tk = 'good' AND hk IN ('warn','bad') AND h_hpd >= 60 THEN 'heavy use, efficient' WHEN ck = 'good' AND tk = 'good' AND hk NOT IN ('warn','bad') THEN 'efficient, usual volume' WHEN NOT (ck = 'good' AND tk = 'good') AND hk IN ('warn','bad') THEN 'high spend, high unit cost' WHEN NOT (ck = 'good' AND tk = 'good') THEN 'unit cost could drop' ELSE 'inconclusive' END"),
]
reg("fuel_efficiency", lambda s, d: E.fuel_efficiency(V.usage(s, d), commits(s, d), as_of=AS_OF), q(" UNION ALL ".join(FUEL)))

for _sfx, _k in (("", ""), ("_by_account", "account")):
    _t, _g, _gb = ("daily_acc", "account, ", "GROUP BY account") if _k else ("daily", "", "")
    _j = "USING (account)" if _k else "ON true"
    _base = f"""(SELECT {_g} coalesce(sum(cost_e4) FILTER (WHERE cost_e4 >= 5000 AND date >= {C7}), 0) AS rs, count(*) FILTER (WHERE cost_e4 >= 5000 AND date >= {C7}) AS rn,
        coalesce(sum(cost_e4) FILTER (WHERE cost_e4 >= 5000 AND date < {C7} AND date >= {C30}), 0) AS ps, count(*) FILTER (WHERE cost_e4 >= 5000 AND date < {C7} AND date >= {C30}) AS pn FROM {_t} {_gb}) a
      JOIN (SELECT {_g} {', '.join(f"coalesce(sum({v}) FILTER (WHERE {w}), 0)::HUGEINT AS {p}{n}" for p, w in (('r_', f'date >= {C7}'), ('p_', f'date < {C7} AND date >= {C30}')) for n, v in (('read', 'cache_read_tokens'), ('side', 'cache_read_tokens+input_tokens+cache_creation_tokens')))} FROM u {_gb}) b {_j}"""

    def _dir(n, d, k):
        return f"CASE WHEN {n}*{k} > {d} THEN 'up' WHEN {n}*{k} < -({d}) THEN 'down' ELSE 'flat' END"

    _dn, _pn, _dh, _bd = "(rs*pn - ps*rn)", "(ps*rn)", "(r_read*p_side - p_read*r_side)", "(r_side*p_side)"
    reg("trend" + _sfx, on_usage(E.trend, keys=[_k] if _k else []), q(
        f"""SELECT {_g} 'daily_cost' AS metric, {sc(rd('rs', 'rn*100'), 2)} AS recent, {sc(rd('ps', 'pn*100'), 2)} AS prior, {sc(rd(f'{_dn}*1000', _pn), 1)} AS delta_pct, {_dir(_dn, _pn, 20)} AS direction FROM {_base} WHERE rn > 0 AND pn > 0
        UNION ALL SELECT {_g} 'cache_hit_rate', {ratio('r_read', 'r_side', 4)}, {ratio('p_read', 'p_side', 4)}, {sc(rd(f'{_dh}*1000', _bd), 1)}, {_dir(_dh, _bd, 100)} FROM {_base} WHERE r_read > 0 AND p_read > 0"""))

# --- status ------------------------------------------------------------------------------------

# The window chain, caps and forecasts once more, per source.
cte("daily_src", f"SELECT *, (cost_nano+50000)//100000 AS cost_e4 FROM (SELECT source, date, {tsums()} FROM u GROUP BY source, date)")
reg(
    "limit_severity",
    lambda s, d: L_.limit_severity(limits(s, d), as_of=AS_OF),
    q(f"""SELECT device, "limit", used_pct, CASE WHEN used_pct >= 90 THEN 'bad' WHEN used_pct >= 70 THEN 'warn' ELSE 'good' END AS severity,
        CASE WHEN reset_at = 0 THEN '' WHEN rest >= 3600 THEN (rest // 3600) || 'h ' || (rest % 3600 // 60) || 'm' ELSE (rest // 60) || 'm' END AS resets_in
      FROM (SELECT *, greatest(reset_at - {us(NOW)} // 1000000, 0) AS rest FROM (
        SELECT device, 'primary' AS "limit", primary_pct AS used_pct, {us('timestamp')} // 1000000 + event_id % 18000 AS reset_at FROM limits_known QUALIFY row_number() OVER (PARTITION BY device ORDER BY timestamp DESC, event_id DESC) = 1
        UNION ALL SELECT device, 'secondary', secondary_pct, CASE WHEN event_id % 3 = 0 THEN 0 ELSE {us('timestamp')} // 1000000 + event_id % 18000 + 86400 END FROM limits_known QUALIFY row_number() OVER (PARTITION BY device ORDER BY timestamp DESC, event_id DESC) = 1))"""),
)
BUDGET = "1 + (c_custkey * 37) % 90"


def budgets(spark, sf):
    return V.raw(spark, sf, "customer").selectExpr("concat('u', c_custkey) AS account", f"CAST(({BUDGET}) / 4.0 AS DOUBLE) AS budget_usd")


_so, _eom = rd("month_e4", 100), rd("(2*month_e4 + t2*mleft)", 200)
reg(
    "budget_status",
    lambda s, d: L_.budget_status(V.usage(s, d), budgets(s, d), as_of=AS_OF, keys=["account"]),
    q(f"""SELECT account, {sc('b', 2)} AS budget_usd, {sc('so', 2)} AS month_so_far, {sc('eom', 2)} AS month_projected_eom, {ratio('so*100', 'b', 1)} AS used_pct, {ratio('eom*100', 'b', 1)} AS projected_pct,
        {sc('(eom - b)', 2)} AS over_usd, CASE WHEN eom > b THEN 'bad' WHEN 10*so > 9*b THEN 'warn' ELSE 'good' END AS kind, {big('mleft')} AS days_left,
        {sc(f"CASE WHEN mleft > 0 THEN {rd('greatest(eom - so, 0)', 'mleft')} ELSE 0 END", 2)} AS daily_rate
      FROM (SELECT account, mleft, {_so} AS so, {_eom} AS eom FROM fc_acc) JOIN (SELECT 'u' || c_custkey AS account, ({BUDGET}) * 25 AS b FROM customer) USING (account)"""),
)
_tv = "CASE WHEN t IS NULL THEN 'no activity' WHEN n < 3 THEN 'no baseline' WHEN t > p90 THEN 'high' WHEN p50 > 0 AND 2*t >= 3*p50 THEN 'elevated' WHEN p50 <= 0 OR 2*t <= p50 THEN 'light' ELSE 'normal' END"
for _sfx, _t, _g, _gb in (("", "daily", "", ""), ("_by_account", "daily_acc", "account, ", "GROUP BY account")):
    reg("today_vs_baseline" + _sfx, on_usage(L_.today_vs_baseline, keys=["account"] if _g else []), q(
        f"""SELECT {_g} n AS samples, {sc('t', 4)} AS today_cost, {sc('p50', 4)} AS cost_p50, {sc('p90', 4)} AS cost_p90, CASE WHEN p50 > 0 THEN {sc(rd('t*100', 'p50'), 2)} ELSE 0.0::DOUBLE END AS ratio, {_tv} AS verdict
          FROM (SELECT *, {rd(pct('c', 50), 100)} AS p50, {rd(pct('c', 90), 100)} AS p90 FROM (SELECT {_g} count(*) AS n, sum(cost_e4) FILTER (WHERE date = {TODAY}) AS t, {sorted_list('cost_e4')} AS c FROM {_t} {_gb}))"""))


def levels(spark, sf):
    v = V.view(spark, sf, "rate_limits")
    used = F.greatest("primary_pct", "secondary_pct")
    return v.select(F.lit("agent_b").alias("source"), "device", F.col("timestamp").alias("checked_at"), F.col("event_id").alias("tie"), L_.limit_level(used).alias("level"))


LEVELS = "SELECT device, timestamp, event_id, CASE WHEN greatest(primary_pct, secondary_pct) >= 95 THEN 3 WHEN greatest(primary_pct, secondary_pct) >= 85 THEN 2 ELSE 0 END::BIGINT AS level FROM rate_limits"
CROSS = f"""SELECT device, {ts('timestamp')} AS checked_at, event_id AS tie, level, prev AS previous_level FROM (SELECT *, lag(level) OVER (PARTITION BY device ORDER BY timestamp, event_id) AS prev FROM ({LEVELS}))
  WHERE level >= 2 AND level > coalesce(prev, 0)"""
reg("alert_crossings", lambda s, d: L_.alert_crossings(levels(s, d), keys=["device"], order=["checked_at", "tie"]).drop("source"), q(CROSS))

STATUS = f"""SELECT CASE WHEN rc >= z_heavy THEN 'heavy' WHEN rc >= z_busy THEN 'busy' WHEN rc >= z_typical THEN 'typical' ELSE 'calm' END AS verdict, active_model, {sc('rc', 2)} AS burn_rate_per_hour,
  CASE WHEN active THEN {big('rem // 60')} ELSE 0 END AS block_remaining_min, coalesce(burning AND w_cost > 0 AND c90 > 0 AND w_cost >= c90*100, false) AS block_past_p90, err AS errors_24h,
  {sc(rd('hit_e4', 10), 1)} AS cache_hit_pct, {sc(rd('((tod+50000)//100000)', 100), 2)} AS today_cost
FROM (SELECT z.*, p.rem, p.active, p.burning, p.w_cost AS wc FROM zones z JOIN wprog p USING (g))
CROSS JOIN (SELECT two, tod, {rd('10000::HUGEINT*two', '20000::HUGEINT*10000000')} AS rc, {rd('10000::HUGEINT*r', 's')} AS hit_e4 FROM (
  SELECT coalesce(sum(cost_nano) FILTER (WHERE timestamp >= {NOW} - INTERVAL 2 HOUR),0) AS two, coalesce(sum(cost_nano) FILTER (WHERE date = {TODAY}),0) AS tod,
    sum(cache_read_tokens) AS r, sum(cache_read_tokens+input_tokens+cache_creation_tokens) AS s FROM u))
CROSS JOIN (SELECT count(*) FILTER (WHERE {DAY}) AS err FROM error_rows)
CROSS JOIN (SELECT CASE WHEN m IS NULL OR m LIKE '<%' THEN '—' WHEN regexp_matches(lower(m), '(opus|sonnet|haiku)-\\d+-\\d+') THEN
    upper(regexp_extract(lower(m),'(opus|sonnet|haiku)-(\\d+)-(\\d+)',1)[1]) || regexp_extract(lower(m),'(opus|sonnet|haiku)-(\\d+)-(\\d+)',1)[2:] || ' ' || regexp_extract(lower(m),'(opus|sonnet|haiku)-(\\d+)-(\\d+)',2) || '.' || regexp_extract(lower(m),'(opus|sonnet|haiku)-(\\d+)-(\\d+)',3)
    ELSE m END AS active_model FROM (SELECT max(model) FILTER (WHERE model <> '') AS m FROM u WHERE session_id = (SELECT session_id FROM u GROUP BY session_id HAVING sum(total_tokens) > 0 ORDER BY max(timestamp) DESC, session_id LIMIT 1)))"""
reg("status_fields", lambda s, d: L_.status_fields(V.usage(s, d), errors(s, d), as_of=AS_OF), q(STATUS))

# Windows, caps and projections per source, for the alert levels.
for _s in ("agent_a", "agent_b"):
    _u = f"(SELECT * FROM u WHERE source = '{_s}')"
    cte(f"pts_{_s}", f"SELECT DISTINCT timestamp AS ts FROM u WHERE source = '{_s}'")
    cte(f"succ_{_s}", f"SELECT * FROM (SELECT ts, min(ts) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM pts_{_s}) WHERE nx IS NOT NULL")
    cte(f"st_{_s}", f"SELECT min(ts) AS ts FROM pts_{_s} UNION ALL SELECT n.nx FROM st_{_s} s JOIN succ_{_s} n ON n.ts = s.ts")
    cte(f"win_{_s}", f"SELECT ts, (sum(cost_nano)+50000)//100000 AS cost_e4, sum(billable_tokens) AS bill, sum(total_tokens)::BIGINT AS tok FROM {_u} r ASOF JOIN st_{_s} s ON r.timestamp >= s.ts GROUP BY ts")
    cte(f"base_{_s}", f"""SELECT *, {pct('recent', 90)} AS p90x, CASE WHEN nb >= 8 THEN {rd(pct('c', 90), 10000)} END AS c90 FROM (
      SELECT count(*) FILTER (WHERE rn > 1 AND bill > 0) AS nb, {sorted_list('cost_e4', 'rn > 1 AND cost_e4 > 0')} AS c, {sorted_list('tok', f'ts >= {NOW} - INTERVAL 8 DAY')} AS recent
      FROM (SELECT *, row_number() OVER (ORDER BY ts DESC) AS rn FROM win_{_s}))""")
    cte(f"heavy_{_s}", f"""SELECT CASE WHEN coalesce(c90, 0) > 0 THEN {rd('(8-w8)*mk*5 + w8*2*c90', 40)} ELSE mk END AS heavy FROM (
      SELECT *, least(greatest(nb-8, 0), 8) AS w8, CASE WHEN len(recent) = 0 THEN 3500 WHEN p90x <= 4400000 THEN 3500 WHEN p90x <= 8800000 THEN 7000 ELSE 14000 END AS mk FROM base_{_s})""")
    cte(f"cap_{_s}", f"""SELECT {rd('now_e4', 100)} AS week_c, coalesce({rd(pct('hist', 95), 10000)}, 0) AS p95_c FROM (SELECT coalesce(sum(cost_e4) FILTER (WHERE date BETWEEN {TODAY}-6 AND {TODAY}),0) AS now_e4, {sorted_list('s7', 'n7 = 7 AND s7 > 5000')} AS hist
      FROM (SELECT *, sum(cost_e4) OVER w AS s7, count(*) OVER w AS n7 FROM daily_src WHERE source = '{_s}' WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)))""")
    cte(f"eom_{_s}", f"""SELECT {rd("(2*m + coalesce((" + pct('act', 50) + f")//50, 0) * date_diff('day', {TODAY}, last_day({TODAY})))", 200)} AS eom_c FROM (
      SELECT coalesce(sum(cost_e4) FILTER (WHERE date BETWEEN date_trunc('month', {TODAY}) AND {TODAY}),0) AS m, {sorted_list('cost_e4', 'ar <= 7 AND cost_e4 > 5000')} AS act
      FROM (SELECT *, row_number() OVER (PARTITION BY cost_e4 > 5000 ORDER BY date DESC) AS ar FROM daily_src WHERE source = '{_s}'))""")


def money(c):
    return f"'$' || format('{{:,}}', {rd(c, 100)})"


def alert_sql(s, limited):
    used = "(SELECT max(greatest(primary_pct, secondary_pct)) FROM (SELECT * FROM limits_known QUALIFY row_number() OVER (PARTITION BY device ORDER BY timestamp DESC, event_id DESC) = 1))" if limited else "0"
    rc = f"(SELECT {rd('10000::HUGEINT*n', '20000::HUGEINT*10000000')} FROM (SELECT coalesce(sum(cost_nano),0) AS n FROM u WHERE source = '{s}' AND timestamp >= {NOW} - INTERVAL 2 HOUR))"
    first = "CASE WHEN used >= 95 THEN 3 WHEN used >= 85 THEN 2 ELSE 0 END" if limited else "CASE WHEN 10*rc >= 16*heavy THEN 2 ELSE 0 END"
    text = "'limit at ' || used || '%'" if limited else f"'burn at ' || {money('rc')} || '/h'"
    pace = "(p95_c > 0 AND 10*week_c >= 12*p95_c)"
    pace_text = f"'pace: ' || {money('week_c')} || ' in 7 days, ' || ({rd('week_c*100', 'p95_c')} - 100) || '% above the heaviest week (' || {money('p95_c')} || ')' || CASE WHEN eom_c > 0 THEN '; ' || {money('eom_c')} || ' by month end' ELSE '' END"
    return f"""SELECT '{s}' AS source, CASE WHEN {pace} AND f < 2 THEN 2 ELSE f END::BIGINT AS level, CASE WHEN f > 0 THEN {text} WHEN {pace} THEN {pace_text} ELSE '' END AS message
      FROM (SELECT *, {first} AS f FROM (SELECT *, {used} AS used, {rc} AS rc FROM heavy_{s} CROSS JOIN cap_{s} CROSS JOIN eom_{s}))"""


reg("alert_level", lambda s, d: L_.alert_level(V.usage(s, d), limits(s, d), as_of=AS_OF), q(alert_sql("agent_a", False) + " UNION ALL " + alert_sql("agent_b", True)))
