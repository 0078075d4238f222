"""Fleet roll-ups, exports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import loglines as L, views as V
from checks.q_core import burn_rows, rate
from checks.q_rest import AS_OF, CROSS, levels
from checks.q_sources import ASSISTANT
from checks.q_time import live_sql
from checks.registry import reg
from checks.sqlkit import NOW, TODAY, big, cte, hit, pct, q, ratio, rd, sc, sorted_list, tout, ts, tsums, us, usd4
from usagelens.operators import aggregates as A, billing as B, common as C, fleet as M
from usagelens.plans.report import build_report
from usagelens.session import shared_dir
from usagelens.sources import agent_b as SB, sinks as SK
from usagelens.streaming import alert_stream as RA, burn_stream as RB, pane_stream as RP, usage_stream as RU

DS = "device, source"
cte("daily_ds", f"SELECT *, (cost_nano+50000)//100000 AS cost_e4 FROM (SELECT {DS}, date, {tsums()} FROM u GROUP BY {DS}, date)")
cte("sum_ds", f"""SELECT a.*, {rd('10000::HUGEINT*two', '20000::HUGEINT*10000000')} AS burn_c, {rd('((cost_nano+50000)//100000)', 100)} AS life_c, {rd('today_e4', 100)} AS today_c, {rd('month_e4', 100)} AS month_c,
    {rd(f"(2*month_e4 + coalesce(({pct('act', 50)})//50, 0) * date_diff('day', {TODAY}, last_day({TODAY})))", 200)} AS eom_c, {rd('cache_read_tokens::HUGEINT*10000', '(cache_read_tokens+input_tokens+cache_creation_tokens)')} AS hit_e4
  FROM (SELECT {DS}, {tsums()}, max(timestamp) AS last_ts, coalesce(sum(cost_nano) FILTER (WHERE timestamp >= {NOW} - INTERVAL 2 HOUR),0) AS two FROM u GROUP BY {DS}) a
  JOIN (SELECT {DS}, coalesce(sum(cost_e4) FILTER (WHERE date = {TODAY}),0) AS today_e4, coalesce(sum(cost_e4) FILTER (WHERE date BETWEEN date_trunc('month', {TODAY}) AND {TODAY}),0) AS month_e4, {sorted_list('cost_e4', 'ar <= 7 AND cost_e4 > 5000')} AS act
    FROM (SELECT *, row_number() OVER (PARTITION BY {DS}, cost_e4 > 5000 ORDER BY date DESC) AS ar FROM daily_ds) GROUP BY {DS}) b USING ({DS})""")


def summary(spark, sf):
    return M.device_summary(V.usage(spark, sf), as_of=AS_OF)


SUMMARY = f"""device, source, messages AS record_count, {sc('burn_c', 2)} AS burn_rate_per_hour, {sc('life_c', 2)} AS lifetime_cost, total_tokens AS lifetime_tokens, {sc('hit_e4', 4)} AS cache_hit_rate,
  {ts('last_ts')} AS last_seen, {sc('today_c', 2)} AS today_cost, {sc('month_c', 2)} AS month_so_far, {sc('eom_c', 2)} AS month_projected"""
reg("device_summary", summary, q(f"SELECT {SUMMARY} FROM sum_ds"))


def snapshot(spark, sf):
    s = M.device_snapshot(V.usage(spark, sf), as_of=AS_OF)
    ids = F.transform("recent", lambda r: r["turn_id"])
    return s.withColumns({
        "recent": ids, "by_project": F.transform("by_project", lambda p: p["project_label"]),
        "live": F.transform(F.coalesce("live", F.expr("slice(live, 1, 0)")), lambda r: r["model_id"]),
        "daily": F.transform("daily", lambda d: F.concat(d["date"].cast("string"), F.lit("="), F.round(d["cost"] * 100).cast("bigint").cast("string"))),
        "burn_1h": F.try_element_at("burn_rates_by_hours", F.lit("1")),
    }).drop("burn_rates_by_hours")


def ranked(sel, frm, order, n, name, by=DS):
    return f"(SELECT {by}, array_to_string(list(x ORDER BY rn), ',') AS {name} FROM (SELECT {by}, {sel} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {frm}) WHERE rn <= {n} GROUP BY {by})"


_turns = f"(SELECT {DS}, turn_id, max(timestamp) AS lt FROM u WHERE model <> '' AND model NOT LIKE '<%' GROUP BY {DS}, turn_id)"
_proj = f"(SELECT {DS}, project_dir, any_value(project_label) AS project_label, (sum(cost_nano)+50000)//100000 AS e4 FROM u GROUP BY {DS}, project_dir)"
_live = f"(SELECT {DS}, model_id, max(timestamp) AS lt FROM u WHERE timestamp >= {NOW} - INTERVAL 15 MINUTE AND model_id NOT LIKE '<%' GROUP BY {DS}, model_id)"
_c = {"on_c": "sum(cache_read_tokens*p_read)", "saved": "sum(cache_read_tokens*(p_in-p_read))"}
SNAP = f"""SELECT {SUMMARY}, strftime({NOW}, '%Y-%m-%d %H:%M:%S.%f') AS generated_at, recent, by_project, coalesce(live, '') AS live, daily, {sc(rd('saved', 10000000), 2)} AS usd_saved, {sc(rd('on_c', 10000000), 2)} AS usd_on_cache,
    {sc(rd('saved+on_c', 10000000), 2)} AS full_equiv_usd, {ratio('saved', 'saved+on_c', 4)} AS discount_pct, {sc(rd('b1*10000::HUGEINT', '10000::HUGEINT*10000000'), 2)} AS burn_1h
  FROM sum_ds JOIN (SELECT {DS}, {_c['on_c']} AS on_c, {_c['saved']} AS saved, coalesce(sum(cost_nano) FILTER (WHERE timestamp >= {NOW} - INTERVAL 1 HOUR),0) AS b1 FROM u GROUP BY {DS}) USING ({DS})
  LEFT JOIN {ranked('turn_id', _turns, 'lt DESC, turn_id', 25, 'recent')} USING ({DS})
  LEFT JOIN {ranked('project_label', _proj, 'e4 DESC, project_dir', 12, 'by_project')} USING ({DS})
  LEFT JOIN {ranked('model_id', _live, f"({us(NOW)} - epoch_us(lt)) // 1000000, model_id", 4, 'live')} USING ({DS})
  LEFT JOIN (SELECT {DS}, array_to_string(list(x ORDER BY date), ',') AS daily FROM (SELECT {DS}, date, date || '=' || {rd('cost_e4', 100)} AS x, row_number() OVER (PARTITION BY {DS} ORDER BY date DESC) AS rn FROM daily_ds) WHERE rn <= 14 GROUP BY {DS}) USING ({DS})"""
reg("device_snapshot", snapshot, q(SNAP))


def fleet_zones(spark, sf):
    """Zones of one device, as the fleet view scales a local gauge."""
    local = V.usage(spark, sf).where(F.col("device") == "dev0")
    return B.burn_rate_zones(local, as_of=AS_OF, keys=["source"])


FLEET = f"""source, count(DISTINCT device) AS devices, count(*) FILTER (WHERE burn_c > 1) AS active_devices, {', '.join(f"{sc(f'sum({c}_c)', 2)} AS {n}" for c, n in (('burn', 'burn_rate_per_hour'), ('today', 'today_cost'), ('month', 'month_so_far'), ('life', 'lifetime_cost')))},
  {big('sum(total_tokens)')} AS lifetime_tokens, {big('sum(messages)')} AS record_count, {sc(rd('sum(hit_e4::HUGEINT*messages)', 'sum(messages)'), 4)} AS cache_hit_rate"""
reg("fleet_totals", lambda s, d: M.fleet_totals(summary(s, d)), q(f"SELECT {FLEET} FROM sum_ds GROUP BY source"))
for _s in ("agent_a", "agent_b"):
    cte(f"pz_{_s}", f"SELECT DISTINCT timestamp AS ts FROM u WHERE source = '{_s}' AND device = 'dev0'")
    cte(f"succz_{_s}", f"SELECT * FROM (SELECT ts, min(ts) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM pz_{_s}) WHERE nx IS NOT NULL")
    cte(f"sz_{_s}", f"SELECT min(ts) AS ts FROM pz_{_s} UNION ALL SELECT n.nx FROM sz_{_s} s JOIN succz_{_s} n ON n.ts = s.ts")
    cte(f"wz_{_s}", f"SELECT ts, (sum(cost_nano)+50000)//100000 AS cost_e4, sum(billable_tokens) AS bill, sum(total_tokens)::BIGINT AS tok FROM (SELECT * FROM u WHERE source = '{_s}' AND device = 'dev0') r ASOF JOIN sz_{_s} s ON r.timestamp >= s.ts GROUP BY ts")
    cte(f"bz_{_s}", f"""SELECT '{_s}' AS source, *, least(greatest(nb-8, 0), 8) AS w8, {pct('recent', 90)} AS p90x, CASE WHEN nb >= 8 THEN {rd(pct('c', 50), 10000)} END AS c50, CASE WHEN nb >= 8 THEN {rd(pct('c', 90), 10000)} END AS c90 FROM (
      SELECT count(*) FILTER (WHERE rn > 1 AND bill > 0) AS nb, {sorted_list('cost_e4', 'rn > 1 AND cost_e4 > 0')} AS c, {sorted_list('tok', f'ts >= {NOW} - INTERVAL 8 DAY')} AS recent
      FROM (SELECT *, row_number() OVER (ORDER BY ts DESC) AS rn FROM wz_{_s}))""")
_mk = {"typical": (800, 1500, 3000), "busy": (1800, 3500, 7000), "heavy": (3500, 7000, 14000), "max": (6000, 12000, 24000)}
_own = {"typical": "c50", "busy": "c90", "heavy": "c90*2", "max": "greatest(c90*3, 500)"}
_tier = "CASE WHEN len(recent) = 0 OR p90x <= 4400000 THEN {} WHEN p90x <= 8800000 THEN {} ELSE {} END"
_zcols = ", ".join(f"CASE WHEN coalesce(c90,0) > 0 THEN {rd(f'(8-w8)*({_tier.format(*_mk[z])})*5 + w8*{_own[z]}', 40)} ELSE {_tier.format(*_mk[z])} END AS {z}" for z in _mk)
cte("fz", f"SELECT source, {_zcols} FROM (SELECT * FROM bz_agent_a UNION ALL SELECT * FROM bz_agent_b)")
reg(
    "fleet_zones",
    lambda s, d: M.fleet_totals(summary(s, d), fleet_zones(s, d)),
    q(f"SELECT f.*, {', '.join(f'{sc(f'{z} * greatest(active_devices, 1)', 2)} AS zone_{z}' for z in _mk)} FROM (SELECT {FLEET} FROM sum_ds GROUP BY source) f JOIN fz USING (source)"),
)
reg(
    "fleet_burn_windows",
    lambda s, d: M.fleet_burn_windows(V.usage(s, d), as_of=AS_OF),
    q(f"SELECT source, window_hours, {sc('sum(c)', 2)} AS cost_per_hour, count(*) FILTER (WHERE c > 1) AS active_devices FROM (SELECT *, {rd('10000::HUGEINT*nano', 'h::HUGEINT*10000000')} AS c FROM ({burn_rows(['device', 'source'])})) GROUP BY source, window_hours"),
)
reg(
    "fleet_cache",
    lambda s, d: M.fleet_cache(V.usage(s, d), as_of=AS_OF),
    q(f"""SELECT source, {sc('sum(a)', 2)} AS usd_saved, {sc('sum(b)', 2)} AS usd_on_cache, {sc('sum(c)', 2)} AS full_equiv_usd, {ratio('sum(a)', 'sum(c)', 4)} AS discount_pct
      FROM (SELECT device, source, {rd(_c['saved'], 10000000)} AS a, {rd(_c['on_c'], 10000000)} AS b, {rd(_c['saved'] + '+' + _c['on_c'], 10000000)} AS c FROM u GROUP BY {DS}) GROUP BY source"""),
)
cte("daily_dev", f"SELECT device, date, (sum(cost_nano)+50000)//100000 AS e4 FROM u GROUP BY device, date")
reg(
    "fleet_daily",
    lambda s, d: M.fleet_daily(V.usage(s, d), as_of=AS_OF, last=20),
    q(f"SELECT CAST(date AS VARCHAR) AS date, {sc('sum(e4)', 4)} AS cost_usd, count(DISTINCT device) AS devices FROM daily_dev GROUP BY daily_dev.date ORDER BY daily_dev.date DESC LIMIT 20"),
)
reg(
    "fleet_recent",
    lambda s, d: M.fleet_recent(V.usage(s, d), as_of=AS_OF).select("device", "turn_id", "timestamp", "total_tokens", "cost_usd", "effective_tokens"),
    q(f"""SELECT device, turn_id, {ts('lt')} AS timestamp, total_tokens, {usd4('cost_nano')} AS cost_usd, eff AS effective_tokens
      FROM (SELECT device, turn_id, {tsums()}, sum(effective_tokens)::BIGINT AS eff, max(timestamp) AS lt FROM u WHERE model <> '' AND model NOT LIKE '<%' GROUP BY device, turn_id) ORDER BY lt DESC, turn_id, device LIMIT 20"""),
)
_live15 = live_sql([15], "AND model_id NOT LIKE '<%'").replace("GROUP BY model_id, device", "GROUP BY source, model_id, device").replace("SELECT 15::BIGINT AS window_minutes,", "SELECT source,")
_fl = "source, w AS window_minutes, model_id, device, project, tokens_per_min, messages, cost_per_hour, last_seen, seconds_since_last"
reg(
    "fleet_live_snapshots",
    lambda s, d: M.fleet_live(V.usage(s, d), as_of=AS_OF, cap=4),
    q(f"SELECT {_fl} FROM (SELECT * FROM ({_live15}) WHERE seconds_since_last <= 900 QUALIFY row_number() OVER (PARTITION BY source, device ORDER BY seconds_since_last, model_id) <= 4) CROSS JOIN (SELECT unnest([1,5,15,60,300,1440])::BIGINT AS w) WHERE seconds_since_last <= w*60"),
)
_live = live_sql([1, 5, 15, 60, 300, 1440], "AND model_id NOT LIKE '<%'").replace("GROUP BY model_id, device", "GROUP BY source, model_id, device").replace("AS window_minutes,", "AS w, source,")
reg("fleet_live", lambda s, d: M.fleet_live(V.usage(s, d), as_of=AS_OF), q(f"SELECT {_fl} FROM ({_live})"))
reg(
    "fleet_projects",
    lambda s, d: M.fleet_projects(V.usage(s, d), as_of=AS_OF),
    q(f"""SELECT project_label, {sc('sum(e4)', 4)} AS cost_usd, sum(t)::BIGINT AS tokens, sum(m)::BIGINT AS messages, count(DISTINCT device) AS devices, CASE WHEN count(DISTINCT project_dir) = 1 THEN max(project_dir) END AS project_dir
      FROM (SELECT device, project_dir, any_value(project_label) AS project_label, (sum(cost_nano)+50000)//100000 AS e4, sum(total_tokens) AS t, count(*) AS m FROM u GROUP BY device, project_dir) GROUP BY project_label ORDER BY sum(e4) DESC, project_label LIMIT 12"""),
)
reg("device_share", lambda s, d: M.device_share(summary(s, d)), q(f"SELECT device, {sc('c', 2)} AS month_cost, {ratio('c', 'sum(c) OVER ()', 4)} AS share FROM (SELECT device, sum(month_c) AS c FROM sum_ds GROUP BY device)"))
_age = f"({us(NOW)} - epoch_us(t))"
reg(
    "device_freshness",
    lambda s, d: M.device_freshness(summary(s, d).withColumnRenamed("device", "_d").withColumn("device", F.col("_d")), as_of=AS_OF),
    q(f"SELECT device, {ts('t')} AS last_seen, {big(_age + ' // 1000000')} AS age_seconds, CASE WHEN {_age} < 360000000 THEN 'online' WHEN {_age} < 86400000000 THEN 'idle' ELSE 'offline' END AS state FROM (SELECT device, max(last_ts) AS t FROM sum_ds GROUP BY device)"),
)
# The same by account, where idle and offline occur.
reg(
    "account_freshness",
    lambda s, d: M.device_freshness(C.until(V.usage(s, d), AS_OF).groupBy("account").agg(F.max("timestamp").alias("last_seen")), as_of=AS_OF, keys=["account"]),
    q(f"SELECT account, {ts('t')} AS last_seen, {big(_age + ' // 1000000')} AS age_seconds, CASE WHEN {_age} < 360000000 THEN 'online' WHEN {_age} < 86400000000 THEN 'idle' ELSE 'offline' END AS state FROM (SELECT account, max(timestamp) AS t FROM u GROUP BY account)"),
)
reg(
    "both_sources",
    lambda s, d: M.both_sources(summary(s, d)),
    q(f"""SELECT device, {', '.join(f"coalesce(sum(messages) FILTER (WHERE source = '{x}'),0)::BIGINT AS {x}_records, {sc(f"coalesce(sum(month_c) FILTER (WHERE source = '{x}'),0)", 2)} AS {x}_month" for x in ('agent_a', 'agent_b'))},
      {sc('sum(month_c)', 2)} AS month_cost FROM sum_ds GROUP BY device"""),
)

# --- sinks -----------------------------------------------------------------------------------


def fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exported(spark, sf):
    path = fresh(spark, "export")
    SK.export_records_csv(V.usage(spark, sf), path)
    back = spark.read.option("header", "true").option("escape", '"').csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


reg(
    "export_records_csv",
    exported,
    q("""SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(timestamp) % 1000000 <> 0 THEN strftime(timestamp, '.%f') ELSE '' END || '+00:00' AS timestamp, session_id, project_label, git_branch, model,
      input_tokens::VARCHAR AS input_tokens, output_tokens::VARCHAR AS output_tokens, cache_creation_tokens::VARCHAR AS cache_creation_tokens, cache_read_tokens::VARCHAR AS cache_read_tokens FROM usage_all"""),
)
SECTIONS = ("totals", "daily", "by_model", "by_project", "recent_turns")


def reported(spark, sf):
    path = fresh(spark, "report")
    SK.write_report(build_report(V.usage(spark, sf), as_of=AS_OF, sections=SECTIONS), path)
    out = None
    for name, df in SK.read_report(spark, path, SECTIONS).items():
        part = df.agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("rows"), F.sum("total_tokens").alias("tokens"))
        out = part if out is None else out.unionByName(part)
    return out


reg(
    "write_report",
    reported,
    q(f"""SELECT 'totals' AS section, 1::BIGINT AS rows, sum(total_tokens)::BIGINT AS tokens FROM u UNION ALL SELECT 'daily', count(DISTINCT date), sum(total_tokens)::BIGINT FROM u
      UNION ALL SELECT 'by_model', count(DISTINCT family), sum(total_tokens)::BIGINT FROM u UNION ALL SELECT 'by_project', count(DISTINCT project_dir), sum(total_tokens)::BIGINT FROM u
      UNION ALL SELECT 'recent_turns', count(*), sum(t)::BIGINT FROM (SELECT sum(total_tokens) AS t FROM u WHERE model <> '' AND model NOT LIKE '<%' GROUP BY turn_id ORDER BY max(timestamp) DESC, turn_id LIMIT 30)"""),
)

# --- streams ------------------------------------------------------------------------------------


def event_stream(spark, sf):
    """The events table (a file or a folder) as a file stream."""
    schema = V.raw(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")


def usage_stream(spark, sf):
    names = F.when(F.col("tools") != "", F.split("tools", ",")).otherwise(F.array().cast("array<string>"))
    u = spark.sql(V.VIEWS["usage_all"].replace("{K}", V.K_SPARK), events=event_stream(spark, sf))
    return u.withColumns({"tool_names": names, "source_file": F.lit("events"), "line_no": F.col("event_id"), "uuid": F.col("message_id"), "parent_uuid": F.lit("")})


def drained(spark, df, name):
    path = fresh(spark, name)
    RU.run_available(df, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def stream_lines(spark, sf):
    """Log lines written as files, half of them twice, then read back as a stream."""
    path = fresh(spark, "logs")
    lines = L.agent_a(spark, sf)
    twice = lines.unionByName(lines.where("line_no % 2 = 0"))
    twice.select("value").write.option("compression", "none").text(path)
    return RU.read_line_stream(spark, path, pattern="*.txt")


reg(
    "stream_usage",
    lambda s, d: drained(s, RU.agent_a_stream(stream_lines(s, d), delay="60 days"), "usage").select("message_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "session_id", "input_tokens", "output_tokens"),
    q(f"SELECT CASE WHEN event_id % 7 <> 0 THEN message_id ELSE 'e' || event_id END AS message_id, {ts('timestamp')} AS timestamp, session_id, input_tokens, output_tokens FROM usage_all WHERE {ASSISTANT}"),
)
# One trigger drains the table, so the last ten minutes stay open and nothing is late.
CLOSED = "(SELECT max(timestamp) - INTERVAL 10 MINUTE FROM u_all)"
reg(
    "stream_minute_costs",
    lambda s, d: drained(s, RB.stream_minute_costs(usage_stream(s, d)), "minutes"),
    q(f"""SELECT {ts('minute')} AS minute, source, device, model, {usd4('sum(cost_nano)')} AS cost, sum(total_tokens)::BIGINT AS tokens, count(*) AS records
      FROM (SELECT *, date_trunc('minute', timestamp) AS minute FROM u_all) WHERE minute + INTERVAL 1 MINUTE <= {CLOSED} GROUP BY minute, source, device, model"""),
)
reg(
    "stream_burn",
    lambda s, d: drained(s, RB.stream_burn(usage_stream(s, d)), "burn"),
    q(f"""SELECT {ts('ws')} AS window_start, {ts('ws + INTERVAL 2 HOUR')} AS window_end, source, device, {rate('sum(cost_nano)', '20000')} AS cost_per_hour
      FROM (SELECT u.*, time_bucket(INTERVAL 5 MINUTE, timestamp) - k * INTERVAL 5 MINUTE AS ws FROM u_all AS u CROSS JOIN (SELECT unnest(range(24)) AS k)) WHERE ws + INTERVAL 2 HOUR <= {CLOSED} GROUP BY ws, source, device"""),
)



def paned(spark, sf):
    """The events in two steps: every third one comes after the others, most of them late."""
    path = fresh(spark, "panes")
    events, schema = V.raw(spark, sf, "events"), V.raw(spark, sf, "events").schema
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        events.where(part).write.mode("append").parquet(f"{path}/events")
        stream = spark.readStream.schema(schema).parquet(f"{path}/events")
        RP.run_panes(spark.sql(V.VIEWS["usage_all"].replace("{K}", V.K_SPARK), events=stream), path, f"{path}/check")
    return path


reg(
    "pane_minutes",
    lambda s, d: RP.minute_costs(s, paned(s, d)),
    q(f"""SELECT {ts('minute')} AS minute, source, device, model, {usd4('sum(cost_nano)')} AS cost, sum(total_tokens)::BIGINT AS tokens, count(*) AS records
      FROM (SELECT *, date_trunc('minute', timestamp) AS minute FROM u_all) WHERE minute + INTERVAL 1 MINUTE <= {CLOSED} GROUP BY minute, source, device, model"""),
)
reg(
    "pane_burn",
    lambda s, d: RP.burn_rates(s, paned(s, d)),
    q(f"""SELECT {ts('ws')} AS window_start, {ts('ws + INTERVAL 2 HOUR')} AS window_end, source, device, {rate('sum(cost_nano)', '20000')} AS cost_per_hour
      FROM (SELECT u.*, time_bucket(INTERVAL 5 MINUTE, timestamp) - k * INTERVAL 5 MINUTE AS ws FROM u_all AS u CROSS JOIN (SELECT unnest(range(24)) AS k)) WHERE ws + INTERVAL 2 HOUR <= {CLOSED} GROUP BY ws, source, device"""),
)
reg(
    "late_rows",
    lambda s, d: RP.late_rows(s, paned(s, d)),
    q(f"""SELECT {ts('minute')} AS minute, source, device, model, count(*) AS records, sum(total_tokens)::BIGINT AS tokens, {usd4('sum(cost_nano)')} AS cost FROM (
      SELECT *, date_trunc('minute', timestamp) AS minute FROM u_all WHERE event_id % 3 = 0 AND timestamp < (SELECT max(timestamp) - INTERVAL 10 MINUTE FROM u_all WHERE event_id % 3 <> 0)) GROUP BY minute, source, device, model"""),
)


def tailed(spark, sf):
    """Agent-B logs read as a stream in two steps, the second of which brings the later files."""
    path = fresh(spark, "tail")
    lines = L.agent_b(spark, sf)
    for part in ("crc32(source_file) % 2 = 0", "crc32(source_file) % 2 = 1"):
        L.write_files(lines.where(part), f"{path}/logs")
        RU.run_usage_stream(RU.tail_lines(spark, f"{path}/logs", pattern="*.txt", wanted=SB.INTEREST), f"{path}/out", f"{path}/check", source="agent_b", device="pc", account="me")
    out = RU.read_usage_stream(spark, f"{path}/out", "agent_b")
    return out.select("account", "device", "session_id", "project_dir", "message_id", "turn_id", "model", "timestamp", "input_tokens", "output_tokens", "cache_read_tokens")


reg(
    "stream_usage_agent_b",
    tailed,
    q(f"""SELECT 'me' AS account, 'pc' AS device, session_id, project_dir, message_id, turn_id, model, {ts('timestamp')} AS timestamp, input_tokens, output_tokens, cache_read_tokens FROM (
      SELECT concat('s-', file) AS session_id, concat('/repo/', file) AS project_dir, concat('s-', file, ':', idx) AS message_id, coalesce(t, concat('s-', file, ':', idx)) AS turn_id, coalesce(m, 'gpt-5') AS model,
        timestamp, greatest(input_tokens - cached_tokens, 0) AS input_tokens, output_tokens, cached_tokens AS cache_read_tokens, file, line_no FROM kept_events)
      QUALIFY row_number() OVER (PARTITION BY turn_id, input_tokens, output_tokens, cache_read_tokens ORDER BY timestamp, file, line_no) = 1"""),
)


def alert_stream(spark, sf):
    path = fresh(spark, "alerts")
    # Four scheduled runs over the weeks: the state passes from run to run.
    lv = levels(spark, sf).drop("source")
    cuts = ["2024-01-01", "2024-01-09", "2024-01-17", "2024-01-25", "2024-02-01"]
    for lo, hi in zip(cuts, cuts[1:]):
        lv.where((F.col("checked_at") >= lo) & (F.col("checked_at") < hi)).write.mode("append").parquet(f"{path}/levels")
        stream = spark.readStream.schema(lv.schema).parquet(f"{path}/levels")
        RA.run_alert_stream(stream, path, f"{path}/checkpoint", keys=["device"], order=["checked_at", "tie"])
    return RA.read_alerts(spark, path)


reg("stream_alerts", alert_stream, q(CROSS))
