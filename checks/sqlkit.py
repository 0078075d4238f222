"""Small pieces of DuckDB SQL shared by the oracle queries."""

from __future__ import annotations

import re

from checks import views as V

TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens")
BURN = (("0.0833", 833), ("0.25", 2500), ("1", 10000), ("2", 20000), ("4", 40000), ("6", 60000))
NOW = f"TIMESTAMP '{V.AS_OF}'"
TODAY = f"CAST({NOW} AS DATE)"


def rd(n, d):
    """Half away from zero."""
    n, d = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    return f"CAST(CASE WHEN {d} = 0 THEN NULL ELSE sign({n}) * ((2*abs({n}) + {d}) // (2*{d})) END AS BIGINT)"


def idiv(n, d):
    return f"CAST(CAST({n} AS HUGEINT) // CAST({d} AS HUGEINT) AS BIGINT)"


def sc(units, places):
    return f"CAST({units} AS DOUBLE) / {10.0 ** places}"


def usd4(nano):
    return sc(f"((CAST({nano} AS BIGINT) + 50000) // 100000)", 4)


def usd2(nano):
    return sc(rd(nano, 10_000_000), 2)


def ratio(n, d, places):
    return f"CASE WHEN ({d}) > 0 THEN {sc(rd(f'({n}) * CAST({10**places} AS HUGEINT)', d), places)} ELSE 0.0::DOUBLE END"


def ts(x):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def us(x):
    return f"epoch_us({x})"


def from_us(x):
    return f"make_timestamp({x})"


def big(x):
    return f"CAST({x} AS BIGINT)"


def pct(l, q):
    """Interpolated percentile of a sorted list, times 100."""
    pos = f"({q}*(len({l})-1))"
    lo, fr = f"({pos}//100)", f"({pos}%100)"
    return f"CASE WHEN len({l})>0 THEN {l}[{lo}+1]*(100-{fr}) + {l}[least({lo}+2, len({l}))]*{fr} END"


def sorted_list(x, where=None):
    f = f" FILTER (WHERE {where})" if where else ""
    return f"coalesce(list_sort(list({x}){f}), [])"


def tsums(when="true", prefix=""):
    parts = [f"coalesce(sum({c}) FILTER (WHERE {when}),0)::BIGINT AS {prefix}{c}" for c in (*TOKENS, "cost_nano")]
    parts.append(f"count(*) FILTER (WHERE {when}) AS {prefix}messages")
    return ", ".join(parts)


def hit(p=""):
    return ratio(f"{p}cache_read_tokens", f"{p}cache_read_tokens + {p}input_tokens + {p}cache_creation_tokens", 4)


def tout(p=""):
    cols = [f"{p}{c} AS {c}" for c in TOKENS]
    return ", ".join([*cols, f"{usd4(p + 'cost_nano')} AS cost_usd", f"{p}messages AS messages", f"{hit(p)} AS cache_hit_rate"])


def g(keys):
    return "".join(k + ", " for k in keys)


def group(keys, *more):
    cols = [*keys, *more]
    return f"GROUP BY {', '.join(cols)}" if cols else ""


def part(keys):
    return f"PARTITION BY {', '.join(keys)}" if keys else ""


CTES: dict[str, str] = {}


def cte(name, text):
    CTES[name] = text.strip()
    return name


def q(final: str) -> str:
    """Prefix a SELECT with the CTEs it uses, directly or through others."""
    used: set[str] = set()

    def visit(text):
        for name in CTES:
            if name not in used and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                used.add(name)
                visit(CTES[name])

    visit(final)
    order = [n for n in CTES if n in used]
    if not order:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n.startswith('succ') else ''}({CTES[n]})" for n in order) + "\n" + final


for _name, _text in V.VIEWS.items():
    _t = _text.replace("{K}", V.K_DUCK)
    for _r in (*V.RAW, *V.VIEWS):
        _t = _t.replace("{" + _r + "}", _r)
    cte(_name, _t)

# The price list again, in dollars as published, apart from the library's table.
cte("prices", """
SELECT family, CAST(round(i*1000) AS BIGINT) AS p_in, CAST(round(o*1000) AS BIGINT) AS p_out, CAST(round(r*1000) AS BIGINT) AS p_read,
  CAST(round(w5*1000) AS BIGINT) AS p_w5, CAST(round(w1*1000) AS BIGINT) AS p_w1
FROM (VALUES ('fable-5',10.0,50.0,1.0,12.5,20.0),('opus',5.0,25.0,0.5,6.25,10.0),('sonnet',3.0,15.0,0.3,3.75,6.0),
  ('haiku',1.0,5.0,0.1,1.25,2.0),('gpt-5.5',5.0,30.0,0.5,5.0,5.0),('gpt-5.4',2.5,15.0,0.25,2.5,2.5),
  ('gpt-5-mini',0.75,4.5,0.075,0.75,0.75),('gpt-5-codex',1.75,14.0,0.175,1.75,1.75),('unknown',0,0,0,0,0)) t(family,i,o,r,w5,w1)""")

FAMILY = """CASE WHEN {m} LIKE '%opus%' THEN 'opus' WHEN {m} LIKE '%sonnet%' THEN 'sonnet' WHEN {m} LIKE '%haiku%' THEN 'haiku'
  WHEN {m} LIKE '%fable%' OR {m} LIKE '%mythos%' THEN 'fable-5' WHEN {m} LIKE '%codex%' THEN 'gpt-5-codex'
  WHEN {m} LIKE '%mini%' AND ({m} LIKE '%gpt%' OR {m} LIKE 'o%') THEN 'gpt-5-mini'
  WHEN {m} LIKE '%gpt-5.5%' OR {m} LIKE '%gpt5.5%' THEN 'gpt-5.5' WHEN {m} LIKE '%gpt-5.4%' OR {m} LIKE '%gpt5.4%' THEN 'gpt-5.4'
  WHEN {m} LIKE '%gpt%' OR {m} LIKE 'o1%' OR {m} LIKE 'o3%' OR {m} LIKE 'o4%' THEN 'gpt-5.5' ELSE 'unknown' END"""

cte("u_all", f"""
SELECT a.*, p.*, input_tokens+output_tokens+cache_creation_tokens AS billable_tokens,
  input_tokens+output_tokens+cache_creation_tokens+cache_read_tokens AS total_tokens,
  input_tokens*p_in + output_tokens*p_out + cache_read_tokens*p_read + cache_creation_tokens*p_w5 AS cost_nano,
  input_tokens*p_in + output_tokens*p_out + cache_read_tokens*p_read + cache_creation_tokens*p_w1 AS cost_nano_1h,
  CASE WHEN p_in > 0 THEN (input_tokens*p_in + output_tokens*p_out + cache_read_tokens*p_read + cache_creation_tokens*p_w5) // p_in
    ELSE input_tokens + output_tokens END AS effective_tokens,
  CAST(timestamp AS DATE) AS date, coalesce(nullif(model,''),'unknown') AS model_id
FROM usage_all a JOIN prices p ON p.family = {FAMILY.format(m='lower(model)')}""")

# What is known at as_of.
cte("u", f"SELECT * FROM u_all WHERE timestamp <= {NOW}")

# One set of keyed CTEs per grouping: none and per account.
for _s, _k in (("", []), ("_acc", ["account"])):
    _g = _k[0] if _k else "0"
    cte(f"daily{_s}", f"SELECT *, (cost_nano+50000)//100000 AS cost_e4 FROM (SELECT {g(_k)} date, {tsums()} FROM u {group(_k, 'date')})")
    cte(f"points{_s}", f"SELECT DISTINCT {_g} AS g, timestamp AS ts FROM u")
    cte(f"succ{_s}", f"SELECT * FROM (SELECT g, ts, min(ts) OVER (PARTITION BY g ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM points{_s}) WHERE nx IS NOT NULL")
    cte(f"starts{_s}", f"""SELECT g, min(ts) AS ts FROM points{_s} GROUP BY g
      UNION ALL SELECT n.g, n.nx FROM starts{_s} s JOIN succ{_s} n ON n.g = s.g AND n.ts = s.ts""")
    cte(f"wins{_s}", f"""SELECT *, (cost_nano+50000)//100000 AS cost_e4 FROM (
      SELECT s.g, s.ts AS started, max(timestamp) AS last_at, {tsums()}, sum(billable_tokens)::BIGINT AS billable_tokens,
        coalesce(list_sort(list(DISTINCT family) FILTER (WHERE model <> '')), []) AS models
      FROM (SELECT *, {_g} AS gg FROM u) r ASOF JOIN starts{_s} s ON r.gg = s.g AND r.timestamp >= s.ts GROUP BY s.g, s.ts)""")
    cte(f"wstate{_s}", f"""
      SELECT *, CASE WHEN len(recent)=0 THEN 'unknown' WHEN p90x <= 4400000 THEN 'pro' WHEN p90x <= 8800000 THEN 'max5' ELSE 'max20' END AS guess,
        CASE WHEN len(b)>=8 THEN {idiv(pct('b',50),100)} END AS billable_p50, CASE WHEN len(b)>=8 THEN {idiv(pct('b',90),100)} END AS billable_p90,
        CASE WHEN len(b)>=8 THEN coalesce({rd(pct('c',50),10000)},0) END AS c50, CASE WHEN len(b)>=8 THEN coalesce({rd(pct('c',90),10000)},0) END AS c90
      FROM (SELECT *, {pct('recent',90)} AS p90x FROM (
        SELECT g, {sorted_list('billable_tokens', 'rn > 1 AND billable_tokens > 0')} AS b, {sorted_list('cost_e4', 'rn > 1 AND cost_e4 > 0')} AS c,
          {sorted_list('total_tokens', f"started >= {NOW} - INTERVAL 8 DAY")} AS recent,
          max(started) AS w_start, arg_max(total_tokens, started) AS w_total, arg_max(billable_tokens, started) AS w_bill,
          arg_max(cost_e4, started) AS w_cost, arg_max(models, started) AS w_models
        FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY started DESC) AS rn FROM wins{_s}) GROUP BY g))""")
    cte(f"wprog{_s}", f"""
      SELECT *, el < 18000000000 AS active, (18000000000 - el)//1000000 AS rem, el < 18000000000 AND el > 60000000 AS burning
      FROM (SELECT *, greatest({us(NOW)} - {us('w_start')}, 0) AS el FROM wstate{_s})""")

    def _zone(name):
        idx = {"typical": 0, "busy": 1, "heavy": 2, "max": 3}[name]
        mk = {"pro": (800, 1800, 3500, 6000), "max5": (1500, 3500, 7000, 12000), "max20": (3000, 7000, 14000, 24000)}
        m = f"(CASE tier WHEN 'max20' THEN {mk['max20'][idx]} WHEN 'max5' THEN {mk['max5'][idx]} ELSE {mk['pro'][idx]} END)"
        p = ("c50", "c90", "c90*2", "greatest(c90*3, 500)")[idx]
        return f"CASE WHEN coalesce(c90,0) > 0 THEN {rd(f'(8-w8)*{m}*5 + w8*{p}', 40)} ELSE {m} END AS z_{name}"

    cte(f"zones{_s}", f"""
      SELECT *, {', '.join(_zone(z) for z in ('typical', 'busy', 'heavy', 'max'))}
      FROM (SELECT *, least(greatest(len(b)-8, 0), 8) AS w8,
        CASE WHEN guess LIKE '%20%' THEN 'max20' WHEN guess LIKE '%max%' OR guess LIKE '%5%' THEN 'max5' ELSE 'pro' END AS tier FROM wstate{_s})""")
    cte(f"fc{_s}", f"""
      SELECT *, 6 - (isodow({TODAY})-1) AS wleft, date_diff('day', {TODAY}, last_day({TODAY})) AS mleft,
        86400000000 - {us(NOW)} % 86400000000 AS left_us, coalesce(({pct('act',50)})//50, 0) AS t2
      FROM (SELECT {g(_k)} coalesce(sum(cost_e4) FILTER (WHERE date = {TODAY}),0) AS today_e4,
          coalesce(sum(cost_e4) FILTER (WHERE date BETWEEN {TODAY} - CAST(isodow({TODAY})-1 AS INTEGER) AND {TODAY}),0) AS week_e4,
          coalesce(sum(cost_e4) FILTER (WHERE date BETWEEN date_trunc('month', {TODAY}) AND {TODAY}),0) AS month_e4,
          {sorted_list('cost_e4', 'ar <= 7 AND cost_e4 > 5000')} AS act
        FROM (SELECT *, row_number() OVER ({part([*_k, 'cost_e4 > 5000'])} ORDER BY date DESC) AS ar FROM daily{_s}) {group(_k)})""")
    cte(f"cap{_s}", f"""
      SELECT {g(_k)} now_e4, prev_e4, hist, coalesce({pct('hist',95)},0) AS p95, coalesce({pct('hist',50)},0) AS med
      FROM (SELECT {g(_k)} coalesce(sum(cost_e4) FILTER (WHERE date BETWEEN {TODAY}-6 AND {TODAY}),0) AS now_e4,
          coalesce(sum(cost_e4) FILTER (WHERE date BETWEEN {TODAY}-13 AND {TODAY}-7),0) AS prev_e4,
          {sorted_list('s7', 'n7 = 7 AND s7 > 5000')} AS hist
        FROM (SELECT *, sum(cost_e4) OVER w AS s7, count(*) OVER w AS n7 FROM daily{_s}
          WINDOW w AS ({part(_k)} ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) {group(_k)})""")
