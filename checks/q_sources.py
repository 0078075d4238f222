"""Sources and normalization."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import loglines as L, views as V
from checks.registry import reg
from checks.sqlkit import NOW, big, cte, q, ts
from usagelens.functions import text as S
from usagelens.operators import normalize as N
from usagelens.plans.ingest import derive_agent_a
from usagelens.plans.store import IngestStore, Root
from usagelens.plans.turns import resolve_turns
from usagelens.session import cut_lineage, shared_dir
from usagelens.sources import agent_a as SA, agent_b as SB, lines as SL, side_tables as ST

# --- agent A ------------------------------------------------------------------------

GOOD = "event_id % 97 <> 0 AND event_id % 89 <> 0"
FILE = L.FILE_A
ASSISTANT = f"{GOOD} AND event_type NOT IN ('error', 'signup')"
ERRORS = f"""SELECT session_id, {ts('timestamp')} AS timestamp, category, replace(substr(text, 1, 160), chr(10), ' ') AS snippet FROM error_all"""
RULES = (
    ("file_not_found", "lower(text) LIKE '%no such file%' OR lower(text) LIKE '%file not found%' OR lower(text) LIKE '%no file at%'"),
    ("permission_denied", "lower(text) LIKE '%permission denied%'"),
    ("command_not_found", "lower(text) LIKE '%command not found%'"),
    ("timeout", "lower(text) LIKE '%timeout%' OR lower(text) LIKE '%timed out%'"),
    ("python_error", "lower(text) LIKE '%syntaxerror%' OR lower(text) LIKE '%traceback%'"),
    ("bash_failure", "lower(text) LIKE '%exit code%' OR lower(text) LIKE '%exit status%'"),
    ("stale_reference", "lower(text) LIKE '%no longer exists%' OR lower(text) LIKE '%not found in%'"),
    ("output_too_large", "lower(text) LIKE '%exceeds maximum%' OR lower(text) LIKE '%too large%'"),
    ("rate_limited", "lower(text) LIKE '%rate limit%' OR lower(text) LIKE '%rate!_limit%' ESCAPE '!'"),
)
CATEGORY = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in RULES) + " ELSE 'other_error' END"
cte("error_all", f"SELECT *, {CATEGORY} AS category FROM error_texts")
cte("error_rows", f"SELECT * FROM error_all WHERE timestamp <= {NOW}")


def parsed_a(spark, sf):
    return SA.parse_lines(L.agent_a(spark, sf))


reg(
    "ingest_agent_a",
    lambda spark, sf: parsed_a(spark, sf).select("source_file", "line_no", "bad", "type", "role", "uuid", "session_id", "timestamp", "text", F.size(F.coalesce("blocks", F.array())).alias("blocks")),
    q(f"""SELECT {FILE} AS source_file, event_id AS line_no, NOT ({GOOD}) AS bad, CASE WHEN NOT ({GOOD}) THEN '' WHEN event_type IN ('error','signup') THEN 'user' ELSE 'assistant' END AS type,
      CASE WHEN NOT ({GOOD}) THEN '' WHEN event_type IN ('error','signup') THEN 'user' ELSE 'assistant' END AS role, CASE WHEN {GOOD} THEN 'e' || event_id ELSE '' END AS uuid,
      CASE WHEN {GOOD} THEN session_id ELSE '' END AS session_id, CASE WHEN {GOOD} THEN {ts('timestamp')} ELSE '1970-01-01 00:00:00.000000' END AS timestamp,
      CASE WHEN {GOOD} AND event_type = 'signup' THEN 'please do e' || event_id END AS text,
      CASE WHEN NOT ({GOOD}) OR event_type = 'signup' THEN 0 WHEN event_type = 'error' THEN 1 ELSE len(string_split(tools, ',')) END AS blocks FROM usage_all"""),
)
reg(
    "usage_from_agent_a",
    lambda spark, sf: SA.usage_records(parsed_a(spark, sf)),
    q(f"""SELECT {ts('timestamp')} AS timestamp, session_id, project_dir, project_label, git_branch, model, CASE WHEN event_id % 7 <> 0 THEN message_id ELSE 'e' || event_id END AS message_id,
      input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, tools AS tool_names, {FILE} AS source_file, event_id AS line_no, 'e' || event_id AS uuid, 'e' || (event_id - 1) AS parent_uuid
      FROM usage_all WHERE {ASSISTANT}"""),
)
FLAGGED = f"{GOOD} AND (event_id % 2 = 0 OR event_id % 3 <> 0)"
reg("tool_errors", lambda spark, sf: N.tool_errors(parsed_a(spark, sf)), q(f"{ERRORS} WHERE {FLAGGED}"))
reg(
    "classify_error",
    lambda spark, sf: N.with_category(V.view(spark, sf, "error_texts")).groupBy("text", "category").agg(F.count(F.lit(1)).alias("errors")),
    q("SELECT text, category, count(*) AS errors FROM error_all GROUP BY text, category"),
)
reg(
    "tool_names",
    lambda spark, sf: parsed_a(spark, sf).where(F.col("blocks").isNotNull()).groupBy(F.concat_ws(",", N.tool_names(F.col("blocks"))).alias("tools")).agg(F.count(F.lit(1)).alias("lines")),
    q(f"SELECT CASE WHEN event_type = 'error' THEN '' ELSE tools END AS tools, count(*) AS lines FROM usage_all WHERE {GOOD} AND event_type <> 'signup' GROUP BY 1"),
)
QUALITY = f"""SELECT {FILE} AS source_file, count(*) AS lines, count(*) FILTER (WHERE NOT ({GOOD})) AS parse_errors, count(*) FILTER (WHERE {ASSISTANT}) AS record_count,
  count(*) FILTER (WHERE {FLAGGED} AND event_type = 'error') AS error_events_count, 0::BIGINT AS undated_lines FROM usage_all GROUP BY source_file"""
reg("ingest_quality", lambda spark, sf: SA.ingest_quality(parsed_a(spark, sf)), q(QUALITY))
reg(
    "ingest_quality_totals",
    lambda spark, sf: SA.quality_totals(SA.ingest_quality(parsed_a(spark, sf))),
    q(f"SELECT count(*) AS files_scanned, {', '.join(big(f'sum({c})') + ' AS ' + c for c in ('lines', 'parse_errors', 'record_count', 'error_events_count', 'undated_lines'))} FROM ({QUALITY})"),
)
reg(
    "quarantine",
    lambda spark, sf: SA.quarantine(L.agent_a(spark, sf)),
    q(f"SELECT {FILE} AS source_file, event_id AS line_no, CASE WHEN event_id % 97 = 0 THEN '{{\"uuid\": \"cut' ELSE '[1, 2]' END AS value FROM usage_all WHERE NOT ({GOOD})"),
)

# --- paths, roots, files ---------------------------------------------------------------

ENCODED = "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN concat('-Users-me-', project_label) ELSE concat('srv-', project_label) END"
reg(
    "decode_project_dir",
    lambda spark, sf: V.view(spark, sf, "usage_all").groupBy(F.expr(ENCODED).alias("encoded")).agg(F.count(F.lit(1)).alias("records"))
    .withColumn("project_dir", S.decode_project_dir("encoded")).withColumn("project_label", S.project_label("project_dir")),
    q(f"""SELECT encoded, records, replace(encoded, '-', '/') AS project_dir, CASE WHEN encoded = '' THEN 'unknown' ELSE string_split(encoded, '-')[-1] END AS project_label
      FROM (SELECT {ENCODED} AS encoded, count(*) AS records FROM usage_all GROUP BY encoded)"""),
)


def two_roots(spark, sf):
    u = V.usage(spark, sf).drop("device")
    return SL.union_roots([(u, "linux"), (u.where("event_id % 10 < 3"), "pc")])


reg(
    "union_roots",
    lambda spark, sf: two_roots(spark, sf).select("event_id", "device", "root_rank"),
    q("SELECT event_id, 'linux' AS device, 0::BIGINT AS root_rank FROM usage_all UNION ALL SELECT event_id, 'pc', 1 FROM usage_all WHERE event_id % 10 < 3"),
)


def listing(spark, sf, where="true"):
    e = V.raw(spark, sf, "events").where(where)
    return e.groupBy(F.expr("concat('/logs/u', user_id, '.jsonl')").alias("path")).agg(F.max("ts").alias("modified_at"), F.count(F.lit(1)).alias("size"))


LISTING = "SELECT concat('/logs/u', user_id, '.jsonl') AS path, max(ts) AS modified_at, count(*) AS size FROM events"
reg(
    "file_lookback",
    lambda spark, sf: SL.file_lookback(listing(spark, sf), as_of="2024-01-31 00:00:00", since_days=1),
    f"SELECT path, {ts('modified_at')} AS modified_at, size FROM ({LISTING} GROUP BY user_id) WHERE modified_at >= TIMESTAMP '2024-01-30'",
)
# The manifest knows the files as of day 29, some of them larger than they are now.
OLD = "user_id % 5 <> 0 AND (ts < TIMESTAMP '2024-01-29' OR user_id % 4 = 1)"


def incremental(spark, sf):
    old = listing(spark, sf, OLD).withColumn("size", F.expr("size + CASE WHEN path LIKE '%3.jsonl' THEN 1000000 ELSE 0 END"))
    return SL.plan_incremental(listing(spark, sf), old)


reg(
    "incremental_ingest",
    incremental,
    f"""SELECT n.path, {ts('n.modified_at')} AS modified_at, n.size, action, CASE WHEN action = 'append' THEN o.size ELSE 0 END AS from_offset FROM (
      SELECT n.*, o.size AS osz, CASE WHEN o.size IS NULL THEN 'new' WHEN o.modified_at = n.modified_at AND o.size = n.size THEN 'skip' WHEN n.size > o.size THEN 'append' ELSE 'reload' END AS action
      FROM ({LISTING} GROUP BY user_id) n LEFT JOIN (SELECT path, modified_at, size + CASE WHEN path LIKE '%3.jsonl' THEN 1000000 ELSE 0 END AS size FROM ({LISTING} WHERE {OLD} GROUP BY user_id)) o ON o.path = n.path) n
      LEFT JOIN (SELECT path, size + CASE WHEN path LIKE '%3.jsonl' THEN 1000000 ELSE 0 END AS size FROM ({LISTING} WHERE {OLD} GROUP BY user_id)) o ON o.path = n.path""",
)


def merged(spark, sf):
    rows = V.raw(spark, sf, "events").select("event_id", "user_id", "ts", F.expr("concat('/logs/u', user_id, '.jsonl')").alias("source_file"))
    out = SL.merge_increment(rows.where(OLD), incremental(spark, sf), rows)
    return out.groupBy("source_file").agg(F.count(F.lit(1)).alias("records"), F.sum("event_id").alias("ids"))


reg("merge_increment", merged, "SELECT concat('/logs/u', user_id, '.jsonl') AS source_file, count(*) AS records, sum(event_id)::BIGINT AS ids FROM events GROUP BY user_id")



def ingested_in_steps(spark, sf):
    """Logs of the events so far, read into a store; the rest, of which a second run reads only the new files."""
    at = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    store, lines = IngestStore(spark, f"{at}/store"), L.agent_a(spark, sf)
    for step, part in enumerate(("line_no % 4 <> 3", "line_no % 4 = 3")):
        lines.where(part).select("value").write.text(f"{at}/logs/step{step}")
        store.update("agent_a", [Root(f"{at}/logs", "mac", "me", "*.txt")])
    return derive_agent_a(store.lines("agent_a")).usage.select("account", "device", "message_id", "timestamp", "session_id", "model", "input_tokens", "output_tokens", "tool_names")


reg(
    "incremental_usage",
    ingested_in_steps,
    q(f"""SELECT 'me' AS account, 'mac' AS device, CASE WHEN event_id % 7 <> 0 THEN message_id ELSE concat('e', event_id) END AS message_id, {ts('timestamp')} AS timestamp, session_id, model, input_tokens, output_tokens,
      tools AS tool_names FROM usage_all WHERE {ASSISTANT}"""),
)

# --- agent B --------------------------------------------------------------------------

for _n, _seq in (
    ("carried", "SELECT *, last_value(ctx_model IGNORE NULLS) OVER w AS m, last_value(ctx_turn_id IGNORE NULLS) OVER w AS t, lag((input_tokens, cached_tokens, output_tokens)) OVER w AS prev FROM token_count_events WINDOW w AS (PARTITION BY file ORDER BY line_no)"),
    ("kept_events", "SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS idx FROM carried WHERE prev IS NULL OR prev <> (input_tokens, cached_tokens, output_tokens) OR (input_tokens = 0 AND output_tokens = 0)"),
):
    cte(_n, _seq)


def parsed_b(spark, sf):
    return SB.parse_events(L.agent_b(spark, sf))


reg(
    "ingest_agent_b",
    lambda spark, sf: parsed_b(spark, sf).groupBy("file", "kind").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens")),
    q(" UNION ALL ".join(
        f"SELECT '/logs/rollout-' || file || '.jsonl' AS file, '{k}' AS kind, count(*) AS events, {v}::BIGINT AS input_tokens FROM token_count_events WHERE {w} GROUP BY file"
        for k, w, v in (("session_meta", "line_no = 1", "0"), ("turn_context", "ctx_model IS NOT NULL OR ctx_turn_id IS NOT NULL", "0"), ("token_count", "true", "sum(input_tokens)"), ("user_message", "line_no % 4 = 2", "0")))),
)
USAGE_B = f"""SELECT {ts('timestamp')} AS timestamp, 's-' || file AS session_id, '/repo/' || file AS project_dir, file AS project_label, 'main' AS git_branch, coalesce(m, 'gpt-5') AS model,
  's-' || file || ':' || idx AS message_id, greatest(0, input_tokens - cached_tokens) AS input_tokens, output_tokens, 0::BIGINT AS cache_creation_tokens, cached_tokens AS cache_read_tokens,
  '' AS tool_names, '/logs/rollout-' || file || '.jsonl' AS source_file, 's-' || file || ':' || idx AS uuid, '' AS parent_uuid, coalesce(t, 's-' || file || ':' || idx) AS turn_id FROM kept_events"""
reg("usage_from_agent_b", lambda spark, sf: SB.usage_records(cut_lineage(parsed_b(spark, sf))).drop("line_no"), q(USAGE_B))
reg("usage_from_agent_b_small_chunks", lambda spark, sf: SB.usage_records(cut_lineage(parsed_b(spark, sf)), chunk=16).drop("line_no"), q(USAGE_B))
reg(
    "drop_consecutive_dup",
    lambda spark, sf: SB.drop_consecutive_dup(V.view(spark, sf, "token_count_events").select("file", "line_no", "input_tokens", "cached_tokens", "output_tokens"), chunk=32),
    q("SELECT file, line_no, input_tokens, cached_tokens, output_tokens FROM kept_events"),
)
reg(
    "intents_agent_b",
    lambda spark, sf: SB.intents(parsed_b(spark, sf)),
    q(f"SELECT 's-' || file AS session_id, 'ask 2' AS intent, {ts('timestamp')} AS intent_at FROM token_count_events WHERE line_no = 2"),
)

# --- side tables ------------------------------------------------------------------------

# Three documents per account, so that source and file order both decide somewhere.
DOCS = """SELECT account, title, title_source, 'local_1' AS file FROM {t} UNION ALL
  SELECT account, concat('  ', title, ' b '), CASE WHEN title LIKE '%1' THEN 'user' ELSE 'auto' END, 'local_2' FROM {t} UNION ALL
  SELECT account, CASE WHEN title LIKE '%4' THEN ' ' ELSE concat(title, ' c') END, CASE WHEN title LIKE '%2' OR title LIKE '%4' THEN 'user' ELSE 'auto' END, 'local_3' FROM {t}"""
reg(
    "chat_titles",
    lambda spark, sf: ST.chat_titles(spark.sql(DOCS, t=V.view(spark, sf, "chat_titles_raw")), keys=["account"]),
    q(f"""SELECT account, coalesce(arg_max(trim(title), file) FILTER (WHERE title_source = 'user'), arg_min(trim(title), file)) AS title
      FROM ({DOCS.format(t='chat_titles_raw')}) WHERE trim(title) <> '' GROUP BY account"""),
)
LOG = "concat(sha, chr(9), CAST({epoch} AS STRING), chr(9), repeat(concat(message, ' '), 20), chr(9), author)"


def commit_log(spark, sf):
    return V.view(spark, sf, "commits").selectExpr("project_dir", LOG.format(epoch="unix_seconds(CAST(timestamp AS TIMESTAMP))") + " AS value")


reg(
    "commits_source",
    lambda spark, sf: ST.commits_source(ST.parse_commit_log(commit_log(spark, sf)), as_of=V.AS_OF),
    q(f"""SELECT project_dir, sha, {ts("date_trunc('second', timestamp)")} AS timestamp, substr(repeat(concat(message, ' '), 20), 1, 90) AS message, author FROM commits
      WHERE date_trunc('second', timestamp) BETWEEN {NOW} - INTERVAL 14 DAY AND {NOW}"""),
)

# --- duplicates, turns, intents, limits ----------------------------------------------------


def replayed(spark, sf):
    return V.view(spark, sf, "usage_replayed").withColumns({"source_file": F.lit("events"), "line_no": F.col("event_id")})


# Blank ids on some rows: those rows all stay.
BLANKED = "CASE WHEN event_id % 11 = 0 THEN '' ELSE message_id END"
reg(
    "dedup_message",
    lambda spark, sf: N.dedup_message(replayed(spark, sf).withColumn("message_id", F.expr(BLANKED)).withColumn("line_no", F.col("line_no") * 2 + F.col("root_rank"))).select("event_id", "message_id", "timestamp", "root_rank"),
    q(f"""SELECT event_id, mid AS message_id, {ts('timestamp')} AS timestamp, root_rank::BIGINT AS root_rank FROM (SELECT *, {BLANKED} AS mid FROM usage_replayed)
      QUALIFY mid = '' OR row_number() OVER (PARTITION BY mid ORDER BY root_rank, event_id) = 1"""),
)
reg(
    "dedup_replay",
    lambda spark, sf: N.dedup_replay(replayed(spark, sf)).select("event_id", "turn_id", "timestamp"),
    q(f"SELECT event_id, turn_id, {ts('timestamp')} AS timestamp FROM usage_replayed QUALIFY row_number() OVER (PARTITION BY turn_id, input_tokens, output_tokens, cache_read_tokens ORDER BY timestamp, event_id) = 1"),
)
cte("walk", """SELECT file, uuid, uuid AS cur FROM turn_chain
  UNION ALL SELECT w.file, w.uuid, t.parent_uuid FROM walk w JOIN turn_chain t ON t.file = w.file AND t.uuid = w.cur WHERE NOT t.is_human AND t.parent_uuid <> ''""")
reg(
    "resolve_turns",
    lambda spark, sf: resolve_turns(V.view(spark, sf, "turn_chain").withColumn("line_no", F.col("turn"))),
    q("""SELECT w.file, w.uuid, w.cur AS turn_id FROM walk w LEFT JOIN turn_chain t ON t.file = w.file AND t.uuid = w.cur WHERE t.uuid IS NULL OR t.is_human OR t.parent_uuid = ''"""),
)
SPOKEN = "CASE (turn + length(text)) % 6 WHEN 0 THEN concat('/cmd ', text) WHEN 1 THEN concat('<x>', text, '</x>') WHEN 2 THEN '  ' ELSE concat('  ', text) END"


def spoken(spark, sf):
    t = V.view(spark, sf, "turn_chain")
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, turn, 0)")
    return t.select(F.col("file").alias("session_id"), F.col("type").alias("role"), F.expr(SPOKEN).alias("text"), at.alias("timestamp"), F.col("file").alias("source_file"), F.col("turn").alias("line_no"))


reg(
    "session_intents",
    lambda spark, sf: N.session_intents(spoken(spark, sf)),
    q(f"""SELECT file AS session_id, arg_min(substr(t, 1, 240), turn) AS intent, {ts("TIMESTAMP '2024-01-01' + to_minutes(CAST(min(turn) AS BIGINT))")} AS intent_at
      FROM (SELECT *, regexp_replace({SPOKEN}, '^\\s+|\\s+$', '', 'g') AS t FROM turn_chain WHERE type = 'user') WHERE t <> '' AND t NOT LIKE '/%' AND NOT (t LIKE '<%' AND t LIKE '%</%') GROUP BY file"""),
)
reg(
    "latest_rate_limits",
    lambda spark, sf: N.latest_rate_limits(V.view(spark, sf, "rate_limits"), order=("timestamp", "event_id")),
    q(f"SELECT device, {ts('timestamp')} AS timestamp, event_id, primary_pct, secondary_pct FROM rate_limits QUALIFY row_number() OVER (PARTITION BY device ORDER BY timestamp DESC, event_id DESC) = 1"),
)
