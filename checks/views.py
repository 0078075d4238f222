"""The test tables projected onto the usage schema.

One SQL text per view serves both engines: `{K}` (the integer in `props`) is the only
dialect difference, and `{events}` etc. are DataFrames in Spark and tables in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-01-30 18:00:00"

K_SPARK = "CAST(get_json_object(props,'$.k') AS BIGINT)"
K_DUCK = "CAST(json_extract_string(props,'$.k') AS BIGINT)"

VIEWS = {
    "usage_all": """
SELECT event_id, ts AS timestamp,
  CASE WHEN user_id % 3 = 2 THEN 'agent_b' ELSE 'agent_a' END AS source,
  concat('u', CAST(user_id AS STRING)) AS account,
  concat('dev', CAST(user_id % 4 AS STRING)) AS device,
  concat('u', CAST(user_id AS STRING), '-', substr(CAST(ts AS STRING), 1, 10)) AS session_id,
  concat('/work/p', CAST(user_id % 12 AS STRING)) AS project_dir,
  concat('p', CAST(user_id % 12 AS STRING)) AS project_label,
  CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'feature/x' END AS git_branch,
  CASE event_id % 10 WHEN 0 THEN 'claude-opus-4-8' WHEN 1 THEN 'claude-sonnet-4-5-20250929'
    WHEN 2 THEN 'claude-haiku-4-5-20251001' WHEN 3 THEN 'gpt-5.5' WHEN 4 THEN 'gpt-5.4'
    WHEN 5 THEN 'gpt-5.4-mini' WHEN 6 THEN 'gpt-5.3-codex' WHEN 7 THEN 'claude-fable-5'
    WHEN 8 THEN '<synthetic>' ELSE '' END AS model,
  concat('m', CAST(event_id AS STRING)) AS message_id,
  concat('t', CAST(user_id AS STRING), '-', substr(CAST(ts AS STRING), 1, 13)) AS turn_id,
  CAST(round(value * 100) AS BIGINT) AS input_tokens,
  {K} * 20 AS output_tokens,
  CAST(CASE WHEN event_id % 4 = 0 THEN 600 ELSE 0 END AS BIGINT) AS cache_creation_tokens,
  (event_id % 200) * 100 AS cache_read_tokens,
  CASE event_type WHEN 'click' THEN 'Read' WHEN 'purchase' THEN 'Edit,Bash'
    WHEN 'view' THEN 'mcp__db__query,Read,Grep' ELSE '' END AS tools,
  event_type
FROM {events}""",
    "usage_replayed": """
SELECT event_id, timestamp, turn_id, input_tokens, output_tokens, cache_read_tokens, message_id, 0 AS root_rank FROM {usage_all}
UNION ALL
SELECT event_id, timestamp + INTERVAL 10 HOUR, turn_id, input_tokens, output_tokens, cache_read_tokens, message_id, 1 FROM {usage_all} WHERE event_id % 10 < 3""",
    "error_texts": """
SELECT event_id, concat('u', CAST(user_id AS STRING), '-', substr(CAST(ts AS STRING), 1, 10)) AS session_id, ts AS timestamp,
  CASE {K} % 12 WHEN 0 THEN 'No such file or directory' WHEN 1 THEN 'Permission denied'
    WHEN 2 THEN 'bash: x: command not found' WHEN 3 THEN 'request timed out' WHEN 4 THEN 'Traceback (most recent call)'
    WHEN 5 THEN 'process ended with exit code 1' WHEN 6 THEN 'string not found in file' WHEN 7 THEN 'output exceeds maximum'
    WHEN 8 THEN 'rate limit hit' WHEN 9 THEN 'permission denied, exit code 126' WHEN 10 THEN '' ELSE 'boom' END AS text
FROM {events} WHERE event_type = 'error'""",
    "commits": """
SELECT concat('/work/p', CAST(user_id % 12 AS STRING)) AS project_dir, ts AS timestamp,
  concat('c', CAST(event_id AS STRING)) AS sha, event_type AS message, concat('u', CAST(user_id AS STRING)) AS author
FROM {events} WHERE event_type = 'signup'""",
    "rate_limits": """
SELECT concat('dev', CAST(user_id % 4 AS STRING)) AS device, ts AS timestamp, event_id,
  {K} AS primary_pct, event_id % 101 AS secondary_pct
FROM {events} WHERE user_id % 3 = 2 AND event_type = 'view'""",
    "token_count_events": """
SELECT concat('f', CAST(user_id AS STRING)) AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no,
  ts AS timestamp,
  CASE WHEN event_id % 5 = 0 THEN concat('gpt-5.', CAST(4 + event_id % 2 AS STRING)) END AS ctx_model,
  CASE WHEN event_id % 3 = 0 THEN concat('T', CAST(event_id AS STRING)) END AS ctx_turn_id,
  {K} % 3 * 100 AS input_tokens, {K} % 2 * 50 AS cached_tokens, {K} % 3 * 10 AS output_tokens
FROM {events} WHERE user_id % 3 = 2""",
    "chat_titles_raw": """
SELECT concat('u', CAST(c_custkey AS STRING)) AS account, c_name AS title,
  CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'auto' END AS title_source
FROM {customer}""",
    "turn_chain": """
SELECT concat('conv', CAST(conv_id AS STRING)) AS file,
  concat(CAST(conv_id AS STRING), ':', CAST(turn AS STRING)) AS uuid,
  CASE WHEN turn > 0 THEN concat(CAST(conv_id AS STRING), ':', CAST(turn - 1 AS STRING)) ELSE '' END AS parent_uuid,
  role AS type, role = 'user' AND length(trim(text)) > 0 AS is_human, text, turn
FROM {conversations}""",
}

RAW = ("events", "customer", "conversations")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; parquet scans keep their pushdown and pruning."""
    text = VIEWS[name].replace("{K}", K_SPARK)
    args = {}
    for t in RAW:
        if "{" + t + "}" in text:
            args[t] = raw(spark, sf_dir, t)
    for v in VIEWS:
        if "{" + v + "}" in text:
            args[v] = view(spark, sf_dir, v)
    return spark.sql(text, **args)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usage_all with the full usage schema."""
    names = F.when(F.col("tools") != "", F.split("tools", ",")).otherwise(F.array().cast("array<string>"))
    return view(spark, sf_dir, "usage_all").withColumns(
        {
            "tool_names": names,
            "source_file": F.lit("events"),
            "line_no": F.col("event_id").cast("bigint"),
            "uuid": F.col("message_id"),
            "parent_uuid": F.lit(""),
        }
    )
