"""Agent-A session logs: one JSON object per line, content a string or a list of blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions import text as S
from usagelens.operators import normalize as N

# Content as VARIANT keeps the JSON type: a string may start like a list, and a list may hold other things than blocks.
_NAME, _CONTENT = (f"try_variant_get(x, '$.{k}', 'variant')" for k in ("name", "content"))
_BLOCKS = f"""filter(transform(try_variant_get(j.message.content, '$', 'array<variant>'), x -> named_struct(
  'type', try_variant_get(x, '$.type', 'string'), 'text', try_variant_get(x, '$.text', 'string'),
  'name', IF(schema_of_variant({_NAME}) = 'STRING', try_variant_get(x, '$.name', 'string'), NULL),
  'is_error', try_variant_get(x, '$.is_error', 'string'),
  'content', coalesce(try_variant_get(x, '$.content[0].text', 'string'), IF(schema_of_variant({_CONTENT}) = 'STRING', try_variant_get(x, '$.content', 'string'), NULL))
)), b -> b.type IS NOT NULL)"""
_TEXT = "IF(schema_of_variant(j.message.content) = 'STRING', try_variant_get(j.message.content, '$', 'string'), NULL)"
_USAGE = "struct<input_tokens: string, output_tokens: string, cache_creation_input_tokens: string, cache_read_input_tokens: string>"
LINE_SCHEMA = (
    "uuid string, parentUuid string, sessionId string, cwd string, gitBranch string, timestamp string, type string, "
    f"message struct<id: string, role: string, model: string, content: variant, usage: {_USAGE}>"
)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed lines. `bad` marks lines that are no JSON object; they carry nothing else."""
    j = F.col("j")
    parsed = lines.withColumn("j", F.from_json("value", LINE_SCHEMA))
    # A valid object can lack every known field, so only such lines are parsed again.
    known = ["uuid", "parentUuid", "sessionId", "cwd", "gitBranch", "timestamp", "type", "message"]
    empty = reduce(Column.__and__, [j[k].isNull() for k in known])
    bad = empty & (~F.startswith(F.ltrim("value"), F.lit("{")) | F.try_parse_json("value").isNull())
    message = j["message"]
    # Blocks are the costliest part of a line: a column of their own first, so that what is made of them does not decode them again.
    # Only content that is no list can be a text; the type of a list is not worked out.
    parsed = parsed.withColumn("blocks", F.expr(_BLOCKS)).withColumn("content_text", F.when(F.col("blocks").isNull(), F.expr(_TEXT)))
    text, blocks = F.col("content_text"), F.col("blocks")
    first_text = F.try_element_at(
        F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: F.coalesce(t, F.lit("")) != ""),
        F.lit(1),
    )
    cols = {
        "uuid": j["uuid"], "parent_uuid": j["parentUuid"], "session_id": j["sessionId"], "cwd": j["cwd"],
        "git_branch": j["gitBranch"], "type": j["type"], "role": message["role"], "model": message["model"],
    }
    return parsed.select(
        *[c for c in lines.columns if c != "value"],
        F.coalesce(bad, F.lit(True)).alias("bad"),
        *[F.coalesce(c, F.lit("")).alias(n) for n, c in cols.items()],
        S.parse_ts(j["timestamp"]).alias("timestamp"),
        message["id"].alias("raw_message_id"),
        message["usage"].alias("usage"),
        "blocks",
        "content_text",
        F.coalesce(text, first_text).alias("text"),
    )


def parent_directory(path) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def usage_records(parsed: DataFrame) -> DataFrame:
    """Usage rows: assistant lines with a usage object."""
    cwd = F.coalesce(F.nullif("cwd", F.lit("")), S.decode_project_dir(parent_directory("source_file")))
    keep = (F.col("role") == "assistant") & F.col("usage").isNotNull()
    passed = [c for c in ("device", "root_rank", "account", "source") if c in parsed.columns]
    return parsed.where(keep).withColumn("project_dir", cwd).select(
        *passed,
        "timestamp", "session_id", "project_dir", S.project_label("project_dir").alias("project_label"), "git_branch", "model",
        F.coalesce(F.nullif("raw_message_id", F.lit("")), "uuid").alias("message_id"),
        S.whole_number(F.col("usage.input_tokens")).alias("input_tokens"),
        S.whole_number(F.col("usage.output_tokens")).alias("output_tokens"),
        S.whole_number(F.col("usage.cache_creation_input_tokens")).alias("cache_creation_tokens"),
        S.whole_number(F.col("usage.cache_read_input_tokens")).alias("cache_read_tokens"),
        N.tool_names(F.col("blocks")).alias("tool_names"),
        "source_file", "line_no", "uuid", "parent_uuid",
    )


_RECORD = (
    "project_dir", "project_label", "git_branch", "model", "message_id", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "tool_names",
)


def compact(parsed: DataFrame) -> DataFrame:
    """What the later steps need of a line, without its text: where it stands, the usage it reports, the intent it may give, the
    errors it flags; and of a bad line its source (column `raw`, if there)."""
    cwd = F.coalesce(F.nullif("cwd", F.lit("")), S.decode_project_dir(parent_directory("source_file")))
    is_record = (F.col("role") == "assistant") & F.col("usage").isNotNull()
    flagged = F.filter("blocks", lambda b: (b["type"] == "tool_result") & N.truthy(b["is_error"]))
    own = parsed.withColumns({"project_dir": cwd, "_texts": F.transform(flagged, lambda b: F.coalesce(b["content"], F.lit("")))}).withColumns({
        "project_label": S.project_label("project_dir"),
        "message_id": F.coalesce(F.nullif("raw_message_id", F.lit("")), "uuid"),
        "input_tokens": S.whole_number(F.col("usage.input_tokens")),
        "output_tokens": S.whole_number(F.col("usage.output_tokens")),
        "cache_creation_tokens": S.whole_number(F.col("usage.cache_creation_input_tokens")),
        "cache_read_tokens": S.whole_number(F.col("usage.cache_read_input_tokens")),
        "tool_names": N.tool_names(F.col("blocks")),
    })
    texts = F.col("_texts")
    told = (F.col("role") == "user") & (F.coalesce("session_id", F.lit("")) != "")
    passed = [c for c in ("device", "root_rank", "account", "source") if c in parsed.columns]
    return own.select(
        *passed, "source_file", "line_no", "bad", "session_id", "timestamp", "uuid", "parent_uuid",
        N.is_human_line("type", "content_text", "blocks").alias("is_human"),
        F.when(is_record, F.struct(*_RECORD)).alias("record"),
        F.when(told, S.intent_text("text")).alias("intent"),
        F.when(F.size(texts) > 0, F.transform(texts, lambda t: F.struct(S.classify_error(t).alias("category"), S.error_snippet(t).alias("snippet")))).alias("errors"),
        F.when(F.col("bad"), F.col("raw") if "raw" in parsed.columns else F.lit(None).cast("string")).alias("raw"),
    )


def compact_records(lines: DataFrame) -> DataFrame:
    """Usage rows of compact lines."""
    passed = [c for c in ("device", "root_rank", "account", "source") if c in lines.columns]
    return lines.where("record IS NOT NULL").select(*passed, "timestamp", "session_id", *[F.col("record." + c).alias(c) for c in _RECORD], "source_file", "line_no", "uuid", "parent_uuid")


def compact_intents(lines: DataFrame, keys=()) -> DataFrame:
    order = F.struct("timestamp", "source_file", "line_no")
    return lines.where("intent IS NOT NULL").groupBy(*keys, "session_id").agg(F.min_by("intent", order).alias("intent"), F.min("timestamp").alias("intent_at"))


def compact_errors(lines: DataFrame, keys=()) -> DataFrame:
    return lines.select(*keys, "session_id", "timestamp", F.explode("errors").alias("e")).select(*keys, "session_id", "timestamp", "e.category", "e.snippet")


def compact_quality(lines: DataFrame, keys=()) -> DataFrame:
    """Counts per file: lines, bad lines, usage records, flagged tool errors, lines without a time."""
    return lines.groupBy(*keys, "source_file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("parse_errors"), F.count_if(F.col("record").isNotNull()).alias("record_count"),
        F.coalesce(F.sum(F.when(F.col("errors").isNotNull(), F.size("errors"))), F.lit(0)).alias("error_events_count"),
        F.count_if(~F.col("bad") & (F.col("timestamp") == F.lit(S.EPOCH).cast("timestamp_ntz"))).alias("undated_lines"),
    )


def chain_lines(parsed: DataFrame) -> DataFrame:
    """Input of resolve_turns."""
    return parsed.select(
        F.col("source_file").alias("file"), "uuid", "parent_uuid", "line_no",
        N.is_human_line("type", "content_text", "blocks").alias("is_human"),
    )


def with_turns(records: DataFrame, turns: DataFrame) -> DataFrame:
    t = turns.select(F.col("file").alias("source_file"), "uuid", "turn_id")
    return records.join(t, ["source_file", "uuid"], "left").fillna("", ["turn_id"])


def ingest_quality(parsed: DataFrame) -> DataFrame:
    """Counts per file: lines, bad lines, usage records, flagged tool errors."""
    record = (F.col("role") == "assistant") & F.col("usage").isNotNull()
    errors = F.size(F.filter("blocks", lambda b: (b["type"] == "tool_result") & N.truthy(b["is_error"])))
    return parsed.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if("bad").alias("parse_errors"),
        F.count_if(record).alias("record_count"),
        F.coalesce(F.sum(F.when(F.col("blocks").isNotNull(), errors)), F.lit(0)).alias("error_events_count"),
        F.count_if(~F.col("bad") & (F.col("timestamp") == F.lit(S.EPOCH).cast("timestamp_ntz"))).alias("undated_lines"),
    )


def quality_totals(quality: DataFrame) -> DataFrame:
    return quality.agg(
        F.count(F.lit(1)).alias("files_scanned"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "parse_errors", "record_count", "error_events_count", "undated_lines")],
    )


def quarantine(lines: DataFrame) -> DataFrame:
    """Source text of the lines that did not parse, for a side table."""
    marked = parse_lines(lines.withColumn("_raw", F.col("value")))
    return marked.where("bad").select("source_file", "line_no", F.col("_raw").alias("value"))
