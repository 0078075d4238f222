"""Agent-B rollout logs: an event stream per file with state carried between events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions import text as S
from usagelens.plans.carry import carry_forward, running_index

# Texts of which one must occur in a line worth decoding, and the fallback model.
INTEREST = ('"token_count"', '"turn_context"', '"session_meta"', '"user_message"')
DEFAULT_MODEL = "gpt-5"

FILE_PATTERN = "rollout-*.jsonl"
CHUNK = 1 << 26               # line positions per chunk of a file

_LIMIT = "struct<used_percent: double, resets_at: bigint>"
EVENT_SCHEMA = (
    "timestamp string, type string, payload struct<id: string, cwd: string, git: struct<branch: string>, model: string, turn_id: string, "
    f"type: string, message: string, text: string, rate_limits: struct<primary: {_LIMIT}, secondary: {_LIMIT}>, "
    "info: struct<last_token_usage: map<string, string>>>"
)


def parse_events(lines: DataFrame, with_bad: bool = False) -> DataFrame:
    """Interesting events, flat. Most bytes are lines without any; they are never decoded. With `with_bad` also the lines
    among them that are no JSON: `bad` is set, `raw` is the line and all else is empty."""
    wanted = F.lit(False)
    for token in INTEREST:
        wanted = wanted | F.contains("value", F.lit(token))
    e, p = F.col("e"), F.col("e.payload")
    kind = F.when(e["type"] == "event_msg", p["type"]).otherwise(e["type"])
    use = p["info"]["last_token_usage"]
    counted = (kind == "token_count") & (F.size(use) > 0)

    def when(k, c):
        return F.when(kind == k, F.nullif(c, F.lit("")))

    out = lines.where(wanted).withColumn("e", F.from_json("value", EVENT_SCHEMA))
    bad = e["type"].isNull() & F.try_parse_json("value").isNull()
    out = out.where(e["type"].isNotNull() | bad) if with_bad else out.where(e["type"].isNotNull())
    return out.select(
        *([bad.alias("bad"), F.when(bad, F.col("value")).alias("raw")] if with_bad else []),
        *[c for c in lines.columns if c not in ("value", "source_file")],
        F.col("source_file").alias("file"),
        S.parse_ts(e["timestamp"]).alias("timestamp"),
        kind.alias("kind"),
        when("session_meta", p["id"]).alias("meta_id"),
        when("session_meta", p["cwd"]).alias("meta_cwd"),
        when("session_meta", p["git"]["branch"]).alias("meta_branch"),
        when("turn_context", p["model"]).alias("ctx_model"),
        when("turn_context", p["turn_id"]).alias("ctx_turn_id"),
        when("user_message", F.coalesce(F.nullif(p["message"], F.lit("")), p["text"])).alias("user_text"),
        F.when(counted, S.whole_number(use["input_tokens"])).alias("input_tokens"),
        F.when(counted, S.whole_number(use["cached_input_tokens"])).alias("cached_tokens"),
        F.when(counted, S.whole_number(use["output_tokens"])).alias("output_tokens"),
        F.when(kind == "token_count", p["rate_limits"]).alias("limits"),
    )


def _with_state(events: DataFrame, chunk: int) -> DataFrame:
    """Token events with the carried context and the usage of the token event before."""
    sig = F.when(F.col("input_tokens").isNotNull(), F.struct("input_tokens", "cached_tokens", "output_tokens"))
    e = events.withColumn("_chunk", F.floor(F.col("line_no") / chunk)).withColumn("_sig", sig)
    contexts = [c for c in ("ctx_model", "ctx_turn_id") if c in events.columns]
    e = carry_forward(e, ["file"], "_chunk", ["line_no"], upto=contexts, ahead=["_sig"])
    return e.where(F.col("_sig").isNotNull())


def _not_repeated():
    """Equal to the event before it, unless it used nothing."""
    used = (F.col("input_tokens") != 0) | (F.col("output_tokens") != 0)
    return ~F.coalesce((F.col("_sig") == F.col("_sig_prev")) & used, F.lit(False))


def drop_consecutive_dup(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Drop token events that repeat the one before them in the file."""
    return _with_state(events, chunk).where(_not_repeated()).select(*events.columns)


def session_meta(events: DataFrame) -> DataFrame:
    """One row per file: id, directory and branch of its last session_meta; without an
    id the file name stands in."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl$", "")
    fields = F.struct("meta_id", "meta_cwd", "meta_branch")
    meta = F.max_by(fields, F.when(F.col("kind") == "session_meta", F.col("line_no"))).alias("m")
    return events.groupBy("file").agg(meta).select(
        "file",
        F.coalesce("m.meta_id", stem).alias("session_id"),
        F.coalesce("m.meta_cwd", F.lit("")).alias("project_dir"),
        F.coalesce("m.meta_branch", F.lit("")).alias("git_branch"),
    )


_STATE = ("meta_id", "meta_cwd", "meta_branch", "ctx_model", "ctx_turn_id", "input_tokens", "cached_tokens", "output_tokens")


def _after(events: DataFrame, before: DataFrame | None) -> DataFrame:
    """Events behind a line -1 per file that says what earlier events left."""
    if before is None:
        return events
    last = before.select("file", F.lit(-1).cast("bigint").alias("line_no"), F.when(F.col("has_meta"), "session_meta").alias("kind"), *_STATE)
    return events.unionByName(last, allowMissingColumns=True)


def file_state(events: DataFrame, records: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """A row per file: what later events of it need to know of these, and how many records (`records` of these events) it gave."""
    def last(c, where):
        return F.max_by(c, F.when(where, F.col("line_no")))

    spent, meta = F.col("input_tokens").isNotNull(), F.col("kind") == "session_meta"
    g = _after(events, before).groupBy("file").agg(
        F.coalesce(F.max(meta), F.lit(False)).alias("has_meta"),
        *[last(c, meta).alias(c) for c in ("meta_id", "meta_cwd", "meta_branch")], *[last(c, F.col(c).isNotNull()).alias(c) for c in ("ctx_model", "ctx_turn_id")],
        *[last(c, spent).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")],
    )
    counts = records.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("_n"))
    g = g.join(counts, "file", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    if before is None:
        return g.withColumnRenamed("_n", "n")
    return g.join(before.select("file", "n"), "file", "left").withColumn("n", F.coalesce("n", F.lit(0)) + F.col("_n")).drop("_n")


def usage_records(events: DataFrame, chunk: int = CHUNK, before: DataFrame | None = None) -> DataFrame:
    """Usage rows: per-response deltas, cached input moved out of the fresh input. `before` is the state of files whose
    earlier events were taken before (`file_state`)."""
    events = _after(events, before)
    kept = _with_state(events, chunk).where(_not_repeated())
    kept = running_index(kept.where("line_no >= 0"), ["file"], "_chunk", ["line_no"], "idx").join(session_meta(events), "file")
    if before is not None:
        kept = kept.join(before.select("file", "n"), "file", "left").withColumn("idx", F.col("idx") + F.coalesce("n", F.lit(0))).drop("n")
    own_id = F.concat_ws(":", "session_id", F.col("idx").cast("string"))
    zero = F.lit(0).cast("bigint")
    passed = [c for c in ("device", "root_rank", "account", "source") if c in events.columns]
    return kept.select(
        *passed,
        "timestamp", "session_id", "project_dir", S.project_label("project_dir").alias("project_label"), "git_branch",
        F.coalesce("ctx_model_carried", F.lit(DEFAULT_MODEL)).alias("model"),
        own_id.alias("message_id"),
        F.greatest(zero, F.col("input_tokens") - F.col("cached_tokens")).alias("input_tokens"),
        "output_tokens",
        zero.alias("cache_creation_tokens"),
        F.col("cached_tokens").alias("cache_read_tokens"),
        F.array().cast("array<string>").alias("tool_names"),
        F.col("file").alias("source_file"), "line_no",
        own_id.alias("uuid"), F.lit("").alias("parent_uuid"),
        F.coalesce("ctx_turn_id_carried", own_id).alias("turn_id"),
    )


def compact(events: DataFrame) -> DataFrame:
    """Events with what an intent needs of a user's text (`said`) instead of all of it."""
    t = F.regexp_replace("user_text", r"^\s+|\s+$", "")
    return events.withColumn("said", F.when((F.col("kind") == "user_message") & (t != ""), F.substring(t, 1, 240))).drop("user_text")


def quality(events: DataFrame, keys=()) -> DataFrame:
    """Counts per file of compact events with bad lines: lines worth decoding, those that are no JSON, token events, events without a time."""
    return events.groupBy(*keys, F.col("file").alias("source_file")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("parse_errors"), F.count_if(F.col("input_tokens").isNotNull()).alias("record_count"),
        F.lit(0).cast("bigint").alias("error_events_count"), F.count_if(~F.col("bad") & (F.col("timestamp") == F.lit(S.EPOCH).cast("timestamp_ntz"))).alias("undated_lines"),
    )


def intents(events: DataFrame, keys=()) -> DataFrame:
    """First user message per file, under its session id (and `keys`, which a file has only one of)."""
    said = (events if "said" in events.columns else compact(events)).where("said IS NOT NULL").withColumnRenamed("said", "_t")
    first = said.groupBy("file", *keys).agg(F.min_by(F.struct("_t", "timestamp"), "line_no").alias("f"))
    by_file = first.join(session_meta(events), "file")
    order = F.struct("file")
    return by_file.groupBy(*keys, "session_id").agg(F.min_by("f._t", order).alias("intent"), F.min_by("f.timestamp", order).alias("intent_at"))


def rate_limits(events: DataFrame) -> DataFrame:
    """Limit readings of all token events with a primary limit."""
    return events.where(F.col("limits.primary").isNotNull()).select(
        *[c for c in ("device", "account", "source") if c in events.columns],
        "timestamp", "file", "line_no",
        F.col("limits.primary.used_percent").alias("primary_pct"), F.col("limits.primary.resets_at").alias("primary_resets_at"),
        F.col("limits.secondary.used_percent").alias("secondary_pct"), F.col("limits.secondary.resets_at").alias("secondary_resets_at"),
    )
