"""From parsed lines to counted records: duplicates, turns, intents, errors, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.functions import text as S
from usagelens.operators import common as C


def _first_per(df: DataFrame, key, order) -> DataFrame:
    """Row 1 per key. Spark cuts every task to one row per key before the shuffle, so a
    message copied into a third of all rows still shuffles once per task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedup_message(records: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    """One row per message id, main root first; rows without an id all stay.

    Rows without an id are told apart by file and line, so they do not form one group.
    """
    blank = F.coalesce("message_id", F.lit("")) == ""
    key = [*keys, F.coalesce("message_id", F.lit("")), F.when(blank, F.col("source_file")), F.when(blank, F.col("line_no"))]
    return _first_per(records, key, ["root_rank", "source_file", "line_no"])


def dedup_replay(records: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    """Replayed history counts once, at its earliest time."""
    key = [*keys, "turn_id", "input_tokens", "output_tokens", "cache_read_tokens"]
    return _first_per(records, key, ["timestamp", "source_file", "line_no"])


def is_human_line(line_type: str, text: str, blocks: str) -> Column:
    """A user line with text, or with blocks none of which is a tool result."""
    has_result = F.exists(blocks, lambda b: F.coalesce(b["type"], F.lit("")) == "tool_result")
    by_text = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    human = F.when(F.col(blocks).isNotNull(), ~has_result).otherwise(by_text)
    return F.coalesce((F.col(line_type) == "user") & human, F.lit(False))


def session_intents(lines: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    """Earliest user text per session. Needs session_id, role, text, timestamp, source_file, line_no."""
    intent = S.intent_text("text")
    order = F.struct("timestamp", "source_file", "line_no")
    user = lines.where((F.col("role") == "user") & (F.coalesce("session_id", F.lit("")) != "")).withColumn("_intent", intent)
    return (
        user.where(F.col("_intent").isNotNull())
        .groupBy(*keys, "session_id")
        .agg(F.min_by("_intent", order).alias("intent"), F.min("timestamp").alias("intent_at"))
    )


def tool_names(blocks) -> Column:
    """Names of the tool_use blocks, in order."""
    uses = F.filter(blocks, lambda b: (b["type"] == "tool_use") & b["name"].isNotNull())
    return F.coalesce(F.transform(uses, lambda b: b["name"]), F.array().cast("array<string>"))


def truthy(c: Column) -> Column:
    return ~F.lower(F.coalesce(c, F.lit("false"))).isin("false", "0", "", "null", "[]", "{}")


def tool_errors(lines: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    """Tool results flagged as errors, from lines with session_id, timestamp, blocks.
    A block's content is its text, or that of the first block of a list."""
    flagged = F.filter("blocks", lambda b: (b["type"] == "tool_result") & truthy(b["is_error"]))
    out = lines.select(*keys, "session_id", "timestamp", F.explode(flagged).alias("b"))
    return with_category(out.withColumn("text", F.coalesce("b.content", F.lit("")))).drop("b", "text")


def with_category(errors: DataFrame) -> DataFrame:
    return errors.withColumns({"category": S.classify_error("text"), "snippet": S.error_snippet("text")})


def latest_rate_limits(limits: DataFrame, *, as_of=None, keys=("device",), order=("timestamp", "line_no")) -> DataFrame:
    """Last limit event per device that carries a primary limit."""
    fields = [c for c in limits.columns if c not in keys]
    last = F.max_by(F.struct(*fields), F.struct(*order)).alias("r")
    return C.until(limits, as_of).where(F.col("primary_pct").isNotNull()).groupBy(*keys).agg(last).select(*keys, "r.*")
