"""The central usage table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from usagelens.functions import pricing as P

USAGE_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("project_dir", T.StringType()),
        T.StructField("project_label", T.StringType()),
        T.StructField("git_branch", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cache_creation_tokens", T.LongType()),
        T.StructField("cache_read_tokens", T.LongType()),
        T.StructField("tool_names", T.ArrayType(T.StringType())),
        T.StructField("source_file", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("parent_uuid", T.StringType()),
        T.StructField("turn_id", T.StringType()),
    ]
)

DERIVED = ("family", "total_tokens", "billable_tokens", "cost_nano", "effective_tokens", "date")


def enrich(usage: DataFrame) -> DataFrame:
    """Add the derived columns once; a table that already has them is returned as is."""
    if set(DERIVED) <= set(usage.columns):
        return usage
    billable = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens")
    return (
        P.with_price(usage)
        .withColumns({
            "billable_tokens": billable,
            "total_tokens": billable + F.col("cache_read_tokens"),
            "cost_nano": P.cost_nano(),
            "date": F.to_date("timestamp"),
        })
        .withColumn("effective_tokens", P.effective_tokens())
        .drop("_model", "_price")
    )
