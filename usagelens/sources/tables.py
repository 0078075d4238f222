"""The curated usage table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.schema import enrich


def write_usage(usage: DataFrame, path: str, *, files_per_day: int = 8, mode: str = "overwrite") -> None:
    """Parquet partitioned by date and source, derived columns included, so that reports
    neither price a record twice nor read days they do not need. A day is spread over
    `files_per_day` tasks by message, whatever account or project fills it."""
    part = F.pmod(F.xxhash64("message_id", "source_file", "line_no"), F.lit(files_per_day))
    (
        enrich(usage)
        .repartition(F.col("date"), F.col("source"), part)
        .sortWithinPartitions("date", "source", "account", "timestamp")
        .write.partitionBy("date", "source")
        .mode(mode)
        .parquet(path)
    )


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
