"""CSV export and report output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EXPORT_COLUMNS = (
    "session_id", "project_label", "git_branch", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens",
)


def iso(ts):
    """ISO-8601 in UTC; the fraction only where there is one."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.concat(base, F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(""), F.lit("+00:00"))


def export_records_csv(usage: DataFrame, path: str) -> None:
    """One CSV folder with header; quotes only around cells that hold a comma or a quote."""
    out = usage.select(iso(F.col("timestamp")).alias("timestamp"), *EXPORT_COLUMNS)
    out.write.option("header", "true").option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").mode("overwrite").csv(path)


def write_report(report: dict[str, DataFrame], path: str, *, as_json: bool = False) -> None:
    """Every section as its own Parquet folder, or as JSON lines."""
    for name, df in report.items():
        w = df.write.mode("overwrite")
        (w.json if as_json else w.parquet)(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
