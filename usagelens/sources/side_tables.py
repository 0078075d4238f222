"""Chat titles and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.operators.common import as_ts

TITLE_SCHEMA = "cliSessionId string, title string, titleSource string"
MESSAGE_CHARS = 90


def read_chat_titles(spark: SparkSession, root: str) -> DataFrame:
    """Title documents, one JSON file each."""
    docs = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "local_*.json").text(root, wholetext=True)
    j = F.from_json("value", TITLE_SCHEMA)
    rows = docs.select(F.col("_metadata.file_path").alias("file"), j.alias("j"))
    return rows.select("file", F.col("j.cliSessionId").alias("session_id"), F.col("j.title").alias("title"), F.col("j.titleSource").alias("title_source"))


def chat_titles(docs: DataFrame, *, as_of=None, keys=("session_id",)) -> DataFrame:
    """One title per session: the last one a user set, else the first."""
    title = F.trim(F.coalesce("title", F.lit("")))
    named = docs.withColumn("title", title).where(title != "")
    for k in keys:
        named = named.where(F.coalesce(k, F.lit("")) != "")
    by_user = F.max_by("title", F.when(F.col("title_source") == "user", F.col("file")))
    first = F.min_by("title", "file")
    return named.groupBy(*keys).agg(F.coalesce(by_user, first).alias("title"))


def parse_commit_log(lines: DataFrame) -> DataFrame:
    """Rows of an exported log: sha, epoch seconds, subject, author, tab separated, plus project_dir."""
    parts = F.split("value", "\t")
    ok = (F.size(parts) >= 4) & F.try_element_at(parts, F.lit(2)).rlike(r"^\d+$")
    p = lines.withColumn("_p", parts).where(ok)
    at = F.timestamp_seconds(F.get("_p", F.lit(1)).cast("bigint")).cast("timestamp_ntz")
    return p.select(
        "project_dir", F.get("_p", F.lit(0)).alias("sha"), at.alias("timestamp"),
        F.get("_p", F.lit(2)).alias("message"), F.get("_p", F.lit(3)).alias("author"),
    )


def commits_source(commits: DataFrame, *, as_of, keys=(), since_days: int = 14) -> DataFrame:
    """Commits of the days up to as_of, merges left out where the table marks them."""
    at = F.col("timestamp")
    recent = commits.where((at >= as_ts(as_of) - F.make_dt_interval(days=F.lit(since_days))) & (at <= as_ts(as_of)))
    if "is_merge" in commits.columns:
        recent = recent.where(~F.col("is_merge"))
    return recent.withColumn("message", F.substring("message", 1, MESSAGE_CHARS))
