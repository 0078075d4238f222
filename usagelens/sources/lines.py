"""Log files as rows of (value, source_file, line_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from usagelens.operators.common import as_ts


def position() -> Column:
    """Order of a line within its file: byte offset of its split plus its row number in
    the task. A task reads at most one split's worth of bytes, so numbers of an earlier
    split stay below the next split's offset."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + row


def read_lines(
    spark: SparkSession, root: str, *, pattern: str = "*.jsonl", as_of=None, since_days: int = 0
) -> DataFrame:
    """Non-blank lines of all matching files under `root`; with since_days, only files
    modified that recently. The file time is a metadata filter, so old files are not opened."""
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(root)
    )
    if since_days > 0:
        cutoff = as_ts(as_of) - F.make_dt_interval(days=F.lit(since_days))
        raw = raw.where(F.col("_metadata.file_modification_time").cast("timestamp_ntz") >= cutoff)
    lines = raw.select("value", F.col("_metadata.file_path").alias("source_file"), position().alias("line_no"))
    return lines.where(F.trim("value") != "")


def file_lookback(files: DataFrame, *, as_of, since_days: int = 90) -> DataFrame:
    """Files (or their lines) with `modified_at` inside the look-back; 0 or less keeps all."""
    if since_days <= 0:
        return files
    return files.where(F.col("modified_at") >= as_ts(as_of) - F.make_dt_interval(days=F.lit(since_days)))


def union_roots(roots: list[tuple[DataFrame, str]]) -> DataFrame:
    """Records of several roots, tagged with device and rank; the first root is the main one."""
    out = None
    for rank, (df, device) in enumerate(roots):
        tagged = df.withColumns({"device": F.lit(device), "root_rank": F.lit(rank)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def plan_incremental(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """What to do with each listed file given the manifest of the last run (path,
    modified_at, size): skip, append (grown), reload (shrunk or rewritten), or new."""
    old = manifest.select("path", F.col("modified_at").alias("_m"), F.col("size").alias("_s"))
    action = (
        F.when(F.col("_s").isNull(), "new")
        .when((F.col("_m") == F.col("modified_at")) & (F.col("_s") == F.col("size")), "skip")
        .when(F.col("size") > F.col("_s"), "append")
        .otherwise("reload")
    )
    start = F.when(action == "append", F.col("_s")).otherwise(F.lit(0).cast("bigint"))
    return listing.join(old, "path", "left").select("path", "modified_at", "size", action.alias("action"), start.alias("from_offset"))


def merge_increment(current: DataFrame, plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace the rows of every re-read file by its fresh rows; other rows stay."""
    touched = plan.where(F.col("action") != "skip").select(F.col("path").alias("source_file"))
    return current.join(touched, "source_file", "left_anti").unionByName(fresh.join(touched, "source_file", "left_semi"))
