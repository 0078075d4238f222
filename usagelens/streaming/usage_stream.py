"""Usage as a stream: new log files, or new lines of growing ones, in; deduplicated records out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.operators import normalize as N
from usagelens.plans.ingest import conform
from usagelens.plans.turns import resolve_turns
from usagelens.session import importable
from usagelens.sources import agent_a as SA, agent_b as SB
from usagelens.sources.tail import LogTail


def read_line_stream(spark: SparkSession, root: str, *, pattern: str = "*.jsonl", max_files: int | None = None) -> DataFrame:
    """New files under `root` as (value, source_file). Line numbers need a whole file, so
    the stream keeps none; turns are resolved by the batch job."""
    r = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    lines = r.text(root).select("value", F.col("_metadata.file_path").alias("source_file"), F.lit(None).cast("bigint").alias("line_no"))
    return lines.where(F.trim("value") != "")


def stream_usage(records: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Drop repeated message ids within the watermark. State is bounded by `delay`; later
    replays are left to the batch deduplication. `timestamp` becomes TIMESTAMP, which a
    watermark needs."""
    typed = records.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    own = F.concat_ws("|", "source_file", "uuid")
    keyed = typed.withColumn("_id", F.when(F.coalesce("message_id", F.lit("")) == "", own).otherwise(F.col("message_id")))
    return keyed.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["_id"]).drop("_id")


def agent_a_stream(lines: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    return stream_usage(SA.usage_records(SA.parse_lines(lines)), delay=delay)


def run_available(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Process what is there and stop; Parquet output, exactly once by the checkpoint."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def tail_lines(spark: SparkSession, root: str, *, pattern: str = "*.jsonl", wanted: tuple[str, ...] = ()) -> DataFrame:
    """Lines of growing files under `root` as (value, source_file, line_no)."""
    importable(spark)
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").options(root=root, pattern=pattern, wanted=",".join(wanted), tasks=spark.sparkContext.defaultParallelism).load()


def run_usage_stream(lines: DataFrame, path: str, checkpoint: str, *, source: str, device: str = "", account: str = "") -> None:
    """Adds the records of what is there to `path` and stops. `lines` is a stream of (value, source_file, line_no) of one agent,
    in any order within a batch; a line of a file comes no later than those after it.

    A batch writes its decoded lines, its records and, for agent B, a row per file with what later lines need (model, turn, last usage,
    session, number of records). Each is a table per batch id and overwritten on a retry, so lost executors or a lost
    driver neither lose nor repeat a record. Copies inside a batch go here, copies between batches in `read_usage_stream`: no
    watermark, hence nothing is too late, and the earliest copy counts as in the batch job.
    """

    def own(df: DataFrame) -> DataFrame:
        return df.withColumns({"source": F.lit(source), "device": F.lit(device), "account": F.lit(account), "root_rank": F.lit(0)})

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def kept(df: DataFrame, name: str) -> DataFrame:
            at = f"{path}/{name}/batch={batch_id}"
            df.write.mode("overwrite").parquet(at)
            return spark.read.schema(df.schema).parquet(at)

        if source == "agent_a":
            found = kept(own(SA.compact(SA.parse_lines(batch.withColumn("raw", F.col("value"))))), "lines")
            kept(N.dedup_message(SA.compact_records(found)).withColumn("turn_id", F.lit("")), "records")
            return
        before = spark.read.parquet(f"{path}/state/batch={batch_id - 1}") if batch_id > 0 else None
        events = kept(own(SB.compact(SB.parse_events(batch))), "lines")
        records = kept(SB.usage_records(events, before=before), "all_records")
        kept(N.dedup_replay(records), "records")
        kept(SB.file_state(events, records, before), "state")

    q = lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_usage_stream(spark: SparkSession, path: str, source: str) -> DataFrame:
    """The usage table of all batches so far, every record once."""
    records = spark.read.option("basePath", f"{path}/records").parquet(f"{path}/records").drop("batch")
    if source == "agent_a":
        lines = spark.read.option("basePath", f"{path}/lines").parquet(f"{path}/lines")
        chain = lines.select(F.col("source_file").alias("file"), "uuid", "parent_uuid", "line_no", "is_human")
        return conform(N.dedup_message(SA.with_turns(records.drop("turn_id"), resolve_turns(chain))), source, "")
    return conform(N.dedup_replay(records), source, "")
