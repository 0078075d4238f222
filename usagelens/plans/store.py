"""Incremental ingest: a store of what was decoded from log files, to which a run adds the new bytes of changed files.

A file is a chain of segments, one per run that read it; a segment tells from which byte the run read it, where its last whole line ended, and what stood
before that byte. A run lists the files, leaves alone those of unchanged time and size, reads a grown file from the end of its last whole line, and
a shrunk or rewritten one whole, under a new generation. Decoded lines (without their texts) are appended in a folder per run, and
never rewritten: a line counts if its segment is of its file's current generation and ends where the next one begins. So a last line without its
line feed counts as it is, and is replaced when the file goes on. What the lines add up to (duplicates, turns, state carried
along a file) is derived from the decoded lines of all runs and equals what one run over all files gives.

A run is valid once its segment table is written, which comes last; a run that failed leaves a folder that the next one overwrites.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from usagelens.sources import agent_a as SA, agent_b as SB, lines as SL, ranges as R

_SEGMENT = "source string, path string, device string, root_rank int, account string, generation long, from_offset long, offset long, size long, modified_at timestamp_ntz, mark string, run long"

#: Per source the files that belong to it, and the texts of which a line worth decoding has one (none: every line is decoded).
SOURCES = {"agent_a": ("*.jsonl", ()), "agent_b": (SB.FILE_PATTERN, SB.INTEREST)}


@dataclass(frozen=True)
class Root:
    """A log folder, and whose files it holds. The first root of a source is the main one and wins duplicates."""

    folder: str
    device: str
    account: str = ""
    pattern: str | None = None


class IngestStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str | None = None) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema) if schema else None

    def segments(self, source: str | None = None) -> DataFrame:
        """Segments of the current generation of every file, with `until`: where the next one begins."""
        found = self._table("segments", _SEGMENT)
        found = found.select(*(c.split()[0] for c in _SEGMENT.split(", "))).where(F.col("source") == source) if source else found
        key = Window.partitionBy("source", "path")
        current = found.withColumn("_last", F.max("generation").over(key)).where("generation = _last").drop("_last")
        return current.withColumn("until", F.lead("from_offset").over(key.orderBy("run")))

    def plan(self, source: str, roots: list[Root], as_of=None, since_days: int = 0) -> DataFrame:
        """Every listed file with what to do: skip, append, reload or new. A file under several roots belongs to the first."""
        tagged = [
            SL.file_lookback(R.list_files(self.spark, r.folder, r.pattern or SOURCES[source][0]), as_of=as_of, since_days=since_days)
            .withColumns({"device": F.lit(r.device), "root_rank": F.lit(i), "account": F.lit(r.account)})
            for i, r in enumerate(roots)
        ]
        listing = tagged[0]
        for more in tagged[1:]:
            listing = listing.unionByName(more)
        listing = listing.groupBy("path").agg(F.min_by(F.struct("modified_at", "size", "device", "root_rank", "account"), "root_rank").alias("f")).select("path", "f.*")
        known = self.segments(source).where("until IS NULL").select("path", "modified_at", "size", "offset", "mark", F.col("generation").alias("old_generation"))
        todo = SL.plan_incremental(listing, known).drop("from_offset")
        told = listing.select("path", "device", "root_rank", "account")
        start = F.when(F.col("action") == "append", F.col("offset")).otherwise(F.lit(0).cast("bigint"))
        return todo.join(told, "path").join(known.drop("modified_at", "size"), "path", "left").withColumn("from_offset", start).drop("offset")

    def update(self, source: str, roots: list[Root], *, as_of=None, since_days: int = 0) -> dict[str, int]:
        """Reads what is new and returns how many files were skipped, appended to, reloaded, new."""
        if since_days > 0 and as_of is None:
            raise ValueError("a look-back of since_days needs as_of")
        run = (self._table("segments", _SEGMENT).agg(F.max("run")).first()[0] or 0) + 1
        plan = self.plan(source, roots, as_of, since_days)
        at = f"{self.path}/plans/{source}/run={run}"
        R.settle(plan.where("action <> 'skip'")).write.mode("overwrite").parquet(at)
        changed = self.spark.read.parquet(at)
        counts = {r["action"]: r["count"] for r in changed.groupBy("action").count().collect()}
        counts["skip"] = plan.where("action = 'skip'").count()
        if len(counts) > 1:
            lines = R.read_ranges(changed, SOURCES[source][1])
            self._decoded(source, lines).write.mode("overwrite").parquet(f"{self.path}/{source}/run={run}")
            whole = F.expr("action <> 'append'")
            generation = F.when(whole, F.lit(run).cast("bigint")).otherwise(F.col("old_generation"))
            rows = changed.withColumns({"source": F.lit(source), "generation": generation})
            rows.select(*(c.split()[0] for c in _SEGMENT.split(", ")[:-1])).coalesce(8).write.mode("overwrite").parquet(f"{self.path}/segments/run={run}")
        return counts

    @staticmethod
    def _decoded(source: str, lines: DataFrame) -> DataFrame:
        if source == "agent_a":
            return SA.compact(SA.parse_lines(lines.withColumn("raw", F.col("value"))))
        return SB.compact(SB.parse_events(lines, with_bad=True)).withColumnRenamed("file", "source_file")

    def lines(self, source: str, only: DataFrame | None = None) -> DataFrame | None:
        """The decoded lines that count, with device, root_rank and account of their file; `only` (path) are the files that still exist.
        None if nothing was ever read."""
        rows = self._table(source)
        if rows is None:
            return None
        segments = self.segments(source)
        if only is not None:
            segments = segments.join(only.select("path"), "path", "left_semi")
        valid = segments.select(F.col("path").alias("source_file"), "run", "device", "root_rank", "account", "source", "from_offset", "until")
        rows = rows.join(valid, ["source_file", "run"]).where("line_no >= from_offset AND (until IS NULL OR line_no < until)")
        return rows.drop("run", "from_offset", "until")
