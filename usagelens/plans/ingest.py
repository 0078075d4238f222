"""From log folders to the usage table and its side tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.operators import normalize as N
from usagelens.plans.store import IngestStore, Root
from usagelens.plans.turns import resolve_turns
from usagelens.schema import USAGE_SCHEMA
from usagelens.session import cut_lineage
from usagelens.sources import agent_a as SA, agent_b as SB, lines as SL


@dataclass
class Loaded:
    """Everything one source yields."""

    usage: DataFrame
    intents: DataFrame
    errors: DataFrame | None = None
    quality: DataFrame | None = None
    rate_limits: DataFrame | None = None
    quarantine: DataFrame | None = None


def conform(records: DataFrame, source: str, account: str) -> DataFrame:
    """Exactly the usage schema; a source registry entry ends here."""
    if "source" not in records.columns:
        records = records.withColumn("source", F.lit(source))
    if "account" not in records.columns:
        records = records.withColumn("account", F.lit(account))
    return records.select(*[F.col(f.name).cast(f.dataType) for f in USAGE_SCHEMA])


def _read_roots(spark, roots, pattern, as_of, since_days, account) -> DataFrame:
    if since_days > 0 and as_of is None:
        raise ValueError("a look-back of since_days needs as_of")
    tagged = [
        (SL.read_lines(spark, path, pattern=pattern, as_of=as_of, since_days=since_days).withColumn("account", F.lit(own[0] if own else account)), device)
        for path, device, *own in roots
    ]
    return SL.union_roots(tagged)


_OWNER = ("account", "source", "device")


def derive_agent_a(lines: DataFrame) -> Loaded:
    """Everything from compact lines (a written table) with account, source, device and root_rank."""
    chain = lines.select(F.col("source_file").alias("file"), "uuid", "parent_uuid", "line_no", "is_human")
    records = SA.with_turns(SA.compact_records(lines), resolve_turns(chain))
    return Loaded(
        usage=conform(N.dedup_message(records, keys=("account",)), "agent_a", ""),
        intents=SA.compact_intents(lines, _OWNER),
        errors=SA.compact_errors(lines, _OWNER),
        quality=SA.compact_quality(lines, _OWNER),
        quarantine=lines.where("bad").select(*_OWNER, "source_file", "line_no", F.col("raw").alias("value")),
    )


def derive_agent_b(lines: DataFrame) -> Loaded:
    """Everything from compact events (a written table) with account, source, device and root_rank."""
    lines = lines.withColumnRenamed("source_file", "file")
    events = lines.where("NOT bad")
    return Loaded(
        usage=conform(N.dedup_replay(SB.usage_records(events), keys=("account",)), "agent_b", ""),
        intents=SB.intents(events, _OWNER),
        quality=SB.quality(lines, _OWNER),
        rate_limits=SB.rate_limits(events),
        quarantine=lines.where("bad").select(*_OWNER, F.col("file").alias("source_file"), "line_no", F.col("raw").alias("value")),
    )


def load_agent_a(spark: SparkSession, roots: list[tuple], *, account: str = "", as_of=None, since_days: int = 0) -> Loaded:
    """`roots` are (folder, device) or (folder, device, account); the first is the main one and wins duplicates.

    The text is decoded once; what the later steps need of it is materialized, the text is not."""
    lines = _read_roots(spark, roots, "*.jsonl", as_of, since_days, account).withColumns({"source": F.lit("agent_a"), "raw": F.col("value")})
    return derive_agent_a(cut_lineage(SA.compact(SA.parse_lines(lines))))


def load_agent_b(spark: SparkSession, roots: list[tuple], *, account: str = "", as_of=None, since_days: int = 0) -> Loaded:
    """All files by default: a look-back would drop earlier usage."""
    lines = _read_roots(spark, roots, SB.FILE_PATTERN, as_of, since_days, account).withColumn("source", F.lit("agent_b"))
    events = SB.compact(SB.parse_events(lines, with_bad=True)).withColumnRenamed("file", "source_file")
    return derive_agent_b(cut_lineage(events))


def load_increment(spark: SparkSession, store: str, source: str, roots: list[tuple], *, account: str = "", as_of=None, since_days: int = 0, keep_missing: bool = False) -> tuple[Loaded | None, dict[str, int]]:
    """The same from a store: only new bytes of changed files are read. With `keep_missing` the lines of files that are gone stay.
    Also how many files were skipped, appended to, reloaded and new."""
    book = IngestStore(spark, store)
    places = [Root(folder, device, own[0] if own else account) for folder, device, *own in roots]
    counts = book.update(source, places, as_of=as_of, since_days=since_days)
    only = None if keep_missing else book.plan(source, places)
    lines = book.lines(source, only)
    return (None if lines is None else (derive_agent_a if source == "agent_a" else derive_agent_b)(lines)), counts
