"""Batch job: read logs, write the usage table and the report sections.

    spark-submit usagelens/job.py --agent-a DIR:DEVICE --agent-b DIR:DEVICE --as-of TS --out DIR
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.operators.common import until
from usagelens.operators.normalize import latest_rate_limits
from usagelens.plans.ingest import load_increment
from usagelens.plans.report import build_report
from usagelens.session import configure
from usagelens.sources.sinks import write_report
from usagelens.sources.side_tables import chat_titles, read_chat_titles
from usagelens.sources.tables import read_usage, write_usage


def _roots(values):
    """DIR:DEVICE or DIR:DEVICE:ACCOUNT."""
    out = []
    for v in values or []:
        folder, *rest = v.split(":") if v.count(":") <= 2 else v.rsplit(":", 2)
        if not rest:
            raise ValueError(f"{v}: a log folder needs a device, as in DIR:DEVICE or DIR:DEVICE:ACCOUNT")
        out.append((folder, *rest))
    return out


def run(
    spark: SparkSession, *, agent_a, agent_b, as_of: str, out: str, keys=(), titles: str | None = None, commits: DataFrame | None = None, sections=None,
    store: str | None = None, account: str = "", since_days: int = 0, plan: str | None = None, per_source: bool = False,
) -> dict[str, dict[str, int]]:
    """Reads what is new in the log folders into the store (by default `out`/store), then writes the usage table, the quarantine
    of lines that could not be read, and the report sections with a section `meta`; with `per_source` also a report of each agent, under
    `out`/sources. Returns per agent how many files were skipped, appended to, reloaded, new."""
    configure(spark)
    store = store or f"{out}/store"
    loaded, counts = [], {}
    for source, roots in (("agent_a", agent_a), ("agent_b", agent_b)):
        if roots:
            found, counts[source] = load_increment(spark, store, source, roots, account=account, as_of=as_of, since_days=since_days)
            loaded += [found] if found else []
    if not counts:
        raise ValueError("no log folders given")
    if not loaded:
        return counts
    write_usage(reduce(DataFrame.unionByName, [x.usage for x in loaded]), f"{out}/usage")
    reduce(DataFrame.unionByName, [x.quarantine for x in loaded]).write.mode("overwrite").parquet(f"{out}/quarantine")
    usage = read_usage(spark, f"{out}/usage")
    errors = next((x.errors for x in loaded if x.errors is not None), None)
    said = reduce(DataFrame.unionByName, [x.intents for x in loaded])
    # A session that both agents know keeps one intent (per key), so it stays one row of the report.
    said = said.groupBy(*[k for k in keys if k in said.columns], "session_id")
    intents = said.agg(F.min_by("intent", F.struct("intent_at", "intent")).alias("intent"), F.min("intent_at").alias("intent_at"))
    names = chat_titles(read_chat_titles(spark, titles)) if titles else None
    given = dict(as_of=as_of, keys=tuple(keys), intents=intents, titles=names, commits=commits, plan=plan, sections=sections)
    report = build_report(usage, errors=errors, **given)
    for x in loaded:
        if x.rate_limits is not None:
            report["rate_limits"] = latest_rate_limits(x.rate_limits, as_of=as_of)
    report["ingest_quality"] = reduce(DataFrame.unionByName, [x.quality for x in loaded])
    report["meta"] = _meta(usage, report["ingest_quality"], as_of, plan)
    write_report(report, f"{out}/report")
    for source in counts if per_source else ():
        mine = usage.where(F.col("source") == source)
        parts = build_report(mine, errors=errors.where(F.col("source") == source) if errors is not None else None, **given)
        parts["meta"] = _meta(mine, report["ingest_quality"].where(F.col("source") == source), as_of, plan)
        write_report(parts, f"{out}/sources/{source}")
    return counts


def _meta(usage: DataFrame, quality: DataFrame, as_of, plan) -> DataFrame:
    """One row: the moment, the plan, and what the report was made from."""
    records = until(usage, as_of).agg(F.count("*").alias("record_count"), F.min("timestamp").alias("first_record_at"), F.max("timestamp").alias("last_record_at"))
    files = quality.agg(
        F.count("*").alias("files_scanned"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("parse_errors", "error_events_count", "undated_lines")]
    )
    return records.join(files).select(F.lit(str(as_of)).alias("as_of"), F.lit(plan).cast("string").alias("plan"), "*")


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--agent-a", action="append", metavar="DIR:DEVICE[:ACCOUNT]")
    p.add_argument("--agent-b", action="append", metavar="DIR:DEVICE[:ACCOUNT]")
    p.add_argument("--account", default="", help="of log folders that name none")
    p.add_argument("--since-days", type=int, default=0, help="leave out files not changed for that long; 0 reads all")
    p.add_argument("--store", help="folder of what was read before; by default OUT/store")
    p.add_argument("--titles")
    p.add_argument("--commits", help="Parquet table of commits (project_dir, timestamp, sha, message, author)")
    p.add_argument("--plan")
    p.add_argument("--as-of", required=True)
    p.add_argument("--key", action="append", default=[])
    p.add_argument("--per-source", action="store_true", help="also a report of each agent by itself")
    p.add_argument("--out", required=True)
    a = p.parse_args()
    spark = SparkSession.builder.appName("usagelens").getOrCreate()
    run(
        spark, agent_a=_roots(a.agent_a), agent_b=_roots(a.agent_b), as_of=a.as_of, out=a.out, keys=a.key, titles=a.titles, store=a.store, account=a.account,
        since_days=a.since_days, plan=a.plan, per_source=a.per_source, commits=spark.read.parquet(a.commits) if a.commits else None,
    )


if __name__ == "__main__":
    main()
