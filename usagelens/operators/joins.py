"""Usage joined with commits, chat titles and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.functions import exact as X, text as S
from usagelens.operators import aggregates as A, common as C
from usagelens.operators.percentiles import exact_percentiles
from usagelens.schema import enrich
from usagelens.session import cut_lineage
from usagelens.sources.side_tables import commits_source

SLICE_US = 900_000_000
# Up to this many commits their index is sent to every task: at most 18 rows and one time per commit, about 40 MB.
BROADCAST_COMMITS = 20_000


def _slot(us):
    return F.call_function("div", us - F.pmod(us, F.lit(SLICE_US)), F.lit(SLICE_US))


def commit_index(commits: DataFrame, keys=(), *, reach: int) -> DataFrame:
    """One row per quarter-hour slice of a project that a commit can claim: the sorted commit times in the
    slice (`own`), and the first commit after it that reaches back into it (`next`).

    Only the first commit of a slice can be the next one of an earlier slice, so it alone is copied back;
    no commit list of a project is sorted or held as a whole."""
    by = [*keys, "project_dir"]
    own = commits.groupBy(*by, _slot(F.col("us")).alias("slice")).agg(F.sort_array(F.collect_set("us")).alias("own"))
    first = F.get("own", F.lit(0))
    # The slice of the commit itself comes along with its times, earlier ones with the first time only.
    spread = own.withColumn("_at", F.explode(F.sequence(_slot(first - reach), F.col("slice"))))
    home = F.col("_at") == F.col("slice")
    return spread.groupBy(*by, F.col("_at").alias("slice")).agg(
        F.coalesce(F.first(F.when(home, F.col("own")), ignorenulls=True), F.array().cast("array<bigint>")).alias("own"),
        F.min(F.when(~home, first)).alias("next"),
    )


def commit_cost(
    usage: DataFrame, commits: DataFrame, *, as_of, keys=(), since_days: int = 14, max_hours: int = 4, top: int | None = None
) -> DataFrame:
    """Cost of the work that led up to each commit: a record belongs to the first commit
    of its project at or after it, no more than `max_hours` later.

    Each record looks its commit up in the index row of its own slice, so records are neither
    sorted nor gathered by project: with few commits they are summed by (commit, session) in the
    task that reads them, with many they are first dealt by slice to a hash of the index.
    """
    keys = list(keys)
    reach = max_hours * C.US_PER_HOUR
    by = [*keys, "project_dir"]
    at = S.micros("timestamp")
    # Among commits of one instant the first by id takes all.
    recent = commits_source(commits, as_of=as_of, since_days=since_days).groupBy(*by, at.alias("us")).agg(
        F.min_by(F.struct("sha", "message", "author"), "sha").alias("commit")
    )
    few = recent.select("us").limit(BROADCAST_COMMITS + 1).count() <= BROADCAST_COMMITS
    index = commit_index(recent.select(*by, "us"), keys, reach=reach)
    index = F.broadcast(index) if few else index.hint("shuffle_hash")
    rows = (
        C.since(enrich(usage), as_of, (since_days * 24 + max_hours) * 10_000)
        .where(F.coalesce("project_dir", F.lit("")) != "")
        .select(*by, at.alias("rec_us"), "session_id", "total_tokens", "cost_nano")
        .withColumn("slice", _slot(F.col("rec_us")))
    )
    own = F.get(F.filter("own", lambda t: t >= F.col("rec_us")), F.lit(0))
    hits = rows.join(index, [*by, "slice"]).withColumn("us", F.coalesce(own, "next"))
    per_session = (
        hits.where(F.col("us") - F.col("rec_us") < reach)
        .groupBy(*by, "us", "session_id")
        .agg(F.sum("total_tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano"))
    )
    matched = (
        per_session.groupBy(*by, "us")
        .agg(F.sum("tokens").alias("tokens"), F.sum("cost_nano").alias("cost_nano"), F.count(F.lit(1)).alias("sessions"))
        .where(F.col("tokens") > 0)
        .withColumn("cost_e4", X.cost_e4("cost_nano"))
    )
    # Texts of commits join the sums, they do not travel with the records.
    out = matched.join(recent, [*by, "us"]).select(
        *by, S.last_segment("project_dir").alias("project_label"),
        F.substring("commit.sha", 1, 8).alias("sha"), S.from_micros("us").alias("timestamp"),
        F.col("commit.message").alias("message"), F.col("commit.author").alias("author"),
        "tokens", X.scaled("cost_e4", 4).alias("cost_usd"), "sessions", "cost_e4",
    )
    out = C.top_n(out, keys, [F.desc("cost_e4"), F.asc("sha"), F.asc("project_dir")], top)
    return out.drop("cost_e4")


def commit_summary(matched: DataFrame, *, as_of=None, keys=()) -> DataFrame:
    """Median and mean over all matched commits, without collecting them. The attribution runs once:
    its result, a row per commit, is written and read by the sums and both medians."""
    keys = list(keys)
    m = cut_lineage(matched.select(*keys, "project_dir", "tokens", F.round(F.col("cost_usd") * 10_000).cast("bigint").alias("cost_e4")))
    plain = m.groupBy(*keys).agg(
        F.coalesce(X.round_div(F.sum("cost_e4"), F.count(F.lit(1))), F.lit(0).cast("bigint")).alias("_mean"),
        F.count(F.lit(1)).alias("total_commits_matched"),
        F.count_distinct("project_dir").alias("projects_matched"),
    )
    cost = exact_percentiles(m, "cost_e4", (50,), keys=keys).select(*keys, F.col("p50_x100").alias("_cost"))
    tokens = exact_percentiles(m, "tokens", (50,), keys=keys).select(*keys, F.col("p50_x100").alias("_tokens"))
    out = C.null_safe_join(C.null_safe_join(plain, cost, keys), tokens, keys)
    zero = F.lit(0).cast("bigint")
    return out.select(
        *keys,
        X.scaled(F.coalesce(X.round_div("_cost", 100), zero), 4).alias("median_cost_usd"),
        F.coalesce(X.idiv("_tokens", 100), zero).alias("median_tokens"),
        X.scaled("_mean", 4).alias("mean_cost_usd"),
        "total_commits_matched", "projects_matched",
    )


def enrich_titles(rows: DataFrame, titles: DataFrame, *, as_of=None, keys=("session_id",)) -> DataFrame:
    """Attach chat titles; rows of unknown sessions keep NULL. No join hint: the title
    table grows with the fleet, so adaptive execution picks the side by its real size."""
    return rows.join(titles.select(*keys, F.col("title").alias("chat")), list(keys), "left")


def sessions_with_errors(usage: DataFrame, errors: DataFrame, *, as_of, keys=(), limit: int | None = 200, lookback_hours: int = 24) -> DataFrame:
    """Newest sessions with their recent error counts."""
    s = A.by_session(usage, as_of=as_of, keys=keys, limit=limit)
    e = A.errors_by_session(errors, as_of=as_of, keys=keys, lookback_hours=lookback_hours)
    return s.join(e, [*keys, "session_id"], "left").fillna(0, ["error_count"])
