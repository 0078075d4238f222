"""Pieces every operator uses."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.functions import exact as X

TOKEN_FIELDS = (
    "input_tokens",
    "output_tokens",
    "cache_creation_tokens",
    "cache_read_tokens",
    "total_tokens",
)

# Record order inside equal timestamps.
RECORD_ORDER = ("timestamp", "source_file", "line_no", "message_id")

US_PER_HOUR = 3_600_000_000

# Look-back windows for burn rates: label and length in 1e-4 hours.
BURN_WINDOWS = (("0.0833", 833), ("0.25", 2500), ("1", 10000), ("2", 20000), ("4", 40000), ("6", 60000))

ACTIVE_DAY_E4 = 5_000          # a day above $0.50 counts as active


def moment(as_of: datetime | str) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)


def as_ts(as_of: datetime | str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{moment(as_of)}'")


def as_date(as_of) -> Column:
    return F.expr(f"DATE '{moment(as_of).date()}'")


def cutoff(as_of, hours_e4: int) -> str:
    """SQL literal of the time hours_e4 ten-thousandths of an hour before as_of."""
    return f"TIMESTAMP_NTZ '{moment(as_of) - timedelta(microseconds=hours_e4 * 360_000)}'"


def hours_before(as_of, hours_e4: int) -> Column:
    return F.expr(cutoff(as_of, hours_e4))


def recent(as_of, hours_e4: int) -> str:
    """SQL condition of the look-back window, which ends at as_of."""
    return f"(timestamp >= {cutoff(as_of, hours_e4)} AND timestamp <= {cutoff(as_of, 0)})"


def until(df: DataFrame, as_of) -> DataFrame:
    """Rows known at as_of: later ones drop out, those without a time stay; all rows without as_of.
    The date predicate lets a table partitioned by date skip the partitions after it."""
    if as_of is None:
        return df
    cond = f"(timestamp <= {cutoff(as_of, 0)} OR timestamp IS NULL)"
    if "date" in df.columns:
        cond = f"(date <= DATE '{moment(as_of).date()}' OR date IS NULL) AND {cond}"
    return df.where(cond)


def since(df: DataFrame, as_of, hours_e4: int) -> DataFrame:
    """Rows of the look-back window. The date predicate lets a table partitioned by date
    skip the partitions outside it."""
    cond = recent(as_of, hours_e4)
    if "date" in df.columns:
        day = (moment(as_of) - timedelta(microseconds=hours_e4 * 360_000)).date()
        cond = f"date BETWEEN DATE '{day}' AND DATE '{moment(as_of).date()}' AND {cond}"
    return df.where(cond)


def maybe_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast `df` if a bounded count shows it is small, else leave the join to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def record_order() -> Column:
    return F.struct(*RECORD_ORDER)


def sum_when(value: str, cond: str, alias: str) -> Column:
    return F.expr(f"coalesce(sum({value}) FILTER (WHERE {cond}), 0L) AS {alias}")


def totals_aggs(when: str = "true", prefix: str = "") -> list[Column]:
    """Sums behind one totals block, optionally only over rows that match a condition."""
    f = "" if when == "true" else f" FILTER (WHERE {when})"
    out = [F.expr(f"coalesce(sum({c}){f}, 0L) AS {prefix}{c}") for c in (*TOKEN_FIELDS, "cost_nano")]
    return [*out, F.expr(f"count(1){f} AS {prefix}messages")]


def hit_rate(prefix: str = "") -> Column:
    """Cache reads over all input-side tokens."""
    read = prefix + "cache_read_tokens"
    return F.expr(X.ratio_sql(read, f"({read} + {prefix}input_tokens + {prefix}cache_creation_tokens)", 4))


def totals_out(prefix: str = "") -> list[Column]:
    return [
        *[F.col(prefix + c).alias(c) for c in TOKEN_FIELDS],
        F.expr(X.usd4_sql(prefix + "cost_nano")).alias("cost_usd"),
        F.col(prefix + "messages").alias("messages"),
        hit_rate(prefix).alias("cache_hit_rate"),
    ]


def top_n(df: DataFrame, keys, order: list[Column], n: int | None) -> DataFrame:
    """First n rows per key. Without keys this is one TakeOrderedAndProject; with keys
    the row_number filter lets Spark cut each task to n rows per key before the shuffle."""
    if n is None:
        return df
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def with_grid(df: DataFrame, keys, cell: str, size: int, zero_fill) -> DataFrame:
    """Left join df onto every (key, 0..size-1) cell; `zero_fill` columns become 0."""
    spark = df.sparkSession
    if keys:
        frame = df.select(*keys).distinct().withColumn(cell, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    else:
        frame = spark.range(size).select(F.col("id").cast("int").alias(cell))
    return frame.join(df, [*keys, cell], "left").fillna(0, subset=list(zero_fill))


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join one-row-per-key frames; without keys both sides are single rows."""
    if keys:
        return left.join(right, list(keys), how)
    one = F.lit(1).alias("_one")
    return left.select("*", one).join(right.select("*", one), "_one", how).drop("_one")
