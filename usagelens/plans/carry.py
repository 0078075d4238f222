"""Carrying values forward along ordered rows whose groups may be very large.

A plain `last_value` window sorts a whole group in one task. Here the order is cut into
chunks: the window runs inside (group, chunk), one row per chunk carries the running
state across, and a join on (group, chunk) brings it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def carry_forward(df: DataFrame, by, chunk: str, order, *, upto=(), ahead=()) -> DataFrame:
    """Add `<c>_carried`, the last non-null value up to each row, for `upto` columns and
    `<c>_prev`, the same up to the row before, for `ahead` columns. `chunk` must rise
    with `order`."""
    by, order, columns = list(by), list(order), [*upto, *ahead]
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    lasts = df.groupBy(*by, chunk).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias("_l_" + c) for c in columns])
    across = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*by, chunk, *[F.last("_l_" + c, ignorenulls=True).over(across).alias("_c_" + c) for c in columns])
    inside = Window.partitionBy(*by, chunk).orderBy(*order)

    def pick(c, end):
        w = inside.rowsBetween(Window.unboundedPreceding, end)
        return F.coalesce(F.last(c, ignorenulls=True).over(w), F.col("_c_" + c))

    added = {c + "_carried": pick(c, 0) for c in upto} | {c + "_prev": pick(c, -1) for c in ahead}
    return df.join(carried, [*by, chunk]).withColumns(added).drop(*["_c_" + c for c in columns])


def running_index(df: DataFrame, by, chunk: str, order, name: str) -> DataFrame:
    """Zero-based position of each row in its group, from per-chunk counts."""
    by, order = list(by), list(order)
    counts = df.groupBy(*by, chunk).agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, chunk, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*by, chunk).orderBy(*order)
    return df.join(offsets, [*by, chunk]).withColumn(name, F.col("_o") + F.row_number().over(inside) - 1).drop("_o")
