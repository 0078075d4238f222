"""Forward as-of lookup built from a union and one running window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_at_or_after(
    points: DataFrame, probes: DataFrame, by, *, at: str, value: Column, alias: str, strict: bool = False
) -> DataFrame:
    """Give every probe the `value` of the first point with the same `by` whose `at` is
    not before the probe's (`strict`: is after it); NULL when there is none.

    Both sides need the `by` columns and `at`. The frame runs from the latest row to
    the current one, so the cost is one sort per `by` group; a frame that looked ahead
    would be re-evaluated per row. Callers keep `by` groups bounded by a time slice.
    """
    probe_cols = [c for c in probes.columns if c not in (*by, at)]
    left = points.select(*by, at, value.alias("_value"), F.lit(0).alias("_probe"))
    for c in probe_cols:
        left = left.withColumn(c, F.lit(None).cast(probes.schema[c].dataType))
    right = probes.select(*by, at, F.lit(None).cast(left.schema["_value"].dataType).alias("_value"), F.lit(1).alias("_probe"), *probe_cols)
    tie = F.desc("_probe") if strict else F.asc("_probe")
    w = Window.partitionBy(*by).orderBy(F.desc(at), tie).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn(alias, F.last("_value", ignorenulls=True).over(w))
    return both.where(F.col("_probe") == 1).drop("_probe", "_value")
