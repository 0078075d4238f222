"""Exact percentiles of raw records without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.functions import exact as X


def exact_percentiles(df: DataFrame, value: str, percents=(50, 90), *, keys=(), bucket_bits: int = 16) -> DataFrame:
    """Linear-interpolation percentiles (times 100, integer) of an integer column per key.

    Records first collapse to counts per value. Counts of value buckets locate the
    buckets that hold the wanted ranks; only values inside those are put in order, and
    a bucket has at most 2**bucket_bits of them however large its group is.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("bigint").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_b", F.shiftright("_v", bucket_bits))
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    w = Window.partitionBy(*keys).orderBy("_b")
    buckets = buckets.withColumns({
        "_end": F.sum("_bn").over(w),
        "_total": F.sum("_bn").over(Window.partitionBy(*keys)),
    })
    # Zero-based ranks of both neighbours of every percentile.
    pos = [F.lit(p) * (F.col("_total") - 1) for p in percents]
    ranks = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), F.lit(hi).alias("hi"), (p % 100).alias("frac"),
                F.least(F.call_function("div", p, F.lit(100)) + hi, F.col("_total") - 1).alias("rank"),
            )
            for i, p in enumerate(pos) for hi in (0, 1)
        ]
    )
    wanted = (
        buckets.withColumn("_r", F.explode(ranks))
        .where((F.col("_r.rank") >= F.col("_end") - F.col("_bn")) & (F.col("_r.rank") < F.col("_end")))
        .groupBy(*keys, "_b", "_total", (F.col("_end") - F.col("_bn")).alias("_before"))
        .agg(F.collect_list("_r").alias("_ranks"))           # at most 2 per percentile
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    ordered = (
        counts.join(wanted, [*keys, "_b"])
        .withColumn("_last", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_r", F.explode("_ranks"))
        .where((F.col("_r.rank") >= F.col("_last") - F.col("_n")) & (F.col("_r.rank") < F.col("_last")))
    )
    weight = F.when(F.col("_r.hi") == 1, F.col("_r.frac")).otherwise(100 - F.col("_r.frac"))
    return ordered.groupBy(*keys).agg(
        F.max("_total").alias("samples"),
        *[F.sum(F.when(F.col("_r.i") == i, F.col("_v") * weight)).alias(f"p{p}_x100") for i, p in enumerate(percents)],
    )
