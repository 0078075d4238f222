"""Live costs from panes: minute sums, written once per batch, from which every minute and every sliding rate is added up.

Sums can be added in any order, so no row comes too late: a row behind the watermark makes a late pane, which is kept, counted, and part of all
figures. A record is in one pane, however many sliding windows overlap it; windows copy panes, not records. A batch overwrites its tables on
a retry, so lost executors or a lost driver neither lose nor repeat a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from usagelens.functions import exact as X
from usagelens.schema import enrich

KEYS = ("source", "device", "model")


def run_panes(usage: DataFrame, path: str, checkpoint: str, *, keys=KEYS, delay_minutes: int = 10) -> None:
    """Adds the minute sums of a stream of usage to `path` and stops when it is drained. A row is late when its time lies more than
    `delay_minutes` before the latest time of the batches before; rows without a time are counted under a null minute."""
    keys = list(keys)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = enrich(batch).withColumn("minute", F.date_trunc("minute", "timestamp").cast("timestamp_ntz"))
        before = spark.read.parquet(f"{path}/clock/batch={batch_id - 1}").first()["latest"] if batch_id > 0 else None
        late = F.lit(False) if before is None else F.coalesce(F.col("timestamp") < F.lit(before) - F.expr(f"INTERVAL {delay_minutes} MINUTE"), F.lit(False))
        panes = at.groupBy("minute", *keys, late.alias("late")).agg(
            F.sum("cost_nano").alias("cost_nano"), F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("timestamp").alias("latest")
        )
        panes.write.mode("overwrite").parquet(f"{path}/panes/batch={batch_id}")
        seen = spark.read.schema(panes.schema).parquet(f"{path}/panes/batch={batch_id}").agg(F.max("latest").alias("latest"))
        clock = seen if before is None else seen.select(F.greatest(F.col("latest"), F.lit(before)).alias("latest"))
        clock.write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")

    q = usage.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _panes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/panes").parquet(f"{path}/panes")


def _closed(df: DataFrame, spark: SparkSession, path: str, end, delay_minutes: int, only_closed: bool) -> DataFrame:
    if not only_closed:
        return df
    clock = spark.read.option("basePath", f"{path}/clock").parquet(f"{path}/clock").agg(F.max("latest").alias("_clock"))
    return df.join(F.broadcast(clock)).where(end <= F.col("_clock") - F.expr(f"INTERVAL {delay_minutes} MINUTE")).drop("_clock")


def minute_costs(spark: SparkSession, path: str, *, keys=KEYS, only_closed: bool = True, delay_minutes: int = 10) -> DataFrame:
    """Cost, tokens and records per minute and key; `only_closed` leaves out the minutes that rows in time may still add to."""
    g = _panes(spark, path).where("minute IS NOT NULL").groupBy("minute", *keys)
    g = g.agg(F.sum("cost_nano").alias("_nano"), F.sum("tokens").alias("tokens"), F.sum("records").alias("records"))
    g = _closed(g, spark, path, F.col("minute") + F.expr("INTERVAL 1 MINUTE"), delay_minutes, only_closed)
    return g.select("minute", *keys, X.usd4("_nano").alias("cost"), "tokens", "records")


def burn_rates(spark: SparkSession, path: str, *, hours_e4: int = 20_000, slide_minutes: int = 5, keys=("source", "device"), only_closed: bool = True, delay_minutes: int = 10) -> DataFrame:
    """Sliding $/h per key, of all windows that hold a record. The window's length must be a multiple of the slide."""
    width = hours_e4 * 36 // 100 // 60
    if width % slide_minutes:
        raise ValueError("the window must be a multiple of the slide")
    first = F.window("minute", f"{slide_minutes} minutes").getField("start").cast("timestamp_ntz")
    slides = _panes(spark, path).where("minute IS NOT NULL").groupBy(first.alias("pane"), *keys).agg(F.sum("cost_nano").alias("_nano"))
    back = F.explode(F.sequence(F.lit(0), F.lit(width // slide_minutes - 1))).alias("_k")
    spread = slides.select(*keys, "pane", "_nano", back).withColumn("window_start", F.expr(f"pane - make_interval(0, 0, 0, 0, 0, _k * {slide_minutes})"))
    sums = spread.groupBy("window_start", *keys).agg(F.sum("_nano").alias("_nano")).withColumn("window_end", F.col("window_start") + F.expr(f"INTERVAL {width} MINUTE"))
    sums = _closed(sums, spark, path, F.col("window_end"), delay_minutes, only_closed)
    return sums.select("window_start", "window_end", *keys, X.scaled(X.per_hour_cents("_nano", F.lit(hours_e4)), 2).alias("cost_per_hour"))


def late_rows(spark: SparkSession, path: str, *, keys=KEYS) -> DataFrame:
    """Records, tokens and cost that came late, per minute they belong to."""
    g = _panes(spark, path).where("late").groupBy("minute", *keys)
    return g.agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens"), F.sum("cost_nano").alias("_nano")).select("minute", *keys, "records", "tokens", X.usd4("_nano").alias("cost"))
