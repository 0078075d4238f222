"""Alert crossings as a stream: each micro-batch starts from the last level per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from usagelens.operators.status import alert_crossings


def run_alert_stream(levels: DataFrame, path: str, checkpoint: str, *, keys=("source",), order=("checked_at",)) -> None:
    """Write the crossings of a stream of checks (keys, order columns, level) to
    `path`/alerts and stop when the input is drained.

    The state between batches is a small table, one row per key, under `path`/state. Both
    outputs are written per batch id and overwritten on a retry, so a lost executor or
    driver neither loses nor repeats an alert.
    """
    keys, order = list(keys), list(order)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_old", F.lit(False))
        if batch_id > 0:
            state = spark.read.parquet(f"{path}/state/{batch_id - 1}")
            rows = rows.unionByName(state.withColumn("_old", F.lit(True)), allowMissingColumns=True)
        fired = alert_crossings(rows, keys=keys, order=order).where(~F.col("_old")).drop("_old")
        fired.write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*order, "level"), F.struct(*order)).alias("s")).select(*keys, "s.*")
        last.write.mode("overwrite").parquet(f"{path}/state/{batch_id}")

    q = levels.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_alerts(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/alerts").parquet(f"{path}/alerts").drop("batch")
