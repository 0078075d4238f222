"""Session settings the operators rely on."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings: UTC clock, adaptive execution with skew handling, and of a key that a JSON
    object has twice the last one counts instead of losing the object."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a temporary folder;
    a cluster session without it is an error, since executors could not see one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="usagelens-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@functools.lru_cache(maxsize=8)
def _ship(app: str) -> None:
    from pyspark import SparkContext

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="package-"), "usagelens"), "zip", root, "usagelens")
    SparkContext._active_spark_context.addPyFile(made)


def importable(spark: SparkSession) -> None:
    """Sends this package to the executors unless their PYTHONPATH has it already; Python tasks import from it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        _ship(spark.sparkContext.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: survives lost executors, and
    later steps read only the columns they use."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
