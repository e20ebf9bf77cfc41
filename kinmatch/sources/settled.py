"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local run where it is unset, a folder of our own."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/kinmatch"


def settled(df: DataFrame, label: str) -> DataFrame:
    """df, written and read again: computed once however often it is used, and not again when executors are lost. The files go when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver's garbage happens to be collected. Nothing may read those jobs' DataFrames later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for p in _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
