"""Intermediate tables: written where the driver and all executors see them, removed when the driver's Python ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset, one below the warehouse, if the driver
    and the executors are one process; a cluster has to name a folder that all of them see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone, and its cluster with it
        pass


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path that nothing is at yet, and that is removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives a lost
    executor, and later readers prune columns."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
