"""Session construction, the shared work folder and results that are read several times."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "colophon", cores: str | int = "*", partitions: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark.  On a cluster, pass your own session instead."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COLOPHON_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def partitions_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def work_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; it goes when the driver's JVM ends.

    Without the setting the folder lies in the warehouse, which driver and executors share too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root.rstrip('/')}/colophon-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one table or one stream, visible to all executors."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reuse(df: DataFrame, name: str = "result") -> DataFrame:
    """For a result read several times in one job, or carried from round to round.

    It is written to the shared work folder once as Parquet, so the lineage ends there, a lost
    executor costs nothing, and each reader takes only the columns it needs.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
