"""Session and table helpers shared by the library and its tests."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wordweft")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WORDWEFT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are cores, as small inputs do; otherwise df itself, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """Where written intermediate tables go: the folder that spark.checkpoint.dir names. Only a session without a cluster gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="wordweft-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _at(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read again, so that later steps neither recompute it nor depend on its executors.

    A table that nobody drops, because a result reads it, goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _at(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*written: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more, and lets Spark drop the shuffle files of what made them."""
    for df in written:
        at, files = _at(df.sparkSession, df._cut_path)
        files.delete(at, True)
    gc.collect()
    written[0].sparkSession.sparkContext._jvm.System.gc()  # else the files of finished shuffles stay until the driver happens to collect its garbage
