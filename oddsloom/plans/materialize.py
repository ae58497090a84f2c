"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it. Where nothing is named, a local master (tests, one machine) gets a
    temporary folder; on a cluster that is an error, as executors could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if (known := spark.sparkContext.getCheckpointDir()) is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="oddsloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def run_dir(spark: SparkSession) -> str:
    """A folder of this application below the shared one; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/oddsloom-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows, order and partitions are kept and survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write once to the shared folder as Parquet and read back; cheaper on disk than a checkpoint, order is not kept."""
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
