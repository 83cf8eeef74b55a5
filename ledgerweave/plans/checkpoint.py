"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is configured and the master is local."""
    configured = spark.conf.get(DIR_KEY, None) or spark.sparkContext.getConf().get(DIR_KEY)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"{DIR_KEY} must name a folder that all executors share")
    base = f"file://{tempfile.gettempdir()}/checkpoints"
    spark.conf.set(DIR_KEY, base)
    return base


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it.

    The files are columnar and compressed, so they cost less disk than ``DataFrame.checkpoint``; every executor
    can read them, so a lost executor costs nothing. They are removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    out = df.coalesce(partitions) if partitions else df
    out.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
