"""Intermediate tables of the core in the folder that all executors share; deleted when the session ends."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or "file://" + tempfile.mkdtemp(prefix="chronolith-")).rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The path and its file system, as the JVM's objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used; what is written there goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    p, fs = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once, and read it from there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """For queries that are executed once: shuffle files of one that ended go at once, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)
