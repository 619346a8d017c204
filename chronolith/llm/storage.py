"""Durable intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost executor then costs a
re-read, not a recomputation. Only where that setting is absent and the master is local (tests on one
machine) a temporary folder takes its place; elsewhere its absence is an error. Intermediate tables that
aren't dropped earlier are deleted when the session's file system is closed; products are not.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="chronolith-"))
        found = _LOCAL[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows in a row group of staged tables whose rows have large values. A reader holds a batch of 4,096 rows of a row group, and a
#: writer the whole group; so both hold some tens of MB.
ROWS = {"coded": 2, "asked": 64, "word-counts": 64}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the frame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    p, fs = _hadoop(spark, path)
    fs.deleteOnExit(p)
    w = df.write
    if name in ROWS:
        w = w.option("parquet.block.row.count.limit", ROWS[name])
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that :func:`stage` wrote; nothing may read it afterwards."""
    remove(df.sparkSession, df.staged_path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


#: Columns that :func:`row_keyed` adds.
ROW_KEY = ["__row_key_a", "__row_key_b"]


def row_keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with two 64-bit hashes of the whole row. Rows alike in all columns share them; among 10**12
    others some two do with odds of 10**-15. Maps, which have no hash, are left out."""
    cols = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return docs.withColumns({ROW_KEY[0]: F.xxhash64(*map(_quoted, cols)), ROW_KEY[1]: F.xxhash64(F.lit(5), *map(_quoted, cols[::-1]))})


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def local_or_remote(uri: str):
    """A pyarrow filesystem and the path in it; any scheme that pyarrow knows (Hadoop's names of s3 too), or a
    plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.normpath("/" + uri[5:].lstrip("/"))
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
