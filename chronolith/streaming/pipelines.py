"""Structured Streaming forms, run to the end of what is there (availableNow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import file_system, new_path


def stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A file stream over a Parquet table (a folder, or one file beside others)."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", name).option("recursiveFileLookup", False).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.getFileStatus(p).isFile()


def run(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a streaming frame over all input with a checkpoint, and read its sink. Without ``keys`` in append
    mode: rows that are final. With ``keys`` in update mode, for aggregates whose windows needn't close
    before input ends: each batch appends the groups that it changed with its number, and the latest row of
    a group stands. State is bounded by the watermark either way."""
    spark = df.sparkSession
    base = new_path(spark, "stream")
    writer = df.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if keys is None:
        writer.outputMode("append").format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{base}/out")
    # a batch that is run again after a failure writes over its own folder
    writer.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).start().awaitTermination()
    rows = spark.read.schema(df.schema.add("batch", "long")).parquet(f"{base}/out")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*").select(*df.columns)


def tumbling(df: DataFrame, time: str, every: str, late: str, keys: list[str], *aggs) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(*aggs)


def sessions(df: DataFrame, time: str, gap: str, late: str, keys: list[str], *aggs) -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggs)


def first_of(df: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """Idempotent intake: repeats of a key within the watermark are dropped."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
