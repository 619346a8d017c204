"""Run-level intake of a stream into a store: a run is in the store whole or not at all, and once.

Each micro-batch writes its rows below its own number, so a batch that is run again after a failure writes over itself. A
run's rows may come in several batches, or more than once: rows of a run are told apart by their key. A run counts when as many of
them have arrived as it announced, so one that was cut off stays out until it is sent again, and what had come of it before is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


class RunStore:
    """A store of runs below ``path``: ``run`` and ``key`` name the columns, ``announced`` the number of a run's rows."""

    def __init__(self, spark: SparkSession, path: str, run: list[str], key: list[str], announced: str):
        self.spark, self.path, self.run, self.key, self.announced = spark, path.rstrip("/"), run, key, announced

    def take(self, rows: DataFrame, checkpoint: str) -> None:
        """Read a stream to the end of what is there. ``checkpoint`` remembers how far it was read; one stream, one folder."""

        name = F.lit(checkpoint.rstrip("/").rsplit("/", 1)[-1])

        def write(batch: DataFrame, n: int) -> None:
            batch.withColumn("__source", name).write.mode("overwrite").parquet(f"{self.path}/{checkpoint.rstrip('/').rsplit('/', 1)[-1]}-batch-{n}")

        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    def _arrived(self) -> DataFrame:
        """Each key of a run once; where its rows differ, it is marked."""
        rows = self.spark.read.parquet(f"{self.path}/*-batch-*").drop("__source")
        rest = [c for c in rows.columns if c not in (*self.run, *self.key)]
        h = F.xxhash64(*rest)
        one = rows.groupBy(*self.run, *self.key).agg(F.min_by(F.struct(*rest), h).alias("__row"), (F.min(h) != F.max(h)).alias("__differs"))
        return one.select(*self.run, *self.key, "__row.*", "__differs")

    def runs(self) -> DataFrame:
        """run, announced, arrived rows, rows whose copies differ, and ``complete``."""
        a = F.max(self.announced)
        per = self._arrived().groupBy(*self.run).agg(a.alias("announced"), F.count(F.lit(1)).alias("arrived"), F.count_if("__differs").alias("differing"))
        return per.withColumn("complete", (F.col("arrived") == F.col("announced")) & (F.col("differing") == 0))

    def rows(self) -> DataFrame:
        """The rows of complete runs."""
        return self._arrived().join(self.runs().where("complete").select(*self.run), self.run, "left_semi").drop("__differs")

    def latest(self, order: list[str]) -> DataFrame:
        """For each key its row of the last complete run, by ``order``."""
        w = Window.partitionBy(*self.key).orderBy(*[F.desc(c) for c in order])
        return self.rows().withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
