"""Readers and sinks: driver tables, typed CSV, nested JSON, partitioned Parquet, append-only stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``sec``, whole seconds since the epoch, for range frames and strict comparisons."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000))


def read_csv(spark: SparkSession, path, schema: StructType, header: list[str] | None = None) -> DataFrame:
    """Typed CSV scan with provenance. The header must be the schema's names in order (the reader
    rejects others); malformed values fail the read. Adds ``source_path``."""
    if header is not None and header != schema.names:
        raise ValueError(f"the columns must be {schema.names}, not {header}")
    out = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return out.withColumn("source_path", F.input_file_name())


def read_results_json(spark: SparkSession, path: str, schema: str, date: str = "date", floor: str | None = None) -> DataFrame:
    """Multi-line JSON list of results, with ``day``, ``precision`` ('exact' if the text has a time)
    and an optional era floor."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    day = F.try_to_timestamp(F.substring(date, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    df = df.withColumn("day", day).withColumn("precision", F.when(F.instr(date, "T") > 0, "exact").otherwise("date_only"))
    return df.where(F.col("day") >= F.lit(floor).cast("date")) if floor else df


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object keyed by id, as one row (id, fields) for each key."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("id", "v")).select("id", "v.*")


def read_xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Rows of an XML file (a sitemap's ``url`` entries, for one)."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def years_between(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """Partition-pruned read of a dataset partitioned by ``year``."""
    return spark.read.parquet(root).where(F.col("year").between(first, last))


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet sink: zstd, optionally partitioned; rows of a partition are dealt to its own tasks, of which a large partition
    has several."""
    w = (df.hint("rebalance", *by) if by else df).write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def new_rows(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: rows of a batch, one for each key, whose keys aren't stored yet."""
    return batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Merge on read: a batch's non-null values win, except in ``keep_first`` columns; keys of either
    side are kept. Both sides have at most one row for each key."""
    rest = [c for c in stored.columns if c not in keys]
    s, b = stored.alias("s"), batch.alias("b")
    j = s.join(b, [s[k].eqNullSafe(b[k]) for k in keys], "full_outer")
    pick = [F.coalesce(f"b.{k}", f"s.{k}").alias(k) for k in keys]
    pick += [(F.coalesce(f"s.{c}", f"b.{c}") if c in keep_first else F.coalesce(f"b.{c}", f"s.{c}")).alias(c) for c in rest]
    return j.select(*pick)


def content_hash(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that doesn't depend on the order or partitions of ``df``."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
