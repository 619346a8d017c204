"""Latest versions, conflicts, cross-source duplicates, entity resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in ``order`` (give descending columns)."""
    return top_per_group(df, keys, order, 1)


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; Spark prunes them before the shuffle too."""
    out = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= k)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def first_seen_of_latest(df: DataFrame, keys: list[str], seen: str, payload: list[str]) -> DataFrame:
    """Each key's latest payload and when that payload was first seen, later versions aside."""
    body = F.struct(*payload)
    last = df.groupBy(*keys).agg(F.max_by(body, seen).alias("__last"))
    same = df.join(last, keys).where(body.eqNullSafe(F.col("__last")))
    return same.groupBy(*keys).agg(F.min(seen).alias("available_at"), F.first("__last").alias("p")).select(*keys, "available_at", "p.*")


def split_conflicts(df: DataFrame, keys: list[str], body: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row for each key whose versions agree, all rows of keys whose versions don't)."""
    versions = F.struct(*body)
    per = df.groupBy(*keys).agg(F.min(versions).alias("__lo"), F.max(versions).alias("__hi"))
    good = per.where(F.col("__lo").eqNullSafe(F.col("__hi"))).select(*keys, "__lo.*")
    bad = df.join(per.where(~F.col("__lo").eqNullSafe(F.col("__hi"))).select(*keys), keys, "left_semi")
    return good, bad


def prefer_source(df: DataFrame, keys: list, source: str, preferred: str) -> DataFrame:
    """Drop other sources' rows of a key only where the preferred source has it; repeats within one
    source stay."""
    w = Window.partitionBy(*keys)
    has = F.max((F.col(source) == preferred).cast("int")).over(w)
    return df.withColumn("__has", has).where((F.col("__has") == 0) | (F.col(source) == preferred)).drop("__has")


def merged(df: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """Monotone merge: each field's first known value in ``order``; ``conflicts`` counts the fields
    with several values."""
    w = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    n = sum((F.count_distinct(f) > 1).cast("int") for f in fields)
    return df.groupBy(*keys).agg(*w, n.cast("long").alias("conflicts"))


def resolve(queries: DataFrame, key: str, candidates: DataFrame, candidate_id: str, overrides: DataFrame | None = None) -> DataFrame:
    """Unique-key entity resolution. ``overrides`` (key, override_id) win; else a key with exactly one
    candidate resolves, with none is ``no_active``, with more ``ambiguous``."""
    per = candidates.groupBy(key).agg(F.count_distinct(candidate_id).alias("__n"), F.min(candidate_id).alias("__id"))
    q = queries.join(per, key, "left")
    q = q.join(overrides, key, "left") if overrides is not None else q.withColumn("override_id", F.lit(None).cast(candidates.schema[candidate_id].dataType))
    status = F.when(F.col("override_id").isNotNull(), "override").when(F.col("__n").isNull(), "no_active").when(F.col("__n") > 1, "ambiguous").otherwise("exact")
    q = q.withColumn("resolution", status)
    return q.withColumn("resolved_id", F.when(F.col("resolution") == "override", F.col("override_id")).when(F.col("resolution") == "exact", F.col("__id"))).drop("__n", "__id", "override_id")


def reasons(*named: tuple[str, Column]) -> Column:
    """All reasons that hold, in order, as an array; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in named]))


def first_reason(*named: tuple[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for k, c in reversed(named):
        out = F.when(c, F.lit(k)).otherwise(out)
    return out
