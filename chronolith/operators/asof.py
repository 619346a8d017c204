"""Point-in-time joins: strict as-of, editions, validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str],
    prefix: str = "prev_", inclusive: bool = False, ties: list[str] | None = None, bucket: float | None = None,
) -> DataFrame:
    """Each left row with the last right row of its key strictly before it (or at it, if inclusive).

    Both sides are laid in one sequence and the last right row is carried on: one shuffle and one
    sort, and no pair of rows is ever made. Rows with equal times stand so that strictness holds;
    equal right times are settled by ``ties`` (the last one wins).

    ``bucket`` (in units of the time column, a number) splits a key's sequence, for keys that hold
    a large share of all rows: what earlier buckets end with is carried by one row for each bucket.
    """
    ties = ties or []
    here, there = (1, 0) if inclusive else (0, 1)
    cols = left.columns
    keep = F.struct(F.col(right_time).alias("time"), *[F.col(v) for v in values])
    r = right.select(*on, F.col(right_time).alias("__t"), F.lit(there).alias("__side"), keep.alias("__r"), F.struct(F.lit(0).alias("z"), *ties).alias("__tie"))
    whole = F.struct(*cols).alias("__l")
    null_r = F.lit(None).cast(r.schema["__r"].dataType).alias("__r")
    null_tie = F.lit(None).cast(r.schema["__tie"].dataType).alias("__tie")
    lhs = left.select(*on, F.col(left_time).alias("__t"), F.lit(here).alias("__side"), null_r, null_tie, whole)
    both = lhs.unionByName(r, allowMissingColumns=True)
    part = list(on)
    if bucket:
        both = both.withColumn("__b", F.floor(F.col("__t") / bucket))
        part.append("__b")
    w = Window.partitionBy(*part).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__r", F.when(F.col("__l").isNotNull(), F.last("__r", ignorenulls=True).over(w)))
    out = found.where(F.col("__l").isNotNull())
    if bucket:
        order = F.struct("__t", "__tie")
        ends = both.groupBy(*part).agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), order)).alias("__end"))
        before = Window.partitionBy(*on).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("__end", F.last("__end", ignorenulls=True).over(before))
        out = out.join(ends, part, "left").withColumn("__r", F.coalesce("__r", "__end"))
    return out.select("__l.*", F.col("__r.time").alias(f"{prefix}{right_time}"), *[F.col(f"__r.{v}").alias(f"{prefix}{v}") for v in values])


def edition_asof(left: DataFrame, seen: DataFrame, on: list[str], left_time: str, edition: str, captured: str, value: str) -> DataFrame:
    """The latest edition (not the latest capture) strictly before each left row, captured before it
    too. An edition whose captures disagree gives a null value; the earliest capture is reported."""
    per = seen.groupBy(*on, edition, captured).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    so_far = Window.partitionBy(*on, edition).orderBy(captured).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.withColumns({"__lo": F.min("__lo").over(so_far), "__hi": F.max("__hi").over(so_far), "__first": F.min(captured).over(so_far)})
    # from when on an edition is known, and the latest one known by then
    known = per.groupBy(*on, edition).agg(F.greatest(F.col(edition), F.min(captured)).alias("__at")).groupBy(*on, "__at").agg(F.max(edition).alias("__e"))
    known = known.withColumn("__e", F.max("__e").over(Window.partitionBy(*on).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = asof_join(left, known, on, left_time, "__at", ["__e"], prefix="").withColumnRenamed("__e", edition).drop("__at")
    out = asof_join(one, run, [*on, edition], left_time, captured, ["__lo", "__hi", "__first"], prefix="__c")
    return out.select(*left.columns, edition, F.col("__c__first").alias(captured), F.when(F.col("__c__lo") == F.col("__c__hi"), F.col("__c__lo")).alias(value))


def valid_at(t: Column, start: Column, end: Column) -> Column:
    """Membership in [start, end), where a null end is open."""
    return (start <= t) & (end.isNull() | (t < end))


def interval_join(left: DataFrame, spans: DataFrame, on: list[str], t: str, start: str, end: str, how: str = "left") -> DataFrame:
    """Rows with the validity intervals of their key that hold at ``t``: an equi-join on the key with
    the interval as its residue, so only rows of one key are compared."""
    s = spans.select(*[F.col(k).alias(f"__{k}") for k in on], *[c for c in spans.columns if c not in on])
    cond = valid_at(F.col(t), F.col(start), F.col(end))
    for k in on:
        cond = (F.col(k) == F.col(f"__{k}")) & cond
    return left.join(s, cond, how).drop(*[f"__{k}" for k in on])


def intervals_of_presence(snapshots: DataFrame, entity: str, group: str, index: str) -> DataFrame:
    """Runs of consecutive snapshots (``index`` counts a group's snapshots) in which an entity is
    present: ``valid_from`` and ``valid_to`` (the first snapshot without it, null if it lasts)."""
    w = Window.partitionBy(group, entity).orderBy(index)
    run = snapshots.select(group, entity, index).distinct().withColumn("__g", F.col(index) - F.row_number().over(w))
    ends = snapshots.groupBy(group).agg(F.max(index).alias("__last"))
    spans = run.groupBy(group, entity, "__g").agg(F.min(index).alias("valid_from"), (F.max(index) + 1).alias("__to"))
    return spans.join(ends, group).select(group, entity, "valid_from", F.when(F.col("__to") <= F.col("__last"), F.col("__to")).alias("valid_to"))


def with_embargo(df: DataFrame, event_date: str, days: int = 21) -> DataFrame:
    """``available_date``: the first date on which a result may be used."""
    return df.withColumn("available_date", F.date_add(event_date, days + 1))
