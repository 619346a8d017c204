"""Constraints as queries: violations, orphans, leakage, uniqueness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def constraint_report(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations, status) for SQL conditions that every row should meet, in one pass."""
    sums = df.agg(*[F.count_if(~F.expr(r)).alias(k) for k, r in rules.items()])
    long = sums.unpivot([], list(rules), "rule", "violations")
    return long.withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def leakage_rows(df: DataFrame, data_upto: str, at: str) -> DataFrame:
    """Rows made with data from after the time that they are meant for."""
    return df.where(F.col(data_upto) > F.col(at))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself; fails at once if a key repeats."""
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"{keys} is not unique")
    return df


def same_on_prefix(build, rows: DataFrame, time: str, cut, key: list[str]) -> bool:
    """Point-in-time check: features of rows before ``cut`` don't change when later rows are gone."""
    full = build(rows).join(rows.where(F.col(time) < cut).select(*key), key, "left_semi")
    early = build(rows.where(F.col(time) < cut)).select(*full.columns)
    return full.exceptAll(early).isEmpty() and early.exceptAll(full).isEmpty()
