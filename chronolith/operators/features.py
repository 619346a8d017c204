"""Feature contracts, antisymmetric pairs, line-ups, nested folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; fails if one is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def antisymmetric(df: DataFrame, directional: list[str]) -> DataFrame:
    """The rows seen from the other side: directional columns negated, ``_a`` and ``_b`` swapped."""
    out = []
    for c in df.columns:
        twin = c[:-1] + {"a": "b", "b": "a"}[c[-1]] if c.endswith(("_a", "_b")) else c
        source = F.col(twin) if twin in df.columns else F.col(c)
        out.append((-source if c in directional else source).alias(c))
    return df.select(*out)


def lineup_features(df: DataFrame, key: str, ratings: str, least: int) -> DataFrame:
    """Mean, gap of best and worst, and weakest of a descending array of ratings; null below ``least``."""
    a = F.col(ratings)
    ok = F.size(a) >= least
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    best, worst = F.get(a, F.lit(0)), F.element_at(a, -1)
    return df.select(key, F.size(a).alias("n"), F.when(ok, F.round(total / F.size(a), 6)).alias("mean"), F.when(ok, best - worst).alias("gap"), F.when(ok, worst).alias("weak"))


def uncertainty(variance: Column, history: Column, members: Column, cap: float = 0.5) -> Column:
    u = F.least(F.lit(cap), F.sqrt(variance + history + members))
    return F.when(u < 0.2, "low").when(u < 0.35, "medium").otherwise("high")


def rank_baseline(games: DataFrame, ranks: DataFrame, key: str, rank: str) -> DataFrame:
    """Accuracy of taking the better ranked of a and b."""
    ra = ranks.select(F.col(key).alias("a"), F.col(rank).alias("ra"))
    rb = ranks.select(F.col(key).alias("b"), F.col(rank).alias("rb"))
    j = games.join(ra, "a").join(rb, "b")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("ra") < F.col("rb")) == (F.col("y") == 1)).cast("int")), 6).alias("accuracy"))


def nested_folds(df: DataFrame, period: str) -> DataFrame:
    """(outer test, inner test, number of training periods): inner tests before the outer one, each
    trained on the periods before it. Made from distinct periods, by their running number."""
    p = df.select(period).distinct()
    before = F.row_number().over(Window.orderBy(period)) - 1
    n = p.withColumn("train_periods", before.cast("long"))  # a row for each period
    inner = n.where("train_periods > 0").select(F.col(period).alias("inner_test"), "train_periods")
    w = Window.orderBy("inner_test").rowsBetween(Window.unboundedPreceding, -1)
    past = inner.withColumn("past", F.collect_list(F.struct("inner_test", "train_periods")).over(w))
    return past.select(F.col("inner_test").alias("outer_test"), F.explode("past").alias("p")).select("outer_test", "p.inner_test", "p.train_periods")
