"""Probability metrics, reliability, segments, significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .significance import quantiles

from ..functions.scalars import brier, log_loss


def binary_aggs(y: str = "y", p: str = "p") -> list[Column]:
    """n, covered, positive rate, accuracy, log-loss and Brier over rows with a probability."""
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    when = lambda x: F.when(ok, x)
    yy = F.col(y).cast("double")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(ok.cast("long")).alias("covered"),
        F.round(F.avg(yy), 6).alias("positive_rate"),
        F.round(F.avg(when(((F.col(p) >= 0.5) == (yy == 1)).cast("double"))), 6).alias("accuracy"),
        F.round(F.avg(when(log_loss(yy, F.col(p)))), 6).alias("log_loss"),
        F.round(F.avg(when(brier(yy, F.col(p)))), 6).alias("brier"),
    ]


def metrics_with_total(df: DataFrame, segments: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """One global row, ``is_total`` 1, and one row for each segment (null segments too), in one pass."""
    out = df.groupingSets([[], [F.col(s) for s in segments]], *[F.col(s) for s in segments]).agg(F.grouping(segments[0]).cast("int").alias("is_total"), *binary_aggs(y, p))
    return out.select(*segments, "is_total", "n", "covered", "positive_rate", "accuracy", "log_loss", "brier")


def auc(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Rank AUC with average ranks for ties; null if a class is missing. Equal probabilities are
    counted before the ranking, so the sequence has one row for each distinct value."""
    per = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    below = Window.partitionBy(*by).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    s = per.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return s.select(*by, "n_pos", "n_neg", F.round(F.try_divide("won", F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


def reliability(df: DataFrame, by: list[str], bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Equal-width bins (the last one closed), non-empty ones only."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.where(F.col(p).isNotNull()).groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def expected_calibration_error(df: DataFrame, by: list[str], bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    r = reliability(df, by, bins, y, p)
    return r.groupBy(*by).agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n"), 6).alias("ece"))


def quantile_reliability(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Bins between linearly interpolated quantiles; equal edges collapse; right-closed."""
    inner = F.array(*map(F.lit, sorted(set(quantiles(df, p, [i / bins for i in range(bins + 1)])))[1:-1])).cast("array<double>")
    d = df.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(p))))
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(F.col(y).cast("double")), 6).alias("mean_y"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def group_versus_rest(df: DataFrame, group: str, failed: str) -> DataFrame:
    """Each group's failure rate with its Wilson interval, its share, and its ratio to the rest."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("k"))
    w = Window.partitionBy(F.lit(0))  # a row for each group
    lo, hi = wilson(F.col("k"), F.col("n"))
    rest = F.try_divide(F.sum("k").over(w) - F.col("k"), F.sum("n").over(w) - F.col("n"))
    rate = F.col("k") / F.col("n")
    return g.select(
        group, "n", "k", F.round(rate, 6).alias("rate"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"),
        F.round(rate - rest, 6).alias("lift"), F.round(F.try_divide(rate, rest), 6).alias("risk_ratio"), F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"),
    )


def benjamini_hochberg(df: DataFrame, p: str, key: str) -> DataFrame:
    """Adjusted p-values: the running minimum of p m / rank from the largest. The window runs over
    hypotheses, not over data rows."""
    w = Window.orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    d = df.withColumn("__x", F.col(p) * m / F.row_number().over(w))
    back = Window.orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("adjusted", F.least(F.lit(1.0), F.min("__x").over(back))).drop("__x")


def effect_sizes(df: DataFrame, y: str, x: str) -> DataFrame:
    """Cohen's d (pooled deviation) and the point-biserial correlation of x by a 0/1 column."""
    one, none = F.when(F.col(y) == 1, F.col(x)), F.when(F.col(y) == 0, F.col(x))
    a = df.agg(
        F.count(one).alias("n1"), F.count(none).alias("n0"), F.avg(one).alias("m1"), F.avg(none).alias("m0"),
        F.var_samp(one).alias("v1"), F.var_samp(none).alias("v0"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"),
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return a.select("n1", "n0", F.round((F.col("m1") - F.col("m0")) / pooled, 6).alias("cohen_d"), F.round("r", 6).alias("point_biserial"))


def shrunk_rate(x: Column, prior: float = 0.5, weight: float = 20.0) -> Column:
    """(sum + weight prior) / (n + weight) over non-null values."""
    return (F.coalesce(F.sum(x), F.lit(0)) + weight * prior) / (F.count(x) + weight)


def segment_calibration(df: DataFrame, segment: str, y: str = "y", p: str = "p") -> DataFrame:
    """n, accuracy, losses, the mean gap of outcome and probability with its 95 % interval, and ECE."""
    gap = F.col(y).cast("double") - F.col(p)
    half = 1.96 * F.sqrt(F.var_samp(gap) / F.count(gap))
    m = df.groupBy(segment).agg(*binary_aggs(y, p), F.round(F.avg(gap), 6).alias("gap"), F.round(F.avg(gap) - half, 6).alias("gap_low"), F.round(F.avg(gap) + half, 6).alias("gap_high"))
    e = expected_calibration_error(df, [segment], y=y, p=p).withColumnRenamed(segment, "__s")
    return m.join(e, F.col(segment).eqNullSafe(F.col("__s")), "left").drop("__s")


def two_window_means(df: DataFrame, order: list, x: str, recent: int = 200, before: int = 500) -> DataFrame:
    """Means of the last ``recent`` rows and of the ``before`` rows ahead of them, and their ratio."""
    last = df.orderBy(*order).limit(recent + before)
    n = last.withColumn("__rn", F.row_number().over(Window.orderBy(*order)))
    now, then = F.avg(F.when(F.col("__rn") <= recent, F.col(x))), F.avg(F.when(F.col("__rn") > recent, F.col(x)))
    return n.agg(F.round(now, 6).alias("recent_mean"), F.round(then, 6).alias("before_mean"), F.round(F.try_divide(now, then), 6).alias("ratio"))
