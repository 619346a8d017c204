"""Paired tests over distributed ranks: Wilcoxon's signed ranks, the least detectable difference, exact binomial tails."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, log1p, sqrt

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges that values are dealt into for ranks, and pairs up to which a test without ties is exact.
RANGES, EXACT = 256, 50


def mid_ranks(values: DataFrame, x: str, weights: list[str]) -> DataFrame:
    """For each distinct value of ``x`` the sums of ``weights``, the rows ``n`` and their common ``rank`` (the mean of
    the places that they take in ascending order).

    Equal values are summed first. Distinct ones are dealt into ``RANGES`` ranges by approximate quantiles and numbered
    within their range; the counts of earlier ranges, a row for each, are added."""
    per = values.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias(x)).agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(w) for w in weights])
    cuts = sorted({v for v in per.approxQuantile(x, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)})
    edges = [float("-inf"), *cuts, float("inf")]
    ranged = Bucketizer(splits=edges, inputCol=x, outputCol="__range").transform(per) if len(edges) > 2 else per.withColumn("__range", F.lit(0.0))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = ranged.groupBy("__range").agg(F.sum("n").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(first), "__range").withColumn("__lower", F.col("__before") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return placed.select(x, "n", *weights, (F.col("__lower") + (F.col("n") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, x: str, qs: list[float]) -> list[float]:
    """Exact quantiles, interpolated between the two nearest values; from places of distinct values, so that no task holds
    them all. No values give none."""
    r = mid_ranks(df, x, []).withColumn("__lower", F.col("rank") - (F.col("n") + 1) / 2)
    total = r.agg(F.sum("n")).first()[0]
    if not total:
        return []
    at = [q * (total - 1) for q in qs]
    places = sorted({int(a) for a in at} | {min(int(a) + 1, total - 1) for a in at})
    here = lambda k: F.max(F.when((F.col("__lower") <= k) & (k < F.col("__lower") + F.col("n")), F.col(x)))
    found = dict(zip(places, r.agg(*[here(k).alias(f"v{k}") for k in places]).first(), strict=True))
    out = []
    for a in at:
        lo, hi = found[int(a)], found[min(int(a) + 1, total - 1)]
        out.append(lo + (hi - lo) * (a - int(a)))
    return out


def _signed_rank_tail(n: int, w: float) -> float:
    """P(W <= w) of n untied pairs at even odds."""
    ways = [1]
    for r in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if s >= r else 0) for s in range(len(ways) + r)]
    return sum(ways[: int(w) + 1]) / 2**n


def wilcoxon(df: DataFrame, diff: Column) -> DataFrame:
    """Signed-rank test of paired differences: ``n`` of them, without zeros; the sums of ranks of either sign; ``z`` with the
    correction for ties; the two-sided ``p``, exact for at most ``EXACT`` pairs without ties and zeros, else normal. No pairs give p = 1."""
    d = df.select(diff.cast("double").alias("d")).where("d IS NOT NULL AND NOT isnan(d)")
    some = d.where("d <> 0").select(F.abs("d").alias("x"), (F.col("d") > 0).cast("long").alias("up"))
    r = mid_ranks(some, "x", ["up"])
    t = F.col("n").cast("double")
    got = r.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("up"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("down"), F.sum(t * t * t - t).alias("ties")).first()
    zeros = d.where("d = 0").count()
    n, up, down, ties = int(got.n or 0), got.up or 0.0, got.down or 0.0, got.ties or 0.0
    z, p = 0.0, 1.0
    if n:
        spread = sqrt(max(1e-300, n * (n + 1) * (2 * n + 1) / 24 - ties / 48))
        z = (min(up, down) - n * (n + 1) / 4) / spread
        p = min(1.0, 2 * _signed_rank_tail(n, min(up, down))) if n <= EXACT and not ties and not zeros else erfc(abs(z) / sqrt(2))
    return df.sparkSession.createDataFrame([(n, zeros, up, down, z, p)], "n long, zeros long, w_plus double, w_minus double, z double, p double")


def detectable(df: DataFrame, diff: Column, factor: float = 2.80) -> DataFrame:
    """n, mean, standard deviation and the least mean difference that as many pairs show (95 % confidence, 80 % power)."""
    d = df.select(diff.cast("double").alias("d"))
    n, sd = F.count("d"), F.stddev_samp("d")
    return d.agg(n.alias("n"), F.avg("d").alias("mean"), sd.alias("sd"), (factor * sd / F.sqrt(n)).alias("mde"))


def binomial_tail(n: int, k: int) -> float:
    """P(X <= k) of n even coin flips. Terms are added from the largest down until they no longer count, some 10 * sqrt(n) of
    them at most; where k lies beyond the mean, the other tail is taken away from 1."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    if 2 * k > n:
        return 1.0 - binomial_tail(n, n - k - 1)
    top = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2)
    total, term, i = 1.0, 1.0, k
    while i > 0 and term > 1e-18 * total:
        term *= i / (n - i + 1)
        total += term
        i -= 1
    return min(1.0, exp(top + log(total))) if top + log1p(total - 1) < 0 else 1.0
