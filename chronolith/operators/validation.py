"""Temporal validation: fold tables, calibration, gates, significance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import brier, log_loss
from ..sources.staging import stage


#: Seasons that expanding folds are made for; each row is in one fold for each later season.
MAX_SEASONS = 500


def season_folds(df: DataFrame, year: str, date: str, available: str) -> DataFrame:
    """(fold, part, row) membership: test is a season; calibration the season before, training all
    earlier ones, both only with rows available before the part that follows begins. Folds are a row
    for each season, so the join's small side is bounded by the number of seasons."""
    starts = df.groupBy(year).agg(F.min(date).alias("__start"))
    if starts.count() > MAX_SEASONS:
        raise ValueError(f"more than {MAX_SEASONS} seasons: expanding folds would repeat each row as often")
    f = starts.select(F.col(year).alias("fold"), F.col("__start").alias("test_start"))
    c = starts.select((F.col(year) + 1).alias("fold"), F.col("__start").alias("calib_start"))
    folds = f.join(c, "fold")
    j = df.join(F.broadcast(folds), F.col(year) <= F.col("fold"))
    part = (
        F.when(F.col(year) == F.col("fold"), "test")
        .when((F.col(year) == F.col("fold") - 1) & (F.col(available) < F.col("test_start")), "calibration")
        .when((F.col(year) <= F.col("fold") - 2) & (F.col(available) < F.col("calib_start")), "train")
    )
    return j.withColumn("part", part).where(F.col("part").isNotNull())


def walk_forward(df: DataFrame, period: str, gap: int = 0, least: int = 1) -> DataFrame:
    """A row for each test period: its rows and the training rows of periods before period - gap."""
    per = df.groupBy(period).agg(F.count(F.lit(1)).alias("test_n"))
    w = Window.orderBy(period).rangeBetween(Window.unboundedPreceding, -(gap + 1))
    out = per.withColumn("train_n", F.coalesce(F.sum("test_n").over(w), F.lit(0)))
    return out.where(F.col("train_n") >= least)


def causal_policy(df: DataFrame, period: str, candidates: list[str], y: str, least: int = 200) -> DataFrame:
    """For each period, the candidate (a probability column) of least mean log-loss over earlier
    periods; the first one until ``least`` rows are known, and where means tie."""
    sums = [F.sum(log_loss(F.col(y), F.col(c))).alias(f"__{c}") for c in candidates]
    per = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"), *sums)
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("n").over(w), F.lit(0))
    best = F.array_min(F.array(*[F.struct((F.sum(f"__{c}").over(w) / seen).alias("loss"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(candidates)]))
    return per.withColumn("__seen", seen).withColumn("chosen", F.when(F.col("__seen") >= least, best["name"]).otherwise(candidates[0])).select(period, "n", "chosen")


def gate(champion: DataFrame, challenger: DataFrame, key: str, y: str, p: str, least: int = 100, eps: float = 0.0) -> DataFrame:
    """One row: metrics of both on the rows that both have, and whether the challenger is promoted."""
    j = champion.select(key, F.col(y).alias("y"), F.col(p).alias("old")).join(challenger.select(key, F.col(p).alias("new")), key)
    m = j.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f(F.col("y"), F.col(c))).alias(f"{n}_{c}") for n, f in (("log_loss", log_loss), ("brier", brier)) for c in ("old", "new")])
    ok = (F.col("n") >= least) & (F.col("log_loss_new") < F.col("log_loss_old") - eps) & (F.col("brier_new") <= F.col("brier_old") + eps)
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]], ok.cast("int").alias("promoted"))


#: Groups whose two numbers the driver holds.
MOST_GROUPS = 100_000


def platt(df: DataFrame, by: list[str], y: str, p: str, steps: int = 30) -> DataFrame:
    """Slope and intercept of a logistic fit on the logit, for each group. Newton's sums are
    aggregations over the data; only they (five numbers a group) meet in one place."""
    from ..functions.scalars import logit

    x = df.where(F.col(p).isNotNull()).select(*by, F.col(y).cast("double").alias("y"), logit(F.col(p)).alias("x"))
    d = stage(x.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")), "platt")  # equal logits once
    fit = d.select(*by).distinct().withColumn("a", F.lit(1.0)).withColumn("b", F.lit(0.0)).toPandas()
    if len(fit) > MOST_GROUPS:
        raise ValueError(f"{len(fit)} groups are more than the {MOST_GROUPS} that are fitted at a time")
    spark = df.sparkSession
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b"))))
        w = d.join(F.broadcast(spark.createDataFrame(fit)), by).withColumn("g", F.col("n") * q - F.col("s")).withColumn("w", F.col("n") * q * (1 - q))
        s = w.groupBy(*by, "a", "b").agg(
            F.sum(F.col("g") * F.col("x")).alias("ga"), F.sum("g").alias("gb"),
            F.sum(F.col("w") * F.col("x") ** 2).alias("haa"), F.sum(F.col("w") * F.col("x")).alias("hab"), F.sum("w").alias("hbb"),
        ).toPandas()
        det = (s.haa + 1e-6) * (s.hbb + 1e-6) - s.hab**2
        da, db = ((s.hbb + 1e-6) * s.ga - s.hab * s.gb) / det, ((s.haa + 1e-6) * s.gb - s.hab * s.ga) / det
        fit = s[by].assign(a=s.a - da, b=s.b - db)
        if max(np.abs(da).max(), np.abs(db).max()) < 1e-9:
            break
    return spark.createDataFrame(fit)


def isotonic(df: DataFrame, y: str, p: str) -> DataFrame:
    """Pool-adjacent-violators steps (p_from, p_to, value, n). Equal probabilities are summed first, ranges of them are
    pooled each in its task, and the blocks that are left, of which there are few, are pooled once more: pooling gives the same
    blocks in whatever order it is done."""
    per = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    each = per.select(F.col(p).cast("double").alias("p_from"), F.col(p).cast("double").alias("p_to"), "s", "n")

    def pool(batches):
        blocks: list[list[float]] = []
        for pdf in batches:
            for lo, hi, s, n in zip(pdf["p_from"], pdf["p_to"], pdf["s"], pdf["n"], strict=True):
                blocks.append([lo, hi, s, n])
                while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                    _, end, s1, n1 = blocks.pop()
                    blocks[-1][1] = end
                    blocks[-1][2] += s1
                    blocks[-1][3] += n1
        yield pd.DataFrame([(a, b, s, int(n)) for a, b, s, n in blocks], columns=["p_from", "p_to", "s", "n"])

    kind = "p_from double, p_to double, s double, n long"
    some = each.repartitionByRange("p_from").sortWithinPartitions("p_from").mapInPandas(pool, kind)
    whole = some.repartition(1).sortWithinPartitions("p_from").mapInPandas(pool, kind)
    return whole.select("p_from", "p_to", (F.col("s") / F.col("n")).alias("value"), "n")


def paired_bootstrap(df: DataFrame, day: str, diff: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """Mean difference with a 95 % interval from resampled days: days are aggregated first, and each
    replicate weighs them by a Poisson draw from a hash of (day, replicate)."""
    per = df.groupBy(day).agg(F.sum(diff).alias("s"), F.count(F.lit(1)).alias("n"))
    r = per.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.pmod(F.xxhash64(day, "r", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cut, total, term = F.lit(0), 0.0, np.exp(-1.0)
    for k in range(8):
        total += term
        term /= k + 1
        cut = cut + (u >= total).cast("int")
    m = r.withColumn("w", cut).groupBy("r").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    ends = m.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return per.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(ends).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Discordant counts and the exact two-sided test: twice the binomial tail at even odds, 1 at most. The
    driver gets two counts."""
    from .significance import binomial_tail

    na, nb = df.agg(F.count_if(a & ~b), F.count_if(~a & b)).first()
    return df.sparkSession.createDataFrame([(na, nb, min(1.0, 2 * binomial_tail(na + nb, min(na, nb))) if na + nb else 1.0)], "only_a long, only_b long, p double")
