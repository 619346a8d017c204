"""Logistic models refitted every period from sums of cells, never from raw rows.

A cell is a period's rows of one group with one value of a grid feature: the number of rows and of positives. What a
period may learn from is a window of earlier periods, so its cells are differences of running sums, and a fit is a fixed
number of Newton steps over at most as many cells as the grid has values. Nothing is fitted on the driver, and a period
more costs its own cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Newton steps of a fit.
STEPS = 8


def cells(df: DataFrame, by: list[str], period: str, x: str, y: str) -> DataFrame:
    """``n`` rows and ``s`` positives by group, period and value of the grid feature ``x``; rows without any of them
    are left out."""
    there = df.dropna(subset=[*by, period, x, y])
    return there.groupBy(*by, period, x).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("s"))


def running(c: DataFrame, by: list[str], period: str, x: str, last: DataFrame) -> DataFrame:
    """The sums of all cells up to each period, until ``last`` (one row, one column): a row for each cell that was met and
    period since, as many as the grid has values, whatever the number of rows behind them. Empty ones are left out."""
    (end,) = last.columns
    first = c.groupBy(*by, x).agg(F.min(period).alias("__from")).join(F.broadcast(last)).where(F.col("__from") <= F.col(end))
    every = first.withColumn(period, F.explode(F.sequence("__from", end))).select(*by, x, period)
    w = Window.partitionBy(*by, x).orderBy(period)
    full = every.join(c, [*by, x, period], "left")
    return full.withColumns({k: F.coalesce(F.sum(k).over(w), F.lit(0)) for k in ("n", "s")}).where("n > 0")


def newton(points: Column, ridge: float, steps: int = STEPS) -> Column:
    """(a, b) of a logistic a + b x over an array of (x, n, s), with a ridge on b, by Newton steps from 0."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def step(w: Column) -> Column:
        start = F.struct(*[F.lit(0.0).alias(k) for k in ("ga", "gb", "aa", "ab", "bb")])

        def add(t: Column, p: Column) -> Column:
            q = 1 / (1 + F.exp(-(w["a"] + w["b"] * p["x"])))
            g, h = p["n"] * q - p["s"], p["n"] * q * (1 - q)
            return F.struct((t["ga"] + g).alias("ga"), (t["gb"] + g * p["x"]).alias("gb"), (t["aa"] + h).alias("aa"), (t["ab"] + h * p["x"]).alias("ab"), (t["bb"] + h * p["x"] * p["x"]).alias("bb"))

        def move(t: Column) -> Column:
            aa, bb, gb = t["aa"] + 1e-9, t["bb"] + ridge, t["gb"] + ridge * w["b"]
            det = aa * bb - t["ab"] * t["ab"]
            return F.struct((w["a"] - (bb * t["ga"] - t["ab"] * gb) / det).alias("a"), (w["b"] - (aa * gb - t["ab"] * t["ga"]) / det).alias("b"))

        return F.aggregate(points, start, add, move)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, lambda w, _: step(w))


def window_fits(wc: DataFrame, by: list[str], period: str, x: str, ridge: float, steps: int = STEPS) -> DataFrame:
    """``a``, ``b`` and the rows ``n`` behind them, by group and period; null a and b where only one class was met."""
    points = F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col("n").cast("double").alias("n"), F.col("s").cast("double").alias("s"))))
    per = wc.groupBy(*by, period).agg(points.alias("points"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    both = (F.col("s") > 0) & (F.col("s") < F.col("n"))
    return per.withColumn("w", F.when(both, newton(F.col("points"), ridge, steps))).select(*by, period, "w.a", "w.b", "n")


def daily_fits(events: DataFrame, played: str, available: str, x: str, y: str, width: int, least: int, ridge: float = 1.0) -> DataFrame:
    """day, a, b, n and ``ready`` for each day from the first available one to a day after the last: the model that stood
    before the day, fitted on events of the last ``width`` days that were known by then. An event counts from the day
    after it became available, and leaves the window by the day it was played."""
    e = events.dropna(subset=[played, available, x, y]).withColumn("__in", F.greatest(F.col(played), F.col(available)) + 1).withColumn("__out", F.col(played) + width + 1).where(F.col("__in") < F.col("__out"))
    comes = cells(e, [], "__in", x, y).withColumnRenamed("__in", "day")
    goes = cells(e, [], "__out", x, y).withColumnRenamed("__out", "day").withColumns({"n": -F.col("n"), "s": -F.col("s")})
    c = comes.union(goes).groupBy("day", x).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    full = running(c, [], "day", x, comes.agg(F.max("day").alias("__last")))
    return window_fits(full, [], "day", x, ridge).withColumn("ready", (F.col("n") >= least) & F.col("a").isNotNull())


def residual_offsets(events: DataFrame, entity: str, played: str, available: str, y: str, expected: str, width: int, prior: float = 5.0, most: float = 1.5) -> DataFrame:
    """entity, day, ``n``, ``offset``: how far an entity's results lay from what was expected of them when they were played,
    as a one-step logistic offset shrunk by ``prior`` and held within ``most``; a row for each day on which an event of the
    entity enters or leaves its window, which holds until the next. Sums by day, running: an event more costs its day."""
    e = events.dropna(subset=[entity, played, available, y, expected])
    e = e.withColumn("__in", F.greatest(F.col(played), F.col(available)) + 1).withColumn("__out", F.col(played) + width + 1).where(F.col("__in") < F.col("__out"))
    ends = F.explode(F.array(F.struct(F.col("__in").alias("day"), F.lit(1).alias("sign")), F.struct(F.col("__out").alias("day"), F.lit(-1).alias("sign")))).alias("e")
    r = F.col(y).cast("double") - F.col(expected)
    at = e.select(entity, ends, r.alias("r"), (F.col(expected) * (1 - F.col(expected))).alias("v")).select(entity, "e.*", "r", "v")
    daily = at.groupBy(entity, "day").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("r")).alias("r"), F.sum(F.col("sign") * F.col("v")).alias("v"))
    w = Window.partitionBy(entity).orderBy("day")
    run = daily.withColumns({k: F.sum(k).over(w) for k in ("n", "r", "v")})
    offset = F.greatest(F.lit(-most), F.least(F.lit(most), F.col("r") / (F.col("v") + prior)))
    return run.select(entity, "day", "n", F.when(F.col("n") > 0, offset).otherwise(0.0).alias("offset"))


def context_fits(df: DataFrame, by: list[str], period: str, x: str, y: str, ridge: float = 1.0) -> DataFrame:
    """The fits of a context's groups (of all rows together, without ``by``) by period, each from all earlier periods."""
    c = cells(df, by, period, x, y).withColumn(period, F.col(period) + 1)  # what a period leaves to later ones
    return window_fits(running(c, by, period, x, df.agg(F.max(period).alias("__last"))), by, period, x, ridge)


def context_calibrated(df: DataFrame, levels: list[list[str]], period: str, x: str, y: str, least: list[int], ridge: float = 1.0) -> DataFrame:
    """``df`` with ``calibrated`` and the ``level`` (0 is the finest) whose fit gave it: the first level that had ``least``
    rows (a number for each level) before the period; null and the number of levels where none had."""
    out, choice, level = df, F.lit(None).cast("double"), F.lit(len(levels))
    for i in reversed(range(len(levels))):
        fit = context_fits(df, levels[i], period, x, y, ridge).where((F.col("n") >= least[i]) & F.col("a").isNotNull()).select(*levels[i], period, F.struct("a", "b").alias(f"__w{i}"))
        out = out.join(fit, [*levels[i], period], "left")
        w = F.col(f"__w{i}")
        choice = F.when(w.isNotNull(), 1 / (1 + F.exp(-(w["a"] + w["b"] * F.col(x))))).otherwise(choice)
        level = F.when(w.isNotNull(), i).otherwise(level)
    return out.withColumns({"calibrated": choice, "level": level}).drop(*(f"__w{i}" for i in range(len(levels))))
