"""Windows over strictly prior rows, days and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def prior(keys: list[str], order: list[str], n: int | None = None):
    """The last n rows before the current one (all, if n is None)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def laplace_rate(win: Column, w) -> Column:
    """(wins + 1) / (n + 2); a half if nothing came before."""
    return (F.coalesce(F.sum(win).over(w), F.lit(0)) + 1) / (F.count(win).over(w) + 2)


def prior_mean(x: Column, w, empty: float = 0.0) -> Column:
    return F.coalesce(F.avg(x).over(w), F.lit(empty))


def decayed_rate(df: DataFrame, keys: list[str], order: list[str], win: str, day: str, n: int = 30, half_life: float = 120.0) -> Column:
    """Win rate of the last n prior rows, weighted 0.5 ** (whole days / half-life), with half a win
    in one pseudo-row. Weights depend on the current row, so the rows are folded in place."""
    past = F.collect_list(F.struct(F.col(win).cast("double").alias("w"), F.col(day).alias("d"))).over(prior(keys, order, n))
    weight = lambda x: F.pow(F.lit(0.5), F.datediff(F.col(day), x["d"]) / half_life)
    num = F.aggregate(past, F.lit(0.5), lambda a, x: a + weight(x) * x["w"])
    return num / F.aggregate(past, F.lit(1.0), lambda a, x: a + weight(x))


def days_since(keys: list[str], order: list[str], seconds: str, cap: int = 90) -> Column:
    """Whole days since the row before, 0 to cap; cap without one."""
    gap = F.floor((F.col(seconds) - F.lag(seconds).over(Window.partitionBy(*keys).orderBy(*order))) / 86400)
    return F.coalesce(F.least(F.greatest(gap, F.lit(0)), F.lit(cap)), F.lit(cap)).cast("long")


def active_in(keys: list[str], seconds: str, days: int) -> Column:
    """Prior rows between one and ``days`` whole days ago; those of the last 24 hours don't count."""
    w = Window.partitionBy(*keys).orderBy(F.floor(seconds)).rangeBetween(-((days + 1) * 86400 - 1), -86400)
    return F.count(F.lit(1)).over(w)


def signed_streak(df: DataFrame, keys: list[str], order: list[str], win: str, name: str = "streak") -> DataFrame:
    """Length of the run of equal outcomes that ends at the row before, negative for losses."""
    w = Window.partitionBy(*keys).orderBy(*order)
    turn = (F.lag(win).over(w).isNull() | (F.lag(win).over(w) != F.col(win))).cast("int")
    d = df.withColumn("__turn", turn)
    d = d.withColumn("__island", F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy(*keys, "__island").orderBy(*order))
    d = d.withColumn("__run", F.when(F.col(win) == 1, run).otherwise(-run))
    return d.withColumn(name, F.coalesce(F.lag("__run").over(w), F.lit(0)).cast("long")).drop("__turn", "__island", "__run")


def form_of_last(df: DataFrame, key: str, day: str, win: str, n: int = 10) -> DataFrame:
    """Win rate before each day over whole days, newest first, until n results are reached: a day is
    taken in full, so more than n may count. One row for each key and day."""
    days = df.groupBy(key, day).agg(F.count(F.lit(1)).alias("n"), F.sum(win).alias("wins"))
    w = Window.partitionBy(key).orderBy(day)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    run = days.withColumn("__n", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("__w", F.coalesce(F.sum("wins").over(before), F.lit(0)))
    # day j is in the form of day i iff the results after j and before i are fewer than n: the first such day is the one
    # with the least running count above (count before i) - n. Days (by the count after them) and questions stand in one
    # sequence by falling count, and the last day seen is carried on
    here = run.select(key, day, F.col("__n").alias("total"), F.col("__w").alias("all_won"), (F.col("__n") - n).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast("struct<upto:bigint,n:bigint,w:double>").alias("__day"))
    past = run.select(key, F.lit(None).cast(df.schema[day].dataType).alias(day), F.lit(None).cast("long").alias("total"), F.lit(None).cast("double").alias("all_won"), (F.col("__n") + F.col("n")).alias("__at"), F.lit(1).alias("__side"),
                      F.struct((F.col("__n") + F.col("n")).alias("upto"), F.col("__n").alias("n"), F.col("__w").cast("double").alias("w")).alias("__day"))
    carried = F.last("__day", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("__at"), "__side").rowsBetween(Window.unboundedPreceding, -1))
    asked = here.withColumn("all_won", F.col("all_won").cast("double")).unionByName(past).withColumn("__first", carried).where("__side = 0")
    known = F.col("__first.upto") <= F.col("total")  # else the day itself is the first one
    held, won = F.when(known, F.col("total") - F.col("__first.n")), F.when(known, F.col("all_won") - F.col("__first.w"))
    return asked.select(key, day, F.coalesce(held, F.lit(0)).cast("long").alias("form_n"), F.try_divide(won, held).alias("form"))


def head_to_head(df: DataFrame, a: str, b: str, order: list[str], won_a: str) -> DataFrame:
    """Meetings of the unordered pair before each row, and wins of ``a`` in them."""
    d = df.withColumn("__lo", F.least(a, b)).withColumn("__hi", F.greatest(a, b))
    d = d.withColumn("__low_won", F.when(F.col(a) == F.col("__lo"), F.col(won_a)).otherwise(1 - F.col(won_a)))
    w = prior(["__lo", "__hi"], order)
    n = F.count(F.lit(1)).over(w)
    low = F.coalesce(F.sum("__low_won").over(w), F.lit(0))
    d = d.withColumn("h2h_n", n).withColumn("h2h_wins", F.when(F.col(a) == F.col("__lo"), low).otherwise(n - low).cast("long"))
    return d.drop("__lo", "__hi", "__low_won")
