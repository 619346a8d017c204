"""Line-ups: what changed against those of the last months, and how a side's players spread around their mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def players_set(x: str) -> Column:
    """Distinct players in order, null ones left out."""
    return F.array_sort(F.array_distinct(F.filter(x, lambda p: p.isNotNull())))


def _recent(per_day: DataFrame, team: str, days: int) -> DataFrame:
    """Of line-ups by day (team, five, d, n, g) the rows (team, five, day, n, last) of each day that has the line-up in the ``days``
    before it: its games of that time, and day and game of the last one."""
    w = Window.partitionBy(team, "five").orderBy("d")
    until = F.least(F.col("d") + days, F.coalesce(F.lead("d").over(w), F.col("d") + days))
    days_on = per_day.withColumn("until", until).withColumn("day", F.explode(F.sequence(F.col("d") + 1, "until")))
    both = days_on.select(team, "five", "day", F.lit(0).cast("long").alias("n"), F.struct("d", "g").alias("last"))
    both = both.unionByName(per_day.select(team, "five", F.col("d").alias("day"), "n"), allowMissingColumns=True)
    cells = both.groupBy(team, "five", "day").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = Window.partitionBy(team, "five").orderBy("day").rangeBetween(-days, -1)
    return cells.withColumn("n", F.sum("n").over(before)).where(F.col("last").isNotNull())


def _without_own(near: DataFrame, known: DataFrame, own: DataFrame, team: str, days: int) -> DataFrame:
    """``near`` for each game of ``own`` (game, team, day, five, own), less the game's ``own`` rows."""
    games = own.select("game", team, "day").distinct()
    latest = Window.partitionBy(team, "five", "d").orderBy(F.desc("g"))  # of a day's games two at most are asked for
    two = known.select(team, "five", "d", "g").distinct().withColumn("at", F.row_number().over(latest)).where("at <= 2")
    again = own.join(two, [team, "five"]).where((F.col("d") < F.col("day")) & (F.col("d") >= F.col("day") - days) & (F.col("g") != F.col("game")))
    last = again.groupBy("game", team, "day", "five").agg(F.max(F.struct("d", "g")).alias("other"))
    mine = own.join(last, ["game", team, "day", "five"], "left").withColumn("is_own", F.lit(True))
    out = games.join(near, [team, "day"]).join(mine, ["game", team, "day", "five"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0)))
    return out.where("n > 0").select("game", team, "day", "five", "n", F.when(F.col("is_own"), F.col("other")).otherwise(F.col("last")).alias("last"))


def roster_change(announced: DataFrame, played: DataFrame, team: str, size: int = 5, days: int = 90) -> DataFrame:
    """``announced`` (game, team, day, players) with what changed against the team's line-ups of ``played`` (game, team, day,
    players) of the last ``days`` before it: status, games compared, distinct line-ups, games of the most frequent one (ties: that of
    the latest), changed from the latest and from it, players in and out since the latest, and players that none of them had.

    Only complete line-ups of ``size`` count. Games aren't compared by pairs: a team's line-ups are counted by day, each line-up
    stands for the days on which it is a recent one, and a window adds up its games of the last ``days``. So rows grow with a
    team's days and line-ups of that time, however many games it has. Games that ``played`` has on an earlier day too (they
    were put off) leave themselves out."""
    now = announced.select("game", team, "day", players_set("players").alias("now"))
    known = played.select(F.col("game").alias("g"), team, F.col("day").alias("d"), players_set("players").alias("five")).where(F.size("five") == size)
    own = now.where(F.size("now") == size).join(known.withColumnRenamed("g", "game"), ["game", team]).where((F.col("d") < F.col("day")) & (F.col("d") >= F.col("day") - days))
    per_day = known.groupBy(team, "five", "d").agg(F.count(F.lit(1)).alias("n"), F.max("g").alias("g"))
    near = _recent(per_day, team, days)
    facts = [
        F.sum("n").alias("compared"), F.count(F.lit(1)).alias("distinct"), F.max("n").alias("modal_games"),
        F.max_by("five", "last").alias("latest"), F.max_by("five", F.struct("n", "last")).alias("modal"), F.array_distinct(F.flatten(F.collect_list("five"))).alias("seen"),
    ]
    out = near.groupBy(team, "day").agg(*facts)
    put_off = own.groupBy("game", team, "day", "five").agg(F.count(F.lit(1)).alias("own"))
    theirs = _without_own(near, known, put_off, team, days).groupBy("game", team, "day").agg(*facts)
    names = ["compared", "distinct", "modal_games", "latest", "modal", "seen"]
    without = theirs.select("game", team, "day", F.struct(*names).alias("b"))
    marked = put_off.select("game", team, "day").distinct().withColumn("off", F.lit(True))
    j = now.join(out.select(team, "day", F.struct(*names).alias("a")), [team, "day"], "left").join(marked, ["game", team, "day"], "left").join(without, ["game", team, "day"], "left")
    j = j.withColumn("s", F.when(F.size("now") == size, F.when(F.col("off"), F.col("b")).otherwise(F.col("a")))).select("game", team, "day", "now", "s.*")
    status = F.when(F.size("now") == 0, "missing").when(F.size("now") != size, "incomplete").when(F.col("latest").isNull(), "no_recent_history").when(F.col("now") == F.col("latest"), "unchanged").otherwise("changed")
    part = lambda a, b: F.size(F.array_except(a, b))
    some = lambda c: F.when(F.col("latest").isNotNull(), c)
    return j.select(
        "game", team, status.alias("status"), F.coalesce("compared", F.lit(0)).alias("compared"), F.coalesce("distinct", F.lit(0)).alias("distinct"), "modal_games",
        some(F.col("now") != F.col("latest")).alias("from_latest"), some(F.col("now") != F.col("modal")).alias("from_modal"),
        some(part("now", "latest")).alias("players_in"), some(part("latest", "now")).alias("players_out"), some(part("now", "seen")).alias("new_players"),
    )


def spread_features(ratings: str, least: int = 4) -> dict[str, Column]:
    """Mean, extremes, the means of the two best and worst, how far the star stands above the mean and the weakest below it,
    of an array of ratings (null ones left out); nulls for fewer than ``least``."""
    r = F.sort_array(F.filter(ratings, lambda x: x.isNotNull()))
    n = F.size(r)
    mean = F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / n
    some = {
        "mean": mean, "star": r[n - 1], "weakest": r[0], "top2": (r[n - 1] + r[n - 2]) / 2, "bottom2": (r[0] + r[1]) / 2,
        "star_gap": r[n - 1] - mean, "weak_link": mean - r[0],
    }
    return {k: F.when(n >= least, v) for k, v in some.items()}
