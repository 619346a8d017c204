"""Ratings continued from stored states, closed day blocks, block checkpoints and roster changes.

A run's states are a small table (universe, entity, rating, day); the next run reads it instead of all
history, so a day costs its own games.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .folds import _p, fold

SIDES = "rating_a double, rating_b double, expected double"


def seeded_elo(states: DataFrame, games: DataFrame, universe: str, order: list[str], keep: list[str], k: float = 32.0, base: float = 1500.0) -> DataFrame:
    """Online Elo over ``games`` (universe, order, a, b, y, day) that begins with ``states``. States stand before
    all games of their universe in the same sequence; a game on or before a universe's last closed day
    fails the run, as its block can't be opened again."""
    cols = list(dict.fromkeys([universe, *order, "a", "b", "y", "day", *keep]))
    closed = states.groupBy(universe).agg(F.max("day").alias("__closed"))
    late = F.when(F.col("__closed") >= F.col("day"), F.raise_error(F.concat(F.lit("closed block: day "), F.col("day").cast("string")))).otherwise(F.lit(1))
    g = games.select(*cols).join(closed, universe, "left").withColumn("__seq", late.cast("int")).drop("__closed").withColumn("__rating", F.lit(None).cast("double"))
    blank = {c: F.lit(None).cast(games.schema[c].dataType) for c in cols if c not in (universe, "a", "day")}
    s = states.select(universe, F.col("entity").alias("a"), F.col("rating").alias("__rating"), F.col("day").cast(games.schema["day"].dataType).alias("day")).withColumns(blank).withColumn("__seq", F.lit(0))
    both = g.unionByName(s).withColumnsRenamed({"__seq": "seq", "__rating": "seed"})

    def step(state: dict, r) -> tuple:
        if r.seq == 0:
            state[r.a] = r.seed
            return None, None, None, 0
        a, b = state.get(r.a, base), state.get(r.b, base)
        e = _p(a, b)
        state[r.a], state[r.b] = a + k * (r.y - e), b - k * (r.y - e)
        return a, b, e, 1

    keep_all = list(dict.fromkeys([*keep, "a", "b", "y", "day"]))
    order = ["seq", *order, "a"] if "a" not in order else ["seq", *order]
    out = fold(both.select(*cols, "seq", "seed"), [universe], order, ["seq", "seed", "a", "b", "y"], step, SIDES + ", real long", keep=[c for c in keep_all if c != universe])
    return out.where("real = 1").drop("real")


def states_after(rated: DataFrame, universe: str, order: list[str], before: DataFrame | None = None, k: float = 32.0) -> DataFrame:
    """States (universe, entity, rating, day) after all rows of a rated run (a, b, y, ratings before each row),
    with those of ``before`` that it didn't touch."""
    d = F.lit(k) * (F.col("y") - F.col("expected"))
    side = lambda e, r: F.struct(F.col(e).alias("entity"), r.alias("rating"))
    one = rated.select(universe, *order, "day", F.explode(F.array(side("a", F.col("rating_a") + d), side("b", F.col("rating_b") - d))).alias("x")).select(universe, *order, "day", "x.*")
    last = one.groupBy(universe, "entity").agg(F.max_by(F.struct("rating", "day"), F.struct(*order)).alias("s")).select(universe, "entity", "s.*")
    if before is None:
        return last
    return last.unionByName(before.join(last, [universe, "entity"], "left_anti").select(universe, "entity", "rating", F.col("day").cast(last.schema["day"].dataType)))


def block_checkpoints(rated: DataFrame, universe: str) -> DataFrame:
    """A row for each universe and day: games, entities and an order-free hash of the inputs, so that a resumed
    run can tell a block that is done from one whose inputs have changed."""
    row = F.xxhash64("a", "b", "y", "game")
    side = rated.withColumn("__e", F.explode(F.array("a", "b"))).groupBy(universe, "day").agg(F.count_distinct("__e").alias("entities"))
    per = rated.groupBy(universe, "day").agg(F.count(F.lit(1)).alias("games"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("input_hash"))
    return per.join(side, [universe, "day"])


def roster_adjusted(df: DataFrame, current: str, previous: str, days: str, rating: str, rd: str, size: int = 5, least: int = 2, floor: float = 0.2, neutral: float = 1500.0, max_rd: float = 350.0, lookback: int = 90) -> DataFrame:
    """Credit for a changed roster: with ``least`` of ``size`` players replaced since a complete line-up at most
    ``lookback`` days old, the rating keeps a fraction f of its distance to neutral and RD grows,
    r' = neutral + f (r - neutral), RD'^2 = f RD^2 + (1 - f) max^2, f from ``floor`` to 1 by players kept."""
    now, old = F.array_distinct(F.filter(current, lambda x: x.isNotNull())), F.array_distinct(F.filter(previous, lambda x: x.isNotNull()))
    comparable = F.coalesce((F.size(now) == size) & (F.size(old) == size) & (F.col(days) > 0) & (F.col(days) <= lookback), F.lit(False))
    kept = F.size(F.array_intersect(now, old))
    f = F.when(comparable & (size - kept >= least), floor + (1 - floor) * kept / size).otherwise(1.0)
    out = df.withColumn("retained", F.when(comparable, kept)).withColumn("credit", f)
    wide = F.sqrt(F.col("credit") * F.col(rd) * F.col(rd) + (1 - F.col("credit")) * max_rd * max_rd)
    return out.withColumns({"rating_adjusted": neutral + F.col("credit") * (F.col(rating) - neutral), "rd_adjusted": F.when(F.col("credit") < 1, F.least(F.lit(max_rd), wide)).otherwise(F.col(rd))})


def roster_ratings(rated: DataFrame, universe: str, order: list[str], size: int = 5, neutral: float = 1500.0, **credit) -> DataFrame:
    """Games of an Elo run (universe, order, day, a, b, players_a, players_b, rating_a, rating_b) with both sides' players kept,
    adjusted ratings and the expectation from them. A side's announced players are compared with the last complete line-up that it
    was seen with, in an earlier game of the order and on an earlier day; the run's own ratings stay as they are."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("team"), F.col(f"players_{s}").alias("now"), F.col(f"rating_{s}").alias("rating"))
    keys = list(dict.fromkeys([universe, *order, "day"]))
    each = rated.select(*keys, F.explode(F.array(side("a"), side("b"))).alias("s")).select(*keys, "s.*")
    five = F.array_distinct(F.filter("now", lambda x: x.isNotNull()))
    before = Window.partitionBy(universe, "team").orderBy(*order, "side").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.size(five) == size, F.struct(five.alias("five"), F.col("day").alias("day"))), ignorenulls=True).over(before)
    seen = each.withColumn("last", last).withColumns({"old": F.col("last.five"), "age": F.col("day") - F.col("last.day"), "rd": F.lit(0.0)})
    adjusted = roster_adjusted(seen, "now", "old", "age", "rating", "rd", size=size, neutral=neutral, **credit)
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    out = adjusted.groupBy(*keys).agg(*[of(s, c).alias(f"{name}_{s}") for s in ("a", "b") for c, name in (("retained", "kept"), ("rating_adjusted", "adjusted"))])
    return out.withColumn("expected", 1 / (1 + F.pow(F.lit(10.0), (F.col("adjusted_b") - F.col("adjusted_a")) / 400)))
