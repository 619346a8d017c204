"""Queries over day blocks that stop and resume, previews, frozen days, late results and run-level intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import blocks as K, folds as R, incremental as I, late_results as L
from ..sources.io import table
from ..sources.staging import new_path, shuffles_freed, stage
from ..streaming import ingest, pipelines as P
from .folds import BLOCK_SQL, GAMES_SQL, ORDER, elo_sql, emitted, games
from .registry import query

SPAN = 1300


def _resumed(spark, sf) -> tuple[K.BlockStore, DataFrame]:
    """A store whose first run ends after one span; the second one takes it up. And its games, staged once for all that reads them."""
    store = K.BlockStore(spark, new_path(spark, "blocks"), "universe", ["game", "b"])
    with shuffles_freed(spark):
        g = stage(games(spark, sf).select("universe", "day", "game", "a", "b", "y", "surface"), "block-games")
    store.run(g, SPAN, stop_after=1, staged=True)
    store.run(g, SPAN, staged=True)
    return store, g


@query("elo_resumed", BLOCK_SQL)
def elo_resumed(spark, sf):
    return emitted(_resumed(spark, sf)[0].read("rated"))


@query("elo_preview", BLOCK_SQL)
def elo_preview(spark, sf):
    """All games as fixtures, from the states of earlier days."""
    store, g = _resumed(spark, sf)
    return emitted(K.preview(store.read("states"), g.drop("y"), "universe"))


@query("elo_frozen_days")
def elo_frozen_days(spark, sf):
    """Days on which a game has no time (here: no surface) are frozen."""
    g = K.frozen_days(games(spark, sf), "universe", "day", F.col("surface").isNull())
    out = R.mixed_days(g.withColumn("opponent", F.col("b")), ["universe"], "day", ["game", "opponent"], "a", "b", "y", "frozen", ["game", "opponent"])
    return out.select("universe", "game", F.col("opponent").alias("b"), *[F.round(c, 6).alias(c) for c in ("rating_a", "rating_b", "expected")])


@query(
    "form_as_known",
    f"""WITH r AS (SELECT o_custkey AS e, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS played, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + l_linenumber * 20 AS known, CAST(l_returnflag = 'R' AS INT) AS won FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
q AS (SELECT o_custkey AS e, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderkey AS ask FROM orders),
d AS (SELECT q.e, q.day, ask, played, sum(won) AS w, count(played) AS n FROM q LEFT JOIN r ON r.e = q.e AND r.known < q.day GROUP BY 1, 2, 3, 4),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY ask ORDER BY played DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM d)
SELECT e, day, ask, round(sum(w) FILTER (later < {L.LAST}) / nullif(sum(n) FILTER (later < {L.LAST}), 0), 6) AS recent_rate, coalesce(sum(n) FILTER (later < {L.LAST}), 0)::BIGINT AS recent_games,
round(sum(w) FILTER (played >= day - {L.DAYS}) / nullif(sum(n) FILTER (played >= day - {L.DAYS}), 0), 6) AS form_rate, coalesce(sum(n) FILTER (played >= day - {L.DAYS}), 0)::BIGINT AS form_games, (day - max(played))::BIGINT AS rest_days FROM c GROUP BY 1, 2, 3""",
)
def form_as_known(spark, sf):
    """Customers' lines as results that become known late, the later the later the line; orders ask for the form."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("e"), F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    li = table(spark, sf, "lineitem").withColumn("played", F.unix_date(F.col("l_shipdate").cast("date")))
    r = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("e", "played", (F.col("played") + F.col("l_linenumber") * 20).alias("known"), (F.col("l_returnflag") == "R").cast("int").alias("won"))
    out = L.form_as_known(r, o.select("e", "day", F.col("o_orderkey").alias("ask")), "e")
    return out.select("e", F.col("day").cast("long").alias("day"), "ask", F.round("recent_rate", 6).alias("recent_rate"), "recent_games", F.round("form_rate", 6).alias("form_rate"), "form_games", "rest_days")


@query("ingested_runs", "SELECT CAST(ts AS DATE) AS run, count(*) AS announced, count(*) AS arrived, 0::BIGINT AS differing, TRUE AS complete FROM events GROUP BY 1")
def ingested_runs(spark, sf):
    """Each day of events as a run, taken in through a stream, twice."""
    e = table(spark, sf, "events")
    announced = e.groupBy(F.to_date("ts").alias("run")).agg(F.count(F.lit(1)).alias("announced"))
    source = new_path(spark, "runs")
    e.withColumn("run", F.to_date("ts")).join(announced, "run").write.parquet(source)
    rows = spark.read.parquet(source)
    store = ingest.RunStore(spark, new_path(spark, "run-store"), ["run"], ["event_id"], "announced")
    for _ in range(2):
        store.take(P.stream(spark, source, rows), new_path(spark, "run-state"))
    return store.runs().select("run", "announced", "arrived", "differing", "complete")


@query(
    "elo_frozen_share",
    f"WITH {GAMES_SQL}, f AS (SELECT universe, day, bool_or(surface IS NULL) AS frozen, count(*) AS n FROM g GROUP BY 1, 2) SELECT universe, sum(n)::BIGINT AS games, coalesce(sum(n) FILTER (frozen), 0)::BIGINT AS frozen_games, count(*) FILTER (frozen) AS frozen_days FROM f GROUP BY 1",
)
def elo_frozen_share(spark, sf):
    """How much of each universe is played on days that are frozen."""
    g = K.frozen_days(games(spark, sf), "universe", "day", F.col("surface").isNull())
    return g.groupBy("universe").agg(F.count(F.lit(1)).alias("games"), F.count_if("frozen").alias("frozen_games"), F.count_distinct(F.when(F.col("frozen"), F.col("day"))).alias("frozen_days"))


@query(
    "roster_ratings",
    f"""WITH o AS ({elo_sql("32 * (y - e)", digits=15)}), {GAMES_SQL},
e AS (SELECT g.universe, g.game, g.b, day, unnest([{{'side': 'a', 'team': g.a, 'r': rating_a}}, {{'side': 'b', 'team': g.b, 'r': rating_b}}]) AS s FROM g JOIN o ON o.universe = g.universe AND o.game = g.game AND o.b = g.b),
p AS (SELECT universe, game, b, day, s.side AS side, s.team AS team, s.r AS r, list_sort(list_distinct([s.team * 10, s.team * 10 + game % 7, s.team * 10 + 2 * game % 7, s.team * 10 + 3 * game % 7, s.team * 10 + 4 * game % 7])) AS five FROM e),
l AS (SELECT *, last_value(CASE WHEN len(five) = 5 THEN {{'f': five, 'd': day}} END IGNORE NULLS) OVER (PARTITION BY universe, team ORDER BY day, game, b, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p),
k AS (SELECT *, CASE WHEN len(five) = 5 AND day > last.d AND day - last.d <= 90 THEN len(list_intersect(five, last.f)) END AS kept FROM l),
x AS (SELECT *, 1500 + CASE WHEN 5 - kept >= 2 THEN 0.2::DOUBLE + 0.8::DOUBLE * kept / 5 ELSE 1 END * (r - 1500) AS adj FROM k)
SELECT a.universe, a.game, a.b, CAST(a.kept AS INT) AS kept_a, CAST(b.kept AS INT) AS kept_b, round(a.adj, 6) AS adjusted_a, round(b.adj, 6) AS adjusted_b, round(1 / (1 + power(10, (b.adj - a.adj) / 400)), 6) AS expected
FROM x a JOIN x b ON a.universe = b.universe AND a.game = b.game AND a.b = b.b AND a.side = 'a' AND b.side = 'b'""",
)
def roster_ratings(spark, sf):
    """Ratings with credit for changed rosters; every seventh game has incomplete line-ups."""
    five = lambda side: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col(side) * 10 + F.pmod(i * F.col("game"), F.lit(7)))
    g = games(spark, sf)
    rated = R.fold(g, ["universe"], ORDER, ["a", "b", "y"], R.elo_step(), "rating_a double, rating_b double, expected double", keep=[*ORDER, "a"])
    out = I.roster_ratings(rated.withColumns({"players_a": five("a"), "players_b": five("b")}), "universe", ORDER)
    return out.select("universe", "game", "b", "kept_a", "kept_b", *[F.round(c, 6).alias(c) for c in ("adjusted_a", "adjusted_b", "expected")])
