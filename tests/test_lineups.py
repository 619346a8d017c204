"""Line-ups against pairs of games, and how many rows a comparison makes."""

import random
import time

from pyspark.sql import functions as F

from chronolith.operators import lineups as L

GAMES = "game long, team long, day int, players array<long>"


def brute(announced, played, size, days):
    out = {}
    for game, team, day, players in announced:
        now = sorted({p for p in players or [] if p is not None})
        near = [] if len(now) != size else [(d, g, five) for g, t, d, x in played for five in [sorted({p for p in x or [] if p is not None})] if t == team and len(five) == size and day - days <= d < day and g != game]
        if not near:
            out[game, team] = (0, 0, None, None, None, None)
            continue
        n = {}
        for d, g, five in near:
            k, last = n.get(tuple(five), (0, (-1, -1)))
            n[tuple(five)] = k + 1, max(last, (d, g))
        latest = max(n, key=lambda f: n[f][1])
        modal = max(n, key=lambda f: n[f])
        seen = {p for f in n for p in f}
        out[game, team] = (len(near), len(n), max(k for k, _ in n.values()), tuple(now) != latest, tuple(now) != modal, len(set(now) - seen))
    return out


def test_roster_change_against_pairs(spark):
    r = random.Random(4)
    row = lambda g: (g, r.randrange(3), r.randrange(400), r.choice([None, [1, 2, None], *[r.sample(range(5), 3) for _ in range(8)]]))
    played = [row(g) for g in range(300)]
    # games that were put off: announced on a later day than they were first played on, some twice, and one of the only line-up
    moved = [(g, t, d + r.randrange(1, 60), x) for g, t, d, x in played[:80]]
    played += [(g, t, d + 2, x) for g, t, d, x in played[:20]] + [(900, 7, 10, [1, 2, 3])]
    announced = moved + played[80:300] + [(900, 7, 20, [1, 2, 3])]
    out = L.roster_change(spark.createDataFrame(announced, GAMES), spark.createDataFrame(played, GAMES), "team", size=3, days=30).collect()
    want = brute(announced, played, 3, 30)
    assert len(out) == len(announced)
    for x in out:
        assert (x.compared, x.distinct, x.modal_games, x.from_latest, x.from_modal, x.new_players) == want[x.game, x.team], x


def test_a_team_of_many_games_is_not_compared_by_pairs(spark):
    """200,000 games of one team within 60 days: some 10 to the 10 pairs."""
    g = spark.range(200_000).select(F.col("id").alias("game"), F.lit(1).cast("long").alias("team"), (F.col("id") % 60).cast("int").alias("day"), F.array(F.lit(1), F.lit(2), F.lit(3) + F.col("id") % 3).alias("players"))
    t = time.time()
    one = L.roster_change(g, g, "team", size=3).agg(F.sum("compared")).first()[0]
    per_day = [sum(1 for i in range(200_000) if i % 60 == d) for d in range(60)]
    assert one == sum(n * sum(per_day[:d]) for d, n in enumerate(per_day))
    assert time.time() - t < 120
