"""Roster skill, history state and ranking badges against plain versions."""

import math
import random
from collections import defaultdict, namedtuple

from chronolith.operators import folds as R
from chronolith.operators.composites import history_state, ranking_badges

Row = namedtuple("Row", "a b players_a players_b y")


def test_roster_skill_emits_before_it_learns():
    step, s = R.roster_trueskill_step(), {}
    new = R.trueskill_step()
    assert step(s, Row("x", "y", [1, 2, 3, 3, None], [4, 5, 6], 1)) == (None,) * 8
    mean_x, top, low, spread, mean_y, *_ = step(s, Row("x", "y", [1, 2], [4, 5, 6], 0))
    assert top == low == mean_x > 25 > mean_y and spread == 0
    held = dict(s)
    step(s, Row("x", "y", None, [4, 5, 6], 1))
    assert s == held  # two or no players on a side change nothing
    # a player meets a team of three as one of variance var / 3
    var = (25 / 3) ** 2
    got = R._meet((25.0, var), (25.0, var / 3), (25 / 6) ** 2, (25 / 300) ** 2)[0]
    assert math.isclose(s["player", 1][0], got[0]) and math.isclose(s["player", 1][1], got[1])
    one, t = {}, namedtuple("T", "a b y")
    new(one, t("p", "q", 1))
    assert math.isclose(one["p"][0] + one["q"][0], 50)


def test_history_state(spark):
    rnd = random.Random(4)
    rows = [(0, g // 3, g, *rnd.sample("abcd", 2), int(rnd.random() < 0.6), rnd.randint(-5, 5), rnd.choice(["e", "f", None])) for g in range(40)]
    df = spark.createDataFrame(rows, "u int, day int, game int, a string, b string, y int, margin int, event string")
    g = R.fold(df, ["u"], ["day", "game"], ["a", "b", "y"], R.elo_step(), "rating_a double, rating_b double, expected double", keep=["day", "game", "a", "b", "y", "margin", "event"])
    got = {(r.team, r.event, r.whole): r for r in history_state(g, ["u"], ["day", "game"], "event").collect()}
    elo, want = defaultdict(lambda: 1500.0), defaultdict(list)
    for _, day, _, a, b, y, margin, event in rows:
        ra, rb = elo[a], elo[b]
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        elo[a], elo[b] = ra + 32 * (y - e), rb - 32 * (y - e)
        for team, won, diff, rival in ((a, y, margin, rb), (b, 1 - y, -margin, ra)):
            for key in ((team, None, 1), (team, event, 0)):
                want[key].append((won, diff, rival, day, elo[team]))
    assert set(got) == set(want)
    for key, x in want.items():
        r, n = got[key], len(x)
        assert (r.games, r.wins, r.last_day) == (n, sum(v[0] for v in x), x[-1][3])
        assert math.isclose(r.mean_margin, sum(v[1] for v in x) / n, abs_tol=1e-9) and math.isclose(r.opponents, sum(v[2] for v in x) / n) and math.isclose(r.rating, x[-1][4])


def test_ranking_badges(spark):
    def badge(href, text, css="ranking-badge"):
        return f'<a class="x {css}" href="{href}">{text}</a>'

    ok = "/ranking/teams/2024/may/6"
    pages = {
        1: badge(ok + "?teamId=7", "<b>World</b> : # 12") + badge("https://h.io" + ok + "/8", "World: #3") + badge(ok + "?x=1&amp;teamId=9", "World: #4"),
        2: badge(ok + "?teamId=7", "World: #1") + badge(ok + "?teamId=7", "World: #2") + badge(ok + "?teamId=8", "World: #5") * 2,
        3: badge(ok, "World: #1") + badge(ok + "/7?teamId=8", "World: #1") + badge(ok + "/x", "World: #1") + badge("http://h.io" + ok + "/7", "World: #1"),
        4: badge("/ranking/teams/2024/may/32/7", "World: #1") + badge("/ranking/teams/2024/mai/3/7", "World: #1") + badge("https://hxio" + ok + "/7", "World: #1"),
        5: badge(ok + "/7", "World: #0") + badge(ok + "/7", "Points: #1") + badge(ok + "/7", "World: #1", "other") + badge("/valued/teams/2024/may/6/7", "Points: #2"),
        6: None,
        7: "",
    }
    df = spark.createDataFrame(list(pages.items()), "page int, html string")
    out = ranking_badges(df, "page", "html", "h.io", {"ranking": "World", "valued": "Points"}).collect()
    got = sorted((r.page, r.team, r.kind, r.position, str(r.published), r.url) for r in out)
    at, day = "https://h.io" + ok, "2024-05-06"
    assert got == [
        (1, "7", "ranking", 12, day, at + "?teamId=7"),
        (1, "8", "ranking", 3, day, at + "/8"),
        (1, "9", "ranking", 4, day, at + "?x=1&teamId=9"),
        (2, "8", "ranking", 5, day, at + "?teamId=8"),
        (5, "7", "valued", 2, day, "https://h.io/valued/teams/2024/may/6/7"),
    ]
