"""Ordered folds over independent universes: the nations of the customers behind the orders. Those whose step SQL can state
have it as a recursive query; tests compare the others with a plain sequential loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import week_index
from ..operators import folds as R
from ..operators.composites import history_state
from ..operators.dedup import top_per_group
from ..sources.io import table
from .registry import query


def games(spark, sf):
    """Games between suppliers: each line against its order's first supplier, in the universe of the customer's nation."""
    li, c = table(spark, sf, "lineitem"), table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("universe"))
    o = table(spark, sf, "orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("date"), "universe")
    g = li.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.min("l_returnflag").alias("flag"))
    first = g.groupBy("l_orderkey").agg(F.min(F.struct("l_suppkey", "q")).alias("f"))
    j = g.join(first, "l_orderkey").where("l_suppkey <> f.l_suppkey").join(o, "l_orderkey")
    return j.select(
        "universe", F.col("l_orderkey").alias("game"), F.col("f.l_suppkey").alias("a"), F.col("l_suppkey").alias("b"),
        (F.col("f.q") >= F.col("q")).cast("int").alias("y"), (F.col("f.q") - F.col("q")).alias("margin"), F.datediff("date", F.lit("1990-01-01")).alias("day"), week_index(F.col("date")).alias("week"),
        F.when(F.col("flag") != "R", F.col("flag")).alias("surface"), ((F.col("l_orderkey") % 79 + 10) / 99.0).alias("p"), (1.3 + 20 * F.col("d")).alias("q1"), (1.3 + 20 * F.col("t")).alias("q2"),
    )


#: The same games as CTEs, the last one ``g``.
GAMES_SQL = """li AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS t, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
fs AS (SELECT l_orderkey, min(l_suppkey) AS a, min_by(q, l_suppkey) AS fq FROM li GROUP BY 1),
g AS (SELECT c_nationkey AS universe, li.l_orderkey AS game, a, l_suppkey AS b, CAST(fq >= q AS INT) AS y, fq - q AS margin, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day,
CASE WHEN flag <> 'R' THEN flag END AS surface, (li.l_orderkey % 79 + 10) / 99.0::DOUBLE AS p, 1.3::DOUBLE + 20 * d AS q1, 1.3::DOUBLE + 20 * t AS q2
FROM li JOIN fs USING (l_orderkey) JOIN orders ON o_orderkey = li.l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_suppkey <> a)"""


def fold_sql(states: dict[str, tuple[str, str]], derived: str, emitted: dict[str, str], source: str = "g", where: str = "", digits: int = 6) -> str:
    """A fold as a recursive query: ``states`` gives each state's first value and its value after a row, ``derived`` names
    what a row and the states give, ``emitted`` what is returned, rounded."""
    first = ", ".join(f"{init} AS {name}" for name, (init, _) in states.items())
    after = ", ".join(f"{new} AS {name}" for name, (_, new) in states.items())
    kept = ", ".join(f"r.{name}" for name in states)
    shown = ", ".join(f"{x} AS {name}" for name, x in emitted.items())
    return f"""WITH RECURSIVE {GAMES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY universe ORDER BY day, game, b) AS i FROM {source}),
r AS (SELECT universe, 0::BIGINT AS i, {first}, NULL::BIGINT AS game, NULL::BIGINT AS b, NULL::BIGINT AS on_day, {", ".join(f"NULL::DOUBLE AS {name}" for name in emitted)} FROM (SELECT DISTINCT universe FROM s)
UNION ALL SELECT universe, i, {after}, game, b, day, {shown} FROM (SELECT s.*, {kept}, {derived} FROM r JOIN s ON s.universe = r.universe AND s.i = r.i + 1))
SELECT universe, game, b, {", ".join(f"round({name}, {digits}) AS {name}" for name in emitted)} FROM r WHERE i > 0 {where}"""


def elo_sql(step: str, where: str = "", source: str = "g", digits: int = 6) -> str:
    """Ratings as a map in the fold's state; ``step`` is what the first side gains."""
    after = f"map_concat(st, map_from_entries([(a, ra + {step}), (b, rb - ({step}))]))"
    derived = "coalesce(r.st[s.a], 1500.0) AS ra, coalesce(r.st[s.b], 1500.0) AS rb, 1 / (1 + power(10, (rb - ra) / 400)) AS e"
    return fold_sql({"st": ("MAP {}::MAP(BIGINT, DOUBLE)", after)}, derived, {"rating_a": "ra", "rating_b": "rb", "expected": "e"}, source, where, digits)


ONLINE_SQL = elo_sql("32 * (y - e)")


def _gain(key: str, gain: str) -> str:
    """An entry of what waits for the day's end, with a gain more."""
    return f"({key}, {{'x': coalesce(wait1[{key}].x, 0) + {gain}, 'n': coalesce(wait1[{key}].n, 0) + 1}})"


RATING = "STRUCT(x DOUBLE, n BIGINT)"
#: Day blocks: ``st`` holds ratings and games as of the day's start by entity and surface, ``wait`` the day's summed gains.
BLOCK_SQL = fold_sql(
    {"st": (f"MAP {{}}::MAP(VARCHAR, {RATING})", "st1"), "wait": (f"MAP {{}}::MAP(VARCHAR, {RATING})", "map_concat(wait1, map_from_entries(list_concat([" + _gain("ka", "da") + ", " + _gain("kb", "-db") + "], CASE WHEN surface IS NULL THEN [] ELSE [" + _gain("ja", "ca") + ", " + _gain("jb", "-cb") + "] END)))"), "at": ("NULL::BIGINT", "day")},
    """s.day IS DISTINCT FROM r.at AS new_day, CASE WHEN new_day THEN map_concat(r.st, map_from_entries(list_transform(map_entries(r.wait), lambda w: (w.key, {'x': coalesce(r.st[w.key].x, 1500) + w.value.x, 'n': coalesce(r.st[w.key].n, 0) + w.value.n})))) ELSE r.st END AS st1,
CASE WHEN new_day THEN MAP {}::MAP(VARCHAR, STRUCT(x DOUBLE, n BIGINT)) ELSE r.wait END AS wait1, s.a::VARCHAR AS ka, s.b::VARCHAR AS kb, s.surface || ':' || s.a AS ja, s.surface || ':' || s.b AS jb,
coalesce(st1[ka].x, 1500.0) AS ga, coalesce(st1[kb].x, 1500.0) AS gb, coalesce(st1[ka].n, 0) AS na, coalesce(st1[kb].n, 0) AS nb, CASE WHEN s.surface IS NULL THEN ga ELSE coalesce(st1[ja].x, 1500.0) END AS sa, CASE WHEN s.surface IS NULL THEN gb ELSE coalesce(st1[jb].x, 1500.0) END AS sb,
s.y - 1 / (1 + power(10, (gb - ga) / 400)) AS left_, s.y - 1 / (1 + power(10, (sb - sa) / 400)) AS left_s, 250 / power(na + 5, 0.4) * left_ AS da, 250 / power(nb + 5, 0.4) * left_ AS db,
250 / power(coalesce(st1[ja].n, 0) + 5, 0.4) * left_s AS ca, 250 / power(coalesce(st1[jb].n, 0) + 5, 0.4) * left_s AS cb""",
    {"elo_a": "ga", "elo_b": "gb", "surface_a": "sa", "surface_b": "sb", "games_a": "na", "games_b": "nb", "expected": "1 / (1 + power(10, ((gb + sb) / 2 - (ga + sa) / 2) / 400))"},
)
#: The step grows with the margin and shrinks with the winner's lead.
MARGIN_SQL = elo_sql("32 * (CASE WHEN margin <> 0 THEN ln(abs(margin) + 1) * 2.2 / (0.001 * (CASE WHEN y = 1 THEN abs(ra - rb) ELSE abs(rb - ra) END) + 2.2) ELSE 1.0 END) * (y - e)")
HINKLEY_SQL = fold_sql(
    {
        "n": ("0::BIGINT", "CASE WHEN alarm = 1 THEN 1 ELSE n1 END"), "mean": ("0::DOUBLE", "CASE WHEN alarm = 1 THEN x ELSE mean1 END"),
        "c": ("0::DOUBLE", "CASE WHEN alarm = 1 THEN 0 ELSE c1 END"), "m": ("0::DOUBLE", "CASE WHEN alarm = 1 THEN 0 ELSE m1 END"),
    },
    "abs(s.margin) / 50 AS x, r.n + 1 AS n1, r.mean + (x - r.mean) / n1 AS mean1, r.c + x - mean1 - 0.005 AS c1, least(r.m, c1) AS m1, c1 - m1 AS gap1, CAST(gap1 > 5 AS INT) AS alarm",
    {"running": "mean1", "gap": "gap1", "alarms": "alarm"},
    digits=9,  # means of few values often end after seven
)
BANK = {"bank": ("1000::DOUBLE", "bank1"), "peak": ("1000::DOUBLE", "peak1")}
BANK_STEP = """s.p >= 0.5 AS home, CASE WHEN home THEN s.p ELSE 1 - s.p END AS pp, 1 + (CASE WHEN home THEN s.q1 ELSE s.q2 END - 1) * 0.98 AS odds, pp * odds - 1 AS roi,
CASE WHEN odds > 1 AND roi > 0 THEN least(r.bank * least(0.025, 0.25 * roi / (odds - 1)), 100.0, 5000.0 / (odds - 1), r.bank) ELSE 0 END AS raw, CASE WHEN raw >= 1 THEN raw ELSE 0 END AS stake1,
r.bank + CASE WHEN (s.y = 1) = home THEN stake1 * (odds - 1) ELSE -stake1 END AS bank1, greatest(r.peak, bank1) AS peak1"""
BANK_SHOWN = {"stake": "stake1", "bankroll": "bank1", "drawdown": "1 - bank1 / peak1"}
PICKS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY universe, day ORDER BY p DESC, game, b) AS k FROM g) WHERE k <= 3)"
GAUSS = "STRUCT(m DOUBLE, v DOUBLE, day BIGINT, n BIGINT)"


def gauss_sql(derived: str, new_a: str, new_b: str, emitted: dict[str, str]) -> str:
    """A mean and a variance by entity in the fold's state."""
    after = f"map_concat(st, map_from_entries([(a, {new_a}), (b, {new_b})]))"
    return fold_sql({"st": (f"MAP {{}}::MAP(BIGINT, {GAUSS})", after)}, derived, emitted)


def _side(s: str, cap: float, drift: float) -> str:
    return f"coalesce(r.st[s.{s}].m, 0.0) AS m{s}, least({cap}, coalesce(r.st[s.{s}].v, 1.0) + {drift} * (s.day - coalesce(r.st[s.{s}].day, s.day)) / 7) AS v{s}, coalesce(r.st[s.{s}].n, 0) AS n{s}"


BRADLEY_SQL = gauss_sql(
    f"{_side('a', 1.0, 0.0025)}, {_side('b', 1.0, 0.0025)}, 1 / (1 + exp(-(ma - mb) / sqrt(1 + pi() * (va + vb + 1) / 8))) AS p1, least(1.0, va + 0.0025) AS ua, least(1.0, vb + 0.0025) AS ub, 1 / (1 + exp(-(ma - mb))) AS q_, greatest(q_ * (1 - q_), 1e-6) AS k_, 1 + k_ * (ua + ub + 1) AS d_",
    f"{{'m': ma + ua * (y - q_) / d_, 'v': greatest(1e-4, ua * (1 - k_ * ua / d_)), 'day': day, 'n': na + 1}}::{GAUSS}",
    f"{{'m': mb - ub * (y - q_) / d_, 'v': greatest(1e-4, ub * (1 - k_ * ub / d_)), 'day': day, 'n': nb + 1}}::{GAUSS}",
    {"rating_a": "ma", "rating_b": "mb", "expected": "p1", "available": "CAST(least(na, nb) >= 5 AS INT)"},
)
KALMAN_SQL = gauss_sql(
    f"{_side('a', 4.0, 0.01)}, {_side('b', 4.0, 0.01)}, 1 / (1 + exp(-(ma - mb) / sqrt(1 + va + vb))) AS p1, least(4.0, va + 0.01) AS ua, least(4.0, vb + 0.01) AS ub, ua + ub + 2 AS t_, CASE WHEN s.y = 1 THEN 1 ELSE -1 END - (ma - mb) AS e_",
    f"{{'m': ma + ua / t_ * e_, 'v': greatest(1e-4, ua * (1 - ua / t_)), 'day': day, 'n': 0}}::{GAUSS}",
    f"{{'m': mb - ub / t_ * e_, 'v': greatest(1e-4, ub * (1 - ub / t_)), 'day': day, 'n': 0}}::{GAUSS}",
    {"rating_a": "ma", "rating_b": "mb", "expected": "p1"},
)


ORDER, KEEP = ["day", "game", "b"], ["game", "b"]
PAIR = "rating_a double, rating_b double, expected double"


def _rounded(df, digits=6):
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


def _pairwise(spark, sf, step, out=PAIR, inputs=("a", "b", "y")):
    return _rounded(R.fold(games(spark, sf), ["universe"], ORDER, list(inputs), step, out, keep=["game", "b"]))


EMITTED = ["elo_a", "elo_b", "surface_a", "surface_b", "games_a", "games_b", "expected"]


def emitted(df):
    """What a day block gives its games."""
    return df.select("universe", "game", "b", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in EMITTED])


@query("elo_online", ONLINE_SQL)
def elo_online(spark, sf):
    return _pairwise(spark, sf, R.elo_step())


@query("elo_mov", MARGIN_SQL)
def elo_mov(spark, sf):
    return _pairwise(spark, sf, R.elo_margin_step(), inputs=("a", "b", "y", "margin"))


@query("elo_block", BLOCK_SQL)
def elo_block(spark, sf):
    g = games(spark, sf).withColumn("opponent", F.col("b"))
    return emitted(R.elo_block(g, ["universe"], "day", ["game", "opponent"], "a", "b", "y", "surface", ["game", "opponent"]).withColumnRenamed("opponent", "b"))


@query("glicko2")
def glicko2(spark, sf):
    g = games(spark, sf).withColumn("opponent", F.col("b"))
    return R.glicko2(g, ["universe"], "week", ["day", "game", "opponent"], "a", "b", "y", ["game", "opponent"])


@query("trueskill")
def trueskill(spark, sf):
    return _pairwise(spark, sf, R.trueskill_step())


@query("bayes_bt", BRADLEY_SQL)
def bayes_bt(spark, sf):
    return _pairwise(spark, sf, R.bradley_terry_step(), PAIR + ", available double", ("a", "b", "y", "day"))


@query("kalman", KALMAN_SQL)
def kalman(spark, sf):
    return _pairwise(spark, sf, R.kalman_step(), inputs=("a", "b", "y", "day"))


@query("page_hinkley", HINKLEY_SQL)
def page_hinkley(spark, sf):
    g = games(spark, sf).withColumn("x", F.abs("margin") / 50)
    return _rounded(R.fold(g, ["universe"], ORDER, ["x"], R.page_hinkley_step(), "running double, gap double, alarms double", keep=["game", "b"]), 9)


BANKED = "stake double, bankroll double, drawdown double"


@query("bankroll", fold_sql(BANK, BANK_STEP, BANK_SHOWN))
def bankroll(spark, sf):
    return _rounded(R.fold(games(spark, sf), ["universe"], ORDER, ["p", "q1", "q2", "y"], R.bankroll_step(), BANKED, keep=["game", "b"]))


@query("trueskill_rosters")
def trueskill_rosters(spark, sf):
    five = lambda side: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col(side) * 10 + F.pmod(i + F.col("game"), F.lit(7)))
    g = games(spark, sf).withColumn("players_a", five("a")).withColumn("players_b", five("b"))
    return R.fold(g, ["universe"], ORDER, ["a", "b", "players_a", "players_b", "y"], R.roster_trueskill_step(), R.ROSTER_SKILL, keep=KEEP)


@query(
    "history_state",
    f"""WITH o AS ({elo_sql("32 * (y - e)", digits=15)}), {GAMES_SQL},
x AS (SELECT g.universe, g.day, g.game, g.b AS opp, surface AS event, unnest([{{'team': g.a, 'won': y, 'diff': margin, 'rival': rating_b, 'after': rating_a + 32 * (y - expected)}}, {{'team': g.b, 'won': 1 - y, 'diff': -margin, 'rival': rating_a, 'after': rating_b + 32 * (1 - y - (1 - expected))}}]) AS s
FROM g JOIN o ON o.universe = g.universe AND o.game = g.game AND o.b = g.b)
SELECT universe, s.team AS team, event, CAST(grouping(event) AS INT) AS whole, count(*) AS games, sum(s.won)::BIGINT AS wins, round(avg(s.diff), 6) AS mean_margin, round(avg(s.rival), 6) AS opponents, max(day) AS last_day, round(arg_max(s.after, {{'d': day, 'g': game, 'b': opp}}), 6) AS rating
FROM x GROUP BY GROUPING SETS ((universe, s.team), (universe, s.team, event))""",
)
def history_state_query(spark, sf):
    g = R.fold(games(spark, sf), ["universe"], ORDER, ["a", "b", "y"], R.elo_step(), PAIR, keep=[*ORDER, "a", "y", "margin", "surface"])
    return _rounded(history_state(g, ["universe"], ORDER, "surface"))


@query("opportunity_bank", fold_sql(BANK, BANK_STEP, BANK_SHOWN, PICKS))
def opportunity_bank(spark, sf):
    """The three surest picks of a day are staked; the feature is a top-k report."""
    picks = top_per_group(games(spark, sf), ["universe", "day"], [F.desc("p"), "game", "b"], 3)
    return _rounded(R.fold(picks, ["universe"], ORDER, ["p", "q1", "q2", "y"], R.bankroll_step(), BANKED, keep=["game", "b"]))
