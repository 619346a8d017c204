"""Queries over strict values, reliability, market weights, bands, line-ups and rating mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decisions as D, scalars as S, strict as T
from ..operators import lineups as L
from ..sources.io import table
from .registry import query

#: Texts of times in several forms, by line.
TEXTS = "CASE l_linenumber WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%dT05:30:00+02:00') WHEN 3 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 4 THEN strftime(l_shipdate, '%Y-%m-%d 10:00') WHEN 5 THEN strftime(l_shipdate, '%Y-02-30') ELSE strftime(l_shipdate, '%d.%m.%Y') END"


def _texts():
    at, n = F.col("l_shipdate"), F.col("l_linenumber")
    form = lambda f: F.date_format(at, f)
    return F.when(n == 1, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 2, form("yyyy-MM-dd'T05:30:00+02:00'")).when(n == 3, form("yyyy-MM-dd")).when(n == 4, form("yyyy-MM-dd' 10:00'")).when(n == 5, form("yyyy'-02-30'")).otherwise(form("dd.MM.yyyy"))


@query(
    "strict_times",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, {TEXTS} AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN CAST(epoch(l_shipdate) AS BIGINT) WHEN 2 THEN CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) + 12600 END AS utc_seconds,
CASE WHEN l_linenumber <= 4 THEN CAST(l_shipdate AS DATE) END AS day, CASE WHEN l_linenumber IN (1, 2, 4) THEN 'exact' WHEN l_linenumber = 3 THEN 'date_only' END AS "precision", substr(x, 1, 10) = strftime(l_shipdate, '%Y-%m-%d') AS same FROM t""",
)
def strict_times(spark, sf):
    """Instants only of texts with an offset, dates only of days that exist."""
    x = table(spark, sf, "lineitem").withColumn("x", _texts())
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.unix_seconds(T.utc_instant(F.col("x"))).alias("utc_seconds"), T.civil_date(F.col("x")).alias("day"), T.date_precision(F.col("x")).alias("precision"), T.same_day(F.col("x"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("same"))


@query(
    "strict_slugs",
    """WITH u AS (SELECT page_id, unnest(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) AS s FROM pages)
SELECT page_id, count(*) AS segments, count(*) FILTER (s <> '' AND NOT regexp_matches(s, '[?#\\s]')) AS slugs FROM u GROUP BY 1""",
)
def strict_slugs(spark, sf):
    """How many segments of a page's address are slugs."""
    s = table(spark, sf, "pages").select("page_id", F.explode(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/")).alias("s"))
    return s.groupBy("page_id").agg(F.count(F.lit(1)).alias("segments"), F.count(T.slug(F.col("s"))).alias("slugs"))


@query(
    "early_birthdays",
    """WITH b AS (SELECT c_custkey, DATE '1984-02-29' + CAST(c_nationkey * 130 AS INT) AS birth FROM customer), f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, first, last, n, round(date_diff('day', birth, first) / 365.2425, 6) AS age FROM b JOIN f ON o_custkey = c_custkey WHERE first < CAST(birth + INTERVAL 10 YEAR AS DATE) AND first >= birth""",
)
def early_birthdays(spark, sf):
    """Identities that appear before their tenth birthday."""
    b = table(spark, sf, "customer").select(F.col("c_custkey"), F.date_add(F.lit("1984-02-29").cast("date"), F.col("c_nationkey") * 130).alias("birth"))
    day = F.col("o_orderdate").cast("date")
    f = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n"))
    age = S.age_years(F.col("birth"), F.col("first"))
    return b.join(f, "c_custkey").where(T.before_birthday(F.col("birth"), F.col("first")) & age.isNotNull()).select("c_custkey", "first", "last", "n", F.round(age, 6).alias("age"))


@query(
    "rating_mix",
    """WITH x AS (SELECT s_suppkey, 1500.0 + s_acctbal / 10 AS g, CASE WHEN s_nationkey % 3 <> 0 THEN 1400.0 + s_nationkey * 7 END AS s FROM supplier)
SELECT s_suppkey, round(coalesce(0.5 * g + 0.5 * s, g), 6) AS mixed, round(1 / (1 + exp(-greatest(-30, least(30, (g - 1500) / 5)))), 9) AS bounded FROM x""",
)
def rating_mix(spark, sf):
    """A general rating beside one of a surface, where there is one, and a sigmoid held within its bounds."""
    g, s = 1500.0 + F.col("s_acctbal") / 10, F.when(F.col("s_nationkey") % 3 != 0, 1400.0 + F.col("s_nationkey") * 7)
    return table(spark, sf, "supplier").select("s_suppkey", F.round(S.mixed_rating(g, s), 6).alias("mixed"), F.round(S.sigmoid((g - 1500) / 5), 9).alias("bounded"))


CASES = """SELECT o_orderkey, o_orderkey % 31 AS ga, o_custkey % 41 AS gb, CASE WHEN o_orderkey % 9 <> 0 THEN 60 + o_orderkey % 120 END AS da, CASE WHEN o_custkey % 7 <> 0 THEN 60 + o_custkey % 120 END AS db,
o_orderpriority = '5-LOW' AS single, CASE WHEN o_orderkey % 23 = 0 THEN 'TBD' ELSE o_orderpriority END AS na, o_orderstatus AS nb, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS snap, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 11) / 10.0 END AS ca, 1.0 AS cb,
(o_orderkey % 97 + 1) / 99.0 AS p, CASE WHEN o_orderkey % 4 <> 0 THEN (o_custkey % 89 + 1) / 99.0 END AS m, o_orderkey % 6 AS books, CASE WHEN o_custkey % 3 = 0 THEN 'low' ELSE 'strong' END AS consensus, (o_custkey % 13) / 100.0 AS drift, CASE WHEN o_custkey % 10 = 0 THEN 0.7 END AS learned FROM orders"""
LADDER = """CASE WHEN least(ga, gb) < 5 THEN 0.35 WHEN least(ga, gb) < 12 THEN 0.6 WHEN least(ga, gb) < 25 THEN 0.85 ELSE 1 END::DOUBLE * CASE WHEN dv > 140 THEN 0.55 WHEN dv > 110 THEN 0.78 WHEN dv > 90 THEN 0.92 ELSE 1 END::DOUBLE * CASE WHEN single THEN 0.82 ELSE 1 END::DOUBLE
* CASE WHEN na = 'TBD' THEN 0.25 ELSE 1 END::DOUBLE * CASE WHEN coalesce(snap, true) THEN 1 ELSE 0.85 END::DOUBLE * CASE WHEN cov < 0.6 THEN 0.75 WHEN cov < 0.8 THEN 0.9 WHEN cov < 1 THEN 0.96 ELSE 1 END::DOUBLE"""
SCORED = f"c AS ({CASES}), v AS (SELECT *, (coalesce(da, 160) + coalesce(db, 160)) / 2 AS dv, least(coalesce(ca, 1), cb) AS cov FROM c), s AS (SELECT *, greatest(0.05, least(1.0, {LADDER})) AS rel FROM v)"


def _cases(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (k % 31).alias("ga"), (c % 41).alias("gb"), F.when(k % 9 != 0, 60 + k % 120).alias("da"), F.when(c % 7 != 0, 60 + c % 120).alias("db"),
        (F.col("o_orderpriority") == "5-LOW").alias("single"), F.when(k % 23 == 0, "TBD").otherwise(F.col("o_orderpriority")).alias("na"), F.col("o_orderstatus").alias("nb"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("snap"),
        F.when(k % 5 != 0, (k % 11) / 10.0).alias("ca"), F.lit(1.0).alias("cb"), ((k % 97 + 1) / 99.0).alias("p"), F.when(k % 4 != 0, (c % 89 + 1) / 99.0).alias("m"), (k % 6).alias("books"),
        F.when(c % 3 == 0, "low").otherwise("strong").alias("consensus"), ((c % 13) / 100.0).alias("drift"), F.when(c % 10 == 0, 0.7).alias("learned"),
    )
    return o.withColumn("rel", D.reliability(*map(F.col, ("ga", "gb", "da", "db", "single", "na", "nb", "snap", "ca", "cb"))))


@query("reliability_ladder", f"WITH {SCORED} SELECT o_orderkey, round(rel, 9) AS reliability FROM s")
def reliability_ladder(spark, sf):
    return _cases(spark, sf).select("o_orderkey", F.round("rel", 9).alias("reliability"))


@query(
    "market_decision",
    f"""WITH {SCORED}, w AS (SELECT *, least(0.3, (0.05 + 0.25 * (1 - rel)) * CASE WHEN books > 0 AND books < 3 THEN 0.75 ELSE 1 END * CASE WHEN consensus = 'low' THEN 0.7 ELSE 1 END * CASE WHEN drift >= 0.08 THEN 0.85 ELSE 1 END) AS dyn FROM s),
x AS (SELECT *, coalesce(least(0.6, learned), dyn) AS own FROM w)
SELECT o_orderkey, round(CASE WHEN m IS NULL THEN 0.5 + rel * (p - 0.5) ELSE (1 - own) * p + own * m END, 9) AS decided, round(CASE WHEN m IS NULL THEN 0 ELSE own END, 9) AS weight, CASE WHEN m IS NULL THEN 'model_shrunk' WHEN learned IS NOT NULL THEN 'learned_weight' ELSE 'dynamic_weight' END AS source FROM x""",
)
def market_decision(spark, sf):
    c = _cases(spark, sf)
    w = D.market_weight(F.col("rel"), F.col("books"), F.col("consensus"), F.col("drift"))
    p, share, source = D.decided(F.col("p"), F.col("m"), F.col("rel"), w, F.col("learned"))
    return c.select("o_orderkey", F.round(p, 9).alias("decided"), F.round(share, 9).alias("weight"), source.alias("source"))


@query(
    "estimate_bands",
    f"""WITH c AS ({CASES}), v AS (SELECT *, least(1.0, least(ga, gb) / 30.0) AS cov, CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 3 END AS members FROM c),
h AS (SELECT *, least(0.25, sqrt(drift * drift + 0.01 * (1 - cov) * (1 - cov) + CASE WHEN members < 2 THEN 0.0025 ELSE 0 END)) AS half FROM v)
SELECT o_orderkey, round(half, 9) AS half, round(cov, 9) AS coverage, CASE WHEN cov >= 0.8 AND members >= 2 AND half <= 0.05 THEN 'high' WHEN cov >= 0.4 AND members >= 2 AND half <= 0.1 THEN 'medium' ELSE 'low' END AS level FROM h""",
)
def estimate_bands(spark, sf):
    members = F.when(F.col("o_orderkey") % 8 == 0, 1).otherwise(3)
    half, coverage, level = D.estimate_band(F.col("drift"), F.col("ga"), F.col("gb"), members)
    return _cases(spark, sf).select("o_orderkey", F.round(half, 9).alias("half"), F.round(coverage, 9).alias("coverage"), level.alias("level"))


@query(
    "roster_change_90",
    """WITH p AS (SELECT o_orderkey AS game, c_nationkey AS team, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, list_sort(list_distinct(list(l_suppkey % 7))) AS five FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
k AS (SELECT * FROM p WHERE len(five) = 4), n AS (SELECT a.game, a.team, a.five AS now, b.five, count(*) AS n, max({'d': b.day, 'g': b.game}) AS last FROM k a JOIN k b ON a.team = b.team AND b.day < a.day AND b.day >= a.day - 90 AND b.game <> a.game GROUP BY 1, 2, 3, 4),
m AS (SELECT *, max(n) OVER (PARTITION BY game, team) AS most FROM n),
g AS (SELECT game, team, any_value(now) AS now, sum(n)::BIGINT AS compared, count(*) AS dist, any_value(most) AS modal_games, arg_max(five, last) AS latest, arg_max(five, last) FILTER (n = most) AS modal, list_distinct(flatten(list(five))) AS seen FROM m GROUP BY 1, 2)
SELECT p.game, p.team, CASE WHEN len(five) <> 4 THEN 'incomplete' WHEN latest IS NULL THEN 'no_recent_history' WHEN five = latest THEN 'unchanged' ELSE 'changed' END AS status, coalesce(compared, 0) AS compared, coalesce(dist, 0) AS "distinct", modal_games,
CASE WHEN latest IS NOT NULL THEN five <> latest END AS from_latest, CASE WHEN latest IS NOT NULL THEN five <> modal END AS from_modal, CAST(CASE WHEN latest IS NOT NULL THEN len(list_filter(five, lambda x: NOT list_contains(latest, x))) END AS INT) AS players_in,
CAST(CASE WHEN latest IS NOT NULL THEN len(list_filter(latest, lambda x: NOT list_contains(five, x))) END AS INT) AS players_out, CAST(CASE WHEN latest IS NOT NULL THEN len(list_filter(five, lambda x: NOT list_contains(seen, x))) END AS INT) AS new_players FROM p LEFT JOIN g USING (game, team)""",
)
def roster_change_90(spark, sf):
    """Nations as teams: an order's suppliers, in seven groups, are its line-up of four."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team"))
    o = table(spark, sf, "orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("game"), "team", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"))
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game"), (F.col("l_suppkey") % 7).alias("player")).join(o, "game").groupBy("game", "team", "day").agg(F.collect_set("player").alias("players"))
    return L.roster_change(p, p, "team", size=4)


@query(
    "player_gaps",
    """WITH g AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(q) >= 4 THEN round(q[-1] - m, 6) END AS star_gap, CASE WHEN len(q) >= 4 THEN round(m - q[1], 6) END AS weak_link, CASE WHEN len(q) >= 4 THEN (q[-1] + q[-2]) / 2 END AS top2, CASE WHEN len(q) >= 4 THEN (q[1] + q[2]) / 2 END AS bottom2 FROM g""",
)
def player_gaps(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    f = L.spread_features("q")
    return g.select("l_orderkey", F.round(f["star_gap"], 6).alias("star_gap"), F.round(f["weak_link"], 6).alias("weak_link"), f["top2"].alias("top2"), f["bottom2"].alias("bottom2"))
