"""Windows over strictly prior rows, whole days and calendar months; ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.scalars import months_before
from ..operators import windows as W
from ..operators.dedup import first_seen_of_latest, latest, top_per_group
from ..sources.io import events, table
from .registry import query

WIN = "SELECT *, CAST(event_type = 'purchase' AS INT) AS win, CAST(ts AS DATE) AS day FROM events"


def wins(spark, sf):
    return events(spark, sf).withColumn("win", (F.col("event_type") == "purchase").cast("int")).withColumn("day", F.col("ts").cast("date"))


K, O = ["user_id"], ["ts", "event_id"]


@query(
    "rolling_laplace",
    f"""WITH e AS ({WIN}) SELECT event_id, {", ".join(f"round((coalesce(sum(win) OVER w{n}, 0) + 1) / (count(*) OVER w{n} + 2), 6) AS rate_{n}" for n in (5, 10, 20, 30))},
round((coalesce(sum(win) OVER wall, 0) + 1) / (count(*) OVER wall + 2), 6) AS rate_all FROM e
WINDOW {", ".join(f"w{n} AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (5, 10, 20, 30))},
wall AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def rolling_laplace(spark, sf):
    e = wins(spark, sf)
    rates = [F.round(W.laplace_rate(F.col("win"), W.prior(K, O, n)), 6).alias(f"rate_{n or 'all'}") for n in (5, 10, 20, 30, None)]
    return e.select("event_id", *rates)


@query(
    "decay_winrate",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ({WIN}))
SELECT a.event_id, round((0.5 + coalesce(sum(pow(0.5, datediff('day', b.day, a.day) / 120.0) * b.win), 0)) / (1 + coalesce(sum(pow(0.5, datediff('day', b.day, a.day) / 120.0)), 0)), 6) AS rate
FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 30 AND a.rn - 1 GROUP BY 1""",
)
def decay_winrate(spark, sf):
    e = wins(spark, sf)
    return e.select("event_id", F.round(W.decayed_rate(e, K, O, "win", "day"), 6).alias("rate"))


@query(
    "rolling_mean",
    """SELECT event_id, coalesce(avg(cents) OVER w, 0) / 100 AS mean_10, coalesce(avg(cents) OVER wall, 0) / 100 AS mean_all FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), wall AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def rolling_mean(spark, sf):
    m = lambda n: W.prior_mean(F.col("cents"), W.prior(K, O, n)) / 100  # noqa: E731  whole cents: sums are exact
    return events(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("long")).select("event_id", m(10).alias("mean_10"), m(None).alias("mean_all"))


@query(
    "days_since_cap",
    """SELECT event_id, CAST(coalesce(least(greatest(floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000.0), 0), 90), 90) AS BIGINT) AS days FROM events
WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def days_since_cap(spark, sf):
    return events(spark, sf).where("event_type = 'signup'").select("event_id", W.days_since(K, O, "sec").alias("days"))


@query(
    "activity_windows",
    "WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events) SELECT event_id, "
    + ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN {(d + 1) * 86400 - 1} PRECEDING AND 86400 PRECEDING) AS n_{d}" for d in (2, 7, 14))
    + " FROM e",
)
def activity_windows(spark, sf):
    return events(spark, sf).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp"))).select("event_id", *[W.active_in(K, "sec", d).alias(f"n_{d}") for d in (2, 7, 14)])


@query(
    "streak",
    f"""WITH e AS ({WIN}), t AS (SELECT *, CAST(lag(win) OVER w IS NULL OR lag(win) OVER w <> win AS INT) AS turn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) * (2 * win - 1) AS run FROM i)
SELECT event_id, CAST(coalesce(lag(run) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS BIGINT) AS streak FROM r""",
)
def streak(spark, sf):
    return W.signed_streak(wins(spark, sf), K, O, "win").select("event_id", "streak")


@query(
    "event_cum",
    f"WITH e AS ({WIN}) SELECT event_id, count(*) OVER w AS n, CAST(coalesce(sum(win) OVER w, 0) AS BIGINT) AS w FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def event_cum(spark, sf):
    w = W.prior(["user_id", "day"], O)
    return wins(spark, sf).select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.coalesce(F.sum("win").over(w), F.lit(0)).alias("w"))


PAIRS = """SELECT event_id, ts, user_id % 12 AS a, (user_id + event_id) % 11 AS b, CAST(event_id % 3 = 0 AS INT) AS y FROM events WHERE user_id % 12 <> (user_id + event_id) % 11"""


def pairs(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "sec", "value", (F.col("user_id") % 12).alias("a"), ((F.col("user_id") + F.col("event_id")) % 11).alias("b"), (F.col("event_id") % 3 == 0).cast("int").alias("y"))
    return e.where("a <> b")


@query(
    "h2h",
    f"""WITH p AS ({PAIRS}), q AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN a < b THEN y ELSE 1 - y END AS low_won FROM p),
r AS (SELECT *, count(*) OVER w AS n, coalesce(sum(low_won) OVER w, 0) AS k FROM q WINDOW w AS (PARTITION BY lo, hi ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, n AS h2h_n, CAST(CASE WHEN a < b THEN k ELSE n - k END AS BIGINT) AS h2h_wins FROM r""",
)
def h2h(spark, sf):
    return W.head_to_head(pairs(spark, sf), "a", "b", O, "y").select("event_id", "h2h_n", "h2h_wins")


@query(
    "form_last_n_block",
    f"""WITH d AS (SELECT user_id, day, count(*) AS n, sum(win) AS w FROM ({WIN}) GROUP BY 1, 2),
x AS (SELECT a.user_id, a.day, b.n, b.w, sum(b.n) OVER (PARTITION BY a.user_id, a.day ORDER BY b.day DESC) - b.n AS newer FROM d a JOIN d b ON a.user_id = b.user_id AND b.day < a.day)
SELECT d.user_id, d.day, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS form_n, round(sum(x.w) / sum(x.n), 6) AS form FROM d LEFT JOIN x ON x.user_id = d.user_id AND x.day = d.day AND newer < 10 GROUP BY 1, 2""",
)
def form_last_n_block(spark, sf):
    return W.form_of_last(wins(spark, sf), "user_id", "day", "win", 10).withColumn("form", F.round("form", 6))


@query(
    "form_3_months",
    """WITH d AS (SELECT o_custkey % 50 AS team, CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(CAST(o_orderstatus = 'F' AS INT)) AS w FROM orders GROUP BY 1, 2)
SELECT a.team, a.day, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n, round(sum(b.w) / sum(b.n), 6) AS form FROM d a LEFT JOIN d b ON a.team = b.team AND b.day < a.day AND b.day >= a.day - INTERVAL 3 MONTH GROUP BY 1, 2""",
)
def form_3_months(spark, sf):
    o = table(spark, sf, "orders")
    d = o.groupBy((F.col("o_custkey") % 50).alias("team"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("w"))
    # three calendar months vary in length: the window spans the longest, the fold keeps the month's bound
    w = Window.partitionBy("team").orderBy(F.unix_date("day")).rangeBetween(-92, -1)
    past = F.collect_list(F.struct("day", "n", "w")).over(w)
    d = d.withColumn("p", F.filter(past, lambda x: x["day"] >= months_before(F.col("day"), 3)))
    total = lambda k: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[k])
    return d.select("team", "day", total("n").alias("n"), F.round(F.try_divide(total("w"), total("n")), 6).alias("form"))


@query(
    "rest_days",
    """WITH d AS (SELECT DISTINCT o_custkey % 50 AS team, CAST(o_orderdate AS DATE) AS day FROM orders) SELECT team, day, CAST(datediff('day', lag(day) OVER (PARTITION BY team ORDER BY day), day) AS BIGINT) AS rest FROM d""",
)
def rest_days(spark, sf):
    d = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("team"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select("team", "day", F.datediff("day", F.lag("day").over(Window.partitionBy("team").orderBy("day"))).cast("long").alias("rest"))


@query("rolling_accuracy", f"WITH e AS ({WIN}) SELECT event_id, round(avg(win) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS acc FROM e")
def rolling_accuracy(spark, sf):
    w = Window.partitionBy(F.col("user_id") % 5).orderBy(*O).rowsBetween(-49, 0)
    return wins(spark, sf).select("event_id", F.round(F.avg("win").over(w), 6).alias("acc"))


@query("rank_day", f"WITH e AS ({WIN}) SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY value DESC, event_id) AS rank FROM e WHERE win = 1")
def rank_day(spark, sf):
    w = Window.partitionBy("day").orderBy(F.desc("value"), "event_id")
    return wins(spark, sf).where("win = 1").select("event_id", F.row_number().over(w).alias("rank"))


@query(
    "open_close_point",
    """SELECT user_id, arg_min(value, ts) AS opening, arg_max(value, ts) AS closing, round(arg_min(value, ts) / arg_max(value, ts) - 1, 6) AS clv FROM events WHERE event_type = 'view' AND value > 5 GROUP BY 1""",
)
def open_close_point(spark, sf):
    v = events(spark, sf).where("event_type = 'view' AND value > 5").groupBy("user_id").agg(F.min_by("value", "ts").alias("opening"), F.max_by("value", "ts").alias("closing"))
    return v.select("user_id", "opening", "closing", F.round(F.col("opening") / F.col("closing") - 1, 6).alias("clv"))


@query(
    "jaccard_turnover",
    """WITH c AS (SELECT l_suppkey, date_trunc('year', l_shipdate) AS y, l_partkey % 40 AS m FROM lineitem), s AS (SELECT l_suppkey, CAST(y AS DATE) AS y, list_distinct(list(m)) AS ms FROM c GROUP BY 1, 2)
SELECT a.l_suppkey, a.y, round(1 - len(list_intersect(a.ms, b.ms)) / len(list_distinct(list_concat(a.ms, b.ms))), 6) AS turnover FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND b.y = a.y - INTERVAL 1 YEAR""",
)
def jaccard_turnover(spark, sf):
    c = table(spark, sf, "lineitem").select("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "year").alias("y"), (F.col("l_partkey") % 40).alias("m"))
    s = c.groupBy("l_suppkey", "y").agg(F.collect_set("m").alias("ms"))
    p = s.select("l_suppkey", F.add_months("y", 12).alias("y"), F.col("ms").alias("before"))
    j = s.join(p, ["l_suppkey", "y"])
    return j.select("l_suppkey", "y", F.round(1 - F.size(F.array_intersect("ms", "before")) / F.size(F.array_union("ms", "before")), 6).alias("turnover"))


@query("official_latest", "SELECT user_id, day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)) WHERE rn = 1")
def official_latest(spark, sf):
    return latest(wins(spark, sf).select("user_id", "day", "event_id", "ts"), ["user_id", "day"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "day", "event_id")


@query("first_valid", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events WHERE value > 10) WHERE rn = 1")
def first_valid(spark, sf):
    return latest(events(spark, sf).where("value > 10").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    "first_version_availability",
    """WITH l AS (SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1) SELECT l.user_id, min(e.ts) AS available_at, l.event_type FROM l JOIN events e ON e.user_id = l.user_id AND e.event_type = l.event_type GROUP BY 1, 3""",
)
def first_version_availability(spark, sf):
    return first_seen_of_latest(events(spark, sf), ["user_id"], "ts", ["event_type"])


@query("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_global(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("topk_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_group(spark, sf):
    return top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, "rn").select("o_custkey", "o_orderkey", "rn")


@query(
    "nulls_first_queue",
    """SELECT c_custkey, last_day FROM (SELECT c_custkey, CAST(max(o_orderdate) AS DATE) AS last_day FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ORDER BY last_day NULLS FIRST, c_custkey DESC LIMIT 25""",
)
def nulls_first_queue(spark, sf):
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").alias("last_day"))
    c = table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return c.orderBy(F.asc_nulls_first("last_day"), F.desc("c_custkey")).limit(25)


@query("backoff_queue", "SELECT event_id FROM events WHERE event_type = 'error' AND ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 50")
def backoff_queue(spark, sf):
    e = events(spark, sf).where("event_type = 'error' AND ts + INTERVAL 6 HOURS <= TIMESTAMP_NTZ '2024-01-15'")
    return e.orderBy("ts", "event_id").limit(50).select("event_id")


@query("median_value", "SELECT event_type, median(value) AS med, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def median_value(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.median("value").alias("med"), F.round(F.percentile("value", 0.9), 6).alias("p90"))
