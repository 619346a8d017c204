"""Composite operators: coverage, market, identity, routing, holdouts, evidence."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.scalars import devig, log_loss
from ..operators.composites import blend_weights, fisher_exact, html_table, identity_merge, ranking_badges, routed, stat_window, strength_of_schedule
from ..operators.rounds import round_history
from ..operators.windows import prior
from ..sources.io import events, table
from .aggregates import DEVIG, METRICS, ODDS, PRED, predictions
from .registry import query


@query(
    "mapping_coverage",
    """SELECT n_regionkey, c_mktsegment, count(*) AS customers, count(o.k) AS mapped, round(100 * count(o.k) / count(*), 6) AS pct FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000) o ON o.k = c_custkey GROUP BY 1, 2""",
)
def mapping_coverage(spark, sf):
    k = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("k", F.lit(1))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, sf, "customer").join(k, "c_custkey", "left").join(n, "c_nationkey")
    return c.groupBy("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.count("k").alias("mapped"), F.round(100 * F.count("k") / F.count(F.lit(1)), 6).alias("pct"))


@query("match_coverage", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1, 2")
def match_coverage(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query(
    "stat_window_selection",
    """WITH m AS (SELECT CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem), w AS (SELECT * FROM (VALUES (0, 90), (1, 180), (2, 360)) t(prio, days)),
g AS (SELECT l_suppkey, prio, count(DISTINCT l_partkey) AS players, count(*) AS maps FROM lineitem, m, w WHERE datediff('day', CAST(l_shipdate AS DATE), hi) < days GROUP BY 1, 2)
SELECT l_suppkey, arg_max(prio, struct_pack(e := players >= 12 AND maps >= 15, p := CASE WHEN players >= 12 AND maps >= 15 THEN -prio ELSE 0 END, n := players, m := maps, q := -prio)) AS prio FROM g GROUP BY 1""",
)
def stat_window_selection(spark, sf):
    return stat_window(table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate", "l_partkey", [90, 180, 360], 12, 15)


@query(
    "map_pool_winrate",
    """WITH u AS (SELECT l_suppkey AS team, l_returnflag AS map, CAST(l_quantity > 25 AS INT) AS won FROM lineitem WHERE l_quantity <> 25 UNION ALL SELECT l_partkey % 100, l_returnflag, CAST(l_quantity < 25 AS INT) FROM lineitem WHERE l_quantity <> 25)
SELECT team, map, count(*) AS played, CAST(sum(won) AS BIGINT) AS wins, sum(won) / count(*) AS rate FROM u GROUP BY 1, 2""",
)
def map_pool_winrate(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity <> 25")
    side = lambda team, won: F.struct(team.alias("team"), won.cast("int").alias("won"))
    both = F.inline(F.array(side(F.col("l_suppkey"), F.col("l_quantity") > 25), side(F.col("l_partkey") % 100, F.col("l_quantity") < 25)))
    u = li.select(F.col("l_returnflag").alias("map"), both)
    return u.groupBy("team", "map").agg(F.count(F.lit(1)).alias("played"), F.sum("won").alias("wins"), (F.sum("won") / F.count(F.lit(1))).alias("rate"))


@query(
    "flag_stats",
    f"""WITH f AS (SELECT unnest(list_filter([CASE WHEN p > 0.8 THEN 'high' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS flag, p, y FROM ({PRED})) SELECT flag, {METRICS} FROM f GROUP BY 1""",
)
def flag_stats(spark, sf):
    from ..operators.dedup import reasons
    from ..operators.metrics import binary_aggs

    flags = reasons(("high", F.col("p") > 0.8), ("english", F.col("lang") == "en"), ("even", F.col("doc_id") % 2 == 0))
    return predictions(spark, sf).withColumn("flag", F.explode(flags)).groupBy("flag").agg(*binary_aggs())


@query(
    "market_benchmark",
    f"""WITH o AS (SELECT l_orderkey AS doc_id, avg({DEVIG}) AS q FROM ({ODDS}) GROUP BY 1), j AS (SELECT p, q, y FROM ({PRED}) JOIN o USING (doc_id) WHERE p IS NOT NULL AND q IS NOT NULL)
SELECT count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS model_loss, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS market_loss FROM j""",
)
def market_benchmark(spark, sf):
    li = table(spark, sf, "lineitem")
    o = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.avg(devig(1.2 + F.col("l_discount") * 10, 1.2 + F.col("l_tax") * 10)).alias("q"))
    j = predictions(spark, sf).join(o, "doc_id").where("p IS NOT NULL AND q IS NOT NULL")
    loss = lambda c: F.round(F.avg(log_loss(F.col("y"), F.col(c))), 6)
    return j.agg(F.count(F.lit(1)).alias("n"), loss("p").alias("model_loss"), loss("q").alias("market_loss"))


@query(
    "service_stats",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey, l_linenumber) AS rn FROM lineitem WHERE l_quantity >= 10) SELECT l_suppkey, count(*) AS n, round(sum(l_discount) / sum(l_quantity), 6) AS ratio, round(avg(l_tax), 6) AS mean_tax FROM r WHERE rn <= 20 GROUP BY 1""",
)
def service_stats(spark, sf):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), "l_partkey", "l_linenumber")
    r = table(spark, sf, "lineitem").where("l_quantity >= 10").withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    return r.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_discount") / F.sum("l_quantity"), 6).alias("ratio"), F.round(F.avg("l_tax"), 6).alias("mean_tax"))


@query(
    "upset_summary",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, CAST(value > 60 AS INT) AS fav, CAST(event_type = 'error' AS INT) AS lost FROM events)
SELECT event_id, CAST(coalesce(sum(fav * lost) OVER w, 0) AS BIGINT) AS losses, CAST(coalesce(sum(fav) OVER w, 0) AS BIGINT) AS favored FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)""",
)
def upset_summary(spark, sf):
    fav, lost = (F.col("value") > 60).cast("int"), (F.col("event_type") == "error").cast("int")
    e = events(spark, sf).select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), fav.alias("fav"), (fav * lost).alias("lost"))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-604800, -1)
    return e.select("event_id", F.coalesce(F.sum("lost").over(w), F.lit(0)).alias("losses"), F.coalesce(F.sum("fav").over(w), F.lit(0)).alias("favored"))


@query(
    "observed_closing_quote",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INT) AS days, CASE WHEN datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) <= 30 THEN 'near' ELSE 'far' END AS quality
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND 120""",
)
def observed_closing_quote(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("kick"))
    j = table(spark, sf, "lineitem").join(o, "l_orderkey").withColumn("days", F.datediff(F.col("l_shipdate").cast("date"), F.col("kick")))
    return j.where("days BETWEEN 0 AND 120").select("l_orderkey", "l_linenumber", "l_partkey", "days", F.when(F.col("days") <= 30, "near").otherwise("far").alias("quality"))


@query(
    "strength_of_schedule",
    """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT a.event_id, round(coalesce(sum(pow(0.5, (epoch_us(a.ts) - epoch_us(b.ts)) / 86400e6 / 30) * b.value) / sum(pow(0.5, (epoch_us(a.ts) - epoch_us(b.ts)) / 86400e6 / 30)), 1500), 6) AS decayed, round(coalesce(stddev_pop(b.value), 0), 6) AS spread
FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.rn BETWEEN a.rn - 20 AND a.rn - 1 GROUP BY 1""",
)
def schedule(spark, sf):
    return strength_of_schedule(events(spark, sf), ["user_id"], ["ts", "event_id"], "value", "sec", 20, 30.0).select("event_id", F.round("decayed", 6).alias("decayed"), F.round("spread", 6).alias("spread"))


@query(
    "participant_selection",
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id % 40 AS name FROM events WHERE event_type = 'signup'), c AS (SELECT c_custkey % 40 AS name, count(DISTINCT c_nationkey) AS n, min(c_nationkey) AS id FROM customer WHERE c_acctbal > 9800 GROUP BY 1)
SELECT day, d.name, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN id END AS id FROM d LEFT JOIN c USING (name)""",
)
def participant_selection(spark, sf):
    d = events(spark, sf).where("event_type = 'signup'").select(F.col("ts").cast("date").alias("day"), (F.col("user_id") % 40).alias("name")).distinct()
    c = table(spark, sf, "customer").where("c_acctbal > 9800").groupBy((F.col("c_custkey") % 40).alias("name")).agg(F.count_distinct("c_nationkey").alias("n"), F.min("c_nationkey").alias("id"))
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return d.join(c, "name", "left").select("day", "name", status.alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


@query(
    "identity_merge",
    """WITH x AS (SELECT c_custkey AS id, 'n' || (c_custkey % 300) AS norm, CASE WHEN c_acctbal > 5000 THEN c_nationkey END AS ext FROM customer), g AS (SELECT norm, min(id) AS survivor, count(DISTINCT ext) AS exts FROM x GROUP BY 1)
SELECT id, CASE WHEN exts <= 1 THEN survivor ELSE id END AS canonical FROM x JOIN g USING (norm)""",
)
def identity(spark, sf):
    x = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), (F.col("c_custkey") % 300).cast("string")).alias("norm"), F.when(F.col("c_acctbal") > 5000, F.col("c_nationkey")).alias("ext"))
    return identity_merge(x, "id", "norm", "ext").select("id", "canonical")


@query(
    "model_routing",
    f"""WITH o AS ({ODDS}), r AS (SELECT l_suppkey, {DEVIG} AS q, (l_partkey % 97 + 1) / 99.0 AS base FROM o) SELECT l_suppkey, count(*) AS n, count(q) AS routed, round(avg(CASE WHEN q IS NOT NULL THEN 0.6 * q + 0.4 * base ELSE base END), 6) AS p FROM r GROUP BY 1""",
)
def model_routing(spark, sf):
    r = table(spark, sf, "lineitem").select("l_suppkey", devig(1.2 + F.col("l_discount") * 10, 1.2 + F.col("l_tax") * 10).alias("q"), ((F.col("l_partkey") % 97 + 1) / 99.0).alias("base"))
    return r.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count("q").alias("routed"), F.round(F.avg(routed(F.col("q"), F.col("base"), 0.6)), 6).alias("p"))


@query(
    "symmetric_prediction",
    "WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, (l_partkey % 89 + 1) / 91.0 AS ab, (l_suppkey % 83 + 1) / 85.0 AS ba FROM lineitem) SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, round(0.5 * (ab + 1 - ba), 6) AS p FROM p",
)
def symmetric_prediction(spark, sf):
    ab, ba = (F.col("l_partkey") % 89 + 1) / 91.0, (F.col("l_suppkey") % 83 + 1) / 85.0
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.round(0.5 * (ab + 1 - ba), 6).alias("p")).distinct()


@query(
    "chronological_holdout",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), c AS (SELECT day, n, sum(n) OVER (ORDER BY day) AS upto, sum(n) OVER () AS total FROM d) SELECT day, n, CASE WHEN upto <= 0.8 * total THEN 'train' ELSE 'holdout' END AS part FROM c""",
)
def chronological_holdout(spark, sf):
    d = events(spark, sf).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))  # a row for each day
    upto, total = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(Window.partitionBy(F.lit(0)))
    return d.select("day", "n", F.when(upto <= 0.8 * total, "train").otherwise("holdout").alias("part"))


@query(
    "source_evidence",
    """SELECT o_orderkey, CAST(len(list_filter([o_orderdate + INTERVAL (o_orderkey % 5 - 2) DAY, o_orderdate + INTERVAL (o_orderkey % 3 - 1) DAY], lambda t: t < o_orderdate)) AS INT) AS n_sources FROM orders""",
)
def source_evidence(spark, sf):
    day = F.col("o_orderdate").cast("date")
    seen = F.array(F.date_add(day, (F.col("o_orderkey") % 5 - 2).cast("int")), F.date_add(day, (F.col("o_orderkey") % 3 - 1).cast("int")))
    return table(spark, sf, "orders").select("o_orderkey", F.size(F.filter(seen, lambda t: t < day)).alias("n_sources"))


@query(
    "availability_queue",
    """WITH d AS (SELECT o_custkey % 50 AS team, CAST(o_orderdate AS DATE) AS day, CAST(o_orderstatus = 'F' AS INT) AS w FROM orders), q AS (SELECT DISTINCT team, day FROM d)
SELECT q.team, q.day, count(d.w) AS n, CAST(coalesce(sum(d.w), 0) AS BIGINT) AS wins FROM q LEFT JOIN d ON d.team = q.team AND d.day + 22 <= q.day GROUP BY 1, 2""",
)
def availability_queue(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("team"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderstatus") == "F").cast("int").alias("w"))
    days = o.groupBy("team", "day").agg(F.count("w").alias("n"), F.sum("w").alias("wins"))
    # results wait 22 days: sums over days by their number, up to the last one released
    w = Window.partitionBy("team").orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, -22)
    return days.select("team", "day", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.coalesce(F.sum("wins").over(w), F.lit(0)).alias("wins"))


@query(
    "learned_blend_weight",
    f"""WITH x AS (SELECT doc_id % 20 AS period, y, p, (doc_id % 89 + 5) / 99.0 AS q FROM ({PRED}) WHERE p IS NOT NULL), w AS (SELECT unnest([0, 1, 2, 3, 4]) AS i), l AS (SELECT period, i, sum(-(y * ln((1 - i / 4) * p + i / 4 * q) + (1 - y) * ln(1 - ((1 - i / 4) * p + i / 4 * q)))) AS s FROM x, w GROUP BY 1, 2),
c AS (SELECT period, i, sum(s) OVER (PARTITION BY i ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM l) SELECT period, arg_min(i / 4, struct_pack(p := coalesce(past, 0), i := i)) AS weight FROM c GROUP BY 1""",
)
def learned_blend_weight(spark, sf):
    x = predictions(spark, sf).where("p IS NOT NULL").withColumn("period", F.col("doc_id") % 20).withColumn("q", (F.col("doc_id") % 89 + 5) / 99.0)
    return blend_weights(x, "period", "y", "p", "q", [0.0, 0.25, 0.5, 0.75, 1.0])


@query(
    "opponent_strength",
    """SELECT event_id, coalesce(avg(v) OVER w, 150000) / 100 AS strength FROM (SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def opponent_strength(spark, sf):
    v = F.round(F.col("value") * 100).cast("long")
    return events(spark, sf).withColumn("v", v).select("event_id", (F.coalesce(F.avg("v").over(prior(["user_id"], ["ts", "event_id"], 5)), F.lit(150000)) / 100).alias("strength"))


@query(
    "fisher_segments",
    """WITH g AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY 1), t AS (SELECT *, sum(a) OVER () - a AS c, sum(b) OVER () - b AS d FROM g),
m AS (SELECT o_orderpriority, a, b, a + b AS r, a + c AS k, a + b + c + d AS n FROM t), x AS (SELECT *, unnest(range(greatest(0, k - n + r)::BIGINT, least(r, k)::BIGINT + 1)) AS x FROM m),
l AS (SELECT *, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(k - x + 1) - lgamma(n - r - k + x + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1) AS lp FROM x),
s AS (SELECT o_orderpriority, lp AS seen FROM l WHERE x = a) SELECT l.o_orderpriority, any_value(a) AS a, any_value(b) AS b, round(least(1.0, sum(exp(lp)) FILTER (lp <= seen + 1e-9)), 6) AS p FROM l JOIN s USING (o_orderpriority) GROUP BY 1""",
)
def fisher_segments(spark, sf):
    o = table(spark, sf, "orders")
    g = o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") != "F").alias("b"))
    w = Window.partitionBy(F.lit(0))  # a row for each priority
    g = g.withColumn("c", F.sum("a").over(w) - F.col("a")).withColumn("d", F.sum("b").over(w) - F.col("b"))
    return g.select("o_orderpriority", "a", "b", F.round(fisher_exact("a", "b", "c", "d"), 6).alias("p"))


@query(
    "html_rows",
    """WITH p AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS li FROM pages), u AS (SELECT page_id, generate_subscripts(li, 1) - 1 AS pos, unnest(li) AS x FROM p)
SELECT page_id, pos, replace(trim(regexp_replace(x, '<[^>]*>', '', 'g')), '&amp;', '&') AS text, nullif(replace(regexp_extract(x, 'href="([^"]*)"', 1), '&amp;', '&'), '') AS href FROM u""",
)
def html_rows(spark, sf):
    return html_table(table(spark, sf, "pages").select("page_id", "html"), "page_id", "html", "li")


@query(
    "ranking_badges",
    """SELECT s_nationkey AS page, CAST(s_suppkey AS VARCHAR) AS team, 'ranking' AS kind, CAST(s_suppkey % 97 + 1 AS INT) AS position, DATE '2024-02-29' AS published,
'https://ranks.example/ranking/teams/2024/february/29?teamId=' || s_suppkey AS url FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def ranking_badges_query(spark, sf):
    """Pages made of suppliers: each has a badge, every fifth a second one that contradicts it."""
    s = table(spark, sf, "supplier").where("s_suppkey IS NOT NULL")
    badge = lambda rank: F.format_string('<li><a class="b ranking-badge" href="/ranking/teams/2024/february/29?teamId=%d"><b>World</b>: #%d</a></li>', "s_suppkey", rank)
    twice = F.when(F.col("s_suppkey") % 5 == 0, badge(F.lit(98).cast("long"))).otherwise("")
    each = s.select(F.col("s_nationkey").alias("page"), F.concat(badge(F.col("s_suppkey") % 97 + 1), twice).alias("li"))
    pages = each.groupBy("page").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list("li"), ""), F.lit("</ul>")).alias("html"))
    return ranking_badges(pages, "page", "html", "ranks.example", {"ranking": "World", "valued": "Points"})


@query(
    "round_history",
    """WITH g AS (SELECT s_suppkey AS page, s_suppkey % 12 AS r FROM supplier), i AS (SELECT page, r, unnest(range(1, r + 14)) AS n FROM g)
SELECT page, CAST(n AS INT) AS number, CAST((n - 1) // 12 + 1 AS INT) AS half, CAST((n - 1) % 12 + 1 AS INT) AS place, false AS overtime, n IN (1, 13) AS pistol,
CASE WHEN n > r THEN '1' ELSE '2' END AS winner, CASE WHEN (n > r) = (n <= 12) THEN 'ct' ELSE 't' END AS winner_side, CASE WHEN n <= 12 THEN 'ct' ELSE 't' END AS left_side,
CASE WHEN (n > r) = (n <= 12) THEN 'ct_win.svg' ELSE 't_win.svg' END AS outcome, CAST(NULL AS VARCHAR) AS reason FROM i""",
)
def round_history_query(spark, sf):
    """Pages made of suppliers: the right team wins the first rounds, the left one thirteen after them."""
    g = table(spark, sf, "supplier").where("s_suppkey IS NOT NULL").select(F.col("s_suppkey").alias("page"), (F.col("s_suppkey") % 12).alias("r"))
    r = F.col("r")

    def icons(mine: bool):
        def one(n):
            won = (n > r) if mine else (n <= r)
            icon = F.when((n > r) == (n <= 12), "ct_win.svg").otherwise("t_win.svg")
            said = F.concat(F.greatest(n - r, F.lit(0)).cast("string"), F.lit("-"), F.least(n, r).cast("string"))
            seen = F.when(won & (n <= r + 13), F.concat(icon, F.lit('" title="'), said)).otherwise("emptyHistory.svg")
            bar = F.when((n - 1) % 12 == 0, '<div class="round-history-bar"></div>').otherwise("")
            return F.concat(bar, F.lit('<img class="round-history-outcome" src="/i/'), seen, F.lit('">'))

        return F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long")), one), "")

    def team(side: str, k: int, score):
        return F.concat(F.lit(f'<div class="team-{side}"><a href="/stats/teams/{k}/x">T{k}</a><div class="bold">'), score.cast("string"), F.lit("</div></div>"))

    def row(k: int):
        return F.concat(F.lit(f'<div class="round-history-team-row"><img class="round-history-team" title="T{k}">'), icons(k == 1), F.lit("</div>"))

    html = F.concat(team("left", 1, F.lit(13)), team("right", 2, r), F.lit('<div class="round-history-con">'), row(1), row(2), F.lit("</div>"))
    return round_history(g.select("page", html.alias("html")), "page", "html")
