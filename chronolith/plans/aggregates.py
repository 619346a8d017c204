"""Aggregates: coverage, shrinkage, probability metrics, segments, significance, market."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from ..functions.scalars import confidence_band, devig
from ..operators import metrics as M
from ..operators.significance import quantiles
from ..sources.io import events, table
from .registry import query

#: Predictions: a probability from the id, in whole 997ths so that both engines agree to the bit.
PRED = """SELECT d.doc_id, d.lang, d.source, CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE (((d.doc_id * 37) % 997) + 1) / 999.0 END AS p, l.quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def predictions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    p = F.when(F.col("doc_id") % 13 != 0, ((F.col("doc_id") * 37) % 997 + 1) / 999.0)
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id").withColumn("p", p)


CLIP = "greatest(1e-9, least(1 - 1e-9, p))"
METRICS = f"""count(*) AS n, CAST(sum(CAST(p IS NOT NULL AS INT)) AS BIGINT) AS covered, round(avg(y), 6) AS positive_rate,
round(avg(CASE WHEN p IS NOT NULL THEN CAST((p >= 0.5) = (y = 1) AS INT) END), 6) AS accuracy,
round(avg(CASE WHEN p IS NOT NULL THEN -(y * ln({CLIP}) + (1 - y) * ln(1 - {CLIP})) END), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier"""


@query("group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def group_count(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "status_matrix",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS rate FROM orders GROUP BY 1""",
)
def status_matrix(spark, sf):
    s = lambda v: F.count_if(F.col("o_orderstatus") == v)
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), s("F").alias("f"), s("O").alias("o"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("rate"))


@query(
    "coverage_two_windows",
    """WITH m AS (SELECT max(CAST(ts AS DATE)) AS d FROM events), x AS (SELECT event_type, datediff('day', CAST(ts AS DATE), d) AS age, value > 20 AS ok FROM events, m),
a AS (SELECT event_type, count(*) FILTER (age < 10) AS n_now, count(*) FILTER (age < 10 AND ok) AS yes_now, count(*) FILTER (age BETWEEN 10 AND 19) AS n_then, count(*) FILTER (age BETWEEN 10 AND 19 AND ok) AS yes_then FROM x GROUP BY 1)
SELECT *, CAST(n_now >= 20 AND yes_now / n_now < 0.5 * yes_then / n_then AS INT) AS degraded FROM a""",
)
def coverage_two_windows(spark, sf):
    e = events(spark, sf).select("event_type", F.col("ts").cast("date").alias("day"), (F.col("value") > 20).alias("ok"))
    last = e.agg(F.max("day").alias("d"))  # one row
    x = e.crossJoin(F.broadcast(last)).withColumn("age", F.datediff("d", "day"))
    now, then = F.col("age") < 10, F.col("age").between(10, 19)
    a = x.groupBy("event_type").agg(F.count_if(now).alias("n_now"), F.count_if(now & F.col("ok")).alias("yes_now"), F.count_if(then).alias("n_then"), F.count_if(then & F.col("ok")).alias("yes_then"))
    bad = (F.col("n_now") >= 20) & (F.try_divide("yes_now", "n_now") < 0.5 * F.try_divide("yes_then", "n_then"))
    return a.withColumn("degraded", bad.cast("int"))


@query("distinct_counts", "SELECT user_id, count(DISTINCT event_type) AS types, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def distinct_counts(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.count_distinct("event_type").alias("types"), F.count_distinct(F.col("ts").cast("date")).alias("days"))


@query("min_evidence_union", "SELECT k, min(t) AS first_seen, count(*) AS n FROM (SELECT user_id AS k, ts AS t FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, ts FROM events WHERE event_type = 'click') GROUP BY 1")
def min_evidence_union(spark, sf):
    e = events(spark, sf).select(F.col("user_id").alias("k"), F.col("ts").alias("t"), "event_type")
    both = e.where("event_type = 'view'").unionByName(e.where("event_type = 'click'"))
    return both.groupBy("k").agg(F.min("t").alias("first_seen"), F.count(F.lit(1)).alias("n"))


@query(
    "year_gap_audit",
    """WITH y AS (SELECT o_custkey % 200 AS k, list_distinct(list(year(o_orderdate))) AS ys FROM orders GROUP BY 1) SELECT k, CAST(len(ys) AS INT) AS years, CAST(list_max(ys) - list_min(ys) + 1 - len(ys) AS INT) AS gaps FROM y""",
)
def year_gap_audit(spark, sf):
    y = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 200).alias("k")).agg(F.collect_set(F.year("o_orderdate")).alias("ys"))
    full = F.sequence(F.array_min("ys"), F.array_max("ys"))
    return y.select("k", F.size("ys").alias("years"), F.size(F.array_except(full, "ys")).alias("gaps"))


@query(
    "top2_stats",
    """SELECT l_orderkey, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS hi, min(l_quantity) AS lo, round(list_avg(list_sort(list(l_quantity), 'DESC')[1:2]), 6) AS top2, round(list_avg(list_sort(list(l_quantity))[1:2]), 6) AS bottom2,
median(l_quantity) AS med, round(stddev_pop(l_quantity), 6) AS sd, arg_max(l_partkey, struct_pack(q := l_quantity, k := l_partkey)) AS best FROM lineitem GROUP BY 1""",
)
def top2_stats(spark, sf):
    q = F.collect_list("l_quantity")
    mean2 = lambda a: F.aggregate(F.slice(a, 1, 2), F.lit(0.0), lambda s, x: s + x) / F.least(F.size(a), F.lit(2))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.avg("l_quantity"), 6).alias("mean"), F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"), F.sort_array(q, False).alias("down"), F.sort_array(q).alias("up"),
        F.median("l_quantity").alias("med"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd"), F.max_by("l_partkey", F.struct("l_quantity", "l_partkey")).alias("best"),
    )
    return g.select("l_orderkey", "mean", "hi", "lo", F.round(mean2(F.col("down")), 6).alias("top2"), F.round(mean2(F.col("up")), 6).alias("bottom2"), "med", "sd", "best")


@query(
    "weighted_argmax",
    """WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, round(sum(q * n) / sum(n * n), 6) AS weighted, arg_max(l_returnflag, struct_pack(r := q / n, f := l_returnflag)) AS best, arg_min(l_returnflag, struct_pack(r := q / n, f := l_returnflag)) AS worst FROM g GROUP BY 1""",
)
def weighted_argmax(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    order = F.struct(F.col("q") / F.col("n"), "l_returnflag")
    return g.groupBy("l_suppkey").agg(F.round(F.sum(F.col("q") * F.col("n")) / F.sum(F.col("n") * F.col("n")), 6).alias("weighted"), F.max_by("l_returnflag", order).alias("best"), F.min_by("l_returnflag", order).alias("worst"))


@query("laplace_rate", "SELECT user_id, (count(*) FILTER (event_type = 'purchase') + 1) / (count(*) + 2) AS rate FROM events GROUP BY 1")
def laplace_rate(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(((F.count_if(F.col("event_type") == "purchase") + 1) / (F.count(F.lit(1)) + 2)).alias("rate"))


@query(
    "shrunk_rates",
    """SELECT l_suppkey, (count(*) FILTER (l_returnflag = 'R') + 10) / (count(*) + 20) AS returned, (count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') + 10) / (count(*) FILTER (l_linestatus = 'F') + 20) AS returned_f FROM lineitem GROUP BY 1""",
)
def shrunk_rates(spark, sf):
    r = (F.col("l_returnflag") == "R").cast("int")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(M.shrunk_rate(r).alias("returned"), M.shrunk_rate(F.when(F.col("l_linestatus") == "F", r)).alias("returned_f"))


@query("metrics_grouping_sets", f"WITH x AS ({PRED}) SELECT lang, CAST(grouping(lang) AS INT) AS is_total, {METRICS} FROM x GROUP BY GROUPING SETS ((), (lang))")
def metrics_grouping_sets(spark, sf):
    return M.metrics_with_total(predictions(spark, sf), ["lang"])


@query("binary_metrics", f"WITH x AS ({PRED}) SELECT source, lang, {METRICS} FROM x GROUP BY 1, 2")
def binary_metrics(spark, sf):
    return predictions(spark, sf).groupBy("source", "lang").agg(*M.binary_aggs())


@query(
    "auc_rank",
    f"""WITH x AS (SELECT *, floor(p * 20) AS b FROM ({PRED}) WHERE p IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2.0 AS ar FROM x)
SELECT lang, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, round((sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 6) AS auc FROM r GROUP BY 1""",
)
def auc_rank(spark, sf):
    return M.auc(predictions(spark, sf).withColumn("b", F.floor(F.col("p") * 20)), ["lang"], p="b")


@query(
    "ece_bins",
    f"""WITH x AS (SELECT lang, least(CAST(floor(p * 10) AS INT), 9) AS bin, p, y FROM ({PRED}) WHERE p IS NOT NULL), b AS (SELECT lang, bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM x GROUP BY 1, 2)
SELECT lang, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b GROUP BY 1""",
)
def ece_bins(spark, sf):
    return M.expected_calibration_error(predictions(spark, sf), ["lang"])


@query("reliability_bins", f"SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM ({PRED}) WHERE p IS NOT NULL GROUP BY 1")
def reliability_bins(spark, sf):
    return M.reliability(predictions(spark, sf), []).select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


@query(
    "reliability_quantile",
    f"""WITH x AS ({PRED}), e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS es FROM x),
b AS (SELECT CAST(len(list_filter(es[2:-2], lambda v: v < p)) AS INT) AS bin, p, y FROM x, e WHERE p IS NOT NULL) SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM b GROUP BY 1""",
)
def reliability_quantile(spark, sf):
    return M.quantile_reliability(predictions(spark, sf).where("p IS NOT NULL"))


@query(
    "segment_calibration",
    f"""WITH x AS ({PRED}), b AS (SELECT lang, least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM x WHERE p IS NOT NULL GROUP BY 1, 2),
e AS (SELECT lang, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b GROUP BY 1),
s AS (SELECT lang, {METRICS}, round(avg(y - p), 6) AS gap, round(avg(y - p) - 1.96 * sqrt(var_samp(y - p) / count(y - p)), 6) AS gap_low, round(avg(y - p) + 1.96 * sqrt(var_samp(y - p) / count(y - p)), 6) AS gap_high FROM x GROUP BY 1)
SELECT s.*, ece FROM s LEFT JOIN e ON s.lang IS NOT DISTINCT FROM e.lang""",
)
def segment_calibration(spark, sf):
    return M.segment_calibration(predictions(spark, sf), "lang")


@query(
    "segmentation_suite",
    f"""WITH x AS ({PRED}), u AS (SELECT 'lang' AS dim, lang AS seg, p, y FROM x UNION ALL SELECT 'source', source, p, y FROM x UNION ALL SELECT 'band', CASE WHEN greatest(p, 1 - p) < 0.65 THEN 'low' ELSE 'high' END, p, y FROM x)
SELECT dim, seg, {METRICS} FROM u GROUP BY 1, 2""",
)
def segmentation_suite(spark, sf):
    band = F.when(F.greatest("p", 1 - F.col("p")) < 0.65, "low").otherwise("high")
    long = predictions(spark, sf).withColumn("band", band).unpivot(["p", "y"], ["lang", "source", "band"], "dim", "seg")
    return long.groupBy("dim", "seg").agg(*M.binary_aggs())


@query(
    "confidence_bands",
    f"""SELECT CASE WHEN c < 0.55 THEN '<.55' WHEN c < 0.65 THEN '.55-.65' WHEN c < 0.8 THEN '.65-.80' ELSE '>=.80' END AS band, {METRICS} FROM (SELECT *, greatest(p, 1 - p) AS c FROM ({PRED}) WHERE p IS NOT NULL) GROUP BY 1""",
)
def confidence_bands(spark, sf):
    return predictions(spark, sf).where("p IS NOT NULL").groupBy(confidence_band(F.col("p")).alias("band")).agg(*M.binary_aggs())


WILSON = "(k / n + {s} * 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n)"


@query(
    "group_vs_rest_wilson",
    f"""WITH g AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k FROM orders GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS tn, sum(k) OVER () AS tk FROM g)
SELECT o_orderpriority, n, k, round(k / n, 6) AS rate, round({WILSON.format(s="-1")}, 6) AS low, round({WILSON.format(s="1")}, 6) AS high, round(k / n - (tk - k) / (tn - n), 6) AS lift,
round((k / n) / ((tk - k) / (tn - n)), 6) AS risk_ratio, round(n / tn, 6) AS share FROM t""",
)
def group_vs_rest_wilson(spark, sf):
    return M.group_versus_rest(table(spark, sf, "orders").withColumn("failed", (F.col("o_orderstatus") == "F").cast("int")), "o_orderpriority", "failed")


@query(
    "bh_fdr",
    """WITH h AS (SELECT l_suppkey, (count(*) FILTER (l_returnflag = 'R') + 1) / (count(*) + 2) AS p FROM lineitem GROUP BY 1), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_suppkey) AS x FROM h)
SELECT l_suppkey, round(p, 6) AS p, round(least(1.0, min(x) OVER (ORDER BY p DESC, l_suppkey DESC ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM r""",
)
def bh_fdr(spark, sf):
    r = F.count_if(F.col("l_returnflag") == "R")
    h = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(((r + 1) / (F.count(F.lit(1)) + 2)).alias("p"))
    return M.benjamini_hochberg(h, "p", "l_suppkey").select("l_suppkey", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@query(
    "effect_sizes",
    """WITH x AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), a AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0, avg(n_chars) FILTER (quality = 1) AS m1, avg(n_chars) FILTER (quality = 0) AS m0,
var_samp(n_chars) FILTER (quality = 1) AS v1, var_samp(n_chars) FILTER (quality = 0) AS v0, corr(n_chars, quality) AS r FROM x)
SELECT n1, n0, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohen_d, round(r, 6) AS point_biserial FROM a""",
)
def effect_sizes(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return M.effect_sizes(x, "quality", "n_chars")


@query(
    "drift_windows",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT round(avg(value) FILTER (rn <= 200), 6) AS recent_mean, round(avg(value) FILTER (rn BETWEEN 201 AND 700), 6) AS before_mean,
round(avg(value) FILTER (rn <= 200) / avg(value) FILTER (rn BETWEEN 201 AND 700), 6) AS ratio FROM r""",
)
def drift_windows(spark, sf):
    return M.two_window_means(events(spark, sf), [F.desc("ts"), F.desc("event_id")], "value")


ODDS = "SELECT *, 1.2 + l_discount * 10 AS q1, 1.2 + l_tax * 10 AS q2 FROM lineitem"
DEVIG = "CASE WHEN q1 BETWEEN 1.001 AND 100 AND q2 BETWEEN 1.001 AND 100 AND 1 / q1 + 1 / q2 BETWEEN 0.9 AND 1.5 THEN (1 / q1) / (1 / q1 + 1 / q2) END"


@query(
    "devig_consensus",
    f"""WITH o AS ({ODDS}), p AS (SELECT l_orderkey, {DEVIG} AS p FROM o) SELECT l_orderkey, count(*) AS books, count(p) AS valid, round(avg(p), 6) AS consensus, round(stddev_pop(p), 6) AS sd, round(max(p) - min(p), 6) AS spread,
CASE WHEN max(p) - min(p) < 0.05 THEN 'tight' WHEN max(p) - min(p) < 0.15 THEN 'normal' ELSE 'wide' END AS label FROM p GROUP BY 1""",
)
def devig_consensus(spark, sf):
    li = table(spark, sf, "lineitem")
    p = li.select("l_orderkey", devig(1.2 + F.col("l_discount") * 10, 1.2 + F.col("l_tax") * 10).alias("p"))
    spread = F.max("p") - F.min("p")
    return p.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("books"), F.count("p").alias("valid"), F.round(F.avg("p"), 6).alias("consensus"), F.round(F.stddev_pop("p"), 6).alias("sd"), F.round(spread, 6).alias("spread"),
        F.when(spread < 0.05, "tight").when(spread < 0.15, "normal").otherwise("wide").alias("label"),
    )


@query(
    "two_way_fatigue",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, CAST(ts AS DATE) AS day FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS last_24h,
count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 172800 PRECEDING AND 1 PRECEDING) AS last_48h, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING) AS next_24h,
count(*) OVER (PARTITION BY user_id, day) - 1 AS same_day FROM e""",
)
def two_way_fatigue(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.col("ts").cast("date").alias("day"))
    w = lambda a, b: F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("s").rangeBetween(a, b))
    day = F.count(F.lit(1)).over(Window.partitionBy("user_id", "day")) - 1
    return e.select("event_id", w(-86400, -1).alias("last_24h"), w(-172800, -1).alias("last_48h"), w(1, 86400).alias("next_24h"), day.alias("same_day"))


@query(
    "quantile_segments",
    """WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS e FROM orders) SELECT CAST(1 + CAST(o_totalprice > e[1] AS INT) + CAST(o_totalprice > e[2] AS INT) + CAST(o_totalprice > e[3] AS INT) AS INT) AS quart, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, q GROUP BY 1""",
)
def quantile_segments(spark, sf):
    o = table(spark, sf, "orders")
    quart = reduce(lambda a, e: a + (F.col("o_totalprice") > e).cast("int"), quantiles(o, "o_totalprice", [0.25, 0.5, 0.75]), F.lit(1))
    return o.groupBy(quart.alias("quart")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "roster_change",
    """WITH d AS (SELECT user_id % 10 AS team, CAST(ts AS DATE) AS day, list_sort(list_distinct(list(user_id))) AS s FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT team, count(*) AS days, count(DISTINCT s) AS signatures, CAST(len(arg_max(s, day)) AS INT) AS latest_size FROM d GROUP BY 1""",
)
def roster_change(spark, sf):
    e = events(spark, sf).where("event_type = 'signup'")
    d = e.groupBy((F.col("user_id") % 10).alias("team"), F.col("ts").cast("date").alias("day")).agg(F.sort_array(F.collect_set("user_id")).alias("s"))
    return d.groupBy("team").agg(F.count(F.lit(1)).alias("days"), F.count_distinct("s").alias("signatures"), F.size(F.max_by("s", "day")).alias("latest_size"))


@query(
    "player_form_windows",
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), p AS (SELECT user_id, avg(CAST(round(value * 100) AS BIGINT)) FILTER (rn <= 5) AS a5, avg(CAST(round(value * 100) AS BIGINT)) FILTER (rn <= 20) AS a20 FROM r GROUP BY 1)
SELECT user_id % 10 AS team, round(avg(a5), 4) AS form_5, round(avg(a20), 4) AS form_20 FROM p GROUP BY 1""",
)
def player_form_windows(spark, sf):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    r = events(spark, sf).select("user_id", F.round(F.col("value") * 100).cast("long").alias("c"), rn.alias("rn")).where("rn <= 20")
    p = r.groupBy("user_id").agg(F.avg(F.when(F.col("rn") <= 5, F.col("c"))).alias("a5"), F.avg("c").alias("a20"))
    return p.groupBy((F.col("user_id") % 10).alias("team")).agg(F.round(F.avg("a5"), 4).alias("form_5"), F.round(F.avg("a20"), 4).alias("form_20"))


@query("economic_summary", f"""WITH o AS ({ODDS}), b AS (SELECT l_suppkey, q1, CAST(l_returnflag = 'R' AS INT) AS won, q1 / q2 - 1 AS clv FROM o WHERE {DEVIG} > 0.55)
SELECT l_suppkey, count(*) AS bets, CAST(sum(won) AS BIGINT) AS wins, round(avg(CASE WHEN won = 1 THEN q1 - 1 ELSE -1 END), 6) AS roi, round(avg(clv), 6) AS clv_mean, round(median(clv), 6) AS clv_median, round(avg(CAST(clv > 0 AS INT)), 6) AS clv_positive FROM b GROUP BY 1""")
def economic_summary(spark, sf):
    q1, q2 = 1.2 + F.col("l_discount") * 10, 1.2 + F.col("l_tax") * 10
    b = table(spark, sf, "lineitem").where(devig(q1, q2) > 0.55).select("l_suppkey", q1.alias("q1"), (F.col("l_returnflag") == "R").cast("int").alias("won"), (q1 / q2 - 1).alias("clv"))
    return b.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("bets"), F.sum("won").alias("wins"), F.round(F.avg(F.when(F.col("won") == 1, F.col("q1") - 1).otherwise(-1)), 6).alias("roi"), F.round(F.avg("clv"), 6).alias("clv_mean"),
        F.round(F.median("clv"), 6).alias("clv_median"), F.round(F.avg((F.col("clv") > 0).cast("int")), 6).alias("clv_positive"),
    )


@query("table_fingerprint", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey * 31 + o_custkey * 7) AS BIGINT) AS digest FROM orders GROUP BY 1")
def table_fingerprint(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey") * 31 + F.col("o_custkey") * 7).alias("digest"))
