"""Feature projections, line-up logic, nested folds and reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.scalars import confidence_band
from ..operators.features import antisymmetric, contract, lineup_features, nested_folds, rank_baseline, uncertainty
from ..sources.io import events, table
from .aggregates import METRICS, PRED, predictions
from .registry import query


@query("ordered_contract", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def ordered_contract(spark, sf):
    return contract(table(spark, sf, "orders").where("o_orderstatus = 'P'"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query(
    "difference_features",
    """WITH a AS (SELECT l_suppkey, avg(CAST(l_quantity AS BIGINT)) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1) SELECT x.l_suppkey AS a, y.l_suppkey AS b, round(x.q - y.q, 6) AS diff_q, round(x.d - y.d, 6) AS diff_d FROM a x JOIN a y ON y.l_suppkey = x.l_suppkey + 1""",
)
def difference_features(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg(F.col("l_quantity").cast("long")).alias("q"), F.max("l_discount").alias("d"))
    y = s.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("q").alias("q2"), F.col("d").alias("d2"))
    j = s.join(y, "l_suppkey")
    return j.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1).alias("b"), F.round(F.col("q") - F.col("q2"), 6).alias("diff_q"), F.round(F.col("d") - F.col("d2"), 6).alias("diff_d"))


@query(
    "antisymmetric_swap",
    """SELECT l_orderkey, l_linenumber, l_partkey, -l_discount AS diff_discount, l_quantity AS total, l_suppkey AS x_a, l_partkey AS x_b FROM lineitem""",
)
def antisymmetric_swap(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("diff_discount"), F.col("l_quantity").alias("total"), F.col("l_partkey").alias("x_a"), F.col("l_suppkey").alias("x_b"))
    return antisymmetric(li, ["diff_discount"])


@query(
    "lineup_features",
    """WITH g AS (SELECT l_orderkey, list_sort(list(l_quantity), 'DESC') AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(n AS INT) AS n, CASE WHEN n >= 4 THEN round(list_avg(q), 6) END AS mean, CASE WHEN n >= 4 THEN q[1] - q[-1] END AS gap, CASE WHEN n >= 4 THEN q[-1] END AS weak FROM g""",
)
def lineups(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity"), False).alias("q"))
    return lineup_features(g, "l_orderkey", "q", 4)


@query(
    "uncertainty_band",
    f"""SELECT doc_id, CASE WHEN u < 0.2 THEN 'low' WHEN u < 0.35 THEN 'medium' ELSE 'high' END AS band FROM (SELECT doc_id, least(0.5, sqrt(p * (1 - p) * 0.25 + 0.01 + (doc_id % 7) / 100.0)) AS u FROM ({PRED}) WHERE p IS NOT NULL)""",
)
def uncertainty_band(spark, sf):
    p = predictions(spark, sf).where("p IS NOT NULL")
    return p.select("doc_id", uncertainty(F.col("p") * (1 - F.col("p")) * 0.25, F.lit(0.01), (F.col("doc_id") % 7) / 100.0).alias("band"))


@query(
    "rank_baseline",
    """WITH r AS (SELECT s_suppkey, rank() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rk FROM supplier), g AS (SELECT l_partkey % 100 AS a, l_suppkey AS b, CAST(l_quantity > 25 AS INT) AS y FROM lineitem)
SELECT count(*) AS n, round(avg(CAST((ra.rk < rb.rk) = (y = 1) AS INT)), 6) AS accuracy FROM g JOIN r ra ON ra.s_suppkey = a JOIN r rb ON rb.s_suppkey = b WHERE a <> b""",
)
def baseline(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.rank().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rk"))  # the ranking list
    g = table(spark, sf, "lineitem").select((F.col("l_partkey") % 100).alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_quantity") > 25).cast("int").alias("y")).where("a <> b")
    return rank_baseline(g, s, "s_suppkey", "rk")


@query(
    "nested_folds",
    """WITH p AS (SELECT DISTINCT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5 AS k FROM events) SELECT o.k AS outer_test, i.k AS inner_test, count(t.k) AS train_periods FROM p o JOIN p i ON i.k < o.k JOIN p t ON t.k < i.k GROUP BY 1, 2""",
)
def nested(spark, sf):
    k = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 5).cast("long")
    return nested_folds(events(spark, sf).select(k.alias("k")), "k")


@query(
    "actual_lineup_pairs",
    """WITH s AS (SELECT user_id % 10 AS team, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2) SELECT a.team AS team_a, b.team AS team_b, a.day FROM s a JOIN s b ON a.day = b.day AND b.team = a.team + 1 WHERE a.n >= 12 AND b.n >= 12""",
)
def actual_lineup_pairs(spark, sf):
    s = events(spark, sf).groupBy((F.col("user_id") % 10).alias("team"), F.col("ts").cast("date").alias("day")).agg(F.count_distinct("user_id").alias("n")).where("n >= 12")
    b = s.select("day", (F.col("team") - 1).alias("team"), F.col("team").alias("team_b"))
    return s.join(b, ["day", "team"]).select(F.col("team").alias("team_a"), "team_b", "day")


@query("favorite_bands", f"SELECT CAST(floor(greatest(p, 1 - p) * 10) AS INT) AS band, {METRICS} FROM ({PRED}) WHERE p IS NOT NULL GROUP BY 1")
def favorite_bands(spark, sf):
    from ..operators.metrics import binary_aggs

    return predictions(spark, sf).where("p IS NOT NULL").groupBy(F.floor(F.greatest("p", 1 - F.col("p")) * 10).cast("int").alias("band")).agg(*binary_aggs())


@query(
    "high_accuracy_segments",
    f"""SELECT * FROM (SELECT source, count(*) AS n, round(avg(CAST((p >= 0.5) = (y = 1) AS INT)), 6) AS accuracy, CAST(count(*) < 20 AS INT) AS small_sample FROM ({PRED}) WHERE p IS NOT NULL GROUP BY 1) WHERE accuracy > 0.5""",
)
def high_accuracy_segments(spark, sf):
    right = ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")
    s = predictions(spark, sf).where("p IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"))
    return s.withColumn("small_sample", (F.col("n") < 20).cast("int")).where("accuracy > 0.5")


@query(
    "context_metrics",
    f"""SELECT lang, CASE WHEN greatest(p, 1 - p) < 0.55 THEN '<.55' WHEN greatest(p, 1 - p) < 0.65 THEN '.55-.65' WHEN greatest(p, 1 - p) < 0.8 THEN '.65-.80' ELSE '>=.80' END AS band, {METRICS} FROM ({PRED}) WHERE p IS NOT NULL GROUP BY 1, 2""",
)
def context_metrics(spark, sf):
    from ..operators.metrics import binary_aggs

    return predictions(spark, sf).where("p IS NOT NULL").groupBy("lang", confidence_band(F.col("p")).alias("band")).agg(*binary_aggs())


@query(
    "nested_children",
    """SELECT conv_id, turn, CAST(i AS INT) AS pos, words[i + 1] AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS words, unnest(range(least(3, len(string_split(text, ' '))))) AS i FROM conversations WHERE text IS NOT NULL)""",
)
def nested_children(spark, sf):
    c = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.posexplode(F.slice(F.split("text", " "), 1, 3)).alias("pos", "word"))
    return c


@query(
    "dashboard_payload",
    """SELECT o_orderstatus AS status, count(*) AS n, CAST(max(o_orderdate) AS DATE) AS last_day, arg_max(o_orderkey, struct_pack(t := o_totalprice, k := o_orderkey)) AS top_order FROM orders GROUP BY 1""",
)
def dashboard_payload(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("date").alias("last_day"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order"))


@query("composite_marker_latest", "SELECT user_id, arg_max(event_type, struct_pack(d := CAST(ts AS DATE), v := value, e := event_id)) AS event_type FROM events GROUP BY 1")
def composite_marker_latest(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", F.struct(F.col("ts").cast("date"), "value", "event_id")).alias("event_type"))


@query("provider_overround", "SELECT l_orderkey, l_linenumber, l_partkey, round(1 / (1.2 + l_discount * 10) + 1 / (1.2 + l_tax * 10) - 1, 6) AS margin FROM lineitem")
def provider_overround(spark, sf):
    q1, q2 = 1.2 + F.col("l_discount") * 10, 1.2 + F.col("l_tax") * 10
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(1 / q1 + 1 / q2 - 1, 6).alias("margin"))
