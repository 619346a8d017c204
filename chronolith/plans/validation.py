"""Temporal validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import log_loss
from ..operators import validation as V
from ..sources.io import events, table
from .aggregates import PRED, predictions
from .registry import query


@query(
    "season_folds",
    """WITH d AS (SELECT o_orderkey, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 22 AS av FROM orders), s AS (SELECT y, min(day) AS st FROM d GROUP BY 1), f AS (SELECT a.y AS fold, a.st AS t0, b.st AS c0 FROM s a JOIN s b ON b.y = a.y - 1),
j AS (SELECT fold, CASE WHEN y = fold THEN 'test' WHEN y = fold - 1 AND av < t0 THEN 'calibration' WHEN y <= fold - 2 AND av < c0 THEN 'train' END AS part FROM d JOIN f ON y <= fold) SELECT fold, part, count(*) AS n FROM j WHERE part IS NOT NULL GROUP BY 1, 2""",
)
def season_folds(spark, sf):
    day = F.col("o_orderdate").cast("date")
    d = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"), day.alias("day"), F.date_add(day, 22).alias("av"))
    return V.season_folds(d, "y", "day", "av").groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "walk_forward_blocks",
    """WITH p AS (SELECT datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS period, count(*) AS test_n FROM events GROUP BY 1), w AS (SELECT *, CAST(coalesce(sum(test_n) OVER (ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) AS BIGINT) AS train_n FROM p) SELECT period, test_n, train_n FROM w WHERE train_n >= 1""",
)
def walk_forward_blocks(spark, sf):
    period = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3).cast("long")
    return V.walk_forward(events(spark, sf).withColumn("period", period), "period", gap=1)


MODELS = f"SELECT doc_id % 20 AS period, y, (doc_id % 89 + 5) / 99.0 AS m1, CASE WHEN y = 1 THEN 0.5 + (doc_id % 40) / 100.0 ELSE 0.6 - (doc_id % 40) / 100.0 END AS m2, 0.5 AS m3, doc_id, p FROM ({PRED})"


def models(spark, sf):
    i = F.col("doc_id")
    m2 = F.when(F.col("y") == 1, 0.5 + (i % 40) / 100.0).otherwise(0.6 - (i % 40) / 100.0)
    return predictions(spark, sf).select("doc_id", "p", (i % 20).alias("period"), "y", ((i % 89 + 5) / 99.0).alias("m1"), m2.alias("m2"), F.lit(0.5).alias("m3"))


LOSS = "-(y * ln({0}) + (1 - y) * ln(1 - {0}))"


@query(
    "causal_policy",
    f"""WITH m AS ({MODELS}), s AS (SELECT period, count(*) AS n, sum({LOSS.format("m1")}) AS s1, sum({LOSS.format("m2")}) AS s2, sum({LOSS.format("m3")}) AS s3 FROM m GROUP BY 1),
c AS (SELECT period, n, sum(n) OVER w AS k, sum(s1) OVER w AS a, sum(s2) OVER w AS b, sum(s3) OVER w AS d FROM s WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT period, n, CASE WHEN coalesce(k, 0) < 100 OR a <= least(b, d) THEN 'm1' WHEN b <= d THEN 'm2' ELSE 'm3' END AS chosen FROM c""",
)
def causal_policy(spark, sf):
    return V.causal_policy(models(spark, sf), "period", ["m1", "m2", "m3"], "y", least=100)


@query(
    "promotion_gate",
    f"""WITH m AS ({MODELS}), g AS (SELECT count(*) AS n, avg({LOSS.format("m1")}) AS lo, avg({LOSS.format("m2")}) AS ln_, avg((m1 - y) * (m1 - y)) AS bo, avg((m2 - y) * (m2 - y)) AS bn FROM m WHERE p IS NOT NULL)
SELECT n, round(lo, 6) AS log_loss_old, round(ln_, 6) AS log_loss_new, round(bo, 6) AS brier_old, round(bn, 6) AS brier_new, CAST(n >= 100 AND ln_ < lo AND bn <= bo AS INT) AS promoted FROM g""",
)
def promotion_gate(spark, sf):
    m = models(spark, sf)
    return V.gate(m.withColumn("p", F.col("m1")), m.where("p IS NOT NULL").withColumn("p", F.col("m2")), "doc_id", "y", "p")


@query("retrain_trigger", "SELECT event_type, count(*) FILTER (CAST(ts AS DATE) > DATE '2024-01-20') AS fresh, CAST(count(*) FILTER (CAST(ts AS DATE) > DATE '2024-01-20') >= 100 AS INT) AS retrain FROM events GROUP BY 1")
def retrain_trigger(spark, sf):
    n = F.count_if(F.col("ts").cast("date") > F.lit("2024-01-20").cast("date"))
    return events(spark, sf).groupBy("event_type").agg(n.alias("fresh"), (n >= 100).cast("int").alias("retrain"))


@query("platt")
def platt(spark, sf):
    return V.platt(models(spark, sf).where("m2 > 0 AND m2 < 1"), ["period"], "y", "m1")


@query(
    "isotonic",
    f"""WITH c AS (SELECT m1 AS p, sum(y)::DOUBLE AS s, count(*) AS n FROM ({MODELS}) WHERE m1 IS NOT NULL GROUP BY 1), k AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM c WINDOW w AS (ORDER BY p)),
r AS (SELECT a.p AS pa, b.p AS pb, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM k a JOIN k b ON a.p <= b.p), l AS (SELECT c.p, r.pa, min(r.m) AS lo FROM c JOIN r ON r.pa <= c.p AND r.pb >= c.p GROUP BY 1, 2),
v AS (SELECT p, round(max(lo), 9) AS value FROM l GROUP BY 1) SELECT min(p) AS p_from, max(p) AS p_to, value, sum(n)::BIGINT AS n FROM v JOIN c USING (p) GROUP BY value""",
)
def isotonic(spark, sf):
    return V.isotonic(models(spark, sf), "y", "m1").withColumn("value", F.round("value", 9))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf):
    d = models(spark, sf).withColumn("diff", log_loss(F.col("y"), F.col("m1")) - log_loss(F.col("y"), F.col("m2")))
    return V.paired_bootstrap(d, "period", "diff")


@query(
    "mcnemar",
    f"""WITH m AS ({MODELS}), c AS (SELECT count(*) FILTER (((m1 >= 0.5) = (y = 1)) AND NOT ((m2 >= 0.5) = (y = 1))) AS only_a, count(*) FILTER (NOT ((m1 >= 0.5) = (y = 1)) AND ((m2 >= 0.5) = (y = 1))) AS only_b FROM m),
t AS (SELECT only_a, only_b, unnest(range(0, least(only_a, only_b) + 1)) AS k FROM c)
SELECT only_a, only_b, round(least(1.0, 2 * sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) - (only_a + only_b) * ln(2)))), 6) AS p FROM t GROUP BY 1, 2""",
)
def mcnemar(spark, sf):
    right = lambda c: (F.col(c) >= 0.5) == (F.col("y") == 1)
    return V.mcnemar(models(spark, sf), right("m1"), right("m2")).withColumn("p", F.round("p", 6))
