"""Streaming queries (against the SQL of their batch equivalents) and the prediction ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ledger import ledger_states, settle
from ..sources.io import events, table
from ..streaming import pipelines as P
from .registry import query


def _events(spark, sf):
    e = table(spark, sf, "events")
    return P.stream(spark, f"{sf}/events.parquet", e).withColumn("at", F.col("ts").cast("timestamp"))


@query("stream_tumbling", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    t = P.tumbling(_events(spark, sf), "at", "1 day", "40 days", ["event_type"], F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = P.run(t.select(F.col("window.start").alias("start"), "event_type", "n", "total"), ["start", "event_type"])
    return out.select(F.col("start").cast("date").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "stream_session",
    """WITH g AS (SELECT user_id, ts, CAST(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS INT) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def stream_session(spark, sf):
    t = P.sessions(_events(spark, sf), "at", "6 hours", "1 day", ["user_id"], F.count(F.lit(1)).alias("n"))
    # sessions grow and merge, so only those are final that the watermark has passed
    out = P.run(t.select("user_id", F.col("session_window.start").alias("started"), "n"))
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


@query("stream_dedup", "SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2")
def stream_dedup(spark, sf):
    e = _events(spark, sf).withColumn("day", F.to_date("at"))
    return P.run(P.first_of(e, "at", "40 days", ["user_id", "event_type", "day"]).select("user_id", "event_type", "day")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("days"))


@query("stream_embargo", "SELECT event_id, CAST(ts AS DATE) + 22 AS available_date FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) + 22 <= DATE '2024-02-10'")
def stream_embargo(spark, sf):
    e = _events(spark, sf).where("event_type = 'signup'").select("event_id", F.date_add(F.to_date("at"), 22).alias("available_date"))
    return P.run(e.where(F.col("available_date") <= F.lit("2024-02-10").cast("date")))


@query(
    "ledger_states",
    """WITH p AS (SELECT o_orderkey AS match_id, o_orderdate AS predicted_at, o_orderdate + INTERVAL (o_orderkey % 9 - 2) DAY AS kickoff, o_orderpriority <> '5-LOW' AS traced FROM orders)
SELECT match_id, CASE WHEN predicted_at >= kickoff OR NOT traced THEN 'invalid' WHEN kickoff <= TIMESTAMP '1997-01-01' THEN 'frozen' ELSE 'open' END AS state, CASE WHEN predicted_at >= kickoff AND NOT traced THEN 'not_before_kickoff,untraced' WHEN predicted_at >= kickoff THEN 'not_before_kickoff' WHEN NOT traced THEN 'untraced' ELSE '' END AS why FROM p""",
)
def ledger(spark, sf):
    o = table(spark, sf, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    p = o.select(F.col("o_orderkey").alias("match_id"), at.alias("predicted_at"), (at + F.make_interval(days=(F.col("o_orderkey") % 9 - 2).cast("int"))).alias("kickoff"), (F.col("o_orderpriority") != "5-LOW").alias("traced"))
    s = ledger_states(p, F.lit("1997-01-01").cast("timestamp"))
    return s.select("match_id", "state", F.array_join("why", ",").alias("why"))


@query(
    "settlement_view",
    """WITH p AS (SELECT o_orderkey AS match_id, o_orderdate AS predicted_at, 0.2 + (o_orderkey % 61) / 100.0 AS p FROM orders), s AS (SELECT l_orderkey AS match_id, l_shipdate AS seen_at, l_returnflag, l_partkey, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem WHERE l_linestatus = 'F'),
j AS (SELECT p.match_id, p.p, s.y, row_number() OVER (PARTITION BY p.match_id ORDER BY seen_at, l_returnflag, l_partkey) AS rn FROM p JOIN s USING (match_id) WHERE seen_at > predicted_at)
SELECT match_id, y, CAST((p >= 0.5) = (y = 1) AS INT) AS correct, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss FROM j WHERE rn = 1""",
)
def settlement(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("predicted_at"), (0.2 + (F.col("o_orderkey") % 61) / 100.0).alias("p"))
    s = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("match_id"), F.col("l_shipdate").alias("seen_at"), "l_returnflag", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return settle(p, s, ["seen_at", "l_returnflag", "l_partkey"]).select("match_id", "y", "correct", F.round("log_loss", 6).alias("log_loss"))


@query(
    "freshness_states",
    """SELECT user_id, CASE WHEN arg_max(event_type, ts) = 'error' THEN 'failed' WHEN max(ts) < TIMESTAMP '2024-01-30' - INTERVAL 12 HOUR THEN 'stale' ELSE 'fresh' END AS status FROM events GROUP BY 1""",
)
def freshness(spark, sf):
    last = events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", "ts").alias("kind"), F.max("ts").alias("ts"))
    cut = F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    return last.select("user_id", F.when(F.col("kind") == "error", "failed").when(F.col("ts") < cut, "stale").otherwise("fresh").alias("status"))
