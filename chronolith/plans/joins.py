"""Joins: as-of, edition, interval, semi, anti, lookups with conflicts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.asof import asof_join, edition_asof, interval_join, intervals_of_presence
from ..operators.dedup import latest, resolve
from ..sources.io import events, table
from .registry import query


@query(
    "asof_prev_view",
    """SELECT p.event_id, p.user_id, v.value AS prev_value, CAST(epoch_us(p.ts) - epoch_us(v.ts) AS BIGINT) AS age_us,
       CAST(v.ts IS NULL AS INT) AS missing
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts > v.ts""",
)
def asof_prev_view(spark, sf):
    e = events(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    p, v = e.where("event_type = 'purchase'"), e.where("event_type = 'view'")
    j = asof_join(p, v, ["user_id"], "us", "us", ["value"], ties=["event_id"], bucket=7 * 86400e6)
    return j.select("event_id", "user_id", "prev_value", (F.col("us") - F.col("prev_us")).alias("age_us"), F.col("prev_us").isNull().cast("int").alias("missing"))


@query(
    "asof_inclusive",
    """SELECT p.event_id, v.event_id AS seen_id FROM (SELECT * FROM events WHERE event_type = 'error') p
ASOF LEFT JOIN events v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_inclusive(spark, sf):
    e = events(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return asof_join(e.where("event_type = 'error'"), e, ["user_id"], "us", "us", ["event_id"], "seen_", True, ["event_id"]).select("event_id", F.col("seen_event_id").alias("seen_id"))


@query(
    "asof_cold_start",
    """WITH l AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders)
SELECT a.o_orderkey, coalesce(max(b.o_totalprice) FILTER (b.o_orderdate = m.d), 1500.0) AS rating, CAST(m.d IS NULL AS INT) AS cold_start
FROM l a LEFT JOIN LATERAL (SELECT max(o_orderdate) AS d FROM l x WHERE x.o_custkey = a.o_custkey AND x.o_orderdate < a.o_orderdate) m ON true
LEFT JOIN l b ON b.o_custkey = a.o_custkey AND b.o_orderdate = m.d GROUP BY a.o_orderkey, m.d""",
)
def asof_cold_start(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("d"), "o_totalprice")
    j = asof_join(o, o, ["o_custkey"], "d", "d", ["o_totalprice"], ties=["o_totalprice"])
    return j.select("o_orderkey", F.coalesce("prev_o_totalprice", F.lit(1500.0)).alias("rating"), F.col("prev_d").isNull().cast("int").alias("cold_start"))


@query(
    "asof_edition_conflict",
    """WITH s AS (SELECT user_id, CAST(ts AS DATE) AS edition, CAST(ts AS DATE) AS captured, CAST(json_extract_string(props, '$.k') AS INT) AS pos FROM events WHERE event_type = 'view'),
q AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'),
m AS (SELECT q.user_id, q.d, max(edition) AS edition FROM q LEFT JOIN s ON s.user_id = q.user_id AND s.edition < q.d AND s.captured < q.d GROUP BY 1, 2)
SELECT m.user_id, m.d, m.edition, min(s.captured) AS captured, CASE WHEN min(pos) = max(pos) THEN min(pos) END AS pos
FROM m LEFT JOIN s ON s.user_id = m.user_id AND s.edition = m.edition GROUP BY 1, 2, 3""",
)
def asof_edition_conflict(spark, sf):
    e = events(spark, sf)
    day = F.col("ts").cast("date")
    seen = e.where("event_type = 'view'").select("user_id", day.alias("edition"), day.alias("captured"), F.get_json_object("props", "$.k").cast("int").alias("pos"))
    q = e.where("event_type = 'purchase'").select("user_id", day.alias("d")).distinct()
    return edition_asof(q, seen, ["user_id"], "d", "edition", "captured", "pos")


@query(
    "interval_membership",
    """WITH s AS (SELECT user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to, event_id AS span_id FROM events WHERE event_type = 'signup')
SELECT p.event_id, s.span_id, CAST(floor((epoch_us(p.ts) - epoch_us(s.valid_from)) / 86400000000.0) AS BIGINT) AS days_in
FROM events p LEFT JOIN s ON s.user_id = p.user_id AND s.valid_from <= p.ts AND (s.valid_to IS NULL OR p.ts < s.valid_to) WHERE p.event_type = 'purchase'""",
)
def interval_membership(spark, sf):
    e = events(spark, sf)
    w = Window.partitionBy("user_id").orderBy("ts")
    spans = e.where("event_type = 'signup'").select("user_id", F.col("sec").alias("valid_from"), F.lead("sec").over(w).alias("valid_to"), F.col("event_id").alias("span_id"))
    j = interval_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "sec"), spans, ["user_id"], "sec", "valid_from", "valid_to")
    return j.select("event_id", "span_id", F.floor((F.col("sec") - F.col("valid_from")) / 86400).cast("long").alias("days_in"))


@query(
    "interval_build",
    """WITH d AS (SELECT DISTINCT user_id % 10 AS team, CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type = 'click'),
x AS (SELECT DISTINCT team, user_id, datediff('day', DATE '2024-01-01', day) AS idx FROM d),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY team, user_id ORDER BY idx) AS grp FROM x),
e AS (SELECT team, max(idx) AS last_idx FROM x GROUP BY 1),
r AS (SELECT team, user_id, min(idx) AS valid_from, max(idx) + 1 AS t FROM g GROUP BY team, user_id, grp)
SELECT team, user_id, valid_from, CASE WHEN t <= last_idx THEN t END AS valid_to FROM r JOIN e USING (team)""",
)
def interval_build(spark, sf):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    snaps = events(spark, sf).where("event_type = 'click'").select((F.col("user_id") % 10).alias("team"), "user_id", day.alias("idx"))
    return intervals_of_presence(snaps, "user_id", "team", "idx")


@query(
    "grouped_complete_asof",
    """WITH g AS (SELECT l_orderkey, l_shipdate, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_partkey END) AS a, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_partkey END) AS b,
  sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS last_complete, round(arg_max(qty, l_shipdate), 6) AS qty FROM g WHERE a >= 1 OR b >= 2 GROUP BY 1""",
)
def grouped_complete_asof(spark, sf):
    li = table(spark, sf, "lineitem")
    new, old = F.when(F.col("l_returnflag") == "N", F.col("l_partkey")), F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))
    g = li.groupBy("l_orderkey", "l_shipdate").agg(F.count_distinct(new).alias("a"), F.count_distinct(old).alias("b"), F.sum("l_quantity").alias("qty"))
    return g.where("a >= 1 OR b >= 2").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("last_complete"), F.round(F.max_by("qty", "l_shipdate"), 6).alias("qty"))


@query(
    "latest_ties",
    """SELECT o.o_custkey, o.o_orderkey, o.o_totalprice FROM orders o JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) m ON o.o_custkey = m.o_custkey AND o.o_orderdate = m.d""",
)
def latest_ties(spark, sf):
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"))
    return o.withColumn("r", F.rank().over(w)).where("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "latest_capture_conditional",
    """WITH m AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1)
SELECT o.o_custkey, CAST(max(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INT) AS complete, count(*) AS n
FROM orders o JOIN m ON o.o_custkey = m.o_custkey AND o.o_orderdate = m.d GROUP BY 1""",
)
def latest_capture_conditional(spark, sf):
    o = table(spark, sf, "orders")
    done = F.max((F.col("o_orderstatus") == "F").cast("int"))
    per = o.groupBy("o_custkey", "o_orderdate").agg(done.alias("complete"), F.count(F.lit(1)).alias("n"))
    return latest(per, ["o_custkey"], [F.desc("o_orderdate")]).select("o_custkey", "complete", "n")


@query("anti_unsettled", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_unsettled(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("semi_published", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_published(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(urgent, "l_orderkey", "left_semi").select("l_orderkey", "l_partkey", "l_quantity")


@query(
    "either_side_semi",
    """SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0)""",
)
def either_side_semi(spark, sf):
    ids = table(spark, sf, "supplier").where("s_suppkey % 7 = 0").select("s_suppkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    a = li.join(ids.select(F.col("s_suppkey").alias("l_partkey")).distinct().withColumn("on_part", F.lit(1)), "l_partkey", "left")
    b = a.join(ids.select(F.col("s_suppkey").alias("l_suppkey")).distinct().withColumn("on_supp", F.lit(1)), "l_suppkey", "left")
    return b.where("on_part = 1 OR on_supp = 1").select("l_orderkey", "l_partkey", "l_suppkey")


@query(
    "dim_chain",
    """SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def dim_chain(spark, sf):
    t = lambda n: table(spark, sf, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))  # before the small dimensions
    j = per.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("r_name", "n_name", "orders", F.round("total", 2).alias("total"))


@query("left_outer_missing", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_outer_missing(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "range_seconds_to_start",
    """SELECT p.event_id, count(v.event_id) AS n_before, CAST(min(epoch_us(p.ts) // 1000000 - epoch_us(v.ts) // 1000000) AS BIGINT) AS seconds_to_start
FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
ON p.user_id = v.user_id AND epoch_us(p.ts) // 1000000 - epoch_us(v.ts) // 1000000 BETWEEN 0 AND 21600 GROUP BY 1""",
)
def range_seconds_to_start(spark, sf):
    e = events(spark, sf).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "s")
    v = e.where("event_type = 'view'").select("user_id", F.col("s").alias("vs"), F.col("event_id").alias("vid"))
    # six-hour buckets make the range an equi-join with at most two matches for each bucket
    p = p.withColumn("b", F.explode(F.array(F.floor(F.col("s") / 21600), F.floor(F.col("s") / 21600) - 1)))
    v = v.withColumn("b", F.floor(F.col("vs") / 21600))
    ok = (F.col("s") - F.col("vs")).between(0, 21600)
    hit = p.join(v, ["user_id", "b"]).where(ok).groupBy("event_id").agg(F.count(F.lit(1)).alias("n_before"), F.min(F.col("s") - F.col("vs")).alias("seconds_to_start"))
    return e.where("event_type = 'purchase'").select("event_id").join(hit, "event_id", "left").select("event_id", F.coalesce("n_before", F.lit(0)).alias("n_before"), "seconds_to_start")


@query(
    "name_key_resolution",
    """WITH k AS (SELECT c_custkey, 'k' || (c_custkey % 97) AS key, c_acctbal > 9000 AS active FROM customer),
c AS (SELECT key, count(DISTINCT c_custkey) AS n, min(c_custkey) AS id FROM k WHERE active GROUP BY 1),
q AS (SELECT s_suppkey, 'k' || (s_suppkey % 131) AS key FROM supplier), o AS (SELECT 'k5' AS key, CAST(-5 AS BIGINT) AS oid)
SELECT s_suppkey, q.key, CASE WHEN oid IS NOT NULL THEN 'override' WHEN n IS NULL THEN 'no_active' WHEN n > 1 THEN 'ambiguous' ELSE 'exact' END AS resolution,
  CASE WHEN oid IS NOT NULL THEN oid WHEN n = 1 THEN id END AS resolved_id FROM q LEFT JOIN c USING (key) LEFT JOIN o USING (key)""",
)
def name_key_resolution(spark, sf):
    key = lambda c, m: F.concat(F.lit("k"), (F.col(c) % m).cast("string")).alias("key")
    active = table(spark, sf, "customer").where("c_acctbal > 9000").select("c_custkey", key("c_custkey", 97))
    q = table(spark, sf, "supplier").select("s_suppkey", key("s_suppkey", 131))
    over = spark.range(1).select(F.lit("k5").alias("key"), F.lit(-5).cast("long").alias("override_id"))
    return resolve(q, "key", active, "c_custkey", over)


@query(
    "one_to_one_merge",
    """SELECT o_orderkey, n_lines, CAST(n_lines > 1 AS INT) AS many FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def one_to_one_merge(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return table(spark, sf, "orders").join(n, "o_orderkey").select("o_orderkey", "n_lines", (F.col("n_lines") > 1).cast("int").alias("many"))


@query(
    "exact_or_conflict",
    """SELECT l_partkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS agreed, CAST(min(l_shipdate) AS DATE) AS earliest, count(*) AS n FROM lineitem GROUP BY 1""",
)
def exact_or_conflict(spark, sf):
    lo, hi = F.min("l_returnflag"), F.max("l_returnflag")  # one value iff they agree: no distinct set is held
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.when(lo == hi, lo).alias("agreed"), F.min("l_shipdate").cast("date").alias("earliest"), F.count(F.lit(1)).alias("n"))


@query(
    "double_identity_available",
    """WITH f AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT p.event_id, a.t AS subject_at, b.t AS rival_at, greatest(a.t, b.t) AS available_at FROM events p
JOIN f a ON a.user_id = p.user_id JOIN f b ON b.user_id = (p.user_id + 1) % 150 WHERE p.event_type = 'click' AND greatest(a.t, b.t) < p.ts""",
)
def double_identity_available(spark, sf):
    e = events(spark, sf)
    f = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t"))
    p = e.where("event_type = 'click'").select("event_id", "ts", "user_id", ((F.col("user_id") + 1) % 150).alias("rival"))
    j = p.join(f.select("user_id", F.col("t").alias("subject_at")), "user_id").join(f.select(F.col("user_id").alias("rival"), F.col("t").alias("rival_at")), "rival")
    return j.withColumn("available_at", F.greatest("subject_at", "rival_at")).where("available_at < ts").select("event_id", "subject_at", "rival_at", "available_at")


@query(
    "unique_pair_profile",
    """WITH u AS (SELECT l_partkey, l_suppkey, min(l_orderkey) AS k FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1)
SELECT l_partkey, l_suppkey, k AS l_orderkey, o_orderstatus FROM u JOIN orders ON o_orderkey = k""",
)
def unique_pair_profile(spark, sf):
    li = table(spark, sf, "lineitem")
    u = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("l_orderkey")).where("n = 1").drop("n")
    return u.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey").select("l_partkey", "l_suppkey", "l_orderkey", "o_orderstatus")
