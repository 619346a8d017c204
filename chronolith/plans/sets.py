"""Set operations, de-duplication, reconciliation, composites, data quality."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import dedup as D
from ..operators.quality import constraint_report, leakage_rows, orphans
from ..sources.io import events, new_rows, table, upserted
from .registry import query


@query("conflict_good", "SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2 HAVING min(l_returnflag) = max(l_returnflag)")
def conflict_good(spark, sf):
    return D.split_conflicts(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"], ["l_returnflag"])[0]


@query(
    "conflict_quarantine",
    """SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING min(l_returnflag) <> max(l_returnflag)) USING (l_orderkey, l_linenumber)""",
)
def conflict_quarantine(spark, sf):
    return D.split_conflicts(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"], ["l_returnflag"])[1]


@query(
    "cross_source_dedup",
    """WITH x AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('view', 'click') THEN 'new' ELSE 'old' END AS src FROM events), f AS (SELECT *, max(CAST(src = 'new' AS INT)) OVER (PARTITION BY user_id, day) AS has FROM x)
SELECT event_id, src FROM f WHERE has = 0 OR src = 'new'""",
)
def cross_source_dedup(spark, sf):
    src = F.when(F.col("event_type").isin("view", "click"), "new").otherwise("old")
    x = events(spark, sf).select("event_id", "user_id", F.col("ts").cast("date").alias("day"), src.alias("src"))
    return D.prefer_source(x, ["user_id", "day"], "src", "new").select("event_id", "src")


@query("resolution_union", "SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def resolution_union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


@query("set_difference", "SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase'")
def set_difference(spark, sf):
    d = lambda k: events(spark, sf).where(F.col("event_type") == k).select("user_id", F.col("ts").cast("date").alias("day"))
    return d("view").subtract(d("purchase"))


@query("set_intersection", "SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view' INTERSECT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'purchase'")
def set_intersection(spark, sf):
    d = lambda k: events(spark, sf).where(F.col("event_type") == k).select("user_id", F.col("ts").cast("date").alias("day"))
    return d("view").intersect(d("purchase"))


@query("duplicate_reasons", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) > 1 THEN 'duplicate' ELSE 'kept' END AS reason FROM orders")
def duplicate_reasons(spark, sf):
    rn = F.row_number().over(Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.when(rn > 1, "duplicate").otherwise("kept").alias("reason"))


@query(
    "reconcile_full_outer",
    """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 80 GROUP BY 1), b AS (SELECT user_id, count(*) AS m FROM events WHERE event_type = 'error' AND value > 80 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN m IS NULL THEN 'left_only' WHEN n IS NULL THEN 'right_only' WHEN n = m THEN 'equal' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id""",
)
def reconcile_full_outer(spark, sf):
    e = events(spark, sf).where("value > 80")
    side = lambda k, n: e.where(F.col("event_type") == k).groupBy("user_id").agg(F.count(F.lit(1)).alias(n))
    j = side("purchase", "n").join(side("error", "m"), "user_id", "full_outer")
    status = F.when(F.col("m").isNull(), "left_only").when(F.col("n").isNull(), "right_only").when(F.col("n") == F.col("m"), "equal").otherwise("differs")
    return j.select("user_id", status.alias("status"))


@query(
    "monotone_merge",
    """WITH o AS (SELECT o_custkey, o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice > 200000 THEN o_orderpriority END AS prio FROM orders)
SELECT o_custkey, arg_min(status, o_orderkey) FILTER (status IS NOT NULL) AS status, arg_min(prio, o_orderkey) FILTER (prio IS NOT NULL) AS prio, CAST(count(DISTINCT status) > 1 AS BIGINT) + CAST(count(DISTINCT prio) > 1 AS BIGINT) AS conflicts FROM o GROUP BY 1""",
)
def monotone_merge(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")).alias("prio"))
    return D.merged(o, ["o_custkey"], "o_orderkey", ["status", "prio"])


@query("idempotent_append", "SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-02')")
def idempotent_append(spark, sf):
    e = events(spark, sf).select("user_id", "event_type", "ts")
    cut = F.lit("2024-01-02").cast("timestamp_ntz")
    return new_rows(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["user_id", "event_type"]).select("user_id", "event_type")


@query(
    "upsert_merge",
    """WITH s AS (SELECT user_id, arg_max(value, ts) AS value, min(ts) AS first_at FROM events WHERE event_type = 'view' AND user_id % 3 < 2 GROUP BY 1), b AS (SELECT user_id, arg_max(CASE WHEN value > 30 THEN value END, ts) AS value, min(ts) AS first_at FROM events WHERE event_type = 'click' AND user_id % 3 > 0 GROUP BY 1)
SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(b.value, s.value) AS value, coalesce(s.first_at, b.first_at) AS first_at FROM s FULL JOIN b ON s.user_id = b.user_id""",
)
def upsert_merge(spark, sf):
    e = events(spark, sf)
    s = e.where("event_type = 'view' AND user_id % 3 < 2").groupBy("user_id").agg(F.max_by("value", "ts").alias("value"), F.min("ts").alias("first_at"))
    high = F.when(F.col("value") > 30, F.col("value"))  # the last value over 30: nulls don't overwrite
    b = e.where("event_type = 'click' AND user_id % 3 > 0").groupBy("user_id").agg(F.max_by("value", F.when(high.isNotNull(), F.col("ts"))).alias("value"), F.min("ts").alias("first_at"))
    return upserted(s, b, ["user_id"], keep_first=("first_at",))


@query(
    "bucket_timeline",
    """WITH r AS (SELECT CAST(max(ts) AS DATE) AS hi FROM events), b AS (SELECT CAST(unnest(generate_series(hi - 40, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM r), p AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, avg(CAST(value > 40 AS INT)) AS acc FROM events WHERE event_type = 'purchase' AND user_id < 20 GROUP BY 1)
SELECT b.day, coalesce(n, 0) AS n, round(acc, 6) AS acc FROM b LEFT JOIN p USING (day)""",
)
def bucket_timeline(spark, sf):
    e = events(spark, sf)
    hi = e.agg(F.max("ts").cast("date").alias("hi"))  # one row
    b = hi.select(F.explode(F.sequence(F.date_sub("hi", 40), F.col("hi"))).alias("day"))
    p = e.where("event_type = 'purchase' AND user_id < 20").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") > 40).cast("int")).alias("acc"))
    return b.join(p, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.round("acc", 6).alias("acc"))


@query("ledger_summary_sets", "SELECT event_type, user_id % 5 AS version, CAST(grouping(event_type) AS INT) AS total, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((), (event_type, user_id % 5))")
def ledger_summary_sets(spark, sf):
    e = events(spark, sf).withColumn("version", F.col("user_id") % 5)
    g = e.groupingSets([[], [F.col("event_type"), F.col("version")]], "event_type", "version")
    return g.agg(F.grouping("event_type").cast("int").alias("total"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "first_capture_followers",
    """WITH t AS (SELECT conv_id, turn, role, lead(role, 1) OVER w AS next_role, lead(length(text), 2) OVER w AS second_len FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT * FROM t WHERE turn = 0""",
)
def first_capture_followers(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("role", 1).over(w).alias("next_role"), F.lead(F.length("text").cast("long"), 2).over(w).alias("second_len"))
    return t.where("turn = 0")


@query(
    "overlay_newer",
    """WITH b AS (SELECT o_custkey AS k, max(o_orderdate) AS d, arg_max(o_totalprice, struct_pack(d := o_orderdate, o := o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), c AS (SELECT o_custkey AS k, max(o_orderdate) AS d, arg_max(o_totalprice, struct_pack(d := o_orderdate, o := o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < DATE '1998-01-01' GROUP BY 1)
SELECT b.k, CASE WHEN c.d > b.d THEN c.v ELSE b.v END AS v, CAST(coalesce(c.d > b.d, false) AS INT) AS overlaid FROM b LEFT JOIN c ON b.k = c.k""",
)
def overlay_newer(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    last = lambda d: d.groupBy("k").agg(F.max("o_orderdate").alias("d"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v"))
    b = last(o.where("o_orderstatus = 'F'"))
    c = last(o.where("o_orderstatus = 'O' AND o_orderdate < DATE '1998-01-01'")).select("k", F.col("d").alias("cd"), F.col("v").alias("cv"))
    newer = F.coalesce(F.col("cd") > F.col("d"), F.lit(False))
    return b.join(c, "k", "left").select("k", F.when(newer, F.col("cv")).otherwise(F.col("v")).alias("v"), newer.cast("int").alias("overlaid"))


@query("attempt_union_max", "SELECT user_id, max(ts) AS last_at, arg_max(kind, ts) AS kind FROM (SELECT user_id, ts, 'ok' AS kind FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, ts, 'failed' FROM events WHERE event_type = 'error') GROUP BY 1")
def attempt_union_max(spark, sf):
    e = events(spark, sf)
    ok = e.where("event_type = 'purchase'").select("user_id", "ts", F.lit("ok").alias("kind"))
    both = ok.unionByName(e.where("event_type = 'error'").select("user_id", "ts", F.lit("failed").alias("kind")))
    return both.groupBy("user_id").agg(F.max("ts").alias("last_at"), F.max_by("kind", "ts").alias("kind"))


@query(
    "contradictions",
    """SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_linestatus = 'F' AND b.l_linestatus = 'O' AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2""",
)
def contradictions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus")
    a = li.where("l_linestatus = 'F'")
    b = li.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("other"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("l_suppkey <> other").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query(
    "one_to_one_backfill",
    """WITH s AS (SELECT user_id, event_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT user_id, event_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT t.event_id AS target, s.event_id AS source FROM t JOIN s ON s.user_id = t.user_id AND s.rn = t.rn AND s.n = t.n""",
)
def one_to_one_backfill(spark, sf):
    e = events(spark, sf)
    w = Window.partitionBy("user_id")
    side = lambda k, n: e.where(F.col("event_type") == k).select("user_id", F.col("event_id").alias(n), F.row_number().over(w.orderBy("ts", "event_id")).alias("rn"), F.count(F.lit(1)).over(w).alias("n"))
    return side("purchase", "target").join(side("signup", "source"), ["user_id", "rn", "n"]).select("target", "source")


@query(
    "surrogate_keys",
    """WITH k AS (SELECT n_nationkey, min(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS a, min(c_custkey) AS b FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1) SELECT n_nationkey, coalesce(a, b, -1 - n_nationkey) AS entity_id FROM k""",
)
def surrogate_keys(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey"))).alias("a"), F.min("c_custkey").alias("b"))
    return table(spark, sf, "nation").join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce("a", "b", -1 - F.col("n_nationkey")).alias("entity_id"))


@query(
    "signature_stability",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_type) || max(event_type) AS sig FROM events GROUP BY 1, 2), c AS (SELECT *, CAST(lag(sig) OVER w IS DISTINCT FROM sig AS INT) AS changed FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, CAST(sum(changed) - 1 AS BIGINT) AS changes, CAST(datediff('day', max(CASE WHEN changed = 1 THEN day END), max(day)) AS BIGINT) AS stable_days FROM c GROUP BY 1""",
)
def signature_stability(spark, sf):
    d = events(spark, sf).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.concat(F.min("event_type"), F.max("event_type")).alias("sig"))
    last = F.lag("sig").over(Window.partitionBy("user_id").orderBy("day"))
    c = d.withColumn("changed", (~last.eqNullSafe(F.col("sig"))).cast("int"))
    since = F.datediff(F.max("day"), F.max(F.when(F.col("changed") == 1, F.col("day"))))
    return c.groupBy("user_id").agg((F.sum("changed") - 1).alias("changes"), since.cast("long").alias("stable_days"))


@query("review_queue_merge", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS flags, min(CAST(l_shipdate AS DATE)) AS first_day, max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1")
def review_queue_merge(spark, sf):
    done = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf, "lineitem").join(done, "l_suppkey", "left_anti").groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("flags"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


@query("flag_update", "SELECT o_orderkey, CAST(o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) AS INT) AS flagged FROM orders")
def flag_update(spark, sf):
    hit = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("f", F.lit(1))
    return table(spark, sf, "orders").join(hit, "o_orderkey", "left").select("o_orderkey", F.coalesce("f", F.lit(0)).alias("flagged"))


@query("fk_violations", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def fk_violations(spark, sf):
    parents = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return orphans(table(spark, sf, "lineitem"), "l_orderkey", parents, "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("leakage_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def leakage(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return leakage_rows(table(spark, sf, "lineitem").join(o, "l_orderkey"), "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "constraint_report",
    """SELECT 'quantity_range' AS rule, count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 50)) AS violations, 'pass' AS status FROM lineitem HAVING count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 50)) = 0
UNION ALL SELECT 'discount_cap', count(*) FILTER (NOT (l_discount <= 0.05)), 'fail' FROM lineitem UNION ALL SELECT 'flag_known', count(*) FILTER (NOT (l_returnflag IN ('A', 'N', 'R'))), 'pass' FROM lineitem""",
)
def constraints(spark, sf):
    return constraint_report(table(spark, sf, "lineitem"), {"quantity_range": "l_quantity BETWEEN 1 AND 50", "discount_cap": "l_discount <= 0.05", "flag_known": "l_returnflag IN ('A', 'N', 'R')"})
