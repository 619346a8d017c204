"""Text fields, look-ups, evidence and repair over records."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.scalars import log_loss, match_format
from ..functions.text import keyword_score, one_of, settlement_kind, stage_flags, surname_initial
from ..operators.dedup import first_reason
from ..sources.io import events, table
from .aggregates import PRED, predictions
from .registry import query


@query(
    "surname_initial",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'customer de ' || c_nationkey END AS surname, CASE WHEN c_custkey % 3 < 2 THEN 'x' END AS initial FROM customer""",
)
def surname_initials(spark, sf):
    name = F.when(F.col("c_custkey") % 3 < 2, F.concat(F.lit("Customer de "), F.col("c_nationkey").cast("string"), F.lit(" X."))).otherwise("Mononym")
    p = surname_initial(name)
    return table(spark, sf, "customer").select("c_custkey", p["surname"].alias("surname"), p["initial"].alias("initial"))


@query("url_ids", "SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def url_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"/([a-z]{2})/([0-9]+)", 2).alias("id"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query(
    "match_context",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'bo1' WHEN 1 THEN 'bo3' WHEN 2 THEN 'bo5' ELSE 'other' END AS format, CAST(o_orderkey % 2 = 0 AS INT) AS lan, CAST(o_orderkey % 3 = 0 AS INT) AS playoff FROM orders""",
)
def match_context(spark, sf):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "Bo1").when(k % 4 == 1, "Best of 3").when(k % 4 == 2, "bo5").otherwise("show match")
    text = F.concat(kind, F.when(k % 2 == 0, " (LAN)").otherwise(" (Online)"), F.when(k % 3 == 0, " Playoffs").otherwise(" Groups"))
    flags = stage_flags(text, {"lan": "lan", "playoff": "playoff"})
    return table(spark, sf, "orders").select("o_orderkey", match_format(text).alias("format"), *flags)


@query("keyword_sentiment", "SELECT conv_id, CAST(sum((length(t) - length(replace(t, 'the', ''))) // 3 - (length(t) - length(replace(t, 'ing', ''))) // 3) AS BIGINT) AS score FROM (SELECT conv_id, lower(text) AS t FROM conversations WHERE text IS NOT NULL) GROUP BY 1")
def keyword_sentiment(spark, sf):
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    return c.groupBy("conv_id").agg(F.sum(keyword_score(F.col("text"), ["the"], ["ing"])).alias("score"))


@query("surface_normal", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Hard' WHEN 1 THEN 'Clay' WHEN 2 THEN 'Grass' WHEN 3 THEN 'Carpet' END AS surface FROM orders")
def surface_normal(spark, sf):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "HARD ").when(k == 1, "clay").when(k == 2, "Grass").when(k == 3, "cARPET").otherwise("moon")
    return table(spark, sf, "orders").select("o_orderkey", one_of(raw, ["Hard", "Clay", "Grass", "Carpet"]).alias("surface"))


@query("round_levels", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 ELSE 0 END AS level FROM orders")
def round_levels(spark, sf):
    levels = F.create_map(*[F.lit(x) for kv in {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3}.items() for x in kv])
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(levels, F.col("o_orderpriority")), F.lit(0)).alias("level"))


@query("canonical_json", """SELECT c_custkey, '{"balance":' || CAST(CAST(c_acctbal * 0 AS INT) AS VARCHAR) || ',"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"}' AS body FROM customer""")
def canonical_json(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.to_json(F.struct((F.col("c_acctbal") * 0).cast("int").alias("balance"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))).alias("body"))


@query("event_metadata", "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_prize, CAST(o_orderpriority = '1-URGENT' AS INT) * CAST(o_totalprice > 100000 AS INT) AS big_stage FROM orders")
def event_metadata(spark, sf):
    flag = (F.col("o_orderpriority") == "1-URGENT").cast("int") * (F.col("o_totalprice") > 100000).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.log1p("o_totalprice"), 6).alias("log_prize"), flag.alias("big_stage"))


@query("map_keyed_lookup", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS n, coalesce(max(l_quantity) FILTER (l_returnflag = 'N'), 0) AS best_n, coalesce(max(l_quantity) FILTER (l_returnflag = 'R'), 0) AS best_r FROM lineitem GROUP BY 1")
def map_keyed_lookup(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("best"))
    m = g.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct("n", "best")))).alias("m"))
    at = lambda k, f, empty: F.coalesce(F.try_element_at("m", F.lit(k))[f], F.lit(empty))
    return m.select("l_orderkey", at("N", "n", 0).alias("n"), at("N", "best", 0.0).alias("best_n"), at("R", "best", 0.0).alias("best_r"))


@query(
    "result_inventory",
    """WITH a AS (SELECT l_orderkey, count(*) AS got FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT o_orderstatus, CASE WHEN got IS NULL THEN 'none' WHEN got >= o_orderkey % 4 + 1 THEN 'complete' ELSE 'partial' END AS state, count(*) AS n FROM orders LEFT JOIN a ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def result_inventory(spark, sf):
    a = table(spark, sf, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("got"))
    state = F.when(F.col("got").isNull(), "none").when(F.col("got") >= F.col("o_orderkey") % 4 + 1, "complete").otherwise("partial")
    return table(spark, sf, "orders").join(a, "o_orderkey", "left").groupBy("o_orderstatus", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("info_coverage", "SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n, round(avg(CAST(o_totalprice > 150000 AS INT)), 6) AS covered FROM orders GROUP BY 1, 2")
def info_coverage(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("o_totalprice") > 150000).cast("int")), 6).alias("covered"))


@query(
    "settlement_kinds",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, 1.2 + l_discount * 10 AS q1, 1.2 + l_tax * 10 AS q2, CAST(l_returnflag = 'R' AS INT) AS won FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q1 = q2 THEN 'even' WHEN (q1 < q2) = (won = 1) THEN 'favourite' ELSE 'upset' END AS kind FROM x""",
)
def settlement_kinds(spark, sf):
    q1, q2 = 1.2 + F.col("l_discount") * 10, 1.2 + F.col("l_tax") * 10
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", settlement_kind(q1, q2, F.col("l_returnflag") == "R").alias("kind"))


@query("settled_performance", "SELECT c_mktsegment, count(*) AS n, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def settled_performance(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))  # before the joins
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    j = o.join(li, "o_orderkey").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return j.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("q"))


@query(
    "snapshot_dereference",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, list(event_id ORDER BY ts, event_id) AS ids FROM events WHERE event_type = 'view' GROUP BY 1, 2), l AS (SELECT user_id, arg_max(ids, day) AS ids FROM d WHERE day < DATE '2024-01-20' GROUP BY 1), u AS (SELECT user_id, unnest(ids) AS event_id, generate_subscripts(ids, 1) - 1 AS pos FROM l)
SELECT u.user_id, CAST(pos AS INT) AS pos, e.value FROM u JOIN events e USING (event_id)""",
)
def snapshot_dereference(spark, sf):
    e = events(spark, sf)
    v = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("s"))
    last = v.where(F.col("day") < F.lit("2024-01-20").cast("date")).groupBy("user_id").agg(F.max_by("s", "day").alias("s"))
    u = last.select("user_id", F.posexplode("s").alias("pos", "x")).select("user_id", "pos", "x.event_id")
    return u.join(e.select("event_id", "value"), "event_id").select("user_id", "pos", "value")


@query("pending_worklist", "SELECT o_orderkey, coalesce(n, 0) AS attempts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND coalesce(n, 0) < 2")
def pending_worklist(spark, sf):
    n = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, sf, "orders").where("o_orderstatus = 'O'").join(n, "o_orderkey", "left")
    return j.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("attempts")).where("attempts < 2")


@query("reference_repair", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_partkey IS NULL THEN NULL ELSE l_partkey END AS fixed_part FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 5 > 0) ON p_partkey = l_partkey")
def reference_repair(spark, sf):
    known = table(spark, sf, "part").where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("fixed_part"))
    return table(spark, sf, "lineitem").join(known, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "fixed_part")


@query(
    "format_inference",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'bo5' WHEN o_orderpriority = '1-URGENT' THEN 'bo3' WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'bo1' END AS format, CASE WHEN o_totalprice > 400000 THEN 'prize' WHEN o_orderpriority = '1-URGENT' THEN 'stage' WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'group' ELSE 'ambiguous' END AS why FROM orders""",
)
def format_inference(spark, sf):
    rules = {"prize": ("bo5", F.col("o_totalprice") > 400000), "stage": ("bo3", F.col("o_orderpriority") == "1-URGENT"), "group": ("bo1", F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"))}
    kind = first_reason(*[(v, c) for v, c in rules.values()])
    why = first_reason(*[(k, c) for k, (_, c) in rules.items()])
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("format"), F.coalesce(why, F.lit("ambiguous")).alias("why"))


@query("latest_decision", "SELECT user_id, arg_max(value, ts) AS value, count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY 1")
def latest_decision(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max_by("value", "ts").alias("value"), F.count_if(F.col("event_type") == "error").alias("rejected"))


@query("evidence_catalogue", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE event_type IN ('view', 'click') UNION SELECT user_id, 'view', CAST(ts AS DATE) FROM events WHERE event_type = 'purchase'")
def evidence_catalogue(spark, sf):
    e = events(spark, sf).select("user_id", "event_type", F.col("ts").cast("date").alias("day"))
    return e.where("event_type IN ('view', 'click')").unionByName(e.where("event_type = 'purchase'").withColumn("event_type", F.lit("view"))).distinct()


@query(
    "calibrator_selection",
    f"""WITH x AS (SELECT lang, y, p, 0.5 + 0.5 * (p - 0.5) AS half, 0.5 AS flat FROM ({PRED}) WHERE p IS NOT NULL), s AS (SELECT lang, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS a, avg(-(y * ln(half) + (1 - y) * ln(1 - half))) AS b, avg(-(y * ln(flat) + (1 - y) * ln(1 - flat))) AS c FROM x GROUP BY 1)
SELECT lang, CASE WHEN a <= b AND a <= c THEN 'identity' WHEN b <= c THEN 'half' ELSE 'flat' END AS chosen FROM s""",
)
def calibrator_selection(spark, sf):
    x = predictions(spark, sf).where("p IS NOT NULL")
    options = {"identity": F.col("p"), "half": 0.5 + 0.5 * (F.col("p") - 0.5), "flat": F.lit(0.5)}
    best = F.array_min(F.array(*[F.struct(F.avg(log_loss(F.col("y"), c)).alias("loss"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, (k, c) in enumerate(options.items())]))
    return x.groupBy("lang").agg(best.alias("b")).select("lang", "b.name").withColumnRenamed("name", "chosen")


@query(
    "asset_history",
    """WITH r AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem), d AS (SELECT DISTINCT * FROM r) SELECT l_suppkey, l_returnflag, l_orderkey, l_partkey, l_linenumber, q, avg(q) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_partkey, l_linenumber, q ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean_20 FROM d""",
)
def asset_history(spark, sf):
    cols = ["l_suppkey", "l_returnflag", "l_orderkey", "l_partkey", "l_linenumber"]
    d = table(spark, sf, "lineitem").select(*cols, F.col("l_quantity").cast("long").alias("q")).distinct()
    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_partkey", "l_linenumber", "q").rowsBetween(-20, -1)
    return d.withColumn("mean_20", F.avg("q").over(w))
