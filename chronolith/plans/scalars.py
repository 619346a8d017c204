"""Projections, predicates with reasons, reshaping, JSON, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.asof import with_embargo
from ..operators.dedup import first_reason, reasons
from ..sources.io import events, table
from .registry import query


@query("safe_cast", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS v FROM events")
def safe_cast(spark, sf):
    text = F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.col("event_id").cast("string"))
    return events(spark, sf).select("event_id", S.finite(text.try_cast("double")).alias("v"))


@query("completed_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL AND o_totalprice <> 0 AND o_orderdate >= DATE '1996-01-01'")
def completed_filter(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_totalprice IS NOT NULL AND o_totalprice <> 0 AND o_orderdate >= DATE '1996-01-01'").select("o_orderkey")


@query(
    "reason_cascade",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 5 THEN 'small' WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 'status' WHEN l_partkey = l_suppkey THEN 'self' WHEN l_discount > 0.09 THEN 'discount' ELSE 'kept' END AS reason FROM lineitem""",
)
def reason_cascade(spark, sf):
    c = F.col
    why = first_reason(("small", c("l_quantity") < 5), ("status", (c("l_linestatus") == "O") & (c("l_returnflag") == "R")), ("self", c("l_partkey") == c("l_suppkey")), ("discount", c("l_discount") > 0.09))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(why, F.lit("kept")).alias("reason"))


@query("embargo_visible", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 22 AS available_date FROM orders WHERE CAST(o_orderdate AS DATE) + 21 < DATE '1996-06-01'")
def embargo_visible(spark, sf):
    o = with_embargo(table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date")), "d", 21)
    return o.where(F.col("available_date") <= F.lit("1996-06-01").cast("date")).select("o_orderkey", "available_date")


@query(
    "validity_reasons",
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_nationkey < 3 THEN 'nation' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS why,
CAST(NOT (c_acctbal < 0 OR c_nationkey < 3 OR c_mktsegment = 'BUILDING') AS INT) AS valid FROM customer""",
)
def validity_reasons(spark, sf):
    why = reasons(("negative", F.col("c_acctbal") < 0), ("nation", F.col("c_nationkey") < 3), ("segment", F.col("c_mktsegment") == "BUILDING"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(why, ",").alias("why"), (F.size(why) == 0).cast("int").alias("valid"))


@query("unpivot_sides", "SELECT l_orderkey AS game, l_partkey AS side, 'a' AS role FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey, 'b' FROM lineitem")
def unpivot_sides(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return li.unpivot("game", ["a", "b"], "role", "side").select("game", "side", "role")


@query(
    "wide_to_long",
    "SELECT l_orderkey, l_linenumber, l_partkey, stat, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT INCLUDE NULLS (value FOR stat IN (quantity, discount, tax))",
)
def wide_to_long(spark, sf):
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    li = table(spark, sf, "lineitem").select(*ids, F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return li.unpivot(ids, ["quantity", "discount", "tax"], "stat", "value")


@query(
    "explode_providers",
    """SELECT event_id, p.name AS provider, CAST(p.odds AS DOUBLE) AS odds FROM (SELECT event_id, unnest(CASE WHEN event_id % 4 = 0 THEN [{'name': 'average', 'odds': 2.0}] ELSE [{'name': 'x', 'odds': 1.5 + event_id % 3}, {'name': 'y', 'odds': 1.6 + event_id % 2}] END) AS p FROM events)""",
)
def explode_providers(spark, sf):
    item = lambda k, v: F.struct(F.lit(k).alias("name"), v.cast("double").alias("odds"))
    books = F.when(F.col("event_id") % 4 != 0, F.array(item("x", 1.5 + F.col("event_id") % 3), item("y", 1.6 + F.col("event_id") % 2)))
    only = F.array(item("average", F.lit(2.0)))
    return events(spark, sf).select("event_id", F.inline(F.coalesce(books, only)).alias("provider", "odds"))


@query("json_typed_view", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_valid(props) AS INT) AS ok FROM events")
def json_typed_view(spark, sf):
    return events(spark, sf).select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.try_parse_json("props").isNotNull().cast("int").alias("ok"))


@query("row_hash", "SELECT c_custkey, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(c_nationkey AS VARCHAR))) AS h FROM customer")
def row_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_mktsegment", F.col("c_nationkey").cast("string")), 256).alias("h"))


@query("pair_id", "SELECT DISTINCT sha256(least(a, b) || '|' || greatest(a, b)) AS id FROM (SELECT CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem)")
def pair_id(spark, sf):
    s = lambda c: F.col(c).cast("string")
    return table(spark, sf, "lineitem").select(S.pair_id(s("l_partkey"), s("l_suppkey")).alias("id")).distinct()


@query(
    "orientation",
    """SELECT o_orderkey, CAST(instr('0123456789abcdef', right(sha256('7|' || CAST(o_orderkey AS VARCHAR)), 1)) - 1 AS INT) % 2 AS swapped FROM orders""",
)
def orientation(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.orientation(F.lit("7"), F.col("o_orderkey").cast("string")).alias("swapped"))


@query(
    "side_swap",
    "SELECT l_orderkey, l_linenumber, CASE WHEN s = 1 THEN l_suppkey ELSE l_partkey END AS a, CASE WHEN s = 1 THEN l_partkey ELSE l_suppkey END AS b, CASE WHEN s = 1 THEN -diff ELSE diff END AS diff FROM (SELECT *, l_orderkey % 2 AS s, l_partkey - l_suppkey AS diff FROM lineitem)",
)
def side_swap(spark, sf):
    s = F.col("l_orderkey") % 2 == 1
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(s, b).otherwise(a).alias("a"), F.when(s, a).otherwise(b).alias("b"), F.when(s, b - a).otherwise(a - b).alias("diff"))


@query("name_normal", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM customer")
def name_normal(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.normal_name(F.col("c_name")).alias("name"))


@query("week_index", "SELECT o_orderkey, CAST((datediff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1) // 7 AS BIGINT) AS week FROM orders")
def week_index(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.week_index(F.col("o_orderdate").cast("date")).alias("week"))


@query("month_clamp", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS back FROM orders")
def month_clamp(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.months_before(F.col("o_orderdate").cast("date"), 3).alias("back"))


@query(
    "odds_functions",
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, 1.2 + l_discount * 10 AS q1, 1.2 + l_tax * 10 AS q2, (l_partkey % 97 + 1) / 99.0 AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(q1 / q2 - 1, 6) AS clv, round(CASE WHEN q1 > 1 THEN greatest(0.0, (p * q1 - 1) / (q1 - 1)) ELSE 0.0 END, 6) AS kelly, round(0.5 + 0.7 * (p - 0.5), 6) AS shrunk, round(ln(p / (1 - p)), 6) AS logit FROM o""",
)
def odds_functions(spark, sf):
    q1, q2, p = 1.2 + F.col("l_discount") * 10, 1.2 + F.col("l_tax") * 10, (F.col("l_partkey") % 97 + 1) / 99.0
    r = lambda x, n: F.round(x, 6).alias(n)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(S.closing_line_value(q1, q2), "clv"), r(S.kelly(p, q1), "kelly"), r(S.toward_half(p, F.lit(0.7)), "shrunk"), r(S.logit(p), "logit"))


@query(
    "rating_functions",
    """WITH x AS (SELECT s_suppkey, s_acctbal AS a, s_nationkey * 40.0 AS b, s_suppkey % 60 AS n FROM supplier)
SELECT s_suppkey, round(1 / (1 + pow(10, (b - a) / 400)), 6) AS expected, round(250 / pow(n + 5, 0.4), 6) AS k, CASE WHEN abs(a - b) < 50 THEN '0-50' WHEN abs(a - b) < 100 THEN '50-100' WHEN abs(a - b) < 200 THEN '100-200' WHEN abs(a - b) < 300 THEN '200-300' ELSE '300+' END AS gap,
round(pow(0.5, n / 30.0), 6) AS weight FROM x""",
)
def rating_functions(spark, sf):
    a, b, n = F.col("s_acctbal"), F.col("s_nationkey") * 40.0, F.col("s_suppkey") % 60
    return table(spark, sf, "supplier").select("s_suppkey", F.round(S.expected_score(a, b), 6).alias("expected"), F.round(S.dynamic_k(n), 6).alias("k"), S.gap_bin(a - b).alias("gap"), F.round(S.recency_weight(n, 30.0), 6).alias("weight"))


@query(
    "money_parser",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN (c_custkey % 90 + 1) * 1000.0 WHEN 1 THEN (c_custkey % 90 + 1) * 1000.0 WHEN 2 THEN (c_custkey % 9 + 1) * 1000000.0 END::DOUBLE AS amount FROM customer""",
)
def money_parser(spark, sf):
    n = F.col("c_custkey")
    text = F.when(n % 4 == 0, F.concat(F.lit("$"), (n % 90 + 1).cast("string"), F.lit("K"))).when(n % 4 == 1, F.concat(F.lit("EUR "), (n % 90 + 1).cast("string"), F.lit(",000"))).when(n % 4 == 2, F.concat(F.lit("$"), (n % 9 + 1).cast("string"), F.lit(".0M"))).otherwise("n/a")
    return table(spark, sf, "customer").select("c_custkey", S.money(text).alias("amount"))


@query(
    "score_parser",
    """WITH t AS (SELECT o_orderkey, unnest([{'i': 1, 'a': 6, 'b': o_orderkey % 5, 't': NULL}, {'i': 2, 'a': 7, 'b': 6, 't': o_orderkey % 7}]) AS s FROM orders) SELECT o_orderkey, s.i AS set_no, CAST(s.a AS INT) AS a, CAST(s.b AS INT) AS b, CAST(s.t AS INT) AS tiebreak FROM t""",
)
def score_parser(spark, sf):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("6-"), (k % 5).cast("string"), F.lit(" 7-6("), (k % 7).cast("string"), F.lit(") RET"))
    sets = table(spark, sf, "orders").select("o_orderkey", F.posexplode(S.set_scores(text)).alias("i", "s"))
    return sets.select("o_orderkey", (F.col("i") + 1).alias("set_no"), "s.a", "s.b", "s.tiebreak")


@query("bankers_round", "SELECT event_id, round_even(CAST(event_id AS DOUBLE) / 2, 0) AS r FROM events")
def bankers_round(spark, sf):
    return events(spark, sf).select("event_id", F.bround(F.col("event_id").cast("double") / 2, 0).alias("r"))


@query(
    "best_of_three",
    """SELECT p_partkey, round(a * b + a * (1 - b) * c + (1 - a) * b * c, 6) AS p FROM (SELECT p_partkey, (p_partkey % 31 + 1) / 33.0 AS a, (p_partkey % 17 + 1) / 19.0 AS b, (p_partkey % 11 + 1) / 13.0 AS c FROM part)""",
)
def best_of_three(spark, sf):
    n = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.round(S.best_of_three((n % 31 + 1) / 33.0, (n % 17 + 1) / 19.0, (n % 11 + 1) / 13.0), 6).alias("p"))


@query(
    "flag_rules",
    """SELECT o_orderkey, CAST(o_totalprice > 300000 AS INT) + CAST(o_orderpriority = '1-URGENT' AS INT) + CAST(o_orderstatus = 'O' AS INT) AS n_flags, CAST(round(greatest(0.05, least(1.0, (CASE WHEN o_totalprice > 300000 THEN 0.8 ELSE 1.0 END) * (CASE WHEN o_orderpriority = '1-URGENT' THEN 0.9 ELSE 1.0 END))), 6) AS DOUBLE) AS reliability FROM orders""",
)
def flag_rules(spark, sf):
    big, urgent = F.col("o_totalprice") > 300000, F.col("o_orderpriority") == "1-URGENT"
    flags = reasons(("big", big), ("urgent", urgent), ("open", F.col("o_orderstatus") == "O"))
    score = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.when(big, 0.8).otherwise(1.0) * F.when(urgent, 0.9).otherwise(1.0)))
    return table(spark, sf, "orders").select("o_orderkey", F.size(flags).alias("n_flags"), F.round(score, 6).alias("reliability"))


@query("page_titles", """SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<li>')) AS INT) AS links FROM pages""")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<li>")).alias("links"))
