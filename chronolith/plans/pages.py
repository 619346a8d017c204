"""Queries over strict page parsers. Pages are made of the tables: a page for each nation, some of them altered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from ..sources.io import table
from .registry import query

RATINGS = [P.Column("Rank", "rank", "int"), P.Column("Name", "name", "text"), P.Column("Rating", "rating", "float"), P.Column("Since", "since", "date", False)]


def _cells(*cells):
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


@query(
    "ratings_pages",
    """WITH s AS (SELECT s_nationkey AS page, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier), p AS (SELECT DISTINCT page FROM s),
bad AS (SELECT page, CASE page % 5 WHEN 1 THEN 'header_changed' WHEN 2 THEN 'rating_invalid_in_row_1' WHEN 3 THEN 'table_missing' END AS reason FROM p)
SELECT s.page, CAST(r - 1 AS INT) AS pos, r AS rank, s_name AS name, CAST(1500 + s_suppkey AS DOUBLE) AS rating, CASE WHEN s_suppkey % 2 = 0 THEN DATE '2020-02-29' END AS since, NULL::VARCHAR AS reason FROM s JOIN bad USING (page) WHERE reason IS NULL
UNION ALL SELECT page, NULL, NULL, NULL, NULL, NULL, reason FROM bad WHERE reason IS NOT NULL""",
)
def ratings_pages(spark, sf):
    """A ratings table by position to typed columns; three kinds of altered pages are rejected."""
    s, page = table(spark, sf, "supplier"), F.col("s_nationkey")
    rows = s.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))

    def line(x, i):
        wrong = (F.col("page") % 5 == 2) & (i == 0)
        rating = F.when(wrong, F.lit("n/a")).otherwise(F.concat((x["s_suppkey"] + 1500).cast("string"), F.lit(".0")))
        return _cells((i + 1).cast("string"), F.concat(F.lit("<a href='/p'> "), x["s_name"], F.lit(" </a>")), rating, F.when(x["s_suppkey"] % 2 == 0, "2020-02-29").otherwise(""))

    head = F.concat(F.lit("<tr><th>Rank</th><th>Name</th><th>"), F.when(F.col("page") % 5 == 1, "Elo").otherwise("Rating"), F.lit("</th><th>Since</th></tr>"))
    name = F.when(F.col("page") % 5 == 3, "new-ratings").otherwise("ratings")
    html = F.concat(F.lit("<html><p>1 &amp; 2</p><table class='x "), name, F.lit("'>"), head, F.array_join(F.transform("rows", line), "\n"), F.lit("</table></html>"))
    return P.typed_table(rows.select("page", html.alias("html")), "page", "html", "ratings", RATINGS)


@query(
    "agenda_pages",
    """WITH o AS (SELECT c_nationkey AS page, o_orderkey AS k, o_orderpriority AS g, c_custkey AS a, c_custkey + 1 + o_orderkey % 3 AS b, o_orderstatus = 'F' AS done, o_orderkey % 4 AS x FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 200000),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY g, k) - 1 AS pos, min(k) OVER (PARTITION BY page) AS first FROM o),
bad AS (SELECT DISTINCT page, first, CASE page % 6 WHEN 2 THEN 'second_row_missing_after_m' || first_pos WHEN 4 THEN 'pair_before_group_in_row_0' END AS reason FROM (SELECT page, first, first_value(k) OVER (PARTITION BY page ORDER BY pos) AS first_pos FROM r))
SELECT r.page, CAST(pos AS INT) AS pos, g AS "group", 'm' || k AS id, a::VARCHAR AS first, b::VARCHAR AS second, CASE WHEN done THEN CAST(x AS INT) END AS score_first, CASE WHEN done THEN CAST(3 - x AS INT) END AS score_second, NULL::VARCHAR AS reason FROM r JOIN bad USING (page) WHERE reason IS NULL
UNION ALL SELECT page, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM bad WHERE reason IS NOT NULL""",
)
def agenda_pages(spark, sf):
    """An agenda's groups and pairs of rows; pages whose pairs are torn or come before a group are rejected."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("page"))
    o = table(spark, sf, "orders").where("o_totalprice > 200000").join(c, "o_custkey")
    k, done = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    game = F.struct(k.alias("k"), F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1 + k % 3).alias("b"), F.when(done, (k % 4).cast("string")).otherwise("").alias("x"), F.when(done, (3 - k % 4).cast("string")).otherwise("").alias("y"))
    groups = o.groupBy("page", F.col("o_orderpriority").alias("g")).agg(F.array_sort(F.collect_list(game)).alias("games"))

    def side(i, who, score):
        return F.concat(F.lit("<tr id='m"), i, F.lit("'><td><a href='/player/"), who.cast("string"), F.lit("/'>P</a></td><td>"), score, F.lit("</td></tr>"))

    def pair(x):
        second = F.when(F.col("page") % 6 == 2, "z").otherwise("b")
        return F.concat(side(x["k"].cast("string"), x["a"], x["x"]), side(F.concat(x["k"].cast("string"), second), x["b"], x["y"]))

    head = F.when(F.col("page") % 6 != 4, F.concat(F.lit("<tr class='head flags'><td>"), F.col("g"), F.lit("</td><td></td></tr>"))).otherwise("")
    part = groups.select("page", F.struct("g", F.concat(head, F.array_join(F.transform("games", pair), "")).alias("html")).alias("p"))
    pages = part.groupBy("page").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    html = F.concat(F.lit("<table class='result'>"), F.array_join(F.transform("ps", lambda p: p["html"]), ""), F.lit("</table>"))
    return P.agenda(pages.select("page", html.alias("html")), "page", "html", "result", r"/player/([^/]+)/")
