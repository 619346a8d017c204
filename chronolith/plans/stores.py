"""Sources and sinks: each query writes a driver table out in a format, reads it back and returns it."""

from __future__ import annotations

from pyspark.sql import Window, functions as F
from pyspark.sql.types import StructType

from ..sources import io
from ..sources.io import table
from ..sources.staging import new_path
from .registry import query

SUPPLIER = "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"


@query("source_csv_typed", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def source_csv_typed(spark, sf):
    path = new_path(spark, "csv")
    io.write_csv(table(spark, sf, "supplier"), path)
    schema = StructType.fromDDL(SUPPLIER)
    return io.read_csv(spark, path, schema, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]).drop("source_path")


@query("source_csv_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS born FROM orders")
def source_csv_dates(spark, sf):
    """Dates as yyyyMMdd; what is no date is null."""
    path = new_path(spark, "csv")
    text = F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("00000000")
    io.write_csv(table(spark, sf, "orders").select("o_orderkey", text.alias("dob")), path)
    rows = io.read_csv(spark, path, StructType.fromDDL("o_orderkey long, dob string"))
    return rows.select("o_orderkey", F.try_to_timestamp("dob", F.lit("yyyyMMdd")).cast("date").alias("born"))


@query("source_years_pruned", "SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996")
def source_years_pruned(spark, sf):
    path = new_path(spark, "years")
    io.write_parquet(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year")), path, ["year"])
    return io.years_between(spark, path, 1994, 1996)


@query("source_provenance", "SELECT o_orderstatus AS family, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def source_provenance(spark, sf):
    """Files carry their family in their path; rows keep where they come from."""
    path = new_path(spark, "family")
    table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("family")).write.partitionBy("family").option("header", True).csv(path)
    rows = io.read_csv(spark, f"{path}/*", StructType.fromDDL("o_orderkey long"))
    return rows.groupBy(F.regexp_extract("source_path", r"family=([^/]+)/", 1).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("source_rankings", "SELECT c_custkey, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS rank, c_mktsegment FROM customer")
def source_rankings(spark, sf):
    """Integers with a sentinel for what is missing."""
    path = new_path(spark, "csv")
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 7, -1).otherwise(F.col("c_nationkey")).alias("rank"), "c_mktsegment")
    io.write_csv(c, path)
    rows = io.read_csv(spark, path, StructType.fromDDL("c_custkey long, rank int, c_mktsegment string"))
    return rows.select("c_custkey", F.when(F.col("rank") >= 0, F.col("rank")).alias("rank"), "c_mktsegment")


@query("source_pruned_filter", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01' AND (l_suppkey IN (3, 5, 7) OR l_partkey IN (3, 5, 7))")
def source_pruned_filter(spark, sf):
    wanted = [3, 5, 7]
    cut = F.lit("1993-01-01").cast(table(spark, sf, "lineitem").schema["l_shipdate"].dataType)
    return table(spark, sf, "lineitem").where((F.col("l_shipdate") < cut) & (F.col("l_suppkey").isin(wanted) | F.col("l_partkey").isin(wanted))).select("l_orderkey", "l_partkey")


@query("sink_parquet", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1")
def sink_parquet(spark, sf):
    path = new_path(spark, "sink")
    io.write_parquet(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag"), path, ["l_returnflag"])
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def _one_text(df, path):
    """A single text of all rows; for tables of a fixed few rows."""
    df.coalesce(1).write.text(path)


@query("source_results_json", "SELECT n_nationkey AS id, n_name AS name, DATE '2020-01-01' + CAST(n_nationkey AS INT) AS day, CASE WHEN n_nationkey % 2 = 0 THEN 'exact' ELSE 'date_only' END AS precision FROM nation WHERE n_nationkey >= 3")
def source_results_json(spark, sf):
    """A JSON list, with an era floor; the table has 25 rows."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("n_nationkey")).cast("string")
    row = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(day, F.lit("T10:00:00Z"))).otherwise(day).alias("date"))
    path = new_path(spark, "results")
    _one_text(table(spark, sf, "nation").agg(F.to_json(F.collect_list(row)).alias("value")), path)
    return io.read_results_json(spark, path, "id int, name string, date string", floor="2020-01-04").select("id", "name", "day", "precision")


@query("source_keyed_json", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, n_regionkey AS region FROM nation")
def source_keyed_json(spark, sf):
    entry = F.struct(F.col("n_nationkey").cast("string"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    path = new_path(spark, "master")
    _one_text(table(spark, sf, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")), path)
    return io.read_keyed_json(spark, path, "struct<name:string,region:int>")


@query("source_views", "SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def source_views(spark, sf):
    io.register_views(spark, sf)
    return spark.sql("SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")


#: Named read views over the driver's tables; each is registered before it is read.
VIEWS = {
    "result_settlement": "SELECT o_orderkey AS match_id, o_orderstatus AS status, CAST(o_orderstatus = 'F' AS INT) AS settled FROM orders",
    "result_details": "SELECT l_orderkey AS match_id, count(*) AS maps, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS lost FROM lineitem GROUP BY l_orderkey",
    "match_statistics": "SELECT l_orderkey AS match_id, l_linenumber AS map, l_quantity AS kills, l_suppkey AS player FROM lineitem WHERE l_quantity IS NOT NULL",
    "current_rosters": "SELECT s_nationkey AS team, s_suppkey AS player FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier) x WHERE place <= 5",
}


def _view(name: str):
    def run(spark, sf):
        io.register_views(spark, sf)
        spark.sql(VIEWS[name]).createOrReplaceTempView(f"{name}_v1")
        return spark.table(f"{name}_v1")

    return run


for _name, _sql in VIEWS.items():
    query(f"view_{_name}", _sql)(_view(_name))


@query("source_sitemap_xml", "SELECT page_id, url FROM pages WHERE url LIKE 'http%' AND page_id % 5 <> 0")
def source_sitemap_xml(spark, sf):
    """Addresses of a sitemap; those of another site are left out."""
    path = new_path(spark, "sitemap")
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://foreign/"), F.col("page_id"))).otherwise(F.col("url"))
    table(spark, sf, "pages").select(url.alias("loc"), "page_id").write.format("xml").option("rowTag", "url").option("rootTag", "urlset").save(path)
    rows = io.read_xml_rows(spark, path, "url", "loc string, page_id long")
    return rows.where(F.col("loc").startswith("http")).select("page_id", F.col("loc").alias("url"))


@query("sink_csv", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def sink_csv(spark, sf):
    path = new_path(spark, "predictions")
    io.write_csv(table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice"), path)
    return io.read_csv(spark, path, StructType.fromDDL("o_orderkey long, o_totalprice double")).drop("source_path")


@query("source_runs_latest", "SELECT user_id, event_type, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def source_runs_latest(spark, sf):
    """A folder for each run; of a key's captures the latest stands."""
    path = new_path(spark, "runs")
    e = table(spark, sf, "events").select("user_id", "event_type", "value", F.col("ts").cast("string").alias("captured_at"), F.col("ts").cast("date").cast("string").alias("run"))
    e.write.partitionBy("run").json(path)
    rows = spark.read.schema("user_id long, event_type string, value double, captured_at string").json(f"{path}/*")
    return rows.groupBy("user_id", "event_type").agg(F.max_by("value", "captured_at").alias("value"))


@query(
    "source_publication",
    """WITH p AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 28 AS INT) AS day, url, 40 + page_id % 60 AS conf FROM pages)
SELECT day, page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '[?#].*$', ''), '/$', '') AS url,
CASE WHEN NOT regexp_matches(url, '^https?://[^/?#]+') THEN 'url' WHEN conf NOT BETWEEN 50 AND 100 THEN 'confidence' WHEN row_number() OVER (PARTITION BY day, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) ORDER BY conf DESC, page_id) > 1 THEN 'host_repeated' ELSE '' END AS reason FROM p""",
)
def source_publication(spark, sf):
    """Publications, a folder of JSON lines for each day, with canonical addresses and the first reason against each row: no web
    address, a confidence out of range, or a host that the day has with a higher one."""
    path = new_path(spark, "publication")
    p = table(spark, sf, "pages").select("page_id", "url", (40 + F.col("page_id") % 60).alias("confidence"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")).alias("day"))
    p.write.partitionBy("day").json(path)
    rows = spark.read.schema("page_id long, url string, confidence double, day date").json(path)
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1), r"[?#].*$", ""), "/$", "")
    url = F.concat(F.lower(F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)), rest)
    again = F.row_number().over(Window.partitionBy("day", host).orderBy(F.desc("confidence"), "page_id")) > 1
    reason = F.when(~F.col("url").rlike(r"^https?://[^/?#]+"), "url").when(~F.col("confidence").between(50, 100), "confidence").when(again, "host_repeated").otherwise("")
    return rows.select("day", "page_id", url.alias("url"), reason.alias("reason"))
