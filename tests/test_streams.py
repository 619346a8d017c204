"""Streams with late rows: what the watermark has passed is dropped, what it hasn't is counted."""

import datetime as dt

from pyspark.sql import functions as F

from chronolith.streaming import pipelines as P

KIND = "at timestamp, k string, v long"


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def stream(spark, tmp_path, batches):
    for rows in batches:
        spark.createDataFrame([(at(h), k, v) for h, k, v in rows], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))


def test_late_rows_within_and_beyond_the_watermark(spark, tmp_path):
    # a batch drops rows behind the watermark of the batch before it: one row is 4 hours behind the latest (kept), one 41 (dropped)
    src = stream(spark, tmp_path, [[(0, "a", 1)], [(50, "a", 2)], [(51, "b", 32)], [(47, "a", 4), (10, "a", 8)], [(100, "a", 16)]])
    t = P.tumbling(src, "at", "10 hours", "6 hours", ["k"], F.sum("v").alias("v")).select(F.col("window.start").alias("start"), "k", "v")
    assert sorted(r.v for r in P.run(t, ["start", "k"]).collect()) == [1, 2, 4, 16, 32]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    src = stream(spark, tmp_path, [[(0, "a", 1), (1, "a", 1)], [(3, "a", 1)], [(30, "a", 1)], [(31, "a", 1)], [(2, "a", 1)], [(60, "a", 1)]])
    t = P.sessions(src, "at", "2 hours", "4 hours", ["k"], F.count(F.lit(1)).alias("n")).select("k", F.col("session_window.start").alias("started"), "n")
    out = sorted((r.started, r.n) for r in P.run(t).collect())
    # the row at 2 would be in the first session, but comes behind the watermark; the last session is still open
    assert [n for _, n in out] == [3, 2]


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    src = stream(spark, tmp_path, [[(0, "a", 1), (0, "b", 1)], [(1, "a", 1)], [(100, "c", 1)], [(101, "c", 1)]])
    out = P.run(P.first_of(src, "at", "5 hours", ["k"])).collect()
    assert sorted(r.k for r in out) == ["a", "b", "c"]
