"""What must not grow with a key's share of the rows, or be computed again by each fit."""

import glob
import os
import random
import time

from pyspark.sql import functions as F

from chronolith.operators import estimators as E
from chronolith.operators.blocks import BlockStore, block_hashes, preview
from chronolith.operators.composites import history_state
from chronolith.plans import incremental as I, models as M
from chronolith.sources import io


def test_a_large_partition_is_written_by_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(0, 300_000, 1, 8).select("id", F.xxhash64("id").alias("x"), (F.col("id") % 50 == 0).cast("int").alias("k"))
        io.write_parquet(df, f"{tmp_path}/s", ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(glob.glob(f"{tmp_path}/s/k=0/*.parquet")) > 3
    back = spark.read.parquet(f"{tmp_path}/s").agg(F.count(F.lit(1)), F.sum("id")).first()
    assert tuple(back) == (300_000, 300_000 * 299_999 // 2)


def test_estimators_share_one_set_of_features(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 13 + F.col("id") % 2 * 4).cast("double").alias("q"), F.when(F.col("id") % 5 != 0, "a").alias("c"), (F.col("id") < 300).alias("train"))
    train, test = df.where("train"), df.where("NOT train")
    got = E.compare(train, test, "y", ["q"], ["c"], ["logistic", "forest"])
    for name, p in got.items():
        want = E.fit_predict(train, test, "y", ["q"], ["c"], name)
        for a, b in zip(p.orderBy("q", "y", "c").collect(), want.orderBy("q", "y", "c").collect(), strict=True):
            assert a[:-1] == b[:-1] and (name == "forest" or abs(a.p - b.p) < 1e-6)


def test_fits_read_the_orders_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M, "stage", lambda df, name: seen.append(name) or df.localCheckpoint())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert M.feature_gate(spark, "/root/testdata/sf0.001").count() == 3
        assert seen == ["gate"]


def test_history_state_adds_up_outside_the_folds_tasks(spark):
    df = spark.createDataFrame([(0, d, d, "a", "b", d % 2, 3, "e", 1500.0, 1500.0, 0.5) for d in range(8)], "u int, day int, game int, a string, b string, y int, margin int, event string, rating_a double, rating_b double, expected double")
    out = history_state(df, ["u"], ["day", "game"], "event")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("RepartitionByExpression") and plan.count("Aggregate") == 2  # only sums by event are expanded
    assert sorted((r.team, r.whole, r.games, r.wins) for r in out.collect()) == [("a", 0, 8, 4), ("a", 1, 8, 4), ("b", 0, 8, 4), ("b", 1, 8, 4)]


def test_block_hashes_are_exact_sums(spark):
    rows = [("u", 1, i, i, i + 1, 1, None) for i in range(500)]
    df = spark.createDataFrame(rows, "u string, day int, game long, a long, b long, y int, surface string")
    row = F.xxhash64("day", "game", "a", "b", "y", "surface").cast("decimal(38,0)")
    want = df.agg(F.sum(row).cast("string")).first()[0]
    got = block_hashes(df, "u", ["game"])
    assert got.first().input_hash == want
    assert "decimal(38,0)))" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_previews_ask_general_states_alone(spark):
    states = spark.createDataFrame([("u", 1, 1, k, r, 1) for k, r in (("general", 1600.0), ("clay", 1700.0))], "u string, day int, entity long, kind string, rating double, games long")
    out = preview(states, spark.createDataFrame([("u", 2, 5, 1, 2, "clay")], "u string, day int, game long, a long, b long, surface string"), "u")
    assert (out.first().elo_a, out.first().surface_a, out.first().elo_b) == (1600.0, 1700.0, 1500.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("= general)") >= 2


def test_previews_shuffle_states_and_fixtures_once(spark):
    states = spark.createDataFrame([("u", 1, 1, "general", 1600.0, 1)], "u string, day int, entity long, kind string, rating double, games long")
    out = preview(states, spark.createDataFrame([("u", 2, 5, 1, 2, "clay")], "u string, day int, game long, a long, b long, surface string"), "u")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Union") == 1 and "Window" not in plan and "Join" not in plan
    assert sum(line.count("LogicalRDD") for line in plan.splitlines()) == 2  # each side is read once


def test_previews_of_odd_fixtures_over_many_batches(spark):
    r, kinds = random.Random(5), ("general", "hard", "clay")
    states = [(u, d, e, k, 1500 + r.random(), r.randrange(9)) for u in ("u", "v", None) for d in range(6) for e in range(5) for k in kinds if r.random() < 0.5]
    fixtures = [(r.choice(["u", "v", None]), r.choice([None, *range(8)]), r.choice([None, 2**60 + i]), r.choice([None, *range(7)]), r.randrange(7), r.choice([None, "general", "hard", "clay", "grass"]), i) for i in range(150)]

    def state(u, day, e, kind):
        seen = [s for s in states if s[0] == u and day is not None and s[1] < day and s[2] == e and s[3] == kind]
        return max(seen, key=lambda s: s[1])[4:] if seen else (1500.0, 0)

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(fixtures, "u string, day int, game long, a long, b long, surface string, i int")
        got = preview(spark.createDataFrame(states, "u string, day int, entity long, kind string, rating double, games long"), df, "u").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(fixtures)
    for x in got:
        u, day, game, a, b, surface, _ = fixtures[x.i]
        assert tuple(x[:6]) == (u, day, game, a, b, surface)
        for side, e in (("a", a), ("b", b)):
            general = state(u, day, e, "general")
            assert (x[f"elo_{side}"], x[f"games_{side}"]) == general
            assert x[f"surface_{side}"] == (general if surface is None else state(u, day, e, surface))[0]


def test_resumed_games_are_computed_once(spark, monkeypatch):
    seen, games = [], I.games
    monkeypatch.setattr(I, "games", lambda *a: seen.append(a) or games(*a))
    if os.path.isdir("/root/testdata/sf0.001"):
        sf = "/root/testdata/sf0.001"
        assert I.elo_preview(spark, sf).count() == games(spark, sf).count()
        assert len(seen) == 1


def test_a_stores_shuffles_are_freed(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, gone, key = files(), time.time() + 20, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    rows = [("u", i // 5, i, i % 7, 7 + i % 5, i % 2, None) for i in range(60)]
    store = BlockStore(spark, f"file://{tmp_path}/s", "u", ["game"])
    assert store.run(spark.createDataFrame(rows, "u string, day int, game long, a long, b long, y int, surface string"), 6) == 2
    while files() - before and time.time() < gone:  # they go in the background
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(key) == kept
