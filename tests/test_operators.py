import math
import random

import pytest
from pyspark.sql import functions as F

from chronolith.functions import scalars as S
from chronolith.operators import asof, folds, quality, validation, windows
from chronolith.sources import io


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("bucket", [None, 10])
def test_asof_against_brute_force(spark, inclusive, bucket):
    rnd = random.Random(5)
    left = [(i, rnd.randrange(4), rnd.randrange(60)) for i in range(150)]
    right = [(i, rnd.randrange(4), rnd.randrange(60)) for i in range(90)]
    l_, r_ = spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "rid long, k long, u long")
    got = {r.id: (r.prev_u, r.prev_rid) for r in asof.asof_join(l_, r_, ["k"], "t", "u", ["rid"], inclusive=inclusive, ties=["rid"], bucket=bucket).collect()}
    for i, k, t in left:
        ok = [(u, rid) for rid, kk, u in right if kk == k and (u <= t if inclusive else u < t)]
        assert got[i] == (max(ok) if ok else (None, None))


def test_asof_has_one_window_and_no_join(spark):
    l_ = spark.createDataFrame([(1, 1, 1)], "id long, k long, t long")
    plan = asof.asof_join(l_, l_.withColumnRenamed("t", "u"), ["k"], "t", "u", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_intervals_are_half_open(spark):
    spans = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, None, "b"), (2, 5, 6, "c")], "k long, s long, e long, n string")
    q = spark.createDataFrame([(1, 9), (1, 10), (1, 99), (2, 6), (3, 1)], "k long, t long")
    got = sorted((r.k, r.t, r.n or "") for r in asof.interval_join(q, spans, ["k"], "t", "s", "e").collect())
    assert got == [(1, 9, "a"), (1, 10, "b"), (1, 99, "b"), (2, 6, ""), (3, 1, "")]


def test_form_takes_whole_days(spark):
    rnd = random.Random(1)
    rows = [(k, d, rnd.randrange(2)) for k in range(3) for d in range(12) for _ in range(rnd.randrange(4))]
    got = windows.form_of_last(spark.createDataFrame(rows, "k long, d long, w long"), "k", "d", "w", 5).collect()
    for r in got:
        n = won = 0
        for day in range(r.d - 1, -1, -1):
            if n >= 5:
                break
            own = [w for k, d, w in rows if k == r.k and d == day]
            n, won = n + len(own), won + sum(own)
        assert r.form_n == n and (r.form is None) == (n == 0) and (not n or math.isclose(r.form, won / n))


def _games(spark, n=300):
    rnd = random.Random(9)
    rows = [(u, i // 7, i, f"t{rnd.randrange(6)}", f"t{6 + rnd.randrange(5)}", rnd.randrange(2), rnd.randrange(5)) for u in (0, 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "u int, day int, game long, a string, b string, y int, margin int").repartition(4)


def test_elo_is_the_sequential_loop(spark):
    rows, df = _games(spark)
    got = {(r.u, r.game): (r.ra, r.rb, r.e) for r in folds.fold(df, ["u"], ["game"], ["a", "b", "y"], folds.elo_step(), "ra double, rb double, e double", keep=["game"]).collect()}
    state = {}
    for u, _, g, a, b, y, _ in rows:
        ra, rb = state.get((u, a), 1500.0), state.get((u, b), 1500.0)
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        assert got[u, g] == pytest.approx((ra, rb, e))
        state[u, a], state[u, b] = ra + 32 * (y - e), rb - 32 * (y - e)


def test_block_elo_freezes_a_day(spark):
    rows, df = _games(spark, 60)
    d = df.withColumn("surface", F.when(F.col("margin") > 1, "clay").when(F.col("margin") > 0, "hard"))
    out = folds.elo_block(d.withColumnRenamed("a", "a0").withColumnRenamed("b", "b0"), ["u"], "day", ["game"], "a0", "b0", "y", "surface", ["game", "day"]).collect()
    at = {(r.u, r.game): r for r in out}
    seen = {}
    for u, day, g, a, _, _, _ in rows:
        assert seen.setdefault((u, day, a), at[u, g].elo_a) == at[u, g].elo_a
    assert all(r.elo_a == 1500.0 for r in out if r.day == 0) and any(r.elo_a != 1500.0 for r in out)


@pytest.mark.parametrize("step,inputs", [(folds.trueskill_step(), ["a", "b", "y"]), (folds.kalman_step(), ["a", "b", "y", "day"]), (folds.elo_margin_step(), ["a", "b", "y", "margin"])])
def test_ratings_follow_results(spark, step, inputs):
    rows = [(0, i, i, "good" if i % 3 else "bad", "bad" if i % 3 else "good", int(i % 3 > 0), 2) for i in range(60)]
    df = spark.createDataFrame(rows, "u int, day int, game long, a string, b string, y int, margin int")
    last = folds.fold(df, ["u"], ["game"], inputs, step, "ra double, rb double, p double", keep=["game", "a"]).orderBy(F.desc("game")).first()
    assert (last.ra > last.rb) == (last.a == "good") and (last.p > 0.7) == (last.a == "good")


def test_glicko_reference_values():
    """The published worked example of the method: three games of one player in a period."""
    phi, v, delta = 200 / folds.SCALE, 1.7785, -0.4834
    assert folds._volatility(phi, v, delta, 0.06) == pytest.approx(0.05999, abs=1e-5)


def test_page_hinkley_alarms_and_resets():
    step, s = folds.page_hinkley_step(0.005, 1.0), {}

    class R:
        def __init__(self, x):
            self.x = x

    got = [step(s, R(x))[2] for x in [0.1] * 30 + [2.0] * 3]
    assert sum(got[:30]) == 0 and 1 in got[30:]
    assert step(s, R(float("nan")))[2] == 0


def test_normal_cdf_and_money(spark):
    x = [-3.0, -1.0, 0.0, 0.5, 2.5]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", S.normal_cdf(F.col("x")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(0.5 * (1 + math.erf(r.x / math.sqrt(2))), abs=2e-7)
    m = spark.createDataFrame([("$5K",), ("EUR 20,000",), ("$1.2M",), ("none",)], "t string").select(S.money(F.col("t")).alias("m")).collect()
    assert [r.m for r in m] == [5000.0, 20000.0, 1200000.0, None]


def test_isotonic_is_monotone(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(20) / 20, rnd.randrange(2)) for _ in range(200)]
    out = validation.isotonic(spark.createDataFrame(rows, "p double, y int"), "y", "p").orderBy("p_from").collect()
    assert all(a.value < b.value for a, b in zip(out, out[1:], strict=False)) and sum(r.n for r in out) == 200


def test_point_in_time_features_do_not_leak(spark):
    rows = spark.createDataFrame([(i % 3, i, i % 2) for i in range(60)], "k long, t long, win int")
    build = lambda d: d.select("t", windows.laplace_rate(F.col("win"), windows.prior(["k"], ["t"], 5)).alias("f"))
    leak = lambda d: d.select("t", F.avg("win").over(windows.Window.partitionBy("k")).alias("f"))
    assert quality.same_on_prefix(build, rows, "t", 30, ["t"])
    assert not quality.same_on_prefix(leak, rows, "t", 31, ["t"])


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"date": "2024-01-02T10:00:00", "n": 1}, {"date": "2023-12-30", "n": 2}]')
    got = io.read_results_json(spark, str(tmp_path / "r.json"), "date string, n int", floor="2024-01-01").collect()
    assert [(r.n, r.precision) for r in got] == [(1, "exact")]
    (tmp_path / "k.json").write_text('{"a": {"v": 1}, "b": {"v": null}}')
    assert sorted((r.id, r.v) for r in io.read_keyed_json(spark, str(tmp_path / "k.json"), "struct<v:int>").collect()) == [("a", 1), ("b", None)]
    (tmp_path / "m.csv").write_text("id,name\n1,x\n2,y\n")
    schema = spark.createDataFrame([], "id int, name string").schema
    assert io.read_csv(spark, str(tmp_path / "m.csv"), schema, ["id", "name"]).count() == 2
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path / "m.csv"), schema, ["name", "id"])
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://a</loc></url><url><loc>http://b</loc></url></urlset>")
    assert io.read_xml_rows(spark, str(tmp_path / "s.xml"), "url", "loc string").count() == 2
    df = spark.range(10).withColumn("year", (F.col("id") % 3 + 2000).cast("int"))
    io.write_parquet(df, str(tmp_path / "p"), ["year"])
    assert io.years_between(spark, str(tmp_path / "p"), 2000, 2001).count() == 7
    a, b = io.content_hash(df).first(), io.content_hash(df.repartition(5)).first()
    assert a == b and io.content_hash(df.where("id > 0")).first() != a


def test_upsert_and_append(spark):
    s = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    b = spark.createDataFrame([(2, None, "y"), (3, "c", "z"), (1, "n", "m")], "k int, v string, w string")
    assert sorted(tuple(r) for r in io.upserted(s, b, ["k"], ("w",)).collect()) == [(1, "n", "x"), (2, "b", "y"), (3, "c", "z")]
    assert [r.k for r in io.new_rows(s, b.union(b), ["k"]).collect()] == [3]
