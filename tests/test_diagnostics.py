import math
import random
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolith.operators import composites, diagnostics as D, significance as S, windowed_models as M


def plain_ranks(x):
    order = sorted(x)
    return [(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in x]


def test_mid_ranks_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGES", 5)
    r = np.random.default_rng(1)
    for values in ([1.0], [2.0, 2.0], r.integers(0, 30, 400).astype(float).tolist(), r.normal(size=300).tolist()):
        df = spark.createDataFrame([(v, 1) for v in values], "x double, w int")
        got = {x.x: (x["rank"], x.w) for x in S.mid_ranks(df, "x", ["w"]).collect()}
        want = plain_ranks(values)
        assert all(got[v] == (rank, values.count(v)) for v, rank in zip(values, want, strict=True))


def test_wilcoxon_exact_and_with_ties(spark):
    def test(values):
        return S.wilcoxon(spark.createDataFrame([(v,) for v in values], "d double"), F.col("d")).first()

    for values in ([0.3, -0.1, 0.7, 1.1, -0.2, 0.9], [5.0], [-1.0, 2.0, -3.0]):
        ranks = plain_ranks([abs(v) for v in values])
        w = min(sum(r for r, v in zip(ranks, values, strict=True) if v > 0), sum(r for r, v in zip(ranks, values, strict=True) if v < 0))
        seen = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in product((0, 1), repeat=len(values))]
        assert test(values).p == pytest.approx(min(1.0, 2 * sum(s <= w for s in seen) / len(seen)))
    values = [1.0, 1.0, -1.0, 2.0, 2.0, 0.0, None, float("nan"), 3.0, -2.0]
    got, some = test(values), [1.0, 1.0, -1.0, 2.0, 2.0, 3.0, -2.0]
    ranks = plain_ranks([abs(v) for v in some])
    down = sum(r for r, v in zip(ranks, some, strict=True) if v < 0)
    spread = math.sqrt(7 * 8 * 15 / 24 - (27 - 3 + 27 - 3) / 48)
    assert (got.n, got.zeros, got.w_minus) == (7, 1, down) and got.z == pytest.approx((down - 14) / spread)
    assert got.p == pytest.approx(math.erfc(abs(got.z) / math.sqrt(2)))
    assert test([0.0, None]).p == 1.0 and test([]).n == 0


def test_tails():
    for n in (1, 2, 9, 40):
        for k in range(-1, n + 2):
            want = sum(math.comb(n, i) for i in range(min(n, k) + 1)) / 2**n if k >= 0 else 0
            assert S.binomial_tail(n, k) == pytest.approx(want, abs=1e-12)
    assert S.binomial_tail(10**9, 5 * 10**8) == pytest.approx(0.5, abs=1e-4)  # at once
    assert S.binomial_tail(10**9, 4 * 10**8) == 0.0


def test_fisher_against_all_tables():
    def brute(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        p = {x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r) for x in range(max(0, k - (n - r)), min(r, k) + 1)}
        return min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-9)))

    rnd = random.Random(3)
    for _ in range(400):
        t = [rnd.randint(0, 12) for _ in range(4)]
        got = composites.fisher_exact.func(*(pd.Series([x]) for x in t))[0]
        assert got == pytest.approx(brute(*t), abs=1e-9), t


def test_inflation_and_importance(spark):
    r = np.random.default_rng(2)
    n = 3000
    a, b = r.normal(size=n), r.normal(size=n)
    twin, noise = a + 0.05 * r.normal(size=n), r.normal(size=n)
    y = (a + 0.5 * b + r.logistic(size=n) > 0).astype(int)
    rows = [(i, *map(float, v), int(t)) for i, (*v, t) in enumerate(zip(a, b, twin, noise, y, strict=True))]
    df = spark.createDataFrame(rows, "key long, a double, b double, twin double, noise double, y int").cache()
    got = {x.feature: x.vif for x in D.vif(df.withColumn("flat", F.lit(1.0)), ["a", "b", "twin", "flat"]).collect()}
    m = np.linalg.inv(np.corrcoef(np.stack([a, b, twin])))
    assert got["a"] == pytest.approx(m[0, 0], rel=1e-3) and got["twin"] > 100 and got["b"] < 1.1 and got["flat"] == 1.0
    train, held = df.where("key < 2000"), df.where("key >= 2000")
    imp = {x.feature: x for x in D.permutation_importance(train, held, "key", "y", ["a", "b", "noise"]).collect()}
    assert imp["a"].loss_added > imp["b"].loss_added > 0.01 > abs(imp["noise"].loss_added)
    assert [imp[c]["rank"] for c in ("a", "b")] == [1, 2]
    ranks = {x.feature: x["rank"] for x in D.eliminate(train, "y", ["noise", "a", "b"], 1).collect()}
    assert ranks == {"a": 1, "b": 2, "noise": 3}
    df.unpersist()


def test_permuted_keeps_every_value(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 50)
    df = spark.range(777).withColumn("x", F.col("id") * 2)
    out = D.permuted(df, "id", ["x"], 1, 777).collect()
    assert sorted(r["__perm_x"] for r in out) == [2 * i for i in range(777)] and sum(r["__perm_x"] == r.x for r in out) < 60


def test_gate_reads_history_alone(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(2400):
        good, bad, core = r.normal(size=3)
        rows.append((i // 200, float(core), float(good), float(bad), int(core + 2 * good + r.logistic() > 0)))
    d = spark.createDataFrame(rows, "period int, core double, good double, bad double, y int")
    chosen, told = D.fold_features(d, "period", "y", ["core"], {"good": ["good"], "bad": ["bad"]}, {"good": "good", "bad": "bad"}, held=4)
    assert chosen == ["core", "good"] and dict((f, w) for f, _, w in told) == {"good": "selected", "bad": "no_gain_alone"}
    assert D.fold_features(d.where("period < 3"), "period", "y", ["core"], {"good": ["good"]}, {"good": "good"})[1][0][2] == "insufficient_periods"
    blind = d.withColumn("good", F.when(F.col("period") < 8, F.col("good")))
    assert D.fold_features(blind, "period", "y", ["core"], {"good": ["good"]}, {"good": "good"}, held=4)[1] == [("good", None, "too_few_available")]


def newton(points, ridge, steps):
    a = b = 0.0
    for _ in range(steps):
        ga = gb = aa = ab = bb = 0.0
        for x, n, s in points:
            q = 1 / (1 + math.exp(-(a + b * x)))
            g, h = n * q - s, n * q * (1 - q)
            ga, gb, aa, ab, bb = ga + g, gb + g * x, aa + h, ab + h * x, bb + h * x * x
        aa, bb, gb = aa + 1e-9, bb + ridge, gb + ridge * b
        det = aa * bb - ab * ab
        a, b = a - (bb * ga - ab * gb) / det, b - (aa * gb - ab * ga) / det
    return a, b


def test_daily_fits_know_only_what_was_known(spark):
    r = np.random.default_rng(5)
    rows = [(int(d), int(d + r.integers(0, 9)), int(r.integers(-3, 4)), int(r.random() < 0.4)) for d in r.integers(0, 60, 500)]
    rows += [(3, None, 1, 1), (None, 3, 1, 1), (5, 4, None, 0)]
    df = spark.createDataFrame(rows, "played int, known int, x int, y int")
    out = {x.day: x for x in M.daily_fits(df, "played", "known", "x", "y", 20, 30).collect()}
    for day, got in out.items():
        seen = [(x, y) for p, k, x, y in rows if None not in (p, k, x) and max(p, k) < day and p >= day - 20]
        assert got.n == len(seen) and got.ready == (len(seen) >= 30)
        points = [(x, sum(u == x for u, _ in seen), sum(y for u, y in seen if u == x)) for x in sorted({u for u, _ in seen})]
        if 0 < sum(y for _, y in seen) < len(seen):
            assert (got.a, got.b) == pytest.approx(newton(points, 1.0, M.STEPS), abs=1e-8)
        else:
            assert got.a is None
    assert len(out) > 60


def test_context_falls_back_to_parents(spark):
    r = np.random.default_rng(6)
    rows = [(f"s{i % 3}", "lan" if i % 10 else "online", int(p), float(r.integers(-2, 3)), int(r.random() < 0.7)) for i, p in enumerate(np.sort(r.integers(0, 12, 600)))]
    df = spark.createDataFrame(rows, "stage string, env string, period int, x double, y int")
    out = M.context_calibrated(df, [["stage", "env"], ["stage"], []], "period", "x", "y", [40, 60, 30]).collect()
    assert len(out) == len(rows) and {x.level for x in out} == {0, 1, 2, 3}
    for x in out[::29]:
        before = [t for t in rows if t[2] < x.period]
        groups = [[t for t in before if t[:2] == (x.stage, x.env)], [t for t in before if t[0] == x.stage], before]
        level = next((i for i, (g, least) in enumerate(zip(groups, (40, 60, 30), strict=True)) if len(g) >= least and 0 < sum(t[4] for t in g) < len(g)), 3)
        assert x.level == level
        if level == 3:
            assert x.calibrated is None
        else:
            g = groups[level]
            a, b = newton([(v, sum(t[3] == v for t in g), sum(t[4] for t in g if t[3] == v)) for v in sorted({t[3] for t in g})], 1.0, M.STEPS)
            assert x.calibrated == pytest.approx(1 / (1 + math.exp(-(a + b * x.x))), abs=1e-8)
