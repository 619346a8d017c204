"""Calibrators, ensemble weights, continued ratings and roster credit against plain versions."""

import math

import numpy as np
import pytest

from chronolith.operators import calibration as C, folds as R, incremental as I


def isotonic(p, y):
    """Values by the min-max formula."""
    out = []
    for i in range(len(p)):
        out.append(max(min(np.mean(y[a : b + 1]) for b in range(i, len(p))) for a in range(i + 1)))
    return out


def test_venn_abers_and_isotonic_against_plain_versions(spark):
    rnd = np.random.default_rng(3)
    g = np.sort(rnd.choice(1001, 25, replace=False))
    y = (rnd.random(25) < g / 1000).astype(float)
    df = spark.createDataFrame([(float(a) / 1000, int(b)) for a, b in zip(g, y, strict=True)] + [(None, 1)], "p double, y int")
    iso = {r.g: r.value for r in C.fit(df, "y", "p", "isotonic").collect()}
    assert np.allclose([iso[int(a)] for a in g], isotonic(g, y))
    va = {r.g: r.value for r in C.fit(df, "y", "p", "venn_abers").collect()}
    for v in (0, 137, int(g[4]), 500, 999):
        both = []
        for label in (0.0, 1.0):
            x, t = list(g) + [v], list(y) + [label]
            keys = sorted(set(x))
            n = [sum(a == k for a in x) for k in keys]
            s = [sum(b for a, b in zip(x, t, strict=True) if a == k) for k in keys]
            both.append(C.pooled(np.array(n, float), np.array(s))[keys.index(v)])
        assert abs(va[v] - both[1] / (1 - both[0] + both[1])) < 1e-9


def test_beta_recovers_a_logistic_curve(spark):
    p = np.linspace(0.02, 0.98, 97)
    q = 1 / (1 + np.exp(-(1.5 * np.log(p) - 0.7 * np.log(1 - p) + 0.3)))
    rows = [(float(a), 1) for a, b in zip(p, q, strict=True) for _ in range(round(1000 * b))] + [(float(a), 0) for a, b in zip(p, q, strict=True) for _ in range(1000 - round(1000 * b))]
    got = C.apply(spark.createDataFrame([(float(a), 0) for a in p], "p double, y int"), "p", C.fit(spark.createDataFrame(rows, "p double, y int"), "y", "p", "beta"), "c").collect()
    assert max(abs(r.c - q[np.argmin(np.abs(p - r.p))]) for r in got) < 0.01


def test_selection_is_on_the_validation_rows(spark):
    rows = [((i % 199 + 0.5) / 200, int((i * 7) % 199 < (i % 199) ** 2 / 199), i % 2 == 0) for i in range(1200)]
    from pyspark.sql import functions as F

    out = C.select(spark.createDataFrame(rows, "p double, y int, v boolean"), "y", "p", F.col("v")).collect()
    best = min(out, key=lambda r: r.log_loss)
    assert [r.method for r in out if r.chosen] == [best.method] and len(out) == len(C.FITTERS)


def test_convex_weights(spark):
    rnd = np.random.default_rng(5)
    z = rnd.normal(size=600)
    y = (rnd.random(600) < 1 / (1 + np.exp(-z))).astype(int)
    m = np.clip(np.stack([1 / (1 + np.exp(-(z + rnd.normal(0, s, 600)))) for s in (0.6, 0.8, 3.0)], 1), 1e-4, 1 - 1e-4)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, m, strict=True)], "y int, a double, b double, c double")
    w = np.array(list(C.convex_weights(df, "y", ["a", "b", "c"]).values()))

    def loss(w):
        q = np.clip(m @ w, 1e-4, 1 - 1e-4)
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)) + 0.002 * ((w - 1 / 3) ** 2).sum()

    grid = [np.array([i, j, 50 - i - j]) / 50 for i in range(51) for j in range(51 - i)]
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and loss(w) <= min(map(loss, grid)) + 1e-9


GAMES = "u int, game long, a long, b long, y int, day int"
ORDER = ["day", "game"]


def seasons():
    rnd = np.random.default_rng(2)
    return [(int(i % 3), i, int(a), int(a + 1 + rnd.integers(0, 4)), int(rnd.integers(0, 2)), i // 10) for i, a in enumerate(rnd.integers(0, 6, 300))]


def test_continued_ratings_equal_the_full_run(spark):
    df = spark.createDataFrame(seasons(), GAMES)
    rate = lambda d: R.fold(d, ["u"], ORDER, ["a", "b", "y"], R.elo_step(), I.SIDES, keep=["a", "b", "y", "day", "game"])
    full = {(r.u, r.game): (r.rating_a, r.rating_b, r.expected) for r in rate(df).collect()}
    states = I.states_after(rate(df.where("day <= 11")), "u", ORDER)
    some = I.seeded_elo(states, df.where("day > 11 AND day <= 20"), "u", ORDER, ["game"])
    again = I.states_after(some, "u", ORDER, before=states)
    last = I.seeded_elo(again, df.where("day > 20"), "u", ORDER, ["game"])
    got = {(r.u, r.game): (r.rating_a, r.rating_b, r.expected) for r in some.union(last).collect()}
    assert len(got) == 180 and all(math.isclose(x, z, rel_tol=0, abs_tol=1e-9) for k, v in got.items() for x, z in zip(v, full[k], strict=True))
    whole = {(r.u, r.entity): r.rating for r in I.states_after(rate(df), "u", ORDER).collect()}
    end = {(r.u, r.entity): r.rating for r in I.states_after(last, "u", ORDER, before=again).collect()}
    assert whole.keys() == end.keys() and all(abs(whole[k] - end[k]) < 1e-9 for k in whole)


def test_a_closed_block_is_not_opened_again(spark):
    df = spark.createDataFrame(seasons(), GAMES)
    states = spark.createDataFrame([(0, 1, 1600.0, 12)], "u int, entity long, rating double, day int")
    with pytest.raises(Exception, match="closed block"):
        I.seeded_elo(states, df.where("day >= 12"), "u", ORDER, ["game"]).collect()
    assert I.seeded_elo(states.where("false"), df, "u", ORDER, ["game"]).count() == 300


def test_checkpoints_tell_changed_inputs(spark):
    rows = seasons()
    one = {(r.u, r.day): (r.games, r.entities, r.input_hash) for r in I.block_checkpoints(spark.createDataFrame(rows, GAMES), "u").collect()}
    rows[55] = (*rows[55][:4], 1 - rows[55][4], rows[55][5])
    two = {(r.u, r.day): (r.games, r.entities, r.input_hash) for r in I.block_checkpoints(spark.createDataFrame(rows[::-1], GAMES), "u").collect()}
    assert [k for k in one if one[k] != two[k]] == [(rows[55][0], rows[55][5])]
