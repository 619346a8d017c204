import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.llm import quality_classifier as Q, storage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, quality string"


def auc(score, y):
    r = score.rank().to_numpy()
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def unpacked(rows):
    return [Q._unpacked(pa.array([bytes(r[k]) for r in rows]), n).astype(float) for k, n in (("text", Q.TEXT), ("meta", Q.META))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_rounds_keep_held_out_accuracy(spark, monkeypatch, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    made, train = [], Q.co_train
    monkeypatch.setattr(Q, "co_train", lambda *a: made.append(train(*a)) or made[-1])
    found = []
    for rounds in (0, Q.ROUNDS):
        out = Q.quality(docs, labels.where(~other), rounds).join(labels.where(other), "doc_id").toPandas()
        y = out["quality"].to_numpy()
        found.append(auc(out["score"], y))
        assert len(out) > 90 and (out["kept"].to_numpy() == y).mean() >= max(0.95, y.mean(), 1 - y.mean())
    assert found[0] > 0.99 and found[1] >= found[0] - 0.005, found
    views = made[1]
    assert len(views.rounds) and all(x["lessons"] <= Q.SHARE * x["of"] + 1e-6 for x in views.log)
    x = unpacked(Q.featurize(docs).collect())
    for w, _ in views.rounds:
        for k in (0, 1):
            assert (np.abs(Q.logit(x[k], w[k])) >= Q.BOUND).mean() < 0.01
    # metadata tell most documents no better than guessing does: of the large class they teach nothing
    taught = {(v["view"], v["label"]) for v in views.log if v["lessons"]}
    assert {(0, 0), (0, 1)} <= taught and (1, 1) not in taught


def test_fit_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] - 2 * x[:, 1] + 0.3 > 0).astype(float)
    assert ((Q.logit(x, Q.fit(x, y)) > 0) == y).mean() > 0.97


def synthetic(spark, n, labelled, seed=0):
    """Documents whose words and whose source both tell their quality, most of the time."""
    r = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        good = bool(r.random() < 0.6)
        words = [f"{'good' if (r.random() < 0.75) == good else 'bad'}{r.integers(12)}" for _ in range(r.integers(3, 9))]
        source = f"{'fine' if (r.random() < 0.85) == good else 'poor'}{r.integers(6)}"
        rows.append((i, " ".join(words), "en", source, None, "", "", ""))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:labelled], "doc_id long, quality int"), dict(labels)


def test_rounds_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "SUMS", 1)
    docs, labels, _ = synthetic(spark, 1500, 500)
    docs = docs.union(docs.where("doc_id % 7 = 0"))  # copies are one lesson
    feats = storage.stage(Q.featurize(docs.repartition(5)), "t")
    sample = storage.stage(Q.labelled_sample(labels, 400), "t")
    views = Q.co_train(feats, sample)
    assert len(views.rounds) == Q.ROUNDS
    folds = {r.doc_id: r for r in sample.collect()}
    rows = feats.withColumn("h", F.shiftrightunsigned(F.xxhash64("text", "meta"), 32)).collect()
    own = {r.doc_id: r for r in rows if r.doc_id in folds and folds[r.doc_id].fold != 0}
    y = np.array([folds[d].quality for d in own], float)
    x = unpacked(list(own.values()))
    pool = list({(bytes(r.text), bytes(r.meta)): r for r in rows if r.doc_id not in folds}.values())
    assert len(pool) < sum(r.doc_id not in folds for r in rows)
    px, h = unpacked(pool), np.array([r.h for r in pool])
    given = [{}, {}]
    ends = [w for w, _ in views.rounds[1:]]
    for turn, (w, cuts) in enumerate(views.rounds):
        for k in (0, 1):
            z = np.floor((np.clip(px[k] @ w[k][:-1] + w[k][-1], -30, 30) + 30) * Q.FINE)
            free = [i for i in range(len(pool)) if i not in given[k]]
            for label in (0, 1):
                edge, part = cuts[k][label]
                beyond = [i for i in free if (z[i] > edge if label else z[i] < edge)]
                at = [i for i in free if z[i] == edge]
                took = beyond + [i for i in at if h[i] < part]
                share = Q.SHARE * (y.mean() if label else 1 - y.mean()) * len(free)
                told = next(v for v in views.log if (v["round"], v["view"], v["label"]) == (turn, k, label))
                assert told["of"] == len(free) and 0 < told["lessons"] <= share + 1e-6
                assert len(beyond) <= told["lessons"] + 1e-6 <= len(beyond) + len(at) + 1e-5
                assert all((z[i] >= 30 * Q.FINE) == bool(label) for i in took)
                given[k] |= {i: label for i in took}
        # the fit that follows has no slope left
        for k in (0, 1) if turn < len(ends) else ():
            lessons = given[1 - k]
            n = [sum(v["lessons"] for v in views.log if v["round"] <= turn and v["view"] == 1 - k and v["label"] == c) for c in (0, 1)]
            rx, t = np.vstack([x[k], *(px[k][i] for i in lessons)]), np.append(y, list(lessons.values()))
            c = np.append(np.ones(len(y)), [Q.WEIGHT * len(y) * (1 - y.mean(), y.mean())[v] / max(1, n[v]) for v in lessons.values()])
            a, v = np.hstack([rx, np.ones((len(rx), 1))]), ends[turn][k]
            p = 1 / (1 + np.exp(-a @ v))
            ridge = np.append(np.full(a.shape[1] - 1, Q.RIDGE), 1e-6)
            g, hess = a.T @ (c * (p - t)) + ridge * v, (a * (c * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
            assert g @ np.linalg.solve(hess, g) < 1e-3 * -(c @ (t * np.log(p) + (1 - t) * np.log(1 - p)))
    # labels of all rounds are those of the rounds before, and new ones
    seen = np.full(len(pool), -1)
    for n in range(1, Q.ROUNDS + 1):
        part = Q.Views.__new__(Q.Views)
        part.rounds = views.rounds[:n]
        now = part.labels([v.astype(np.float32) for v in px], h)[0]
        assert (now[seen >= 0] == seen[seen >= 0]).all() and (now >= 0).sum() > (seen >= 0).sum()
        seen = now
    assert views.losses[0] >= views.best[0] == min(views.losses)


def test_lessons_help_where_labels_are_few(spark):
    docs, labels, truth = synthetic(spark, 6000, 300, 4)
    found = []
    for rounds in (0, Q.ROUNDS):
        out = Q.quality(docs, labels, rounds).where("doc_id >= 300").toPandas()
        found.append(auc(out["score"], out["doc_id"].map(truth).to_numpy()))
    assert found[1] > found[0] - 0.005 and found[0] > 0.85, found


def test_descent_from_a_far_start():
    """Undamped steps diverge from here; the damped ones end at the optimum."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2)) * 3
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    d = Q.Descent(np.array([-9.0, 8.0, 20.0]))
    losses = []
    for _ in range(60):
        d.observe(Q.newton_sums(x, y, np.ones(300), d.trial))
        losses.append(d.loss)
        if d.done:
            break
    assert d.done and np.allclose(d.w, Q.fit(x, y), atol=0.02) and all(a >= b for a, b in zip(losses, losses[1:], strict=False))


def test_what_a_view_knows():
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.8).astype(float)
    assert Q.known(rng.normal(size=400) + 2, y) == set()
    assert Q.known(np.where(y == 1, 3.0, -3.0), y) == {0, 1}
    assert Q.known(np.ones(5), np.ones(5)) == Q.known(np.empty(0), np.empty(0)) == set()


def test_edges(spark):
    rows = [(i, ("good plain words here " if i % 2 else "### $$$ *** ") * (1 + i % 7), "en", None if i % 5 else "s", None, "", "", "") for i in range(60)]
    rows += [(900, None, None, None, None, "", "", ""), (901, "", None, "s", 0, "", "", ""), (902, "x" * 50000, "de", "s", 1, "", "", ""), (902, "x" * 50000, "de", "s", 1, "", "", ""), (None, "a", "", "", 1, "", "", "")]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (3, None), (41, 2)], "doc_id long, quality int")
    out = Q.quality(df, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[41] > by[42] and sum(r.doc_id == 902 for r in out) == 2
    assert {(r.score, r.kept) for r in Q.quality(df, labels.where("quality = 1")).collect()} == {(0.5, True)}
    assert Q.quality(df.where("false"), labels).collect() == []
