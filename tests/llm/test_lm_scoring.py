import math
import random
import re
from collections import Counter

import pytest

from chronolith.llm import lm_scoring as L, storage

DOCS = "doc_id long, text string, target string, n string"


def toks(text):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0d]+", text or ""):
        w = "".join(c.lower() if c < "\x80" else c for c in w)
        out.append(w[:-1] if w[-1] in ".," and len(w.encode()) > 1 else w)
    return out


def brute(rows, target, size):
    every = Counter(w for _, t in rows for w in toks(t))
    vocab = {w for w, _ in sorted(every.items(), key=lambda x: -x[1])[:size]}

    def name(w):
        if w in vocab:
            return w
        if re.search("[0-9]", w):
            return 0
        if re.search(r"[!-/:-@\[-`{-~]", w):
            return 1
        return 2 if len(w.encode()) > L.LONG else 3

    seqs = [(d, [name(w) for w in toks(t)]) for d, t in rows]
    types = len(vocab) + L.CLASSES + 1
    two = [Counter(), Counter()]
    for d, s in seqs:
        for v, w in zip([None, *s], s, strict=False):
            two[0][v, w] += 1
            two[1][v, w] += d in target
    n = [sum(c.values()) for c in two]
    loss = []
    for k, c in enumerate(two):
        scale = n[1] / n[0] if k == 0 else 1
        ctx, one = Counter(), Counter()
        for (v, w), x in c.items():
            ctx[v] += x * scale
            one[w] += x * scale
        total = sum(one.values())
        loss.append(lambda v, w, c=c, ctx=ctx, one=one, total=total, scale=scale: -math.log((c[v, w] * scale + L.MU * (one[w] + 0.5) / (total + 0.5 * types)) / (ctx[v] + L.MU)))
    out = {}
    for d, s in seqs:
        pairs = list(zip([None, *s], s, strict=False))
        out[d] = [len(s)] + ([sum(loss[k](v, w) for v, w in pairs) / len(s) for k in (1, 0)] if s else [None, None])
    return out


def test_against_brute_force(spark):
    rnd = random.Random(2)
    good, bad = ["the", "cat", "sat", "on", "mat", "a"], ["x1", "###", "éé", "averyveryverylongword", "dog", "ran"]
    rows = []
    for i in range(80):
        pool = good * 4 + bad if i % 2 else bad * 4 + good
        rows.append((i, " ".join(rnd.choice(pool) + rnd.choice(["", "", ".", ","]) for _ in range(rnd.randint(1, 40)))))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "."), (104, "The the " * 4000)]
    target = {i for i in range(80) if i % 2}
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS).repartition(3)
    want = brute(rows, target, 7)
    wanted = spark.createDataFrame([(i,) for i in target for _ in range(2)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in L.cross_entropy_difference(df, wanted, 7).collect()}
    assert got.keys() == want.keys()
    for d, (n, goal, back) in want.items():
        r = got[d]
        assert r.n_tokens == n
        if n:
            assert r.loss_target == pytest.approx(goal, rel=1e-4) and r.loss_background == pytest.approx(back, rel=1e-4)
            assert r.score == pytest.approx(r.loss_target - r.loss_background)
        else:
            assert r.score is None
    mean = lambda odd: sum(got[i].score for i in range(80) if i % 2 == odd) / 40
    assert mean(1) < mean(0)


def test_no_targets_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "", ""), (1, "a b c", "", "")], DOCS)
    none = spark.createDataFrame([], "doc_id long")
    assert [r.score for r in L.cross_entropy_difference(df, none).collect()] == [0.0, 0.0]
    assert L.cross_entropy_difference(df.where("false"), none).collect() == []


@pytest.mark.parametrize("fan", [256, 4])
def test_every_word_counts(spark, monkeypatch, fan):
    """Counts by one level, and by a tree of several."""
    monkeypatch.setattr(L, "RANGE", 1 << 12)
    monkeypatch.setattr(L, "FAN", fan)
    monkeypatch.setattr(L, "CHUNK", 1 << (20 if fan > 4 else 10))
    rnd = random.Random(5)
    pools = [[f"{k}{''.join(rnd.choice('abcdefgh') for _ in range(4))}" for _ in range(2500)] for k in "xy"]
    rows = [(i, " ".join(rnd.choice(pools[i % 2]) for _ in range(rnd.randint(0, 120)))) for i in range(120)]
    rows += [(200, " ".join(pools[0][:40])), (201, " ".join(pools[1][:40])), (202, "The word. " * 500), (203, None)]
    target = {i for i in range(120) if i % 2}
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS).repartition(5)
    types = len({w for _, t in rows for w in toks(t)})
    assert types > 2500
    monkeypatch.setattr(L, "CLASSES", 0)  # brute() adds the classes, which a whole vocabulary hasn't
    want = brute(rows, target, types)
    got = {r.doc_id: r for r in L.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}
    assert got.keys() == want.keys()
    for d, (n, goal, back) in want.items():
        assert got[d].n_tokens == n
        if n:
            assert got[d].loss_target == pytest.approx(goal) and got[d].loss_background == pytest.approx(back)
    assert got[201].score < got[200].score


def test_rows_grow_as_the_text_does(spark, monkeypatch):
    """Eight times the chunks ask eight times the rows at each level, and no node asks more of them."""
    for k, x in (("RANGE", 512), ("FAN", 4), ("CHUNK", 256)):
        monkeypatch.setattr(L, k, x)
    made, stage = [], storage.stage

    def kept(df, name):
        out = stage(df, name)
        if name == "asked":
            made[-1].append(out)
        return out

    monkeypatch.setattr(storage, "stage", kept)
    rnd = random.Random(3)
    line = lambda: "the " + " ".join(f"w{rnd.randrange(4000)}" for _ in range(30))
    for n in (16, 128):
        made.append([])
        rows = [(i, line(), "", "") for i in range(n)]
        L.cross_entropy_difference(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(0,)], "doc_id long")).count()
    total = [sum(x.count() for x in level) for level in made]
    assert 0 < total[1] <= 16 * total[0]  # 8, and higher levels, each half of the one below it
    for level in made:
        for x in level:
            assert x.groupBy("node").count().agg({"count": "max"}).first()[0] <= L.FAN**2


def test_staged_rows_with_large_values_lie_in_small_row_groups(spark, monkeypatch):
    import glob

    import pyarrow.parquet as pq

    made = []
    seen = storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda s, name: made.append((name, seen(s, name))) or made[-1][1])
    monkeypatch.setattr(L, "CHUNK", 40)
    monkeypatch.setattr(L, "RANGE", 40)
    monkeypatch.setattr(L, "FAN", 16)
    docs = spark.createDataFrame([(i, f"a{i % 9} b{i % 5} c{i}", None, None) for i in range(200)], DOCS).coalesce(1)
    out = L.cross_entropy_difference(docs, docs.where("doc_id < 50").select("doc_id"))
    assert out.count() == 200
    for name, most in (("coded", 2), ("asked", 64), ("word-counts", 64)):
        paths = [p for n, p in made if n == name]
        groups = [f.row_group(i).num_rows for p in paths for x in glob.glob(p.removeprefix("file://") + "/*.parquet") for f in [pq.ParquetFile(x).metadata] for i in range(f.num_row_groups)]
        assert groups and max(groups) <= most and sum(groups) > most, name
