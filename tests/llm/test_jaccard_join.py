import random
import re

import numpy as np
import pytest

from chronolith.llm import jaccard_join as J

DOCS = "doc_id long, text string, node string, n string, a string, component_id string"


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(low[find(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyzé") + rnd.choice("klmn")
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rnd.choice([3, 5, 6, 8, 12, 30, 60, 120]))] for _ in range(25)]
    bases += [passage + [word() for _ in range(k)] for k in (4, 9, 14, 20, 60)]
    rows = []
    for i in range(n):
        w = list(bases[rnd.randrange(len(bases))] if rnd.random() < 0.85 else bases[3])
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            k = rnd.randrange(len(w))
            rnd.choice([lambda: w.__setitem__(k, word()), lambda: w.insert(k, word()), lambda: w.pop(k) if len(w) > 1 else None])()
        if rnd.random() < 0.2:
            w += [word() for _ in range(rnd.randint(1, len(w) // 2 + 1))]
        rows.append((i * 3 + 5, rnd.choice([" ", "  ", "\n"]).join(w).title() if i % 9 == 0 else " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,small,light,block", [(1, 16, None, 1024), (2, 3, None, 1024), (3, 3, 0, 9), (4, 4, 60, 1024), (5, 2, 24, 5), (6, 3, None, 7)])
def test_against_brute_force(spark, monkeypatch, seed, small, light, block):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", block)
    if light is not None:
        monkeypatch.setattr(J, "boundary", lambda sizes: light)
    rows = corpus(seed, 420)
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one"), (0, "One"), (9000, "long text " * 9000), (9001, "long text " * 8000), (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d e f"), (8, "other words are here now")]
    df = spark.createDataFrame([(i, t, "", "", "", "") for i, t in rows], DOCS).repartition(5)
    got = sorted(tuple(r) for r in J.jaccard_components(df).collect())
    assert got == brute(rows)


def test_boundary_follows_cost():
    assert J.boundary([]) == 0
    assert J.boundary([(500, 1000)]) == 0
    assert 8 <= J.boundary([(n, 100) for n in range(3, 60)]) < 60


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []


def test_places_lose_no_link():
    """For any two sets that link, the first shared shingle within both firsts passes the test."""
    rnd = np.random.default_rng(3)
    for _ in range(3000):
        n = rnd.integers(3, 60)
        base = rnd.permutation(200)[:n]
        other = np.unique(np.concatenate([rnd.permutation(base)[: rnd.integers(n * 3 // 4, n + 1)], rnd.integers(0, 200, rnd.integers(0, 8))]))
        s, t = np.sort(base), np.sort(other)
        both = np.intersect1d(s, t)
        if 100 * len(both) >= 75 * (len(s) + len(t) - len(both)):
            for k in (1, 2):
                if len(both) < k:
                    continue
                i, j = int(np.searchsorted(s, both[k - 1])), int(np.searchsorted(t, both[k - 1]))
                assert i < len(s) - J.need(len(s)) + k and j < len(t) - J.need(len(t)) + k
                assert J.possible(len(s), i - k + 1, len(t), j - k + 1)


def test_stage_tells_rows_with_one_id_apart(spark):
    t, u = "one two three four five six seven", "other words stand here in this other text"
    v, w = "again a text of its own with words", "the last of all these texts is this one"
    rows = [(3, t, "a"), (7, t, "b"), (7, u, "c"), (5, v, "d"), (None, v, "e"), (None, w, "f"), (None, w, "f"), (8, "", "g"), (8, "", "g"), (9, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = J.jaccard_stage(spark, df, "")
    assert out.columns == df.columns and sorted(r.source for r in out.collect()) == ["a", "c", "d", "f", "g", "h"]
    assert J.jaccard_stage(spark, df.where("false"), "").collect() == []
