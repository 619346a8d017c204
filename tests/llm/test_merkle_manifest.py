import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from chronolith.llm import merkle_manifest as M, storage

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, n int, tree int, bucket string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """The root, and for each node its siblings before and after, level by level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        new, below = [], []
        for lo in range(0, len(nodes), 3):
            run = nodes[lo : lo + 3]
            for j in range(len(run)):
                for i in under[lo + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            new.append(h(*run))
            below.append([i for u in under[lo : lo + 3] for i in u])
        nodes, under = new, below
    return nodes[0], paths


def brute(rows):
    trees = defaultdict(list)
    for d, s, la, n, t in rows:
        change = d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and t is not None
        leaf, bad = (h(*map(field, (d, s, la, n, x))) for x in (t, t.replace("\n", "") if change else t))
        trees[s].append((d is not None, d or 0, leaf, bad))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        trees[s].sort()
        made[s] = climb([x[2] for x in trees[s]])
    root, top = climb([made[s][0] for s in names]) if names else ("", [])
    out = []
    for s, above in zip(names, top, strict=True):
        for (there, d, leaf, bad), own in zip(trees[s], made[s][1], strict=True):
            x = bad
            for a, b in own + above:
                x = h(a, x, b)
            out.append((d if there else None, leaf, made[s][0], root, h(*(y for p in own + above for y in p)), x, x == root))
    return sorted(out, key=str)


def made(df):
    return sorted((tuple(r) for r in M.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "", 1, 2, "x") for r in rows], DOCS)


def sized(sizes, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for s, n in sizes.items():
        ids = r.choice(10**6, n, replace=False) * 2_000_003 - 10**12
        rows += [(int(i), s, "en" if i % 3 else None, int(i % 9) or None, f"line {i}\nnext\n" if i % 4 else None) for i in ids]
    return [rows[i] for i in r.permutation(len(rows))]


def test_sizes_around_runs_and_blocks(spark):
    rows = sized({None: 4, "": 1, "a": 2, "b": 3, "ä": 10, "B": 243, "c": 244, "d": 731})
    got = made(table(spark, rows))
    assert got == brute(rows)
    assert {x[-1] for x in got} == {True, False}
    for x in got:
        if not x[-1]:
            assert x[0] is not None and zlib.crc32(str(x[0]).encode()) % 2 == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_many_levels_of_digits(spark, monkeypatch, seed):
    """Ranks with buckets of a few rows and narrow digits are those of a sort, whatever the ids are."""
    monkeypatch.setattr(M, "DIGIT", 3)
    r = np.random.default_rng(seed)
    ids = [*range(60), *(int(x) for x in r.integers(-(1 << 63), (1 << 63) - 1, 80)), (1 << 63) - 1, -(1 << 63), None, None, *[5] * 30, *[77] * 40]
    rows = [(d, "s" if i % 3 else None, "en", i % 7, "same\ntext" if d in (5, None) else f"t{i % 9}") for i, d in enumerate(ids)]
    leaves = storage.stage(M.leaves(table(spark, rows)), "t")
    got = defaultdict(list)
    for x in M.ranked(leaves, 4).collect():
        got[x.tree].append((x.idx, x.doc_id, x.leaf))
    for tree, of in got.items():
        of.sort()
        assert [x[0] for x in of] == list(range(len(of)))
        keys = [(d is not None, d or 0, leaf) for _, d, leaf in of]
        assert keys == sorted(keys) and len(of) == sum((r[1] is None) == (tree == "") for r in rows)
    monkeypatch.setattr(M, "LIMIT", 4)
    monkeypatch.setattr(M, "SMALL", 0 if seed == 1 else 1000)  # facts that are met in parts, and sent to all tasks
    assert made(table(spark, rows)) == brute(rows)


def test_many_trees(spark):
    rows = sized({f"s{i}": 1 + i % 3 for i in range(300)}, 3)
    assert made(table(spark, rows)) == brute(rows)


def test_edges(spark):
    rows = [(7, None, None, None, None), (None, "s", "en", 3, "a\nb"), (2, "s", "", 0, ""), (2, "s", "", 0, ""), (2, "s", "en", 5, "x\n" * 200_000)]
    assert made(table(spark, rows)) == brute(rows)
    assert made(table(spark, rows[:1])) == brute(rows[:1])
    assert made(table(spark, rows).where("false")) == []
