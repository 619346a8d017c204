import random
import re
from collections import Counter

import numpy as np

from chronolith.llm import decontamination as D

DOCS = "doc_id long, text string, item_id long, similarity string, part string, at string"
WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(docs, items):
    toks = lambda t: WORD.findall("".join(c.lower() if c < "\x80" else c for c in t or ""))
    bags = [(i, bag(toks(t)), len(toks(t))) for i, t in items]
    df = Counter(s for _, b, _ in bags for s in b)
    out = {}
    for d, t in docs:
        w = toks(t)
        for i, b, n in bags:
            best = 0
            for k in range(max(1, len(w) - n + 1) if w and b else 0):
                x = bag(w[k : k + n])
                every = set(x) | set(b)
                wt = {s: 1 / max(1, df[s]) for s in every}
                best = max(best, sum(wt[s] * min(x[s], b[s]) for s in every) / sum(wt[s] * max(x[s], b[s]) for s in every))
            if best >= D.THRESHOLD:
                out[d, i] = round(best, 9)
    return out


def cases():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 45)))) for i in range(30)]
    items += [(90, items[0][1]), (91, None), (92, " .,"), (93, "Only four Words here"), (94, items[1][1] + " " + items[2][1])]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rnd.randint(0, 80))]
        if d % 3:
            got = items[rnd.randrange(30)][1].split()
            for _ in range(d % 4):
                got[rnd.randrange(len(got))] = word()
            if d % 5 == 0:
                got.insert(rnd.randrange(len(got)), word())
            k = rnd.randint(0, len(body))
            body[k:k] = [w.upper() + "," for w in got]
        docs.append((d, "  ".join(body)))
    docs += [(500, None), (501, ""), (502, "only FOUR words, here"), (503, items[3][1]), (503, items[3][1]), (504, " ".join(items[4][1].split()[:-2]))]
    docs += [(506, "filler then Only four words, here and more filler"), (507, "the words here only")]
    docs.append((505, "filler words go on " * 3000 + items[5][1]))
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, 1, "", "", "") for i, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([d for d in docs if d[0] != 505], items)
    for per_block in (4096, 10):
        rows = D.contamination(df, bench, per_block=per_block).collect()
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows if r.doc_id != 505}
        assert got == want
        assert (505, 5) in {(r.doc_id, r.item_id) for r in rows}
        assert sum(r.doc_id == 503 and r.item_id == 3 for r in rows) == 2


def test_index_is_exact_within_the_radius():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 256, (50, 32), np.uint8)
    flips = np.zeros((400, 256), bool)
    for i in range(400):
        flips[i, rnd.choice(256, i % 120, replace=False)] = True
    probes = base[np.arange(400) % 50] ^ np.packbits(flips, axis=1)
    got = set(zip(*map(np.ndarray.tolist, D.HammingIndex(base).search(probes)), strict=True))
    dist = np.bitwise_count(probes[:, None] ^ base[None]).sum(2)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(dist <= D.RADIUS)), strict=True))


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b", 0, "", "", "")], DOCS)
    assert D.contamination(docs, none).collect() == []
    assert D.contamination(docs.where("false"), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_stage_keeps_the_clean(spark, tmp_path):
    docs, items = cases()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.append((None, items[6][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = D.decontamination_stage(spark, df, str(tmp_path))
    bad = {d for d, _ in brute([d for d in docs if d[0] != 505], items)} | {505}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in bad)
    assert kept.columns == df.columns


def test_short_items_inside_documents(spark):
    items = [(1, "answer key hidden"), (2, "two words"), (3, "one"), (4, "A b c d"), (5, "answer key hidden")]
    docs = [(1, "the Answer: key, hidden below"), (2, "these two words are ordinary"), (3, "two words"), (4, "answer key"), (5, "x a b c d a b c d"), (6, "hidden answer key"), (7, "answer key"), (8, "hidden")]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity, r.at) for r in got) == [(1, 1, 1.0, 1), (1, 5, 1.0, 1), (2, 2, 1.0, 1), (3, 2, 1.0, 0), (5, 4, 1.0, 1)]


def test_stage_drops_no_clean_row_for_its_id(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, "clean text", "a"), (1, item, "b"), (None, "clean too", "c"), (None, item, "d"), (2, item + " x", "e"), (2, item, None)]
    kept = D.decontamination_stage(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), str(tmp_path))
    assert sorted(r.source for r in kept.collect()) == ["a", "c"]


def test_repeated_items_and_templates_with_one_word_changed(spark):
    rnd = random.Random(8)
    text = lambda n: ["".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(n)]
    often, twice, frame = text(104), text(50), text(60)
    items = [(i, " ".join(often)) for i in range(10)] + [(20 + i, " ".join(twice)) for i in range(2)] + [(30 + i, " ".join(frame + text(40))) for i in range(10)]
    docs = []
    for d, (_, t) in enumerate([items[0], items[10], items[12]]):
        w = t.split()
        w[len(w) // 2] = "changed"
        docs.append((d, " ".join(text(30) + w + text(30))))
    docs += [(3, " ".join(text(20) + frame + text(20))), (4, " ".join(text(200)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(0, i) for i in range(10)} | {(1, 20), (1, 21), (2, 30)}
    for per_block in (4096, 5):
        got = D.contamination(df, bench, per_block=per_block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert {r.at for r in got} == {30}


def test_weights_keep_within_the_radius():
    """With square roots of the weights, bags at the threshold are near each other however unlike their weights are."""
    rnd = np.random.default_rng(3)
    far = []
    for _ in range(60):
        n = int(rnd.integers(20, 120))
        h = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        w = 1.0 / rnd.choice([1, 2, 10, 200], n)
        order, total = rnd.permutation(n), w.sum()
        out = order[np.cumsum(w[order]) < total / 7]  # each bag lacks some of the other's: 5 / 7 in common, then 3 / 4
        side = rnd.random(len(out)) < 0.5
        a, b = np.ones(n, bool), np.ones(n, bool)
        a[out[side]], b[out[~side]] = False, False
        if w[a & b].sum() / total >= 0.75:
            far.append(np.bitwise_count(D.simhash(h[a], np.sqrt(w[a])) ^ D.simhash(h[b], np.sqrt(w[b]))).sum())
    assert len(far) > 40 and max(far) <= D.RADIUS


def test_a_long_text_of_a_shared_template_takes_little_memory():
    import time
    import tracemalloc

    import pyarrow as pa

    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    frame = text(12)
    items = D.Items(list(range(2000)), [f"{frame} {text(30)}" for _ in range(2000)])
    doc = pa.array([" ".join(f"{frame} {text(3)}" for _ in range(10_000))])  # 1 MB
    _, _, wb, sh, sb = next(D.word_shingles(doc))
    tracemalloc.start()
    t = time.time()
    assert items.search(sh, items.hits(sh), int(wb[1])) == {}
    assert tracemalloc.get_traced_memory()[1] < 200e6 and time.time() - t < 60
    tracemalloc.stop()
