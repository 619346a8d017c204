import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronolith.llm import divergence as V

DOCS = "doc_id long, text string, lang string, source string, term string, n int, value double"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=3, top=200):
    seen, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        seen[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in {g[0] for g in count}:
        kept = {t for t, n in seen[lang].items() if n >= least}
        groups = {s: {t: n for t, n in c.items() if t in kept} for (la, s), c in count.items() if la == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)
        share = lambda c, t: 1 + 10**9 * (c.get(t, 0) + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        for s, c in groups.items():
            pairs = [(-sum((share(c, t) - share(d, t)) ** 2 // share(d, t) for t in kept), o.encode(), o) for o, d in groups.items() if o != s]
            terms = [(-((share(c, t) - share(whole, t)) ** 2 // share(whole, t)), t.encode(), t) for t in c if share(c, t) > share(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, x[2], -x[0], i + 1) for i, x in enumerate(sorted(found)[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def random_rows(seed, n, sources):
    r = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(65 + i // 26)}" for i in range(120)]
    pick = lambda: words[min(119, int(r.exponential(15)))]
    return [(i, " ".join(pick() for _ in range(r.integers(0, 40))) + "\x00-9_", ["en", "de", None][i % 7 % 3], None if i % 11 == 0 else f"s{r.integers(sources)}", "", 0, 0.0) for i in range(n)]


@pytest.mark.parametrize(("part", "block", "cells", "chunk"), [(20_000, 256, 1 << 19, 4 << 20), (7, 3, 16, 200)])
def test_against_brute_force(spark, monkeypatch, part, block, cells, chunk):
    for k, x in (("PART", part), ("BLOCK", block), ("CELLS", cells), ("CHUNK_BYTES", chunk)):
        monkeypatch.setattr(V, k, x)
    rows = random_rows(1, 300, 8)
    rows += rows[:40]  # repeated rows count
    got = rows_of(V.divergence(spark.createDataFrame(rows, DOCS)))
    assert got == brute([(r[1], r[2], r[3]) for r in rows])
    assert {x[2] for x in got} == {"pair", "term"}


def test_ranks_are_cut_at_the_top(spark):
    rows = random_rows(2, 200, 3)
    got = rows_of(V.divergence(spark.createDataFrame(rows, DOCS), top=4))
    assert got == brute([(r[1], r[2], r[3]) for r in rows], top=4)


def test_shares_are_exact():
    n = np.array([0, 1, 999, 10**9, 2 * 10**13, 2 * 10**14])
    for total in (1, 7, 10**9 + 7, 28 * 10**13):
        some = n[n < total]  # a count is never above its total
        assert V.share(some, np.int64(total)).tolist() == [1 + 10**9 * (int(x) + 1) // total for x in some]


def test_edges(spark):
    rows = [(1, None, None, None, "", 0, 0.0), (2, "", "en", "b", "", 0, 0.0), (2, "", "en", "b", "", 0, 0.0), (3, "123 ...", "en", "a", "", 0, 0.0)]
    df = spark.createDataFrame(rows, DOCS)
    assert rows_of(V.divergence(df)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    long = [(i, "x" * 300_000 + " Word word 一", "en", f"s{i % 2}", "", 0, 0.0) for i in range(4)]
    got = rows_of(V.divergence(df.union(spark.createDataFrame(long, DOCS))))
    assert got == brute([(r[1], r[2], r[3]) for r in rows + long]) and any(len(x[3]) == 300_000 for x in got)
    assert V.divergence(df.where("false")).collect() == []
