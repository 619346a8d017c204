from math import comb

import pytest

from chronolith.operators import composites as C


def test_fisher_against_exact_counts(spark):
    rows = [(3, 1, 1, 3), (10, 0, 2, 9), (5, 5, 5, 5), (0, 7, 4, 1)]

    def want(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        p = lambda x: comb(r, x) * comb(n - r, k - x) / comb(n, k)
        return sum(p(x) for x in range(max(0, k - n + r), min(r, k) + 1) if p(x) <= p(a) * (1 + 1e-9))

    got = spark.createDataFrame(rows, "a long, b long, c long, d long").select("a", C.fisher_exact("a", "b", "c", "d").alias("p")).collect()
    by = {r.a: r.p for r in got}
    for t in rows:
        assert by[t[0]] == pytest.approx(want(*t))


def test_html_rows(spark):
    page = "<ul><li><a href='/x'>One</a></li><li>Two &amp; <b>more</b></li></ul><p>no</p>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<li>open")], "id long, html string")
    got = [(r.id, r.pos, r.text, r.href) for r in C.html_table(df, "id", "html", "li").orderBy("id", "pos").collect()]
    assert got == [(1, 0, "One", "/x"), (1, 1, "Two & more", None), (3, 0, "open", None)]


def test_identity_merge(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "a", "x"), (4, "b", "x"), (5, "b", "y")], "id long, norm string, ext string")
    assert {r.id: r.canonical for r in C.identity_merge(df, "id", "norm", "ext").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
