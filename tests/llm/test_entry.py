import os

import pytest

from chronolith.llm import entry

from ..compare import same, tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    same(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in entry.queries()) == list(range(1, 1 + len(entry.queries())))


def test_pipeline(spark):
    """Each stage's decision, checked on its own input; the last one's totals."""
    import corpus_pipeline as P
    from chronolith.llm import jaccard_join, language_id, storage

    from .test_decontamination import WORD, bag, brute
    from .test_jaccard_join import brute as groups

    docs = storage.read(spark, SF, "documents")
    steps = dict(P.STAGES)
    one = storage.stage(steps["language_id"](spark, docs, SF), "t")
    assert one.columns == docs.columns and one.count() == docs.count()
    assert language_id.MIN_SCORE < 0.2 and jaccard_join.K == 5
    rows = [(r.doc_id, r.text) for r in one.select("doc_id", "text").collect()]
    two = storage.stage(steps["jaccard_join"](spark, one, SF), "t")
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, _, c in groups(rows)})
    kept = [(r.doc_id, r.text) for r in two.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in storage.read(spark, SF, "benchmark").collect()]
    three = storage.stage(steps["decontamination"](spark, two, SF), "t")
    words = {x for _, t in items for x in bag(WORD.findall((t or "").lower()))}
    some = [(d, t) for d, t in kept if words & set(bag(WORD.findall((t or "").lower())))]  # others share no shingle with any
    bad = {d for d, _ in brute(some, items)}
    assert bad and sorted(r.doc_id for r in three.collect()) == sorted(d for d, _ in kept if d not in bad)
    four = storage.stage(steps["mixing"](spark, three, SF), "t")
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    last = steps["token_files"](spark, four, SF).orderBy("start").collect()
    assert len(last) == four.count() and last[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:], strict=False))
    assert len(P.STAGES) == 5 and P.run(spark, SF).count() == len(last)
