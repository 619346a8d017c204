import re
from collections import Counter

from hypothesis import given, settings, strategies as st
import pyarrow as pa

from chronolith.llm import host_rules as H

DOCS = "doc_id long, text string, source string, n_words string, host_rate string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    lines = Counter(x for x in t.split("\n") if WORD.search(x))
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    cover = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(v - 1 for v in lines.values()), len(cover)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #é日\n\t ", max_size=40)), min_size=1, max_size=12))
@settings(max_examples=300, deadline=None)
def test_counts(texts):
    got = H.text_counts(pa.array(texts, pa.string()))
    assert [[int(got[k][i]) for k in H.COUNTS] for i in range(len(texts))] == [plain(t) for t in texts]


def test_long_text():
    t = "a b c d\n" * 300_000
    got = H.text_counts(pa.array([t, None, "x " * 10]))
    assert [int(got[k][0]) for k in H.COUNTS] == [1_200_000, 1_200_000, 0, 299_999, 1_200_000]


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "same words again " * 30
    rows = [(i, good if i % 10 else bad, "fine", "", "", "") for i in range(100)]
    rows += [(200 + i, bad if i % 8 else good, "spam", "", "", "") for i in range(80)]
    rows += [(400, bad, "tiny", "", "", ""), (401, good, None, "", "", ""), (402, None, None, "", "", ""), (401, good, None, "", "", "")]
    out = H.host_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    for r in out:
        host_bad = r.source in ("spam", "tiny") and r.host_failed
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not host_bad)
    assert all(r.host_failed for r in out if r.source == "spam") and not any(r.host_failed for r in out if r.source == "fine")
    assert {r.host_n for r in out if r.source is None} == {3}
    assert H.host_rules(spark.createDataFrame([], DOCS)).collect() == []
