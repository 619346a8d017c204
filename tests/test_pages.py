from datetime import date

import pytest

from chronolith.operators import pages as P

COLUMNS = [P.Column("Rank", "rank", "int"), P.Column("Name", "name", "text"), P.Column("Elo", "elo", "float", False), P.Column("Day", "day", "date")]
HEAD = "<tr><th>Rank</th><th>Name</th><th>Elo</th><th>Day</th></tr>"
LINE = "<tr><td>1</td><td><a href='/x'>Ann  &amp; Co</a></td><td>1500.5</td><td>2024-02-29</td></tr>"


def page(*rows, name="t"):
    return f"<html><table class='other'><tr><td>x</td></tr></table><table class='a {name}'>{''.join(rows)}</table></html>"


def test_a_table_in_its_layout():
    assert P.typed_rows(page(HEAD, LINE, LINE.replace("1500.5", "")), "t", COLUMNS) == [(1, "Ann & Co", 1500.5, date(2024, 2, 29)), (1, "Ann & Co", None, date(2024, 2, 29))]
    assert P.typed_rows(page(HEAD), "t", COLUMNS) == []


@pytest.mark.parametrize(
    ("html", "reason"),
    [
        (None, "empty_page"), ("", "empty_page"), ("<p>no table</p>", "table_missing"), (page(HEAD, name="u"), "table_missing"), (page(HEAD) + page(HEAD), "table_doubled"),
        (page(LINE), "header_changed"), (page(HEAD.replace("Elo", "Rating"), LINE), "header_changed"), (page(HEAD.replace("<th>Elo</th>", ""), LINE), "header_changed"),
        (page(HEAD, LINE.replace("<td>1500.5</td>", "")), "width_changed_in_row_1"), (page(HEAD, LINE, LINE.replace("1500.5", "1,500")), "elo_invalid_in_row_2"),
        (page(HEAD, LINE.replace("2024-02-29", "2023-02-29")), "day_invalid_in_row_1"), (page(HEAD, LINE.replace(">1<", "><")), "rank_missing_in_row_1"),
        (page(HEAD, "<tr><td><table></table></td></tr>"), "table_in_table"), (page(HEAD, LINE).replace("</table></html>", ""), "table_open"),
    ],
)
def test_altered_tables_are_rejected(html, reason):
    with pytest.raises(P.Rejected) as e:
        P.typed_rows(html, "t", COLUMNS)
    assert str(e.value) == reason


GROUP = "<tr class='head flags'><td>Open</td><td></td></tr>"
PAIR = "<tr id='r1'><td><a href='/p/ann/'>A.</a></td><td>2</td></tr><tr id='r1b'><td><a href='/p/bob/'>B.</a></td><td>0</td></tr>"


def test_agenda_and_its_rejections():
    read = lambda *rows: P.paired_rows(page(*rows), "t", r"/p/([^/]+)/")
    later = PAIR.replace("r1", "r2").replace(">2<", "><").replace(">0<", "><")
    assert read(GROUP, PAIR, "<tr><td></td></tr>", later) == [("Open", "r1", "ann", "bob", 2, 0), ("Open", "r2", "ann", "bob", None, None)]
    cases = {
        "pair_before_group_in_row_0": (PAIR,), "second_row_missing_after_r1": (GROUP, PAIR.replace("r1b", "r9b")), "name_not_linked_in_r1": (GROUP, PAIR.replace("/p/ann/", "/team/ann/")),
        "score_invalid_in_r1b": (GROUP, PAIR.replace(">0<", ">w<")), "one_score_in_r1": (GROUP, PAIR.replace(">0<", "><")), "same_side_twice_in_r1": (GROUP, PAIR.replace("bob", "ann")),
        "unknown_row_1": (GROUP, "<tr><td>advert</td></tr>"), "group_without_name_in_row_0": (GROUP.replace("Open", ""), PAIR), "width_changed_in_r1": (GROUP, PAIR.replace("<td>2</td>", "<td>2</td><td></td>")),
    }
    for reason, rows in cases.items():
        with pytest.raises(P.Rejected) as e:
            read(*rows)
        assert str(e.value) == reason


def test_pages_in_a_frame(spark):
    df = spark.createDataFrame([(1, page(HEAD, LINE)), (2, page(LINE)), (3, None)], "k long, html string")
    out = {r.k: r for r in P.typed_table(df, "k", "html", "t", COLUMNS).collect()}
    assert (out[1].rank, out[1]["name"], out[1].day, out[1].reason, out[1].pos) == (1, "Ann & Co", date(2024, 2, 29), None, 0)
    assert (out[2].reason, out[3].reason, out[2].rank) == ("header_changed", "empty_page", None)
    assert P.typed_table(df.where("false"), "k", "html", "t", COLUMNS).collect() == []


def test_a_long_page_is_parsed_in_pieces(monkeypatch):
    """As from one piece, with the same reasons in the same order; and in a bounded part of what all rows would take."""
    import tracemalloc

    pair = lambda k: f"<tr id='m{k}'><td><a href='/p/{k}/'>A &amp; {k}</a></td><td>1</td></tr><tr id='m{k}b'><td><a href='/p/x{k}/'>B</a></td><td>2</td></tr>"
    table = lambda *rows: "<table class='t'><tr class='head'><td>G</td></tr>" + "".join(rows) + "</table>"
    good, bad = table(*map(pair, range(40))), table(pair(1), "<tr id='q'><td>x</td><td></td></tr>", *map(pair, range(30)))
    other = "<table class='u'><tr><td>1</td></tr></table>"
    nested = table(pair(1), "<tr><td><table class='t'></table></td></tr>")
    pages = [good, bad, other, other + good + other, good + good, bad + good, good + bad, good[:-8], bad[:-8], bad + nested, "<table class='t'></table>" + good, "<table class='t'></table>", "", None, good + "<td>x</td>", "<table class='t'><td>x</td></table>"]

    def read(html):
        try:
            return P.paired_rows(html, "t", r"/p/([^/]+)/")
        except P.Rejected as e:
            return str(e)

    want = [read(x) for x in pages]
    assert len(want[0]) == 40 and want[1] == "second_row_missing_after_q" and want[5] == want[6] == "table_doubled" and want[8] == "table_open" and want[9] == "table_in_table"
    for size in (1, 50, 1000):
        monkeypatch.setattr(P, "PIECE", size)
        assert [read(x) for x in pages] == want
    monkeypatch.setattr(P, "PIECE", 1 << 16)
    long = table(*map(pair, range(20_000)))
    tracemalloc.start()
    assert sum(1 for _ in P._pairs(P.rows_of(long, "t"), r"/p/([^/]+)/")) == 20_000
    assert tracemalloc.get_traced_memory()[1] < len(long)
    tracemalloc.stop()
