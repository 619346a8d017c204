"""Strict page parsers: a page is rows in the layout it is known for, or the reason why it isn't. Nothing is guessed.

A layout says which table is meant by its class, its header cells in order, and each column's type. A page whose table is missing,
doubled, or headed otherwise, or one of whose cells doesn't fit its column, gives no row but a reason, so that a site's change
is seen at once and never becomes wrong data. Pages are parsed in their tasks, batch by batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VOID = {"img", "br", "hr", "input", "link", "meta", "col"}


class Rejected(ValueError):
    """A page that isn't in its layout."""


def need(ok: bool, reason: str) -> None:
    if not ok:
        raise Rejected(reason)


@dataclass
class Row:
    """A table's row: id, classes, cells (text and first link) and whether all of them are header cells."""

    id: str
    classes: set[str]
    cells: list[tuple[str, str]]
    header: bool


class Tables(HTMLParser):
    """The tables of a page by class, with their rows. A table in a table is an error."""

    def __init__(self):
        super().__init__()
        self.found: list[tuple[set[str], list[Row]]] = []
        self.inside, self.cell = False, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "table":
            need(not self.inside, "table_in_table")
            self.inside = True
            self.found.append((set(a.get("class", "").split()), []))
        elif not self.inside:
            return
        elif tag == "tr":
            self.found[-1][1].append(Row(a.get("id", ""), set(a.get("class", "").split()), [], True))
            self.cell = None
        elif tag in ("td", "th"):
            need(bool(self.found[-1][1]), "cell_without_row")
            row = self.found[-1][1][-1]
            row.header &= tag == "th"
            row.cells.append(("", ""))
            self.cell = row
        elif tag == "a" and self.cell is not None and not self.cell.cells[-1][1]:
            self.cell.cells[-1] = self.cell.cells[-1][0], a.get("href", "")

    def handle_endtag(self, tag):
        if tag == "table":
            self.inside, self.cell = False, None
        elif tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            text, link = self.cell.cells[-1]
            self.cell.cells[-1] = text + data, link


def table_rows(html: str | None, name: str) -> list[Row]:
    """Rows of the one table of a class, texts with single spaces."""
    need(bool(html), "empty_page")
    p = Tables()
    p.feed(html)
    p.close()
    tables = [rows for classes, rows in p.found if name in classes]
    need(len(tables) > 0, "table_missing")
    need(len(tables) == 1, "table_doubled")
    need(not p.inside, "table_open")
    for row in tables[0]:
        row.cells = [(" ".join(t.split()), href) for t, href in row.cells]
    return tables[0]


#: Characters of a page that are parsed at a time.
PIECE = 1 << 20
#: Rows that are held as Python's objects; more of a page wait in columns.
HELD = 20_000


def rows_of(html: str | None, name: str) -> Iterator[Row]:
    """:func:`table_rows` one by one, so that a long page's rows are never held together. What is wrong with the page's tables is
    raised where it is met, at the latest at the end."""
    need(bool(html), "empty_page")
    p, at, named = Tables(), 0, 0
    while at < len(html):
        # a piece ends before a tag
        end = html.find("<", at + PIECE)
        p.feed(html[at:] if end < 0 else html[at:end])
        at = len(html) if end < 0 else end
        last = at == len(html)
        if last:
            p.close()
        for k, (classes, rows) in enumerate(p.found):
            mine = name in classes
            named += mine and not hasattr(rows, "seen")
            open_ = k == len(p.found) - 1 and not last
            done, rest = (rows[:-1], rows[-1:]) if open_ else (rows, [])
            if mine and named == 1:
                for row in done:
                    row.cells = [(" ".join(t.split()), href) for t, href in row.cells]
                    yield row
            kept = _Rows(rest)
            p.found[k] = classes, kept
        p.found = p.found[-1:]
    need(named > 0, "table_missing")
    need(named == 1, "table_doubled")
    need(not p.inside, "table_open")


class _Rows(list):
    """Rows of a table that was met before."""

    seen = True


def _date(x: str) -> date:
    need(bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", x)), "not a date")
    return date.fromisoformat(x)


def _number(form: str, kind: Callable) -> Callable:
    def read(x: str):
        need(bool(re.fullmatch(form, x)), "not a number")
        return kind(x)

    return read


#: Types of cells: what Spark calls them, and how their text is read.
TYPES: dict[str, tuple[str, Callable]] = {"int": ("long", _number(r"-?[0-9]{1,18}", int)), "float": ("double", _number(r"-?[0-9]+(\.[0-9]+)?", float)), "date": ("date", _date), "text": ("string", str)}


@dataclass
class Column:
    """A column of a layout: its header, its name, the type of its cells, and whether each row must have a value."""

    header: str
    name: str
    kind: str
    required: bool = True


def _cell(c: Column, text: str, at: int):
    if not text:
        need(not c.required, f"{c.name}_missing_in_row_{at}")
        return None
    try:
        return TYPES[c.kind][1](text)
    except ValueError:
        raise Rejected(f"{c.name}_invalid_in_row_{at}") from None


def typed_rows(html: str | None, name: str, columns: list[Column]) -> list[tuple]:
    """The rows of a table with exactly these columns."""
    rows = table_rows(html, name)
    need(bool(rows) and rows[0].header and [t for t, _ in rows[0].cells] == [c.header for c in columns], "header_changed")
    out = []
    for i, row in enumerate(rows[1:], 1):
        need(len(row.cells) == len(columns), f"width_changed_in_row_{i}")
        out.append(tuple(_cell(c, t, i) for c, (t, _) in zip(columns, row.cells, strict=True)))
    return out


def paired_rows(html: str | None, name: str, link: str) -> list[tuple]:
    """Pairs of an agenda: (group, id, first, second, score_first, score_second). Rows of class ``head`` name the group of those
    below; a pair is a row with an id and one with the same id and a ``b`` right after it, with a linked name (an address that
    matches ``link``) and a score, or none on both sides."""
    return list(_pairs(rows_of(html, name), link))


def _pairs(rows: Iterator[Row], link: str) -> Iterator[tuple]:
    """The pairs of a page's rows. A page's tables come before its rows: with a row that is wrong the rest is still read."""
    try:
        yield from _next_pairs(rows, link)
    except Rejected:
        for _ in rows:
            pass
        raise


def _next_pairs(rows: Iterator[Row], link: str) -> Iterator[tuple]:
    group, i = None, 0
    for row in rows:
        if "head" in row.classes:
            group = row.cells[0][0] if row.cells else ""
            need(bool(group), f"group_without_name_in_row_{i}")
            i += 1
            continue
        if not row.id:
            need(not any(t for t, _ in row.cells), f"unknown_row_{i}")
            i += 1
            continue
        need(group is not None, f"pair_before_group_in_row_{i}")
        other = next(rows, None)
        need(other is not None and other.id == f"{row.id}b", f"second_row_missing_after_{row.id}")
        sides = []
        for one in (row, other):
            need(len(one.cells) == 2, f"width_changed_in_{one.id}")
            (who, href), (score, _) = one.cells
            found = re.fullmatch(link, href)
            need(bool(who) and found is not None, f"name_not_linked_in_{one.id}")
            need(not score or score.isdecimal(), f"score_invalid_in_{one.id}")
            sides.append((found[1], int(score) if score else None))
        (a, x), (b, y) = sides
        need((x is None) == (y is None), f"one_score_in_{row.id}")
        need(a != b, f"same_side_twice_in_{row.id}")
        yield group, row.id, a, b, x, y
        i += 2


def _parsed(pages: DataFrame, key: str, html: str, fields: str, parse: Callable[[str | None], Iterable[tuple]]) -> DataFrame:
    """A row (key, pos, fields, null reason) for each that a page gives; one with its reason for a rejected page."""
    kind = pages.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"`{key}` {kind}, pos int, {fields}, reason string")
    arrow = to_arrow_schema(schema)
    width = len(schema) - 3

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for at in range(batch.num_rows):
                k, done = batch.column(0)[at].as_py(), []
                try:
                    rows: list[tuple] = []
                    for i, row in enumerate(parse(batch.column(1)[at].as_py())):
                        rows.append((k, i, *row, None))
                        if len(rows) == HELD:  # a page that is rejected later gives none of them
                            done.append(made(rows))
                            rows = []
                    yield from done
                    out += rows
                except Rejected as e:
                    out.append((k, None, *[None] * width, str(e)))
                if len(out) >= HELD:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    return pages.select(key, html).mapInArrow(run, schema)


def typed_table(pages: DataFrame, key: str, html: str, name: str, columns: list[Column]) -> DataFrame:
    fields = ", ".join(f"`{c.name}` {TYPES[c.kind][0]}" for c in columns)
    return _parsed(pages, key, html, fields, lambda text: typed_rows(text, name, columns))


def agenda(pages: DataFrame, key: str, html: str, name: str, link: str) -> DataFrame:
    return _parsed(pages, key, html, "`group` string, id string, first string, second string, score_first int, score_second int", lambda text: _pairs(rows_of(text, name), link))

