"""Round histories of games from HTML pages: validated rounds, or the reason why a page has none."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: The side that an outcome's icon stands for.
SIDES = {"ct_win.svg": "ct", "bomb_defused.svg": "ct", "stopwatch.svg": "ct", "t_win.svg": "t", "bomb_exploded.svg": "t"}
#: Fixed value: the icon of a round that a team did not win.
NOTHING = "emptyHistory.svg"
VOID = {"img", "br", "hr", "input", "link", "meta"}


class Rejected(ValueError):
    """A page that doesn't say all of a history, without contradictions."""


def _need(ok: bool, reason: str) -> None:
    if not ok:
        raise Rejected(reason)


class _Page(HTMLParser):
    """Both teams (id, name, score) and, by part of the game and team row, names and halves of icons."""

    def __init__(self):
        super().__init__()
        self.open, self.parts, self.teams = [], [], {s: {"id": "", "name": "", "score": ""} for s in ("team-left", "team-right")}

    def _within(self, name: str) -> bool:
        return any(name in c for _, c in self.open)

    def _team(self) -> dict | None:
        return next((t for s, t in self.teams.items() if self._within(s)), None)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        css = set(a.get("class", "").split())
        if tag not in VOID:
            self.open.append((tag, css))
        if "round-history-con" in css:
            self.parts.append(("round-history-overtime" in css, []))
        elif "round-history-team-row" in css and self.parts:
            self.parts[-1][1].append((set(), []))
        elif self._within("round-history-team-row") and self.parts:
            names, halves = self.parts[-1][1][-1]
            if "round-history-team" in css:
                names.add(a.get("title", ""))
            elif "round-history-bar" in css:
                halves.append([])
            elif "round-history-outcome" in css:
                _need(bool(halves), "icon before a half")
                halves[-1].append((a.get("src", "").split("?")[0].rsplit("/", 1)[-1], a.get("title", "")))
        elif tag == "a" and self._team() is not None and (found := re.search(r"/teams/(\d+)/", a.get("href", ""))):
            self._team()["id"] = found[1]

    def handle_endtag(self, tag):
        while any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        team = self._team()
        if team is not None and self._within("bold"):
            team["score"] += data.strip()
        elif team is not None and any(t == "a" for t, _ in self.open):
            team["name"] += data


def _half(left: list, right: list) -> list[tuple[bool, str, str]]:
    """(won by the left team, icon, score) for each round played; the rest of a half is empty."""
    _need(len(left) == len(right), "rows of unequal length")
    played = [(a[0] != NOTHING, b[0] != NOTHING) for a, b in zip(left, right, strict=True)]
    n = sum(any(p) for p in played)
    _need(all(sum(p) == (i < n) for i, p in enumerate(played)), "a gap, or two winners")
    _need(not any(a[1] or b[1] for a, b in list(zip(left, right, strict=True))[n:]), "a score without a winner")
    return [(p[0], *(a if p[0] else b)) for p, a, b in zip(played[:n], left, right, strict=False)]


def rounds(html: str) -> list[tuple]:
    """Rounds of a page: number, half, place in the half, overtime, pistol (a regulation half's first),
    winner's id, winner's side, the left team's side, outcome. Raises ``Rejected`` with a reason."""
    page = _Page()
    page.feed(html)
    left, right = page.teams.values()
    _need(left["id"] != "" and right["id"] != "" and left["id"] != right["id"], "no two teams")
    _need(left["score"].isdigit() and right["score"].isdigit(), "no final score")
    _need(bool(page.parts), "no history")
    _need([extra for extra, _ in page.parts] == [k > 0 for k in range(len(page.parts))], "regulation and overtime unclear")
    halves: list[tuple[bool, list, list]] = []
    for extra, rows in page.parts:
        _need(len(rows) == 2 and all(r[0] == {t["name"].strip()} for r, t in zip(rows, (left, right), strict=True)), "rows of other teams")
        (_, a), (_, b) = rows
        _need(len(a) == len(b) and (len(a) == 2 if not extra else len(a) > 0 and len(a) % 2 == 0), "halves unclear")
        halves += [(extra, x, y) for x, y in zip(a, b, strict=True)]
    length = len(halves[0][1])
    _need(length in (12, 15) and all(len(x) == 3 for extra, x, _ in halves if extra), "unknown format")
    out, score, sides = [], [0, 0], []
    for h, (extra, x, y) in enumerate(halves):
        own = set()
        for k, (mine, icon, said) in enumerate(_half(x, y)):
            _need(icon in SIDES, "unknown outcome")
            score[0 if mine else 1] += 1
            _need(said == f"{score[0]}-{score[1]}", "another running score")
            side = SIDES[icon]
            own.add(side if mine else {"ct": "t", "t": "ct"}[side])
            out.append((len(out) + 1, h + 1, k + 1, extra, not extra and k == 0, (left if mine else right)["id"], side, min(own), icon))
        _need(len(own) < 2, "sides change within a half")
        sides.append(own)
    _need(all(a != b or not a for a, b in zip(sides[::2], sides[1::2], strict=True)), "sides don't swap")
    _need(score == [int(left["score"]), int(right["score"])], "another final score")
    _need([r[0] for r in out if r[4]] == [1, length + 1], "pistols missing")
    _need(max(score) > length and score[0] != score[1], "unfinished")
    return out


def round_history(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Rounds of each page (see ``rounds``), or one row with the ``reason`` of its rejection. A null
    page is one without teams."""
    names = ["number", "half", "place", "overtime", "pistol", "winner", "winner_side", "left_side", "outcome"]
    types = "number int, half int, place int, overtime boolean, pistol boolean, winner string, winner_side string, left_side string, outcome string"

    def run(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                try:
                    out += [(k, *r, None) for r in rounds(text or "")]
                except Rejected as e:
                    out.append((k, *[None] * len(names), str(e)))
            yield pd.DataFrame(out, columns=[key, *names, "reason"]).astype({n: "Int32" for n in names[:3]} | {n: "boolean" for n in names[3:5]})

    return pages.select(key, html).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {types}, reason string")
