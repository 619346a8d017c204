"""Round histories: formats, overtime, and pages that are rejected."""

import pytest

from chronolith.operators.rounds import NOTHING, Rejected, rounds


def page(halves, score):
    """Halves: lists of (won by left, side of left) or None; a part holds two, or all of overtime."""
    a = b = 0
    rows, parts = (["", ""]), []
    for k, half in enumerate(halves):
        for t in (0, 1):
            rows[t] += '<div class="round-history-bar"></div>'
        for won in half:
            icon, said = NOTHING, ""
            if won:
                mine, side = won
                a, b = a + mine, b + (not mine)
                icon, said = ("ct_win.svg" if (side == "ct") == mine else "bomb_exploded.svg"), f"{a}-{b}"
            for t in (0, 1):
                own = bool(won) and won[0] == (t == 0)
                rows[t] += f'<img class="round-history-outcome" src="/i/{icon if own else NOTHING}?v=1" title="{said if own else ""}">'
        if k == 1 or k == len(halves) - 1:
            css = "round-history-con" + (" round-history-overtime" if k > 1 else "")
            team = "".join(f'<div class="round-history-team-row"><img class="round-history-team" title="{n}">{r}</div>' for n, r in zip(("A", "B"), rows, strict=True))
            parts.append(f'<div class="{css}">{team}</div>')
            rows = ["", ""]
    teams = "".join(f'<div class="team-{s}"><a href="/stats/teams/{i}/x">{n}</a><div class="bold">{p}</div></div>' for s, i, n, p in (("left", 7, "A", score[0]), ("right", 8, "B", score[1])))
    return teams + "".join(parts)


@pytest.mark.parametrize("n", [12, 15])
def test_formats_and_overtime(n):
    whole = [[(True, "ct")] * n, [(False, "t")] * n]
    extra = [[(True, "t")] * 3, [(True, "ct"), None, None]]
    out = rounds(page(whole + extra, (n + 4, n)))
    assert [r[0] for r in out if r[4]] == [1, n + 1] and len(out) == 2 * n + 4
    assert [r[5] for r in out] == ["7"] * n + ["8"] * n + ["7"] * 4 and [r[3] for r in out] == [False] * 2 * n + [True] * 4
    assert out[n][6:8] == ("ct", "t") and out[-1][1:3] == (4, 1)


@pytest.mark.parametrize(
    "old,new",
    [("1-0", "9-0"), ("ct_win", "other"), ('title="A"', 'title="B"'), (">13<", ">14<"), ("/teams/8/", "/teams/7/"), ('class="round-history-con"', 'class="x"'), ('<div class="round-history-bar"></div>', "")],
)
def test_rejected(old, new):
    good = page([[(True, "ct")] * 12, [(True, "t")] + [None] * 11], (13, 0))
    assert len(rounds(good)) == 13
    with pytest.raises(Rejected):
        rounds(good.replace(old, new, 1))


def test_unfinished_empty_and_sides_that_stay():
    for html in ("", page([[(True, "ct")] * 12, [None] * 12], (12, 0)), page([[(True, "ct")] * 12, [(True, "ct")] + [None] * 11], (13, 0))):
        with pytest.raises(Rejected):
            rounds(html)
