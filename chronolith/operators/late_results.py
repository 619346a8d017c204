"""Form, head-to-head and rest from results that become known late.

A result has the day on which it was played and the day from which it is known. What is known on a day never changes later:
a question asked for a day sees the results known on earlier days alone, whatever was played when. Once known, a result takes its
place by the day it was played, in front of later ones, so it changes only what is asked afterwards.

The state of an entity is a short list of days with wins and games in order, inserted into or added to; it is the same code
in a batch, where an entity's results and questions stream through its task in order of what was known, and in a stream,
where it is kept between micro-batches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .folds import fold

#: Games of the recent form, and days that the longer form looks back.
LAST, DAYS = 10, 90
FORM = "recent_rate double, recent_games long, form_rate double, form_games long, rest_days long"


class Form:
    """Days (ascending), wins and games of what is known of an entity."""

    def __init__(self, days: list[int] | None = None, wins: list[int] | None = None, games: list[int] | None = None):
        self.days, self.wins, self.games = days or [], wins or [], games or []

    def insert(self, day: int, won: int) -> None:
        i = bisect_left(self.days, day)
        if i == len(self.days) or self.days[i] != day:
            self.days.insert(i, day)
            self.wins.insert(i, 0)
            self.games.insert(i, 0)
        self.wins[i] += won
        self.games[i] += 1
        self._forget()

    def _forget(self) -> None:
        """Drop days that no later question can reach: before the last ``LAST`` games and the longest look back. Days that
        late results may still be put before are of no use then, as later ones already fill the form."""
        kept, i = 0, len(self.days)
        while i and (kept < LAST or self.days[i - 1] >= self.days[-1] - DAYS):
            i -= 1
            kept += self.games[i]
        del self.days[:i], self.wins[:i], self.games[:i]

    def at(self, day: int) -> tuple:
        """The last LAST games with the whole of the day that holds the first of them, the games of the last DAYS days, and the
        days since the last; only days before ``day``."""
        end = bisect_left(self.days, day)
        won = n = 0
        i = end
        while i and n < LAST:
            i -= 1
            won, n = won + self.wins[i], n + self.games[i]
        lo = bisect_left(self.days, day - DAYS)
        w, g = sum(self.wins[lo:end]), sum(self.games[lo:end])
        return won / n if n else None, n, w / g if g else None, g, day - self.days[end - 1] if end else None


def _sequence(results: DataFrame, questions: DataFrame, entity: str) -> DataFrame:
    """Both in one order: what is known by a day stands before that day's questions, as a result counts from the day after."""
    r = results.dropna(subset=[entity, "played", "known"]).select(entity, (F.greatest("played", "known") + 1).alias("at"), F.lit(0).alias("kind"), F.col("played").alias("day"), F.col("won").cast("int").alias("won"), F.lit(None).cast(questions.schema["ask"].dataType).alias("ask"))
    q = questions.dropna(subset=[entity, "day"]).select(entity, F.col("day").alias("at"), F.lit(1).alias("kind"), "day", F.lit(None).cast("int").alias("won"), "ask")
    return r.unionByName(q)


def _step(state: dict, row) -> tuple:
    form = state.setdefault("form", Form())
    if row.kind == 0:
        form.insert(int(row.day), int(row.won or 0) if row.won == row.won else 0)
        return (None,) * 5
    return form.at(int(row.day))


def form_as_known(results: DataFrame, questions: DataFrame, entity: str) -> DataFrame:
    """entity, day, ask and the form of each question (entity, day, ask) from ``results`` (entity, played, known, won). A result
    known before it was played counts from the day after it was played."""
    both = _sequence(results, questions, entity)
    out = fold(both, [entity], ["at", "kind", "day", "ask", "won"], ["kind", "day", "won"], _step, FORM, keep=["day", "ask", "kind"])
    return out.where("kind = 1").drop("kind")


def form_stream(changes: DataFrame, entity: str) -> DataFrame:
    """The same over a stream of (entity, at, kind, day, won, ask) in the order of ``at`` by micro-batch: state by entity, a
    row for each question. Rows of a micro-batch are put in order; a late result is one whose ``at`` is the day it came."""
    kinds = {f.name: f.dataType.simpleString() for f in changes.schema}
    head = f"{entity} {kinds[entity]}, day {kinds['day']}, ask {kinds['ask']}"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        form = Form(*([list(x) for x in state.get] if state.exists else []))
        rows = pd.concat(list(batches)).sort_values(["at", "kind", "day", "ask", "won"], na_position="first")
        out = []
        for r in rows.itertuples(index=False):
            if r.kind == 0:
                form.insert(int(r.day), int(r.won) if r.won == r.won and r.won is not None else 0)
            else:
                out.append((*key, int(r.day), r.ask, *form.at(int(r.day))))
        state.update((form.days, form.wins, form.games))
        yield pd.DataFrame(out, columns=[entity, "day", "ask", *(c.split()[0] for c in FORM.split(", "))])

    grouped = changes.groupBy(entity)
    return grouped.applyInPandasWithState(run, f"{head}, {FORM}", "days array<long>, wins array<long>, games array<long>", "append", "NoTimeout")
