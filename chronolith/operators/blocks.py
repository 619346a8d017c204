"""Ratings by day block that can stop, resume and be corrected: a store of states by day, previews, frozen days.

The store is a folder of generations. A generation holds, for each universe from some day on, the blocks (games and an
order-free hash of their inputs), the states that changed on each day, and the rated games; its marker is written last, so one
that was cut off doesn't count. A later generation takes the place of earlier ones from its first day on. A run compares the
hashes of its input's blocks with the stored ones, restarts every universe from the first block that differs, reads the states as they
stood before it, and writes its blocks in spans of days: each span is a generation, so a run that dies resumes after the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.scalars import dynamic_k, expected_score
from ..sources.staging import file_system, shuffles_freed, stage
from .folds import Slots, elo_block_seeded

GENERAL = "general"


def block_hashes(games: DataFrame, universe: str, order: list[str]) -> DataFrame:
    """universe, day, games and an order-free hash of all that a block's games say."""
    row = F.xxhash64("day", *order, "a", "b", "y", "surface")
    # both halves are added up as longs, which is exact for 2**31 games and much faster than decimals
    high, low = F.sum(F.shiftright(row, 32)), F.sum(row.bitwiseAND(F.lit(0xFFFFFFFF)))
    whole = high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(20,0)")
    return games.groupBy(universe, "day").agg(F.count(F.lit(1)).alias("games"), whole.cast("string").alias("input_hash"))


def changed_states(rated: DataFrame, universe: str) -> DataFrame:
    """universe, day, entity, kind, rating and games of every state that a day's block changed, after it."""
    general, surface = F.col("r.kind") == GENERAL, F.col("r.kind")

    def side(own: str, other: str, sign: int) -> Column:
        e = F.col("y") if sign > 0 else 1 - F.col("y")
        return F.array(
            F.struct(F.col(own).alias("entity"), F.lit(GENERAL).alias("kind"), F.col(f"elo_{own}").alias("before"), F.col(f"elo_{other}").alias("rival"), F.col(f"games_{own}").alias("n"), e.cast("double").alias("won")),
            F.struct(F.col(own).alias("entity"), F.col("surface").alias("kind"), F.col(f"surface_{own}").alias("before"), F.col(f"surface_{other}").alias("rival"), F.col(f"surface_games_{own}").alias("n"), e.cast("double").alias("won")),
        )

    r = rated.select(universe, "day", F.explode(F.concat(side("a", "b", 1), side("b", "a", -1))).alias("r")).where(general | surface.isNotNull()).select(universe, "day", "r.*")
    delta = dynamic_k(F.col("n")) * (F.col("won") - expected_score(F.col("before"), F.col("rival")))
    per = r.withColumn("delta", delta).groupBy(universe, "day", "entity", "kind").agg(F.max("before").alias("before"), F.max("n").alias("n"), F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("more"))
    return per.select(universe, "day", "entity", "kind", (F.col("before") + F.col("delta")).alias("rating"), (F.col("n") + F.col("more")).alias("games"))


class BlockStore:
    """States of day blocks below ``path``; ``universe`` names the column that keeps ratings apart, ``order`` those that put a
    day's games in order."""

    def __init__(self, spark: SparkSession, path: str, universe: str, order: list[str]):
        self.spark, self.path, self.universe, self.order = spark, path.rstrip("/"), universe, order

    def _exists(self, path: str) -> bool:
        p, fs = file_system(self.spark, path)
        return fs.exists(p)

    def generations(self) -> list[int]:
        """Finished ones in order."""
        p, fs = file_system(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        found = sorted(int(n[4:]) for n in names if n.startswith("gen=") and n[4:].isdigit())
        return [n for n in found if self._exists(f"{self.path}/gen={n}/_done")]

    def _used(self) -> int:
        p, fs = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max([int(n[4:]) for n in names if n.startswith("gen=") and n[4:].isdigit()], default=0)

    def read(self, what: str) -> DataFrame | None:
        """``blocks``, ``states`` or ``rated`` as they stand: each day of a universe from the last generation that reaches
        back to it."""
        gens = self.generations()
        if not gens:
            return None
        u = self.universe
        part = lambda n, k: self.spark.read.parquet(f"{self.path}/gen={n}/{k}").withColumn("__gen", F.lit(n))
        rows, starts = part(gens[0], what), part(gens[0], "starts")
        for n in gens[1:]:
            rows, starts = rows.unionByName(part(n, what)), starts.unionByName(part(n, "starts"))
        later = Window.partitionBy(u).orderBy("__gen").rowsBetween(1, Window.unboundedFollowing)  # a row for each generation
        cuts = starts.withColumn("__cut", F.min("from_day").over(later)).select(u, "__gen", "__cut")
        return rows.join(cuts, [u, "__gen"]).where(F.col("__cut").isNull() | (F.col("day") < F.col("__cut"))).drop("__gen", "__cut")

    def restarts(self, games: DataFrame) -> DataFrame:
        """universe and ``from_day``: the first day whose block is new, gone or has other inputs; no row where none is."""
        u, now = self.universe, block_hashes(games, self.universe, self.order)
        then = self.read("blocks")
        if then is None:
            return now.groupBy(u).agg(F.min("day").alias("from_day"))
        old = then.select(u, "day", F.col("input_hash").alias("old"))
        differ = now.join(old, [u, "day"], "full").where(~F.col("input_hash").eqNullSafe(F.col("old")))
        return differ.groupBy(u).agg(F.min("day").alias("from_day"))

    def states_before(self, days: DataFrame, day: str) -> DataFrame | None:
        """universe, entity, kind, rating and games as they stood before each universe's ``day``."""
        states = self.read("states")
        if states is None:
            return None
        u = self.universe
        early = states.join(days.select(u, F.col(day).alias("__day")), u).where(F.col("day") < F.col("__day"))
        return early.groupBy(u, "entity", "kind").agg(F.max_by(F.struct("rating", "games"), "day").alias("s")).select(u, "entity", "kind", "s.*")

    def run(self, games: DataFrame, span: int = 365, stop_after: int | None = None, staged: bool = False) -> int:
        """Bring the store to ``games`` (universe, day, order, a, b, y, surface), ``span`` days at a time; the number of
        generations written. ``stop_after`` ends after so many. Games are staged first, unless they are ``staged`` already."""
        with shuffles_freed(self.spark):
            u, cols = self.universe, [self.universe, "day", *self.order, "a", "b", "y", "surface"]
            games = games.select(*dict.fromkeys(cols))
            games = games if staged else stage(games, "block-games")
            written = 0
            while stop_after is None or written < stop_after:
                starts = stage(self.restarts(games), "block-starts")
                ends = starts.agg(F.min("from_day"), F.count(F.lit(1))).first()
                if not ends[1]:
                    break
                until = ends[0] + span  # universes that begin later wait for their turn
                starts = starts.where(F.col("from_day") < until)
                some = games.join(starts, u).where((F.col("day") >= F.col("from_day")) & (F.col("day") < until)).drop("from_day")
                rated = elo_block_seeded(self.states_before(starts, "from_day"), some, u, self.order)
                self._write(starts, some, rated)
                written += 1
            return written

    def _write(self, starts: DataFrame, games: DataFrame, rated: DataFrame) -> None:
        base = f"{self.path}/gen={self._used() + 1}"
        rated.write.parquet(f"{base}/rated")
        done = self.spark.read.schema(rated.schema).parquet(f"{base}/rated")
        changed_states(done, self.universe).write.parquet(f"{base}/states")
        block_hashes(games, self.universe, self.order).write.parquet(f"{base}/blocks")
        starts.write.parquet(f"{base}/starts")
        p, fs = file_system(self.spark, f"{base}/_done")
        fs.create(p).close()


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Codes of a column's values (nulls are alike), and the values they stand for."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def _cuts(*codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows alike in all ``codes``: first row and row after the last."""
    new = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(codes[0])] if len(codes[0]) else []
    yield from zip(cuts, cuts[1:], strict=False)


def _looked_up(rows: pa.RecordBatch, slots: Slots, base: float) -> list[np.ndarray]:
    """Ratings, games and ratings on the surface of either side for rows of one universe in order, where rows of states change
    what later rows find in ``slots``."""
    s, kinds = _codes(rows["__kind"])
    general, on = [], []
    for side in ("a", "b"):
        x, names = _codes(rows[side])
        general.append(slots.of(x, [(None, n) for n in names]))
        pairs, back = np.unique(s.astype(np.int64) * len(names) + x, return_inverse=True)
        on.append(slots.of(back, [(kinds[p // len(names)], names[p % len(names)]) for p in pairs.tolist()]))
    rating, games = slots.columns
    state, known, played = rows["__state"].to_numpy(), rows["__rating"].fill_null(base).to_numpy(), rows["__games"].fill_null(0).to_numpy()
    out = [np.zeros(len(s), t) for t in (float, np.int64, float) * 2]
    for lo, hi in _cuts(state, _codes(rows["day"])[0]):
        if state[lo]:
            rating[on[0][lo:hi]], games[on[0][lo:hi]] = known[lo:hi], played[lo:hi]
            continue
        for k in (0, 1):
            g, o = general[k][lo:hi], on[k][lo:hi]
            for column, values in zip(out[3 * k : 3 * k + 3], (rating[g], games[g], rating[o]), strict=True):
                column[lo:hi] = values
    return out


def preview(states: DataFrame, fixtures: DataFrame, universe: str, base: float = 1500.0) -> DataFrame:
    """``fixtures`` (universe, day, a, b, surface) with what their day's block would emit before any of its results: both
    general and surface ratings, games, and the expectation; read from ``states`` of strictly earlier days, which nothing changes.

    States and fixtures of a universe stream through one task in the order of days, as its blocks do: each row is shuffled once,
    and what is held is a universe's last states."""
    kind = lambda c: F.when(F.col(c) != GENERAL, F.col(c))  # noqa: E731  # null: the general one, which is also what a game without a surface asks
    types = {f.name: f.dataType for f in fixtures.schema}
    asks = fixtures.withColumns({"__kind": kind("surface"), "__rating": F.lit(None).cast("double"), "__games": F.lit(None).cast("long"), "__state": F.lit(0)})
    own = {universe: F.col(universe), "day": F.col("day"), "a": F.col("entity")}
    known = states.select(
        *[own.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()],
        kind("kind").alias("__kind"), F.col("rating").cast("double").alias("__rating"), F.col("games").cast("long").alias("__games"), F.lit(1).alias("__state"),
    )
    # a day's fixtures stand before the states after it
    rows = asks.unionByName(known).repartition(universe).sortWithinPartitions(universe, "day", "__state")
    names = [f"{c}_{side}" for side in ("a", "b") for c in ("elo", "games", "surface")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, slots = None, None
        for batch in batches:
            codes, keys = _codes(batch[universe])
            for lo, hi in _cuts(codes):
                if slots is None or keys[codes[lo]] != at:
                    at, slots = keys[codes[lo]], Slots(base, 0)
                part = batch.slice(lo, hi - lo)
                got = _looked_up(part, slots, base)
                ask = part["__state"].to_numpy() == 0
                kept = part.select(list(types)).filter(pa.array(ask))
                yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c[ask]) for c in got]], [*types, *names])

    schema = StructType([*fixtures.schema, *[StructField(n, LongType() if n.startswith("games") else DoubleType()) for n in names]])
    mean = lambda s: (F.col(f"elo_{s}") + F.col(f"surface_{s}")) / 2
    return rows.mapInArrow(run, schema).withColumn("expected", expected_score(mean("a"), mean("b")))


def frozen_days(games: DataFrame, universe: str, day: str, dated_only: Column, freeze: bool = False) -> DataFrame:
    """``games`` with ``frozen``: whether all rows of their civil day read the state before the day, as they must where one
    of them has a date without a time (or everywhere, with ``freeze``)."""
    w = Window.partitionBy(universe, day)
    return games.withColumn("frozen", F.lit(True) if freeze else F.max(F.coalesce(dated_only, F.lit(False))).over(w))

