"""How far a prediction is backed by data, how much of a market's price enters a decision, and how wide a band is."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Bounds and factors of each step.
FEW_GAMES = ((5, 0.35), (12, 0.60), (25, 0.85))
WIDE_DEVIATION = ((140, 0.55), (110, 0.78), (90, 0.92))
THIN_COVERAGE = ((0.6, 0.75), (0.8, 0.90), (1.0, 0.96))
SINGLE_GAME, NO_NAME, NO_SNAPSHOT, NEW_DEVIATION = 0.82, 0.25, 0.85, 160
MARKET_LEAST, MARKET_MOST, LEARNED_MOST = 0.05, 0.30, 0.60
FEW_BOOKS, WEAK_CONSENSUS, LARGE_DRIFT = (3, 0.75), 0.70, (0.08, 0.85)
FULL_HISTORY, HISTORY_PENALTY, SINGLE_PENALTY, WIDEST = 30, 0.10, 0.05, 0.25
HIGH, MEDIUM = (0.80, 0.05), (0.40, 0.10)


def held(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _below(x: Column, ladder) -> Column:
    out = F.when(x < ladder[0][0], ladder[0][1])
    for bound, factor in ladder[1:]:
        out = out.when(x < bound, factor)
    return out.otherwise(1.0)


def _above(x: Column, ladder) -> Column:
    out = F.when(x > ladder[0][0], ladder[0][1])
    for bound, factor in ladder[1:]:
        out = out.when(x > bound, factor)
    return out.otherwise(1.0)


def reliability(games_a: Column, games_b: Column, deviation_a: Column, deviation_b: Column, single: Column, name_a: Column, name_b: Column, snapshot: Column, coverage_a: Column, coverage_b: Column) -> Column:
    """From 0.05 to 1: a factor for each thing that a prediction lacks. Null games count as none, a null deviation as a
    newcomer's, null coverage as whole, and a null snapshot flag as one that exists."""
    games = F.least(F.coalesce(games_a, F.lit(0)), F.coalesce(games_b, F.lit(0)))
    deviation = (F.coalesce(deviation_a, F.lit(NEW_DEVIATION)) + F.coalesce(deviation_b, F.lit(NEW_DEVIATION))) / 2
    nameless = lambda n: (F.trim(F.coalesce(n, F.lit(""))) == "") | F.lower(n).rlike("tbd|winner|/")
    coverage = F.least(F.coalesce(coverage_a, F.lit(1.0)), F.coalesce(coverage_b, F.lit(1.0)))
    score = _below(games, FEW_GAMES) * _above(deviation, WIDE_DEVIATION) * F.when(F.coalesce(single, F.lit(False)), SINGLE_GAME).otherwise(1.0)
    score = score * F.when(nameless(name_a) | nameless(name_b), NO_NAME).otherwise(1.0) * F.when(F.coalesce(snapshot, F.lit(True)), 1.0).otherwise(NO_SNAPSHOT)
    return held(score * _below(coverage, THIN_COVERAGE), 0.05, 1.0)


def market_weight(rel: Column, books: Column, consensus: Column, drift: Column) -> Column:
    """A market's share: more where the model's own data are thin, less where the market is."""
    w = MARKET_LEAST + (MARKET_MOST - MARKET_LEAST) * (1 - held(rel, 0.05, 1.0))
    few = F.coalesce((books > 0) & (books < FEW_BOOKS[0]), F.lit(False))
    weak = F.coalesce(consensus.isin("low", "single_or_missing"), F.lit(False))
    moved = F.coalesce(drift >= LARGE_DRIFT[0], F.lit(False))
    for when, factor in ((few, FEW_BOOKS[1]), (weak, WEAK_CONSENSUS), (moved, LARGE_DRIFT[1])):
        w = w * F.when(when, factor).otherwise(1.0)
    return held(w, 0.0, MARKET_MOST)


def decided(p: Column, market: Column, rel: Column, weight: Column, learned: Column | None = None) -> tuple[Column, Column, Column]:
    """Probability of a decision, the market's weight in it, and its source: the model drawn towards a half where there is no
    market, else a blend by the learned weight, if there is one, or by ``weight``."""
    none = market.isNull()
    own = F.coalesce(held(learned, 0.0, LEARNED_MOST), weight) if learned is not None else weight
    alone = held(0.5 + held(rel, 0.05, 1.0) * (p - 0.5), 1e-4, 1 - 1e-4)
    source = F.when(none, "model_shrunk").when(learned.isNotNull() if learned is not None else F.lit(False), "learned_weight").otherwise("dynamic_weight")
    return F.when(none, alone).otherwise(held((1 - own) * p + own * market, 1e-4, 1 - 1e-4)), F.when(none, 0.0).otherwise(own), source


def estimate_band(spread: Column, games_a: Column, games_b: Column, members: Column) -> tuple[Column, Column, Column]:
    """Half width, history's coverage and level (high, medium, low) of a probability's band; ``members`` counts the models
    that have weight in it."""
    coverage = held(F.least(F.greatest(games_a, F.lit(0)), F.greatest(games_b, F.lit(0))) / FULL_HISTORY, 0.0, 1.0)
    short, lone = HISTORY_PENALTY * (1 - coverage), F.when(members < 2, SINGLE_PENALTY).otherwise(0.0)
    half = F.least(F.lit(WIDEST), F.sqrt(spread * spread + short * short + lone * lone))
    fits = lambda b: (coverage >= b[0]) & (members >= 2) & (half <= b[1])
    return half, coverage, F.when(fits(HIGH), "high").when(fits(MEDIUM), "medium").otherwise("low")
