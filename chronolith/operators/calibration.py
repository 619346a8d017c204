"""Calibrators on a grid of probabilities, and weights of a convex ensemble.

Rows are summed by probability rounded to 1 / ``GRID`` first, so that a fit takes at most GRID + 1
rows of (probability, n, positives) whatever the data's size; what a calibrator is, is a table over the
same grid.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

GRID = 1000
EPS = 1e-6


def on_grid(df: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """``by``, g (0..GRID), n and s (positives); null probabilities are left out."""
    g = F.round(F.col(p) * GRID).cast("int").alias("g")
    return df.where(F.col(p).isNotNull()).groupBy(*by, g).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("s"))


def _newton(x: np.ndarray, n: np.ndarray, s: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * q - s) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


def _p(g: np.ndarray) -> np.ndarray:
    return np.clip(g / GRID, EPS, 1 - EPS)


def _logits(g: np.ndarray) -> np.ndarray:
    return np.log(_p(g) / (1 - _p(g)))


def pooled(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Isotonic values by pool-adjacent-violators."""
    blocks: list[list[float]] = []
    for a, b in zip(n.tolist(), s.tolist(), strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            a2, b2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + k]
    return np.repeat([b / a for a, b, _ in blocks], [k for *_, k in blocks])


ALL = np.arange(GRID + 1)


def fit_identity(g, n, s) -> np.ndarray:
    return _p(ALL)


def fit_platt(g, n, s) -> np.ndarray:
    x = lambda v: np.stack([_logits(v), np.ones(len(v))], 1)
    return 1 / (1 + np.exp(-(x(ALL) @ _newton(x(g), n, s))))


def fit_beta(g, n, s) -> np.ndarray:
    """Logistic on ln p and ln(1 - p)."""
    x = lambda v: np.stack([np.log(_p(v)), np.log(1 - _p(v)), np.ones(len(v))], 1)
    return 1 / (1 + np.exp(-np.clip(x(ALL) @ _newton(x(g), n, s), -30, 30)))


def fit_isotonic(g, n, s) -> np.ndarray:
    """Steps, linear between the probabilities that were seen."""
    return np.interp(ALL, g, pooled(n, s))


def fit_venn_abers(g, n, s) -> np.ndarray:
    """Inductive Venn-Abers: isotonic values p0 and p1 with the point itself added as 0 and as 1."""
    out = []
    for v in ALL.tolist():
        k = int(np.searchsorted(g, v))
        there = k < len(g) and g[k] == v
        both = []
        for label in (0.0, 1.0):
            m, t = (n.astype(float), s.astype(float)) if there else (np.insert(n.astype(float), k, 0.0), np.insert(s.astype(float), k, 0.0))
            m, t = m.copy(), t.copy()
            m[k] += 1
            t[k] += label
            both.append(pooled(m, t)[k])
        p0, p1 = both
        out.append(p1 / (1 - p0 + p1) if 1 - p0 + p1 > 1e-12 else p1)
    return np.array(out)


#: The registry of calibrators, in the order that settles ties.
FITTERS = {"identity": fit_identity, "platt": fit_platt, "isotonic": fit_isotonic, "beta": fit_beta, "venn_abers": fit_venn_abers}


def fit(df: DataFrame, y: str, p: str, method: str) -> DataFrame:
    """(g, value) of a calibrator fitted on all rows of ``df``."""
    rows = on_grid(df, y, p).orderBy("g").toPandas()
    values = FITTERS[method](*(rows[c].to_numpy() for c in ("g", "n", "s")))
    return df.sparkSession.createDataFrame(pd.DataFrame({"g": ALL, "value": values}), "g int, value double")


def apply(df: DataFrame, p: str, calibrator: DataFrame, name: str) -> DataFrame:
    """``df`` with the calibrated probability; GRID + 1 rows are sent to the executors."""
    g = F.round(F.col(p) * GRID).cast("int")
    return df.withColumn("__g", g).join(F.broadcast(calibrator.select(F.col("g").alias("__g"), F.col("value").alias(name))), "__g", "left").drop("__g")


def select(df: DataFrame, y: str, p: str, validation: Column, methods: tuple[str, ...] = tuple(FITTERS)) -> DataFrame:
    """A row for each method: fitted on rows where ``validation`` is false, its log loss where it is true,
    and whether it is the best one. One pass over the data."""
    rows = on_grid(df.withColumn("__v", validation), y, p, "__v").orderBy("g").toPandas()
    known, held = rows[~rows["__v"]], rows[rows["__v"]]
    out = []
    for m in methods:
        q = np.clip(FITTERS[m](*(known[c].to_numpy() for c in ("g", "n", "s"))), EPS, 1 - EPS)[held["g"].to_numpy()]
        n, s = held["n"].to_numpy(), held["s"].to_numpy()
        out.append((m, float(-(s * np.log(q) + (n - s) * np.log(1 - q)).sum() / n.sum()) if n.sum() else None))
    best = min((x for x in out if x[1] is not None), key=lambda x: x[1], default=("identity", None))[0]
    return df.sparkSession.createDataFrame([(m, x, m == best) for m, x in out], "method string, log_loss double, chosen boolean")


def _simplex_qp(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The point of the simplex that minimises w h w / 2 + g w, from the supports of a few weights."""
    best, at = np.inf, None
    k = len(g)
    for size in range(1, k + 1):
        for some in combinations(range(k), size):
            i = list(some)
            kkt = np.zeros((size + 1, size + 1))
            kkt[:size, :size] = h[np.ix_(i, i)]
            kkt[:size, size] = kkt[size, :size] = 1
            w = np.zeros(k)
            w[i] = np.linalg.lstsq(kkt, np.append(-g[i], 1.0), rcond=None)[0][:size]
            value = w @ h @ w / 2 + g @ w
            if (w >= -1e-12).all() and abs(w.sum() - 1) < 1e-9 and value < best - 1e-15:
                best, at = value, np.clip(w, 0, 1)
    return at


def convex_weights(df: DataFrame, y: str, columns: list[str], l2: float = 0.002, steps: int = 12) -> dict[str, float]:
    """Weights on the simplex of least mean log loss plus ``l2`` times their squared distance to equal ones, by
    Newton's method: each step is one aggregation of k + k * k sums. For up to ten columns."""
    k = len(columns)
    w = np.full(k, 1 / k)
    p = [F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(c))) for c in columns]
    for _ in range(steps if k > 1 else 0):
        q = sum((float(a) * x for a, x in zip(w, p, strict=True)), F.lit(0.0))
        d = (1 - F.col(y)) / (1 - q) - F.col(y) / q
        dd = (1 - F.col(y)) / ((1 - q) * (1 - q)) + F.col(y) / (q * q)
        sums = df.agg(*[F.avg(d * x) for x in p], *[F.avg(dd * a * b) for a in p for b in p]).first()
        if sums[0] is None:
            break
        g, h = np.array(sums[:k], float), np.array(sums[k:], float).reshape(k, k) + 2 * l2 * np.eye(k)
        g = g + 2 * l2 * (w - 1 / k)
        new = _simplex_qp(h, g - h @ w)
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    return dict(zip(columns, w.tolist(), strict=True))
