"""Which features to prune: inflation of variance, importance by permutation, recursive elimination, and a gate that is
nested in each outer fold. Fits are Spark's; the driver holds numbers by feature, never rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a block within which a column is permuted.
BLOCK = 4096


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, ``vif`` (1 / (1 - R**2) against the others, from the inverse of the correlations, 1 to 10**6) and the largest
    absolute correlation with another. One pass of sums; rows with a null are left out, constants have no correlation."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    got = d.agg(*[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    r = np.eye(len(columns))
    for i, j in pairs:
        spread = ((got[f"v{i}"] or 0.0) * (got[f"v{j}"] or 0.0)) ** 0.5
        r[i, j] = r[j, i] = got[f"c{i}_{j}"] / spread if spread > 0 and np.isfinite(spread) else 0.0
    inflated = np.clip(np.diag(np.linalg.pinv(r + 1e-9 * np.eye(len(r)), hermitian=True)), 1.0, 1e6)
    most = np.abs(r - np.eye(len(r))).max(axis=1) if len(r) > 1 else np.zeros(len(r))
    rows = [(c, float(v), float(m)) for c, v, m in zip(columns, inflated, most, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, most_correlated double")


class Scaled:
    """A logistic model on columns scaled by the rows that it was fitted on, as numbers by column."""

    def __init__(self, df: DataFrame, y: str, columns: list[str], ridge: float = 0.01):
        stats = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.columns = columns
        self.mean = [float(stats[f"m_{c}"] or 0.0) for c in columns]
        self.sd = [float(stats[f"s_{c}"] or 0.0) or 1.0 for c in columns]
        x = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__x").transform(df.select(F.col(y).cast("double").alias("__y"), *[v.alias(f"__{c}") for c, v in zip(columns, self.scaled(), strict=True)]))
        fit = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=ridge, standardization=False, maxIter=50, tol=1e-8).fit(x.select("__x", "__y"))
        self.weights, self.intercept = [float(w) for w in fit.coefficients], float(fit.intercept)

    def scaled(self, names: dict[str, str] | None = None) -> list[Column]:
        """Scaled columns, null as the mean; ``names`` says which column stands in for one."""
        return [F.coalesce((F.col((names or {}).get(c, c)) - m) / s, F.lit(0.0)) for c, m, s in zip(self.columns, self.mean, self.sd, strict=True)]

    def p(self, names: dict[str, str] | None = None) -> Column:
        z = F.lit(self.intercept)
        for w, x in zip(self.weights, self.scaled(names), strict=True):
            z = z + w * x
        return 1 / (1 + F.exp(-z))


def _loss(y: str, p: Column) -> Column:
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.avg(-(F.col(y) * F.ln(c) + (1 - F.col(y)) * F.ln(1 - c)))


def permuted(df: DataFrame, key: str, columns: list[str], seed: int, rows: int) -> DataFrame:
    """``df`` with ``__perm_c`` for each column: all of another row's, drawn at random within a block of about ``BLOCK``
    rows. Blocks are dealt by hash, so that no task gets more; a block's rows change places by their hashes' order."""
    blocks = max(1, rows // BLOCK)
    h = lambda k: F.xxhash64(key, F.lit(seed), F.lit(k))
    dealt = df.withColumn("__block", F.pmod(h(0), F.lit(blocks)))
    place = lambda k: F.row_number().over(Window.partitionBy("__block").orderBy(h(k), key))
    other = dealt.select("__block", place(2).alias("__place"), *[F.col(c).alias(f"__perm_{c}") for c in columns])
    return dealt.withColumn("__place", place(1)).join(other, ["__block", "__place"]).drop("__block", "__place")


def permutation_importance(train: DataFrame, held: DataFrame, key: str, y: str, columns: list[str], repeats: int = 3, seed: int = 42) -> DataFrame:
    """feature, the mean and deviation over ``repeats`` of the loss that permuting it adds on ``held``, and its rank. The
    model is fitted on ``train`` once; a repeat permutes whole rows and scores every column from them in one pass."""
    model, rows = Scaled(train, y, columns), held.count()
    base = held.agg(_loss(y, model.p())).first()[0]
    found: dict[str, list[float]] = {c: [] for c in columns}
    for k in range(repeats):
        got = permuted(held, key, columns, seed + k, rows).agg(*[_loss(y, model.p({c: f"__perm_{c}"})).alias(c) for c in columns]).first()
        for c in columns:
            found[c].append(got[c] - base if got[c] is not None else 0.0)
    order = sorted(columns, key=lambda c: (-np.mean(found[c]), columns.index(c)))
    return train.sparkSession.createDataFrame([(c, float(np.mean(found[c])), float(np.std(found[c])), order.index(c) + 1) for c in columns], "feature string, loss_added double, deviation double, rank int")


def eliminate(train: DataFrame, y: str, columns: list[str], keep: int, step: int = 1) -> DataFrame:
    """feature and ``rank``: 1 for the ``keep`` that stay, then by the round in which a feature of least absolute weight
    (on scaled columns) went, the last round first."""
    left, gone = list(columns), []
    while len(left) > keep:
        m = Scaled(train, y, left)
        weakest = sorted(zip(left, m.weights, strict=True), key=lambda x: (abs(x[1]), -columns.index(x[0])))[: min(step, len(left) - keep)]
        gone.append([c for c, _ in weakest])
        left = [c for c in left if c not in gone[-1]]
    rows = [(c, 1) for c in left] + [(c, 2 + i) for i, cs in enumerate(reversed(gone)) for c in cs]
    return train.sparkSession.createDataFrame(rows, "feature string, rank int")


def fold_features(history: DataFrame, period: str, y: str, core: list[str], families: dict[str, list[str]], available: dict[str, str], held: int = 8, gain: float = 0.0005, least: int = 80, least_available: int = 20) -> tuple[list[str], list[tuple[str, float | None, str]]]:
    """Columns that an outer fold's history alone lets in, and for each family its gain and verdict. The last ``held``
    periods of the history are set aside; a family must lower the loss there by ``gain`` over the core alone, and again when it is added
    to those let in before it, in order of the gain alone. Families seen in too few of those rows aren't tried."""
    periods = [r[0] for r in history.select(period).distinct().orderBy(F.desc(period)).limit(held + 1).collect()]
    refuse = lambda why: (list(core), [(f, None, why) for f in families])
    if len(periods) <= held:
        return refuse("insufficient_periods")
    cut = periods[held - 1]
    fit, check = history.where(F.col(period) < cut), history.where(F.col(period) >= cut)
    sizes = [d.agg(F.count(y).alias("n"), F.min(y).alias("lo"), F.max(y).alias("hi")).first() for d in (fit, check)]
    if sizes[0].n < 100 or sizes[1].n < least or any(s.lo == s.hi for s in sizes):
        return refuse("insufficient_temporal_holdout")
    seen = check.agg(*[F.count(F.col(available[f])).alias(f) for f in families]).first()
    loss = lambda cols: check.agg(_loss(y, Scaled(fit, y, cols).p())).first()[0]
    best, alone, told = loss(core), {}, {}
    for f, cols in families.items():
        if seen[f] < least_available:
            told[f] = (None, "too_few_available")
            continue
        alone[f] = best - loss([*core, *cols])
        told[f] = (alone[f], "no_gain_alone")
    chosen = list(core)
    for f in sorted((f for f in alone if alone[f] >= gain), key=lambda f: (-alone[f], f)):
        now = loss([*chosen, *families[f]])
        told[f] = (best - now, "selected" if best - now >= gain else "no_gain_added")
        if best - now >= gain:
            chosen, best = [*chosen, *families[f]], now
    return chosen, [(f, *told[f]) for f in families]
