"""Estimators over feature tables, as pipelines of the built-in ML library.

Everything is fitted on the training rows alone: imputation, scales, categories (a null is a category
of its own) and the model.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import stage
from .calibration import apply, fit

NULL = "__null__"


def prepared(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Numbers as doubles, non-finite ones as null; null categories by name."""
    num = {c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), None).otherwise(F.col(c).cast("double")) for c in numeric}
    return df.withColumns(num | {c: F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in categorical})


def preprocessor(numeric: list[str], categorical: list[str], scale: bool = True) -> list:
    """Stages that make ``features``: imputed by the mean and standardised numbers, one-hot categories
    (unseen ones give zeros)."""
    stages = []
    parts = []
    if numeric:
        filled = [f"{c}__filled" for c in numeric]
        stages += [Imputer(inputCols=numeric, outputCols=filled, strategy="mean"), VectorAssembler(inputCols=filled, outputCol="numbers")]
        stages += [StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)] if scale else []
        parts.append("scaled" if scale else "numbers")
    if categorical:
        index, hot = [f"{c}__index" for c in categorical], [f"{c}__hot" for c in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False, handleInvalid="keep")]
        parts += hot
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


#: Estimators by name.
ZOO = {
    "logistic": lambda y: LogisticRegression(labelCol=y, regParam=0.001, maxIter=100),
    "elastic_net": lambda y: LogisticRegression(labelCol=y, regParam=0.01, elasticNetParam=0.5, maxIter=100),
    "forest": lambda y: RandomForestClassifier(labelCol=y, numTrees=40, maxDepth=5, seed=7),
    "boosted": lambda y: GBTClassifier(labelCol=y, maxIter=15, maxDepth=3, seed=7),
}


def fit_predict(train: DataFrame, test: DataFrame, y: str, numeric: list[str], categorical: list[str], name: str = "logistic") -> DataFrame:
    """``test`` with ``p``, the estimator's probability of a 1."""
    model = Pipeline(stages=[*preprocessor(numeric, categorical), ZOO[name](y)]).fit(prepared(train, numeric, categorical))
    out = model.transform(prepared(test, numeric, categorical))
    return out.withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p")


def compare(train: DataFrame, test: DataFrame, y: str, numeric: list[str], categorical: list[str], names: list[str]) -> dict[str, DataFrame]:
    """For each estimator ``test`` with ``p``, as :func:`fit_predict` gives it; the features are fitted and made once for all."""
    ready = Pipeline(stages=preprocessor(numeric, categorical)).fit(prepared(train, numeric, categorical))
    made = [stage(ready.transform(prepared(x, numeric, categorical)).select(*cols, "features"), "features") for x, cols in ((train, [y]), (test, test.columns))]
    fitted = {name: ZOO[name](y).fit(made[0]) for name in names}
    return {name: m.transform(made[1]).withColumn("p", vector_to_array("probability")[1]).select(*test.columns, "p") for name, m in fitted.items()}


def backtest(df: DataFrame, segment: str, period: str, y: str, key: str, numeric: list[str], categorical: list[str], name: str = "logistic") -> DataFrame:
    """Out-of-fold table (segment, fold, key, y, p, calibrated): for each segment and period with two
    before it, a base fit on periods before the last but one, Platt on the last one. Segments and
    periods are few; each fold's fits are jobs over its rows."""
    df = stage(df, "backtest")  # each fold reads it again
    folds = df.select(segment, period).distinct().orderBy(segment, period).collect()
    by: dict = {}
    for r in folds:
        by.setdefault(r[0], []).append(r[1])
    parts = []
    for s, periods in by.items():
        own = df.where(F.col(segment).eqNullSafe(F.lit(s)))
        for at in range(2, len(periods)):
            train, calib, test = own.where(F.col(period) < periods[at - 1]), own.where(F.col(period) == periods[at - 1]), own.where(F.col(period) == periods[at])
            if len({r[0] for r in train.select(y).distinct().collect()}) < 2:
                continue
            scored = fit_predict(train, calib.withColumn("__test", F.lit(False)).unionByName(test.withColumn("__test", F.lit(True))), y, numeric, categorical, name)
            platt = fit(scored.where(~F.col("__test")), y, "p", "platt")
            out = apply(scored.where("__test"), "p", platt, "calibrated")
            parts.append(out.select(F.col(segment).alias("segment"), F.lit(periods[at]).alias("fold"), key, y, "p", "calibrated"))
    result = parts[0] if parts else None
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def multiclass(train: DataFrame, test: DataFrame, y: str, key: str, numeric: list[str], classes: int, mirrored: list[str]) -> DataFrame:
    """The ``key`` of rows of ``test`` with class probabilities of a multinomial model that don't change when sides are swapped:
    the mean of the direct ones and of the reversed ones of the row with ``mirrored`` columns negated."""
    model = Pipeline(stages=[*preprocessor(numeric, []), LogisticRegression(labelCol=y, family="multinomial", regParam=0.001)]).fit(prepared(train, numeric, []))
    probs = lambda d: model.transform(prepared(d, numeric, [])).withColumn("c", vector_to_array("probability"))
    both = test.withColumn("__side", F.explode(F.array(F.lit(1), F.lit(-1))))
    turned = both.withColumns({c: F.col(c) * F.col("__side") for c in mirrored})
    p = probs(turned).withColumn("c", F.when(F.col("__side") == 1, F.col("c")).otherwise(F.reverse("c")))
    return p.groupBy(key).agg(*[F.avg(F.col("c")[i]).alias(f"p{i}") for i in range(classes)])


def redundant(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, reason, of): constant columns, and columns whose values all equal an earlier one's. Equality is
    that of order-free sums of hashes by row, made in one pass."""
    value = lambda c: F.coalesce(F.round(F.col(c).cast("double"), 12), F.lit(0.0))
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    one = df.agg(*[F.max(value(c)).alias(f"hi_{c}") for c in columns], *[F.min(value(c)).alias(f"lo_{c}") for c in columns], *[F.sum(F.xxhash64(row, value(c)).cast("decimal(38,0)")).alias(f"h_{c}") for c in columns]).first()
    out, seen = [], {}
    for c in columns:
        if one[f"hi_{c}"] == one[f"lo_{c}"]:
            out.append((c, "constant", None))
        elif one[f"h_{c}"] in seen:
            out.append((c, "duplicate", seen[one[f"h_{c}"]]))
        else:
            seen[one[f"h_{c}"]] = c
    return df.sparkSession.createDataFrame(out, "column string, reason string, of string")
