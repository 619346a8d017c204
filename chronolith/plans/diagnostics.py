"""Queries over paired tests, detectable differences and what features to prune."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D, significance as S
from ..sources.io import table
from ..sources.staging import stage
from .models import order_features
from .registry import query

#: A paired difference with many ties and some zeros.
EDGE = "round(l_discount - l_tax - 0.01, 2)"


def _edge():
    return F.round(F.col("l_discount") - F.col("l_tax") - 0.01, 2)


@query(
    "wilcoxon_pairs",
    f"""WITH d AS (SELECT {EDGE} AS d FROM lineitem), r AS (SELECT abs(d) AS x, d > 0 AS up, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
t AS (SELECT sum(n::DOUBLE * n * n - n) AS ties FROM (SELECT count(*) AS n FROM r GROUP BY x)), w AS (SELECT count(*) AS n, sum(r) FILTER (up) AS w_plus, coalesce(sum(r) FILTER (NOT up), 0) AS w_minus FROM r),
z AS (SELECT *, (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w, t),
s AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c FROM (SELECT unnest(range(0, 4001)) AS i)),
g AS (SELECT sum(c * exp(-(i * abs(z) / 4000) * (i * abs(z) / 4000) / 2)) AS area FROM z, s)
SELECT n, (SELECT count(*) FROM d WHERE d = 0) AS zeros, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, round(z, 6) AS z, round(1 - 2 * area * abs(z) / 4000 / 3 / sqrt(2 * pi()), 6) AS p FROM z, g""",
)
def wilcoxon_pairs(spark, sf):
    return S.wilcoxon(table(spark, sf, "lineitem"), _edge()).withColumns({"z": F.round("z", 6), "p": F.round("p", 6)})


@query("detectable_difference", f"SELECT count(*) AS n, round(avg(d), 9) AS mean, round(stddev_samp(d), 9) AS sd, round(2.80 * stddev_samp(d) / sqrt(count(*)), 9) AS mde FROM (SELECT {EDGE} AS d FROM lineitem)")
def detectable_difference(spark, sf):
    return S.detectable(table(spark, sf, "lineitem"), _edge()).select("n", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "mde")])


@query(
    "variance_inflation",
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem),
v AS (SELECT 'l_quantity' AS feature, a AS p, b AS q, c AS o FROM r UNION ALL SELECT 'l_extendedprice', a, c, b FROM r UNION ALL SELECT 'l_discount', b, c, a FROM r)
SELECT feature, round(greatest(1.0, 1 / (1 - (p * p + q * q - 2 * p * q * o) / (1 - o * o))), 4) AS vif, round(greatest(abs(p), abs(q)), 6) AS most_correlated FROM v""",
)
def variance_inflation(spark, sf):
    out = D.vif(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("feature", F.round("vif", 4).alias("vif"), F.round("most_correlated", 6).alias("most_correlated"))


COLUMNS = ["quantity", "discount", "tax", "lines"]


def _rows(spark, sf):
    return stage(order_features(spark, sf), "order-features")


@query("permutation_importance")
def permutation_importance(spark, sf):
    """Fitted on orders before 1996, permuted on those from then on."""
    d = _rows(spark, sf)
    return D.permutation_importance(d.where("year < 1996"), d.where("year >= 1996"), "o_orderkey", "y", COLUMNS)


@query("eliminated_features")
def eliminated_features(spark, sf):
    return D.eliminate(_rows(spark, sf).where("year < 1996"), "y", COLUMNS, 2)


@query("nested_gate")
def nested_gate(spark, sf):
    """For each outer year the families that its history lets in (fitted on earlier quarters, checked on the last eight), and
    the year's loss with and without them."""
    d = _rows(spark, sf)
    families = {"prices": ["discount", "tax"], "lines": ["lines"]}
    years = [r[0] for r in d.select("year").distinct().orderBy("year").collect()]  # a few
    rows = []
    for year in years[3:]:
        history, fold = d.where(F.col("year") < year), d.where(F.col("year") == year)
        chosen, told = D.fold_features(history, "quarter", "y", ["quantity"], families, {"prices": "discount", "lines": "lines"})
        loss = {n: fold.agg(D._loss("y", D.Scaled(history, "y", cols).p())).first()[0] for n, cols in (("core", ["quantity"]), ("gated", chosen))}
        rows += [(year, f, gain, why, loss["core"], loss["gated"]) for f, gain, why in told]
    return spark.createDataFrame(rows, "fold int, family string, gain double, verdict string, core_loss double, gated_loss double")
