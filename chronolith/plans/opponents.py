"""Queries over models that are refitted every period from sums of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import log_loss
from ..operators import windowed_models as M
from ..sources.io import table
from .registry import query

WIDTH, LEAST = 90, 100


def returns(spark, sf):
    """Lines as events: the day they were shipped (played), the day that was known (later for later lines), a feature of 19
    values, and whether they came back."""
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    x = F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("int")
    return table(spark, sf, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_linestatus", day.alias("played"), (day + F.col("l_linenumber")).alias("known"),
        x.alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


EVENTS = """SELECT l_suppkey, l_linenumber, l_linestatus, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS played, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + l_linenumber AS known,
CAST(round((l_discount - l_tax) * 100) AS INT) AS x, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem"""


def newton_sql(source: str, keys: str, ridge: float, into: str, steps: int = M.STEPS) -> str:
    """CTEs that fit each group of ``source`` (keys, x, n, s) by the same steps, the last one named ``into``."""
    on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM w.{k}" for k in keys.split(", "))
    own = ", ".join(f"c.{k}" for k in keys.split(", "))
    out = [f"{into}0 AS (SELECT {keys}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {source} GROUP BY {keys} HAVING sum(s) > 0 AND sum(s) < sum(n))"]
    for i in range(steps):
        name = into if i == steps - 1 else f"{into}{i + 1}"
        out.append(
            f"{into}h{i} AS (SELECT {own}, w.a, w.b, sum(c.n * q - c.s) AS ga, sum((c.n * q - c.s) * c.x) + {ridge} * w.b AS gb, sum(c.n * q * (1 - q)) + 1e-9 AS aa, sum(c.n * q * (1 - q) * c.x) AS ab, sum(c.n * q * (1 - q) * c.x * c.x) + {ridge} AS bb "
            f"FROM (SELECT c.*, 1 / (1 + exp(-(w.a + w.b * c.x))) AS q FROM {source} c JOIN {into}{i} w ON {on}) c JOIN {into}{i} w ON {on} GROUP BY {own}, w.a, w.b), "
            f"{name} AS (SELECT {keys}, a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a, b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM {into}h{i})"
        )
    return ", ".join(out)


FITS = f"""e AS ({EVENTS}), i AS (SELECT *, greatest(played, known) + 1 AS comes, played + {WIDTH} + 1 AS goes FROM e), v AS (SELECT * FROM i WHERE comes < goes),
ch AS (SELECT comes AS day, x, 1 AS n, y AS s FROM v UNION ALL SELECT goes, x, -1, -y FROM v), cc AS (SELECT day, x, sum(n) AS n, sum(s) AS s FROM ch GROUP BY 1, 2),
g AS (SELECT x, unnest(range(lo, (SELECT max(comes) + 1 FROM v))) AS day FROM (SELECT x, min(day) AS lo FROM cc GROUP BY 1)),
c AS (SELECT * FROM (SELECT day, x, sum(coalesce(cc.n, 0)) OVER w AS n, sum(coalesce(cc.s, 0)) OVER w AS s FROM g LEFT JOIN cc USING (day, x) WINDOW w AS (PARTITION BY x ORDER BY day)) WHERE n > 0), {newton_sql("c", "day", 1.0, "f")}"""


def _fits(spark, sf):
    return M.daily_fits(returns(spark, sf), "played", "known", "x", "y", WIDTH, LEAST)


@query("opponent_model_days", f"WITH {FITS} SELECT t.day, t.n, round(f.a, 6) AS a, round(f.b, 6) AS b, t.n >= {LEAST} AND f.a IS NOT NULL AS ready FROM (SELECT day, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1) t LEFT JOIN f USING (day)")
def opponent_model_days(spark, sf):
    """The model of each day, from the trailing window's sums."""
    return _fits(spark, sf).select(F.col("day").cast("long").alias("day"), "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "ready")


@query(
    "opponent_offsets",
    f"""WITH {FITS}, x AS (SELECT e.*, 1 / (1 + exp(-(f.a + f.b * e.x))) AS p FROM e JOIN f ON f.day = e.played JOIN (SELECT day FROM c GROUP BY 1 HAVING sum(n) >= {LEAST}) r ON r.day = e.played),
k AS (SELECT *, greatest(played, known) + 1 AS comes, played + {WIDTH} + 1 AS goes FROM x), o AS (SELECT * FROM k WHERE comes < goes),
m AS (SELECT l_suppkey, comes AS day, 1 AS n, y - p AS r, p * (1 - p) AS v FROM o UNION ALL SELECT l_suppkey, goes, -1, p - y, -p * (1 - p) FROM o),
d AS (SELECT l_suppkey, day, sum(n) AS n, sum(r) AS r, sum(v) AS v FROM m GROUP BY 1, 2), u AS (SELECT l_suppkey, day, sum(n) OVER w AS n, sum(r) OVER w AS r, sum(v) OVER w AS v FROM d WINDOW w AS (PARTITION BY l_suppkey ORDER BY day))
SELECT l_suppkey, day, CAST(n AS BIGINT) AS n, round(CASE WHEN n > 0 THEN greatest(-1.5, least(1.5, r / (v + 5))) ELSE 0 END, 6) AS "offset" FROM u""",
)
def opponent_offsets(spark, sf):
    """Suppliers' residual offsets against the model that stood on the day of each line."""
    fits = _fits(spark, sf).where("ready").select(F.col("day").alias("played"), "a", "b")
    e = returns(spark, sf).join(fits, "played").withColumn("expected", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x")))))
    out = M.residual_offsets(e, "l_suppkey", "played", "known", "y", "expected", WIDTH)
    return out.select("l_suppkey", F.col("day").cast("long").alias("day"), "n", F.round("offset", 6).alias("offset"))


CONTEXT = [["l_linenumber", "l_linestatus"], ["l_linenumber"], []]
ENOUGH = [200, 400, 100]


def _level_sql(i: int, by: str) -> str:
    keys = f"{by}, period" if by else "period"
    own = f"{by}, " if by else ""
    part = f"PARTITION BY {own}x"
    joined = f"{own}x, period"
    return f"""q{i} AS (SELECT {own}x, period + 1 AS period, count(*) AS n, sum(y) AS s FROM e GROUP BY {own}x, period),
g{i} AS (SELECT {own}x, unnest(range(lo, (SELECT max(period) + 1 FROM e))) AS period FROM (SELECT {own}x, min(period) AS lo FROM q{i} GROUP BY {own}x)),
c{i} AS (SELECT {own}x, period, sum(coalesce(n, 0)) OVER w AS n, sum(coalesce(s, 0)) OVER w AS s FROM g{i} LEFT JOIN q{i} USING ({joined}) WINDOW w AS ({part} ORDER BY period)),
{newton_sql(f"c{i}", keys, 1.0, f"f{i}_")}, t{i} AS (SELECT f.* FROM f{i}_ f JOIN (SELECT {keys} FROM c{i} GROUP BY {keys} HAVING sum(n) >= {ENOUGH[i]}) USING ({keys}))"""


@query(
    "context_calibrator",
    f"""WITH e AS (SELECT l_linenumber, l_linestatus, x / 10.0 AS x, y, (played // 91)::BIGINT AS period FROM ({EVENTS})),
{_level_sql(0, "l_linenumber, l_linestatus")}, {_level_sql(1, "l_linenumber")}, {_level_sql(2, "")},
j AS (SELECT e.*, CASE WHEN t0.a IS NOT NULL THEN 0 WHEN t1.a IS NOT NULL THEN 1 WHEN t2.a IS NOT NULL THEN 2 ELSE 3 END AS level, coalesce(t0.a, t1.a, t2.a) + coalesce(t0.b, t1.b, t2.b) * e.x AS z
FROM e LEFT JOIN t0 USING (l_linenumber, l_linestatus, period) LEFT JOIN t1 USING (l_linenumber, period) LEFT JOIN t2 USING (period)),
p AS (SELECT *, 1 / (1 + exp(-x)) AS base, 1 / (1 + exp(-z)) AS q FROM j)
SELECT l_linenumber, l_linestatus, CAST(level AS INT) AS level, count(*) AS n, round(avg(-(y * ln(base) + (1 - y) * ln(1 - base))), 6) AS base_log_loss, round(avg(-(y * ln(greatest(1e-9, least(1 - 1e-9, q))) + (1 - y) * ln(1 - greatest(1e-9, least(1 - 1e-9, q))))), 6) AS log_loss FROM p GROUP BY 1, 2, 3""",
)
def context_calibrator(spark, sf):
    """A confidence recalibrated by context each quarter, from earlier quarters alone; by group and fallback level, its loss
    beside that of the confidence as it was."""
    e = returns(spark, sf).withColumns({"period": F.floor(F.col("played") / 91).cast("long"), "x": F.col("x") / 10.0})
    out = M.context_calibrated(e, CONTEXT, "period", "x", "y", ENOUGH)
    base = 1 / (1 + F.exp(-F.col("x")))
    loss = lambda p: F.round(F.avg(log_loss(F.col("y"), p)), 6)
    return out.groupBy("l_linenumber", "l_linestatus", "level").agg(F.count(F.lit(1)).alias("n"), loss(base).alias("base_log_loss"), loss(F.col("calibrated")).alias("log_loss"))
