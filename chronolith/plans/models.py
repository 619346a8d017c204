"""Queries over calibrators, ensembles, estimators, incremental ratings and roster changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import log_loss
from ..operators import calibration as C, estimators as E, folds as R, incremental as I
from ..sources.io import table
from ..sources.staging import stage
from .aggregates import PRED, predictions
from .folds import GAMES_SQL, ORDER, elo_sql, games
from .registry import query
from .validation import models


def _fit_rows(spark, sf):
    return models(spark, sf).withColumn("held", F.col("period") >= 14)


@query("beta_calibration")
def beta_calibration(spark, sf):
    rows = _fit_rows(spark, sf)
    return C.apply(rows.where("held"), "m1", C.fit(rows.where("NOT held"), "y", "m1", "beta"), "calibrated").select("doc_id", "y", "m1", "calibrated")


@query("venn_abers")
def venn_abers(spark, sf):
    rows = _fit_rows(spark, sf)
    return C.apply(rows.where("held"), "m1", C.fit(rows.where("NOT held"), "y", "m1", "venn_abers"), "calibrated").select("doc_id", "y", "m1", "calibrated")


@query("calibrator_tournament")
def calibrator_tournament(spark, sf):
    """Every calibrator fitted on earlier periods, chosen by log loss on later ones."""
    return C.select(_fit_rows(spark, sf), "y", "m1", F.col("held"))


@query("convex_ensemble")
def convex_ensemble(spark, sf):
    w = C.convex_weights(models(spark, sf), "y", ["m1", "m2", "m3"])
    return spark.createDataFrame(list(w.items()), "model string, weight double")


NUMERIC, CATEGORICAL = ["quantity", "discount", "tax", "lines"], ["priority", "segment"]


def order_features(spark, sf):
    """A row for each order: target, a few numbers with gaps, categories with nulls."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.avg("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.min("l_tax").alias("tax"), F.count(F.lit(1)).alias("lines"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y")
    )
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, sf, "orders").join(li, "o_orderkey").join(c, "o_custkey", "left")
    gap = lambda c, n: F.when(F.col("o_orderkey") % n != 0, F.col(c)).alias(c)
    return o.select("o_orderkey", F.year("o_orderdate").alias("year"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("quarter"), "y", gap("quantity", 11), gap("discount", 7), "tax", F.col("lines").cast("double").alias("lines"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"), "segment")


@query(
    "preprocess_scaled",
    """WITH f AS (SELECT l_orderkey AS o_orderkey, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1), g AS (SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 11 <> 0 THEN quantity END AS q, year(o_orderdate) < 1996 AS train, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, 'none') AS priority FROM orders o JOIN f USING (o_orderkey)),
m AS (SELECT avg(q) AS fill FROM g WHERE train), s AS (SELECT avg(coalesce(q, fill)) AS mean, stddev_samp(coalesce(q, fill)) AS sd FROM g, m WHERE train)
SELECT o_orderkey, round((coalesce(q, fill) - mean) / sd, 6) AS scaled, CAST(priority = '1-URGENT' AS INT) AS is_urgent, CAST(priority = 'none' AS INT) AS is_null FROM g, m, s""",
)
def preprocess_scaled(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    d = order_features(spark, sf)
    ready = E.prepared(d, ["quantity"], ["priority"])
    model = Pipeline(stages=E.preprocessor(["quantity"], ["priority"])).fit(ready.where("year < 1996"))
    names = model.stages[3].labels
    out = model.transform(ready).withColumn("v", vector_to_array("features"))
    hot = lambda name: F.col("v")[1 + names.index(name)].cast("int") if name in names else F.lit(0)
    return out.select("o_orderkey", F.round(F.col("v")[0], 6).alias("scaled"), hot("1-URGENT").alias("is_urgent"), hot(E.NULL).alias("is_null"))


@query("estimator_zoo")
def estimator_zoo(spark, sf):
    """Held-out metrics of each estimator: fitted before 1996, tested from then on."""
    d = stage(order_features(spark, sf).select("year", "y", *NUMERIC, *CATEGORICAL), "zoo")
    out = None
    for name, p in E.compare(d.where("year < 1996"), d.where("year >= 1996"), "y", NUMERIC, CATEGORICAL, list(E.ZOO)).items():
        m = p.agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(F.col("y"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p"))))).alias("log_loss"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")).alias("accuracy"))
        m = m.select(F.lit(name).alias("estimator"), "*")
        out = m if out is None else out.unionByName(m)
    return out


@query("segment_backtest")
def segment_backtest(spark, sf):
    d = order_features(spark, sf).withColumn("segment_", F.when(F.col("priority").isNull(), "low").otherwise("other"))
    return E.backtest(d, "segment_", "year", "y", "o_orderkey", ["quantity", "tax", "lines"], ["segment"])


@query("feature_gate")
def feature_gate(spark, sf):
    """Families of features, each added only if it lowers the log loss on the inner validation years."""
    families = {"counts": ["lines"], "prices": ["discount", "tax"], "quantity": ["quantity"]}
    d = stage(order_features(spark, sf).select("year", "y", *[c for cols in families.values() for c in cols]), "gate")  # each fit reads it many times
    train, held = d.where("year < 1997"), d.where("year = 1997")
    loss = lambda cols: E.fit_predict(train, held, "y", cols, []).agg(F.avg(log_loss(F.col("y"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))))).first()[0]
    kept, rows, best = [], [], float("inf")
    for name, cols in families.items():
        now = loss([*kept, *cols])
        rows.append((name, now, now < best))
        if now < best:
            kept, best = [*kept, *cols], now
    return spark.createDataFrame(rows, "family string, log_loss double, added boolean")


@query("scoreline_classes")
def scoreline_classes(spark, sf):
    """Four classes from an order's lines; probabilities don't depend on which side comes first."""
    d = order_features(spark, sf).withColumn("edge", F.col("discount") - F.col("tax")).withColumn("score", F.when(F.col("edge").isNull() | (F.col("edge") < -0.02), 0).when(F.col("edge") < 0, 1).when(F.col("edge") < 0.02, 2).otherwise(3))
    return E.multiclass(d.where("year < 1996"), d.where("year >= 1996"), "score", "o_orderkey", ["edge", "lines"], 4, ["edge"])


@query(
    "redundant_columns",
    """WITH d AS (SELECT row_number() OVER () AS r, l_quantity AS q, l_quantity + 0 AS same, 3.0::DOUBLE AS flat, l_tax FROM lineitem),
v AS (SELECT r, 1 AS i, 'q' AS c, round(q, 12) AS v FROM d UNION ALL SELECT r, 2, 'same', round(same, 12) FROM d UNION ALL SELECT r, 3, 'flat', round(flat, 12) FROM d UNION ALL SELECT r, 4, 'l_tax', round(l_tax, 12) FROM d),
k AS (SELECT i, c, min(coalesce(v, 0)) = max(coalesce(v, 0)) AS fixed FROM v GROUP BY 1, 2),
p AS (SELECT b.i, b.c, min_by(a.c, a.i) AS of FROM (SELECT x.i AS ai, y.i AS bi FROM v x JOIN v y ON x.r = y.r AND x.i < y.i GROUP BY 1, 2 HAVING count(*) FILTER (WHERE coalesce(x.v, 0) <> coalesce(y.v, 0)) = 0) e JOIN k a ON a.i = e.ai JOIN k b ON b.i = e.bi WHERE NOT a.fixed GROUP BY 1, 2)
SELECT c AS "column", 'constant' AS reason, NULL::VARCHAR AS of FROM k WHERE fixed UNION ALL SELECT p.c, 'duplicate', p.of FROM p JOIN k USING (i) WHERE NOT k.fixed""",
)
def redundant_columns(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_quantity") + 0).alias("same"), F.lit(3.0).alias("flat"), "l_tax")
    return E.redundant(d, ["q", "same", "flat", "l_tax"])


@query(
    "odds_architectures",
    f"""WITH x AS (SELECT doc_id, y, (doc_id % 89 + 5) / 99.0 AS odds, p, CASE WHEN abs((doc_id % 89 + 5) / 99.0 - 0.5) < 0.15 THEN 'close' ELSE 'clear' END AS regime FROM ({PRED}) WHERE p IS NOT NULL),
m AS (SELECT regime, y, 'odds' AS arch, odds AS q FROM x UNION ALL SELECT regime, y, 'model', p FROM x UNION ALL SELECT regime, y, 'blend', 0.5 * odds + 0.5 * p FROM x)
SELECT arch, regime, count(*) AS n, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg((q - y) * (q - y)), 6) AS brier FROM m GROUP BY 1, 2""",
)
def odds_architectures(spark, sf):
    odds = (F.col("doc_id") % 89 + 5) / 99.0
    x = predictions(spark, sf).where("p IS NOT NULL").withColumn("odds", odds).withColumn("regime", F.when(F.abs(odds - 0.5) < 0.15, "close").otherwise("clear"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("arch"), v.alias("q")) for k, v in {"odds": F.col("odds"), "model": F.col("p"), "blend": 0.5 * F.col("odds") + 0.5 * F.col("p")}.items()])).alias("a")
    m = x.select("regime", "y", each).select("regime", "y", "a.*")
    return m.groupBy("arch", "regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(log_loss(F.col("y"), F.col("q"))), 6).alias("log_loss"), F.round(F.avg((F.col("q") - F.col("y")) ** 2), 6).alias("brier"))


CUT = 2200  # days after 1990-01-01


def _parts(spark, sf):
    g = games(spark, sf)
    rate = lambda d: R.fold(d, ["universe"], ORDER, ["a", "b", "y"], R.elo_step(), I.SIDES, keep=["a", "b", "y", "day", "game"])
    return g.where(F.col("day") <= CUT), g.where(F.col("day") > CUT), rate


@query("elo_seeded", elo_sql("32 * (y - e)", f"AND on_day > {CUT}"))
def elo_seeded(spark, sf):
    """Games after the cut, continued from the states that the games before it left."""
    old, new, rate = _parts(spark, sf)
    states = I.states_after(rate(old), "universe", ORDER)
    return I.seeded_elo(states, new, "universe", ORDER, ["game"]).select("universe", "game", "b", *[F.round(c, 6).alias(c) for c in ("rating_a", "rating_b", "expected")])


@query("elo_checkpoints")
def elo_checkpoints(spark, sf):
    _, _, rate = _parts(spark, sf)
    return I.block_checkpoints(rate(games(spark, sf)), "universe")


@query(
    "elo_states",
    f"""WITH o AS ({elo_sql("32 * (y - e)", digits=15)}), {GAMES_SQL}, x AS (SELECT g.universe, g.day, g.game, g.b AS opp, unnest([{{'e': g.a, 'r': rating_a + 32 * (g.y - expected)}}, {{'e': g.b, 'r': rating_b - 32 * (g.y - expected)}}]) AS s FROM g JOIN o ON o.universe = g.universe AND o.game = g.game AND o.b = g.b)
SELECT universe, s.e AS entity, round(arg_max(s.r, {{'d': day, 'g': game, 'b': opp}}), 6) AS rating, max(day) AS day FROM x GROUP BY 1, 2""",
)
def elo_states(spark, sf):
    _, _, rate = _parts(spark, sf)
    return I.states_after(rate(games(spark, sf)), "universe", ORDER).withColumn("rating", F.round("rating", 6))


@query(
    "roster_adjusted",
    """WITH r AS (SELECT user_id, [user_id, user_id + 1, user_id + 2, user_id + 3, user_id + 4] AS now, [user_id + e, user_id + 1 + e, user_id + 2 + e, user_id + 3 + e, user_id + 4 + e] AS old, gap, rating, rd FROM (SELECT DISTINCT user_id, user_id % 7 AS e, user_id % 250 + 1 AS gap, 1300.0 + user_id % 500 AS rating, 60.0 + user_id % 200 AS rd FROM events)),
k AS (SELECT *, CASE WHEN gap <= 90 THEN CAST(len(list_intersect(now, old)) AS INT) END AS retained FROM r), f AS (SELECT *, CASE WHEN 5 - retained >= 2 THEN 0.2 + 0.8 * retained / 5 ELSE 1.0 END AS credit FROM k)
SELECT user_id, retained, round(credit, 6) AS credit, round(1500 + credit * (rating - 1500), 6) AS rating_adjusted, round(CASE WHEN credit < 1 THEN least(350.0, sqrt(credit * rd * rd + (1 - credit) * 350.0 * 350.0)) ELSE rd END, 6) AS rd_adjusted FROM f""",
)
def roster_adjusted(spark, sf):
    u = F.col("user_id")
    five = lambda shift: F.array(*[u + i + shift for i in range(5)])
    r = table(spark, sf, "events").select("user_id").distinct().select("user_id", five(F.lit(0)).alias("now"), five(u % 7).alias("old"), (u % 250 + 1).alias("gap"), (1300.0 + u % 500).alias("rating"), (60.0 + u % 200).alias("rd"))
    out = I.roster_adjusted(r, "now", "old", "gap", "rating", "rd")
    return out.select("user_id", "retained", *[F.round(c, 6).alias(c) for c in ("credit", "rating_adjusted", "rd_adjusted")])


@query("projection_defaults", "SELECT s_suppkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, 0.0) AS balance, coalesce(CASE WHEN s_nationkey > 5 THEN s_nationkey END, 0) AS nation FROM supplier")
def projection_defaults(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", F.coalesce(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")), F.lit(0.0)).alias("balance"), F.coalesce(F.when(F.col("s_nationkey") > 5, F.col("s_nationkey")), F.lit(0)).alias("nation"))


@query("batched_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0)")
def batched_lookup(spark, sf):
    """Keys that are present, of a set that is asked for; the keys are joined, whatever their number."""
    keys = table(spark, sf, "lineitem").where("l_quantity = 50 AND l_discount = 0").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query(
    "calibration_input",
    """SELECT p.doc_id, p.p, p.y, d.lang, d.source, CAST(d.doc_id IS NULL AS INT) AS missing FROM (SELECT doc_id, (doc_id * 37 % 997 + 1) / 999.0 AS p, quality AS y FROM labels) p LEFT JOIN (SELECT * FROM documents WHERE source <> 'src3') d USING (doc_id)""",
)
def calibration_input(spark, sf):
    p = table(spark, sf, "labels").select("doc_id", ((F.col("doc_id") * 37 % 997 + 1) / 999.0).alias("p"), F.col("quality").alias("y"))
    d = table(spark, sf, "documents").where("source <> 'src3'").select("doc_id", "lang", "source", F.lit(1).alias("there"))
    return p.join(d, "doc_id", "left").select("doc_id", "p", "y", "lang", "source", F.col("there").isNull().cast("int").alias("missing"))


@query(
    "failure_frame",
    """SELECT o.o_orderkey, l.lines, l.returned, CAST((o.o_totalprice > 150000) <> (l.returned > 0) AS INT) AS failed, abs(o.o_totalprice / 300000 - (l.returned > 0)::INT) AS error FROM orders o JOIN (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey""",
)
def failure_frame(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    o = table(spark, sf, "orders").join(li, "o_orderkey").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    hit = (F.col("returned") > 0).cast("int")
    return o.select("o_orderkey", "lines", "returned", ((F.col("o_totalprice") > 150000).cast("int") != hit).cast("int").alias("failed"), F.abs(F.col("o_totalprice") / 300000 - hit).alias("error"))


@query(
    "chosen_participant",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE 'unknown' END AS side, o_orderpriority AS snapshot FROM orders",
)
def chosen_participant(spark, sf):
    """The authoritative value first, then the captured one; the snapshot stays beside it."""
    o = table(spark, sf, "orders")
    side = F.coalesce(F.when(F.col("o_orderstatus") == "F", "final"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), F.lit("unknown"))
    return o.select("o_orderkey", side.alias("side"), F.col("o_orderpriority").alias("snapshot"))


@query(
    "post_play_features",
    """WITH e AS (SELECT l_orderkey, l_suppkey, l_shipdate, avg(l_quantity) OVER w AS edge, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT l_orderkey, count(*) AS played, count(*) FILTER (n > 0) AS with_history, min(n) AS min_history, round(coalesce(avg(edge), 0), 6) AS mean_edge FROM e GROUP BY 1""",
)
def post_play_features(spark, sf):
    from pyspark.sql import Window

    day = F.unix_date(F.col("l_shipdate").cast("date"))
    w = Window.partitionBy("l_suppkey").orderBy(day).rangeBetween(-365, -1)
    e = table(spark, sf, "lineitem").select("l_orderkey", F.avg("l_quantity").over(w).alias("edge"), F.count(F.lit(1)).over(w).alias("n"))
    return e.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("played"), F.count_if(F.col("n") > 0).alias("with_history"), F.min("n").alias("min_history"), F.round(F.coalesce(F.avg("edge"), F.lit(0.0)), 6).alias("mean_edge"))


@query(
    "complete_lineups",
    """WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS five FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1), a AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS announced FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1)
SELECT l_orderkey, CAST(len(list_filter(announced, lambda x: NOT list_contains(five, x))) AS INT) AS foreign_players, CAST(len(list_filter(five, lambda x: NOT list_contains(announced, x))) AS INT) AS missing_players FROM s JOIN a USING (l_orderkey) WHERE len(five) = 5""",
)
def complete_lineups(spark, sf):
    li = table(spark, sf, "lineitem")
    five = li.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("five")).where(F.size("five") == 5)
    a = li.where("l_linenumber <= 5").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("announced"))
    return five.join(a, "l_orderkey").select("l_orderkey", F.size(F.array_except("announced", "five")).alias("foreign_players"), F.size(F.array_except("five", "announced")).alias("missing_players"))


@query("score_distribution", "SELECT o_orderkey, round(p * p, 6) AS p20, round(2 * p * p * (1 - p), 6) AS p21, round(2 * p * (1 - p) * (1 - p), 6) AS p12, round((1 - p) * (1 - p), 6) AS p02 FROM (SELECT o_orderkey, 0.5 * ((o_orderkey % 97 + 1) / 99.0 + 1 - (o_orderkey % 89 + 1) / 99.0) AS p FROM orders)")
def score_distribution(spark, sf):
    """Series scores from a map probability made symmetric by both orientations."""
    k = F.col("o_orderkey")
    p = 0.5 * ((k % 97 + 1) / 99.0 + 1 - (k % 89 + 1) / 99.0)
    o = table(spark, sf, "orders").select("o_orderkey", p.alias("p"))
    return o.selectExpr("o_orderkey", "round(p * p, 6) p20", "round(2 * p * p * (1 - p), 6) p21", "round(2 * p * (1 - p) * (1 - p), 6) p12", "round((1 - p) * (1 - p), 6) p02")
