"""Composite operators built from the families."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import log_loss
from .windows import prior


def stat_window(df: DataFrame, team: str, date: str, player: str, days: list[int], least_players: int, least_maps: int) -> DataFrame:
    """For each team the index of the window (``days`` back from the last date) to use: the first one
    with enough players and maps, else the one with most players, then maps."""
    hi = df.agg(F.max(date).cast("date").alias("__hi"))  # one row
    age = F.datediff(F.col("__hi"), F.col(date).cast("date"))
    d = df.crossJoin(F.broadcast(hi)).withColumn("__age", age).where(F.col("__age") < max(days))
    win = F.filter(F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(n).alias("days")) for i, n in enumerate(days)]), lambda w: F.col("__age") < w["days"])
    g = d.select(team, player, F.explode(win).alias("w")).groupBy(team, "w.prio").agg(F.count_distinct(player).alias("n"), F.count(F.lit(1)).alias("m"))
    ok = (F.col("n") >= least_players) & (F.col("m") >= least_maps)
    order = F.struct(ok, F.when(ok, -F.col("prio")).otherwise(0), "n", "m", -F.col("prio"))
    return g.groupBy(team).agg(F.max_by("prio", order).alias("prio"))


def strength_of_schedule(df: DataFrame, keys: list[str], order: list[str], x: str, seconds: str, n: int, half_life: float, empty: float = 1500.0) -> DataFrame:
    """``decayed``: mean of the last n prior values weighted by age in fractional days, and their
    population deviation ``spread``."""
    w = prior(keys, order, n)
    d = df.withColumn("__past", F.collect_list(F.struct(F.col(x).alias("x"), F.col(seconds).alias("s"))).over(w))
    weight = lambda r: F.pow(F.lit(0.5), (F.col(seconds) - r["s"]) / 86400 / half_life)
    num = F.aggregate("__past", F.lit(0.0), lambda a, r: a + weight(r) * r["x"])
    den = F.aggregate("__past", F.lit(0.0), lambda a, r: a + weight(r))
    return d.withColumn("decayed", F.coalesce(F.try_divide(num, den), F.lit(empty))).withColumn("spread", F.coalesce(F.stddev_pop(x).over(w), F.lit(0.0))).drop("__past")


def identity_merge(df: DataFrame, key: str, norm: str, external: str) -> DataFrame:
    """``canonical``: the least key of rows with one normal name, if they have at most one external id
    between them; else each row's own."""
    g = df.groupBy(norm).agg(F.min(key).alias("__first"), F.min(external).alias("__lo"), F.max(external).alias("__hi"))
    same = F.coalesce(F.col("__lo") == F.col("__hi"), F.lit(True))
    return df.join(g, norm).withColumn("canonical", F.when(same, F.col("__first")).otherwise(F.col(key))).drop("__first", "__lo", "__hi")


def routed(market: Column, base: Column, w: float) -> Column:
    """The blend where there is a market probability, else the base model's."""
    return F.when(market.isNotNull(), w * market + (1 - w) * base).otherwise(base)


def blend_weights(df: DataFrame, period: str, y: str, p: str, q: str, weights: list[float]) -> DataFrame:
    """For each period the weight of q in (1 - w) p + w q with the least loss over earlier periods (the
    first at a tie)."""
    losses = [F.sum(log_loss(F.col(y), (1 - w) * F.col(p) + w * F.col(q))).alias(f"l{i}") for i, w in enumerate(weights)]
    per = df.groupBy(period).agg(*losses)
    past = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, -1)  # a row for each period
    each = [F.struct(F.coalesce(F.sum(f"l{i}").over(past), F.lit(0.0)).alias("loss"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(weights)]
    return per.select(period, F.array_min(F.array(*each))["w"].alias("weight"))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p-values of 2 x 2 tables: the sum over all tables as unlikely as the one seen. From either end of the
    likelier ones it goes outwards until terms no longer count, so it takes as many steps as the tail is wide."""

    def one(a: int, b: int, c: int, d: int) -> float:
        lg = math.lgamma
        r, k, n = a + b, a + c, a + b + c + d
        lo, hi = max(0, k - (n - r)), min(r, k)

        def log_p(x: int) -> float:
            return lg(r + 1) - lg(x + 1) - lg(r - x + 1) + lg(n - r + 1) - lg(k - x + 1) - lg(n - r - k + x + 1) - lg(n + 1) + lg(k + 1) + lg(n - k + 1)

        top, seen = min(hi, max(lo, (r + 1) * (k + 1) // (n + 2))), log_p(a) + 1e-9

        def edge(inner: int, outer: int, way: int) -> int:
            """The first table from ``inner`` to ``outer`` that is as unlikely as the one seen; one beyond, if none is."""
            if log_p(outer) > seen:
                return outer + way
            near, far = 0, abs(outer - inner)
            while near < far:
                mid = (near + far) // 2
                near, far = (near, mid) if log_p(inner + way * mid) <= seen else (mid + 1, far)
            return inner + way * near

        total = 0.0
        left, right = edge(top, lo, -1), edge(top, hi, 1)
        for start, stop, way in ((left, lo - 1, -1), (right if right != left else right + 1, hi + 1, 1)):
            for x in range(start, stop, way):
                term = math.exp(log_p(x))
                total += term
                if term < 1e-18 * total:
                    break
        return min(1.0, total)

    return pd.Series([one(*map(int, t)) for t in zip(a, b, c, d, strict=True)])


def history_state(games: DataFrame, universe: list[str], order: list[str], event: str, k: float = 32.0) -> DataFrame:
    """State of each side (``team``) after all games (a, b, y, margin, day; ratings before them from the
    Elo fold): games, wins, mean margin, mean rating of opponents, last day and rating, over all events
    (``whole`` 1) and by event (``whole`` 0, the rating as it stood after the last game of the event)."""

    def side(own: str, other: str, rating: str, rival: str, sign: int) -> Column:
        won = F.col("y").cast("int") if sign > 0 else 1 - F.col("y").cast("int")
        e = F.col("expected") if sign > 0 else 1 - F.col("expected")
        return F.struct(F.col(own).alias("team"), won.alias("won"), (sign * F.col("margin")).alias("diff"), F.col(rival).alias("rival"), (F.col(rating) + k * (won - e)).alias("after"))

    both = F.explode(F.array(side("a", "b", "rating_a", "rating_b", 1), side("b", "a", "rating_b", "rating_a", -1))).alias("s")
    rows = games.select(*universe, *order, F.col(event).alias("event"), both).select("*", "s.*")
    # sides leave the fold's few tasks before they are added up, and whole states are those of events added up
    per = rows.repartition(*universe, "team").groupBy(*universe, "team", "event").agg(
        F.count(F.lit(1)).alias("n"), F.sum("won").alias("won"), F.max("day").alias("day"), F.max(F.struct(*order, "after")).alias("last"),
        *[f(c).alias(f"{name}_{c}") for c in ("diff", "rival") for name, f in (("sum", F.sum), ("n", F.count))],
    )
    keys = [F.col(c) for c in [*universe, "team"]]
    mean = lambda c: F.try_divide(F.sum(f"sum_{c}").cast("double"), F.sum(f"n_{c}"))
    return per.groupingSets([keys, [*keys, F.col("event")]], *keys, F.col("event")).agg(
        F.grouping("event").cast("int").alias("whole"), F.sum("n").alias("games"), F.sum("won").alias("wins"), mean("diff").alias("mean_margin"),
        mean("rival").alias("opponents"), F.max("day").alias("last_day"), F.max("last")["after"].alias("rating"),
    )


#: English names of months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def ranking_badges(pages: DataFrame, key: str, html: str, host: str, labels: dict[str, str], css: str = "ranking-badge", param: str = "teamId") -> DataFrame:
    """(key, team, kind, position, published, url) of a page's badges: links of a class whose text is
    ``label: #rank`` and whose address is ``/kind/teams/year/month/day[/team]`` on the host. ``labels``
    maps kinds (the first part of the path) to labels. The team, by path or parameter, has to be one
    number; the date is that of the edition. Badges that don't say all this are left out, and so
    are a page's badges of one team and kind that contradict each other."""
    kinds = "|".join(labels)
    path = rf"^(?:https://{re.escape(host)})?/({kinds})/teams/(\d{{4}})/([a-z]+)/([0-9]{{1,2}})(?:/([0-9]+))?(?:\?([^#]*))?(?:#.*)?$"
    link = F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), 0)).alias("a")
    attr = lambda name: F.regexp_extract("a", rf"(?is)^<a\b[^>]*?\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    d = pages.select(key, link).where(F.array_contains(F.split(attr("class"), r"\s+"), css))
    d = d.withColumn("href", F.replace(attr("href"), F.lit("&amp;"), F.lit("&"))).withColumn("said", F.trim(F.regexp_replace("a", "<[^>]*>", " ")))
    kind, year, month, day, own, asked = (F.regexp_extract("href", path, i) for i in range(1, 7))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), kind)
    teams = F.array_distinct(F.filter(F.concat(F.array(own), F.regexp_extract_all(asked, F.lit(rf"(?:^|&){param}=([^&]*)"), 1)), lambda t: t != ""))
    # the label before ": #rank", letter by letter
    rank = F.regexp_extract("said", r"^(.*?)\s*:\s*#\s*([1-9][0-9]*)$", 2)
    named = F.regexp_extract("said", r"^(.*?)\s*:\s*#\s*([1-9][0-9]*)$", 1) == label
    date = F.try_to_timestamp(F.concat_ws("-", year, F.array_position(F.array(*map(F.lit, MONTHS)), month), day), F.lit("yyyy-M-d")).cast("date")
    d = d.where(kind != "").select(key, teams.alias("teams"), kind.alias("kind"), rank.try_cast("int").alias("position"), named.alias("named"), date.alias("published"), "href")
    d = d.where((F.size("teams") == 1) & F.get("teams", F.lit(0)).rlike("^[0-9]+$") & F.col("named") & F.col("position").isNotNull() & F.col("published").isNotNull())
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(f"https://{host}"), "href")).otherwise(F.col("href"))
    row = F.struct("position", "published", url.alias("url"))
    g = d.groupBy(key, F.get("teams", F.lit(0)).alias("team"), "kind").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    return g.where("lo = hi").select(key, "team", "kind", "lo.*")


class _Items(HTMLParser):
    def __init__(self, tag: str):
        super().__init__()
        self.tag, self.rows, self.depth, self.href = tag, [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag == self.tag:
            self.depth += 1
            self.rows.append(["", None])
        elif self.depth and tag == "a":
            self.rows[-1][1] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag == self.tag and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.rows[-1][0] += data


def html_table(pages: DataFrame, key: str, html: str, tag: str) -> DataFrame:
    """(key, pos, text, href) for each element of a tag; a page without one gives no row."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[html], strict=True):
                parser = _Items(tag)
                parser.feed(text or "")
                out += [(k, i, t.strip(), href) for i, (t, href) in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=[key, "pos", "text", "href"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, pos long, text string, href string")
