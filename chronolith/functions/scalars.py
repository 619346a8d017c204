"""Column expressions: casts, odds, ratings, dates, text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def devig(q1: Column, q2: Column, low: float = 1.001, high: float = 100.0, under: float = 0.9, over: float = 1.5) -> Column:
    """First side's probability from two decimal odds, proportionally; null if either is out of
    [low, high] or their overround out of [under, over]."""
    book = 1 / q1 + 1 / q2
    return F.when(q1.between(low, high) & q2.between(low, high) & book.between(under, over), (1 / q1) / book)


def closing_line_value(opening: Column, closing: Column) -> Column:
    return F.try_divide(opening, closing) - 1


def kelly(p: Column, odds: Column) -> Column:
    return F.when(odds > 1, F.greatest(F.lit(0.0), (p * odds - 1) / (odds - 1))).otherwise(0.0)


def expected_score(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def dynamic_k(n: Column) -> Column:
    return 250 / F.pow(n + 5, F.lit(0.4))


def mixed_rating(general: Column, surface: Column, w: float = 0.5) -> Column:
    return F.coalesce((1 - w) * general + w * surface, general)


def sigmoid(x: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def logit(p: Column, eps: float = 1e-9) -> Column:
    c = clipped(p, eps)
    return F.ln(c / (1 - c))


def clipped(p: Column, eps: float = 1e-9) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, to 1.5e-7 (a rational approximation of erf)."""
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def log_loss(y: Column, p: Column) -> Column:
    c = clipped(p)
    return -(y * F.ln(c) + (1 - y) * F.ln(1 - c))


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def toward_half(p: Column, r: Column) -> Column:
    return 0.5 + r * (p - 0.5)


def blend(p: Column, q: Column, w: Column) -> Column:
    return F.coalesce((1 - w) * p + w * q, p)


def recency_weight(age: Column, half_life: float) -> Column:
    return F.pow(F.lit(0.5), age / half_life)


def gap_bin(gap: Column) -> Column:
    g = F.abs(gap)
    return F.when(g < 50, "0-50").when(g < 100, "50-100").when(g < 200, "100-200").when(g < 300, "200-300").otherwise("300+")


def confidence_band(p: Column) -> Column:
    c = F.greatest(p, 1 - p)
    return F.when(c < 0.55, "<.55").when(c < 0.65, ".55-.65").when(c < 0.80, ".65-.80").otherwise(">=.80")


def normal_name(x: Column) -> Column:
    """Lower case, other characters than letters and digits to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def week_index(day: Column) -> Column:
    """Weeks since day 1 of year 1."""
    return F.floor((F.datediff(day, F.lit("1970-01-01").cast("date")) + 719163) / 7).cast("long")


def months_before(day: Column, n: int) -> Column:
    """n calendar months back, clamped to the month's end."""
    return F.add_months(day, -n)


def age_years(birth: Column, day: Column) -> Column:
    days = F.datediff(day, birth)
    return F.when(days >= 0, days / 365.2425)


def money(x: Column) -> Column:
    """'$5K', 'EUR 20,000', '$1.2M' as numbers; null for other text."""
    n = F.regexp_extract(x, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([KkMm]?)", 1)
    unit = F.lower(F.regexp_extract(x, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*([KkMm]?)", 2))
    times = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
    return F.regexp_replace(n, ",", "").try_cast("double") * times


def match_format(x: Column) -> Column:
    n = F.regexp_extract(F.lower(x), r"\b(?:bo|best of )([135])\b", 1)
    return F.when(n != "", F.concat(F.lit("bo"), n)).otherwise("other")


def pair_id(a: Column, b: Column, *rest: Column) -> Column:
    """Stable id of an unordered pair."""
    return F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b), *rest), 256)


def orientation(*parts: Column) -> Column:
    """0 or 1 from the lowest bit of a SHA-256: which side comes first."""
    return (F.conv(F.right(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1)), 16, 10).cast("int") % 2).cast("int")


def best_of_three(p1: Column, p2: Column, p3: Column) -> Column:
    """Chance of winning two of three maps with these chances."""
    return p1 * p2 + p1 * (1 - p2) * p3 + (1 - p1) * p2 * p3


def set_scores(score: Column) -> Column:
    """'6-4 3-6 7-6(5)' as an array of (a, b, tiebreak); other tokens give no element."""
    tokens = F.regexp_extract_all(score, F.lit(r"(?:^|\s)([0-9]+-[0-9]+(?:\([0-9]+\))?)(?=\s|$)"), F.lit(1))
    part = lambda t, i: F.regexp_extract(t, r"^([0-9]+)-([0-9]+)(?:\(([0-9]+)\))?$", i)
    return F.transform(tokens, lambda t: F.struct(part(t, 1).cast("int").alias("a"), part(t, 2).cast("int").alias("b"), part(t, 3).try_cast("int").alias("tiebreak")))
