"""Text fields: names, flags, keyword scores, dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def surname_initial(name: Column) -> Column:
    """(surname, initial), lower case, of 'Surname Parts X.'; nulls for other text."""
    n = F.lower(F.trim(name))
    ok = n.rlike(r"^.+\s+\p{L}\.?$")
    surname = F.regexp_extract(n, r"^(.+?)\s+(\p{L})\.?$", 1)
    return F.struct(F.when(ok, surname).alias("surname"), F.when(ok, F.regexp_extract(n, r"^(.+?)\s+(\p{L})\.?$", 2)).alias("initial"))


def stage_flags(text: Column, words: dict[str, str]) -> list[Column]:
    """0/1 columns: is the word in the text, in any case."""
    low = F.lower(text)
    return [low.contains(w).cast("int").alias(k) for k, w in words.items()]


def keyword_score(text: Column, good: list[str], bad: list[str]) -> Column:
    """Occurrences of good words less those of bad ones, in any case."""
    low = F.lower(text)
    hits = lambda ws: reduce(lambda a, w: a + F.regexp_count(low, F.lit(w)), ws, F.lit(0))
    return (hits(good) - hits(bad)).cast("long")


def one_of(text: Column, names: list[str]) -> Column:
    """The name that the text is, in any case and trimmed; null if it is none of them."""
    low = F.lower(F.trim(text))
    return reduce(lambda out, n: F.when(low == n.lower(), n).otherwise(out), names, F.lit(None).cast("string"))


def settlement_kind(q1: Column, q2: Column, first_won: Column) -> Column:
    """Did the market's favourite win: 'favourite', 'upset', or 'even' without one."""
    return F.when(q1 == q2, "even").when((q1 < q2) == first_won, "favourite").otherwise("upset")
