"""Strict text values: what isn't exactly in its form is null, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def utc_instant(x: Column) -> Column:
    """A timestamp of text in ISO form with an offset or a Z; null without one, as a naive time names no instant."""
    text = F.trim(x)
    form = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(form, F.try_to_timestamp(F.regexp_replace(text, " ", "T")))


def civil_date(x: Column) -> Column:
    """The date of ISO text, with or without a time after it; null for other text and for days that no calendar has."""
    text = F.trim(x)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?$"), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def date_precision(x: Column) -> Column:
    """'exact' if ISO text has a time, 'date_only' if it has a date alone, null if neither."""
    return F.when(civil_date(x).isNotNull(), F.when(F.trim(x).rlike(r"^.{10}[T ][0-9]{2}:[0-9]{2}"), "exact").otherwise("date_only"))


def same_day(x: Column, y: Column) -> Column:
    """Whether two ISO texts begin with the same date."""
    return F.substring(x, 1, 10) == F.substring(y, 1, 10)


def slug(x: Column) -> Column:
    """One segment of a path as it stands; null if it is empty or has a slash, a question or number sign, white space or control
    characters."""
    return F.when((x != "") & ~x.rlike(r"[/?#\p{javaWhitespace}\x00-\x1F]"), x)


def before_birthday(birth: Column, day: Column, years: int = 10) -> Column:
    """Whether ``day`` lies before the birthday (a 29 February's is the 28th in other years)."""
    return day < F.add_months(birth, 12 * years)
