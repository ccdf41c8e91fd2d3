"""Availability text to dates. The reference date is always an argument."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of

# Fixed values.
IMMEDIATE = ("now", "today", "immediately", "immediate", "asap", "available now")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
PAST_DAYS, FUTURE_DAYS, GRACE_DAYS = 365, 730, 31
DMY = r"\b(\d{1,2})\s*[/.-]\s*(\d{1,2})\s*[/.-]\s*(\d{2,4})\b"
DAY_MONTH = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?\s*(\d{4})?\b"
MONTH_DAY = r"(?i)\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s*(\d{4})?\b"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it reads more than once, and that is worked out once a row: branches don't share what they read."""
    return F.element_at(F.transform(F.array(value), f), 1)


def make(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none such."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def iso(c: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")


def day_first(c: Column) -> Column:
    part = [F.nullif(F.regexp_extract(c, DMY, i), F.lit("")).try_cast("int") for i in (1, 2, 3)]
    return make(F.when(part[2] < 100, part[2] + 2000).otherwise(part[2]), part[1], part[0])


def resolve(year: Column, month: Column, day: Column, reference: Column) -> Column:
    """Without a year: the reference's, or the next one if that lies over 31 days back."""
    guess = once(make(F.year(reference), month, day), lambda here: F.when(here < F.date_sub(reference, GRACE_DAYS), make(F.year(reference) + 1, month, day)).otherwise(here))
    return F.when(year.isNotNull(), make(year, month, day)).otherwise(guess)


def _named(c: Column, pattern: str, name_first: bool, reference: Column) -> Column:
    """The first match whose word names a month."""
    month_of = lambda word: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(word, 1, 3)))
    name, day = (1, 2) if name_first else (2, 1)
    hits = F.filter(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: month_of(F.regexp_extract(m, pattern, name)) > 0)
    parts = lambda hit: F.struct(
        F.nullif(F.regexp_extract(hit, pattern, 3), F.lit("")).try_cast("int").alias("year"), month_of(F.regexp_extract(hit, pattern, name)).alias("month"), F.regexp_extract(hit, pattern, day).try_cast("int").alias("day"))
    return once(once(F.try_element_at(hits, F.lit(1)), parts), lambda p: resolve(p["year"], p["month"], p["day"], reference))


def day_month(c: Column, reference: Column) -> Column:
    return _named(c, DAY_MONTH, False, reference)


def month_day(c: Column, reference: Column) -> Column:
    return _named(c, MONTH_DAY, True, reference)


def available_from(c: Column, reference: Column) -> Column:
    """Words for now or tomorrow, else the first reading that gives a date, if it lies in the window."""
    raw = F.nullif(F.trim(c), F.lit(""))
    low = F.lower(raw)
    read = F.coalesce(iso(raw), day_first(raw), day_month(raw, reference), month_day(raw, reference))
    fits = once(read, lambda d: F.when(d.between(F.date_sub(reference, PAST_DAYS), F.date_add(reference, FUTURE_DAYS)), d))
    return F.when(any_of(low, IMMEDIATE), reference).when(low.contains("tomorrow"), F.date_add(reference, 1)).otherwise(fits)


def as_date(c: Column) -> Column:
    """The first ten characters as an ISO date, else null."""
    return F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")


def as_timestamp(c: Column) -> Column:
    """An ISO date or date and time, with a blank or a T between them, to the microsecond, with or without a zone; else null."""
    said = c.cast("string")
    whole = said.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.]\d{1,6})?)?)?(?:Z|[+-]\d{2}:\d{2})?)?$")
    hour_only = F.regexp_replace(said, r"^(.{10})[T ](\d{2})(Z|[+-].*)?$", "$1T$2:00$3")
    return F.when(whole, hour_only.try_cast("timestamp"))
