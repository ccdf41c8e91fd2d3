"""Displayed prices to pounds per calendar month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of

# Tokens of a period, looked for anywhere in the lower-cased text.
WEEKLY = ("p/w", "pw", "per week", "a week", "weekly", "per wk", "/week", "/wk", "pppw")
MONTHLY = ("p/m", "pcm", "pm", "per month", "a month", "monthly", "per calendar month", "/month", "/mo", "ppcm")
AMOUNT = r"£?\s*([0-9][0-9,\s]*(?:\.[0-9]{1,2})?)"


def period(c: Column) -> Column:
    """week, month or unknown; weekly tokens first, as the leading figure is then the weekly one."""
    low = F.lower(c)
    return F.when(any_of(low, WEEKLY), "week").when(any_of(low, MONTHLY), "month").otherwise("unknown")


def amount(c: Column) -> Column:
    found = F.regexp_extract(F.translate(c, "\u00a0", " "), AMOUNT, 1)
    return F.nullif(F.translate(found, ", ", ""), F.lit("")).try_cast("double")


def to_pcm(c: Column, default_period: Column | str = "month") -> Column:
    """Whole pounds a month, half to even; null where ``reject`` names a reason."""
    default = F.lit(default_period) if isinstance(default_period, str) else default_period
    said = F.when(period(c) == "unknown", default).otherwise(period(c))
    monthly = F.when(said == "week", amount(c) * 52 / 12).when(said == "month", amount(c))
    return F.rint(monthly).cast("int")


def reject(c: Column, default_period: Column | str = "month") -> Column:
    default = F.lit(default_period) if isinstance(default_period, str) else default_period
    empty = F.coalesce(c, F.lit("")) == ""
    return F.when(empty, "empty price").when(amount(c).isNull(), "no amount").when((period(c) == "unknown") & (default == "unknown"), "no period")


def deposit(c: Column) -> Column:
    return amount(c)
