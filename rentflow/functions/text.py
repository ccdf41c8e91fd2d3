"""Free text to typed values, Column to Column. Unknown stays null; "not stated" and "no" are different answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that the rules look for, in the order in which they are tried.
YES = ("yes", "allowed", "accepted", "considered", "welcome", "ok", "permitted", "included")
NO = ("no", "not allowed", "not accepted", "none", "excluded", "not included", "without")
STUDIO = ("studio", "bedsit")
SHARED = ("room in", "shared house", "shared flat", "houseshare", "flatshare", "room to rent")
PART_FURNISHED = ("part furnished", "partly furnished", "partially furnished", "optional")
UNFURNISHED = ("unfurnished", "not furnished")
PROPERTY_TYPES = ("maisonette", "studio", "apartment", "flat", "bungalow", "terrace", "detached", "semi", "house")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def any_of(c: Column, tokens: tuple[str, ...]) -> Column:
    """Whether one of the tokens occurs anywhere (a substring test); one alternation, so one pass over the text."""
    return c.rlike("|".join(rf"\Q{t}\E" for t in tokens))


def _low(c: Column) -> Column:
    return F.lower(F.trim(c))


def clean(c: Column, limit: int | None = None) -> Column:
    """White space (no-break space too) collapsed and trimmed, empty as null, cut at ``limit`` characters."""
    out = blank_to_null(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    return F.substring(out, 1, limit) if limit else out


def tri_state(c: Column) -> Column:
    """False if a negation occurs as a word, else true if an affirmation does, else null."""
    low = _low(c)
    word = lambda tokens: low.rlike(r"\b(?:" + "|".join(tokens) + r")\b")
    return F.when(word(NO), False).when(word(YES), True)


def bedrooms(c: Column) -> Column:
    low = _low(c)
    digits = F.regexp_extract(low, r"(\d+)", 1)
    return F.when(any_of(low, STUDIO), 0).when(digits != "", digits.try_cast("int")).when(any_of(low, SHARED), 1)


def furnished(c: Column) -> Column:
    low = _low(c)
    return F.when(any_of(low, PART_FURNISHED), "part").when(any_of(low, UNFURNISHED), "unfurnished").when(low.contains("furnished"), "furnished").otherwise("unknown")


def property_type(c: Column) -> Column:
    low = _low(c)
    out = F.when(any_of(low, SHARED), "room")
    for kind in PROPERTY_TYPES:
        out = out.when(low.contains(kind), "flat" if kind == "apartment" else kind)
    return out


def min_tenancy_months(c: Column) -> Column:
    low = F.lower(c)
    months = blank_to_null(F.regexp_extract(low, r"(\d+)\s*(?:month|mth|mo)", 1)).try_cast("int")
    return F.coalesce(months, blank_to_null(F.regexp_extract(low, r"(\d+)\s*year", 1)).try_cast("int") * 12)


def flag(c: Column) -> Column:
    """The strings true and false as a boolean; anything else is null."""
    return F.when(c == "true", True).when(c == "false", False)


def number(c: Column) -> Column:
    """A number, or null; booleans are not numbers."""
    return F.when(~F.lower(F.trim(c)).isin("true", "false", "t", "f", "yes", "no", "y", "n"), c.try_cast("double"))


def present(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))


def pounds(n: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(n, 0))


def short_date(d: Column) -> Column:
    return F.date_format(d, "d MMM")
