"""Postcode districts from urls, postcodes and addresses. Unknown is never out of scope."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of an outward code, a listing url's tail and a full postcode.
OUTWARD = r"^[A-Z]{1,2}[0-9]{1,2}[A-Z]?$"
SLUG = r"-([a-z]{1,2}[0-9]{1,2}[a-z]?)/[0-9]+/?$"
POSTCODE = r"(?i)\b([A-Z]{1,2}[0-9][0-9A-Z]?)\s*([0-9][A-Z]{2})\b"
TRAILING = r"(?i)([A-Z]{1,2}[0-9]{1,2}[A-Z]?)\s*$"


def outward(c: Column) -> Column:
    """The canonical outward code, or null."""
    code = F.replace(F.upper(F.trim(c)), F.lit(" "), F.lit(""))
    return F.when(code.rlike(OUTWARD), code)


def outward_from_url(url: Column) -> Column:
    return outward(F.nullif(F.regexp_extract(F.substring_index(url, "?", 1), SLUG, 1), F.lit("")))


def split_postcode(c: Column) -> Column:
    """Struct (outward, inward); without a full postcode the whole value may be an outward code."""
    full = F.regexp_extract(c, POSTCODE, 1)
    return F.struct(F.when(full != "", outward(full)).otherwise(outward(c)).alias("outward"), F.nullif(F.upper(F.regexp_extract(c, POSTCODE, 2)), F.lit("")).alias("inward"))


def outward_from_address(c: Column) -> Column:
    tail = F.nullif(F.regexp_extract(F.trim(c), TRAILING, 1), F.lit(""))
    return F.coalesce(split_postcode(c)["outward"], outward(tail))


def in_scope(url: Column, scope: list[str]) -> Column:
    """Struct (in_scope, outward)."""
    code = outward_from_url(url)
    return F.struct((code.isNull() | code.isin(scope)).alias("in_scope"), code.alias("outward"))


def url_path(url: Column) -> Column:
    """Path with query, ``/`` for an empty one."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.when(query.isNull(), path).otherwise(F.concat(path, F.lit("?"), query))


def origin(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("HOST")))
