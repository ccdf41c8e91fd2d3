"""What users add to the library, and what it adds to SQL: registered sources and channels, functions, a table function.

A source is a name, its extraction rules by page kind and a normaliser, a function from its raw rows to canonical ones. All
sources are normalised in one plan; each reads only its own rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pages, rules

Normaliser = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Source:
    name: str
    normalise: Normaliser
    #: By page kind: the selector of an item, and the rules of its fields.
    rules: dict[str, tuple[str, dict[str, dict]]] = field(default_factory=dict)


@dataclass(frozen=True)
class Channel:
    """Where messages go. ``render`` makes the text of a message from its columns; null says there is nothing to send."""

    name: str
    render: Callable[[], Column]
    implemented: bool = True


SOURCES: dict[str, Source] = {}
CHANNELS: dict[str, Channel] = {}


def register_source(name: str, normaliser: Normaliser, rules: dict[str, tuple[str, dict[str, dict]]] | None = None) -> Source:
    """Adds a source, or replaces the one of this name. A rule must locate its field in one way only."""
    for kind, (item, fields) in (rules or {}).items():
        if not item or not fields:
            raise ValueError(f"{name}, {kind}: an item selector and fields are needed")
        for told, rule in fields.items():
            if sum(k in rule for k in ("sel", "label", "const")) != 1:
                raise ValueError(f"{name}, {kind}, {told}: provide exactly one of: sel, label, const")
    SOURCES[name] = Source(name, normaliser, rules or {})
    return SOURCES[name]


def register_channel(name: str, render: Callable[[], Column], implemented: bool = True) -> Channel:
    CHANNELS[name] = Channel(name, render, implemented)
    return CHANNELS[name]


def normalised(raw: DataFrame, sources: dict[str, Source] | None = None) -> DataFrame:
    """Canonical rows of all registered sources from ``raw`` (source_key and the sources' own columns). Columns that only some
    sources give are null for the others; rows of a source that isn't registered are an error, as their normaliser is missing."""
    known = SOURCES if sources is None else sources
    if not known:
        raise ValueError("no source is registered")
    unknown = F.assert_true(F.col("source_key").isin(*known), F.concat(F.lit("source without normaliser: "), F.coalesce("source_key", F.lit("null"))))
    checked = raw.where(unknown.isNull())
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.normalise(checked.where(F.col("source_key") == s.name)) for s in known.values()])


def source_items(bodies: DataFrame, key: str, body: str, page_kind: str, sources: dict[str, Source] | None = None) -> DataFrame:
    """(source_key, key, ordinal, fields, error) of pages (source_key, key, body), each by its own source's rules."""
    known = {n: s for n, s in (SOURCES if sources is None else sources).items() if page_kind in s.rules}
    if not known:
        raise ValueError(f"no source has rules for {page_kind}")
    each = [pages.extract(bodies.where(F.col("source_key") == n), key, body, *s.rules[page_kind]).withColumn("source_key", F.lit(n)) for n, s in known.items()]
    return reduce(DataFrame.unionByName, each).select("source_key", key, "ordinal", "fields", "error")


def rendered(messages: DataFrame, channels: dict[str, Channel] | None = None) -> DataFrame:
    """``messages`` (channel, ...) with their text; an unregistered or unimplemented channel gives null."""
    text = F.lit(None).cast("string")
    for c in (CHANNELS if channels is None else channels).values():
        if c.implemented:
            text = F.when(F.col("channel") == c.name, c.render()).otherwise(text)
    return messages.withColumn("text", text)


class PageItems:
    """SQL table function page_items(html, item, rules): (ordinal, fields, error), a row for each element that ``item``
    selects. ``rules`` is JSON text, a rule for each field; it is read once for each text in a row."""

    def __init__(self) -> None:
        self.told, self.rules = None, {}

    def eval(self, html: str, item: str, told: str) -> Iterator[tuple]:
        try:
            if told != self.told:
                self.told, self.rules = told, json.loads(told)
            for i, found in enumerate(pages.items_of(pages.parse(html or ""), item, self.rules)):
                yield i, found, None
        except Exception as error:  # noqa: BLE001 - one bad page is a row of its own
            yield 0, {}, f"{type(error).__name__}: {error}"[:500]


def register_functions(spark: SparkSession) -> None:
    """Names for SQL text: ``page_items`` (table function), ``page_fingerprint(html, item)``, ``page_reduced(html)`` and
    ``json_layout(text)``. A page that can't be read has fingerprint and reduction null."""

    def quietly(f: Callable[[str], str]) -> Callable[[str], str | None]:
        def run(html: str, *more: str) -> str | None:
            try:
                return f(html or "", *more)
            except Exception:  # noqa: BLE001
                return None

        return run

    spark.udtf.register("page_items", F.udtf(PageItems, returnType="ordinal int, fields map<string,string>, error string"))
    spark.udf.register("page_fingerprint", F.udf(quietly(lambda html, item: pages.layout_of(pages.parse(html), item)["fingerprint"]), "string", useArrow=True))
    spark.udf.register("page_reduced", F.udf(quietly(lambda html: pages.reduced_of(pages.parse(html), html, pages.TEXT_LIMIT)["reduced"]), "string", useArrow=True))
    spark.udf.register("json_layout", rules.json_layout_function())
