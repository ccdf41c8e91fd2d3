"""Extraction rules as a table: validation, the registry of versions, and the built-in sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIVE = ("active", "pinned")
LOCATORS = ("path", "sel", "label", "const")


def problems(rules: DataFrame) -> DataFrame:
    """``rules`` (strategy, root, item, field, path, sel, label, const, attr, true_if, false_if) with ``problem``: the first
    fault of the rule, then of its container, else null."""
    has = lambda c: F.col(c).isNotNull()
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    located = sum((has(c).cast("int") for c in LOCATORS), F.lit(0))
    why = (
        F.when(has("field") & (located != 1), "provide exactly one of: path, sel, label, const")
        .when(has("attr") & ~has("sel") & ~has("label"), "attr applies to sel or label")
        .when((some("true_if") | some("false_if")) & has("path"), "true_if and false_if are for the dom strategy")
        .when((F.col("strategy") == "dom") & ~some("item"), "dom strategy requires item")
        .when((F.col("strategy") != "dom") & ~some("root"), F.concat("strategy", F.lit(" strategy requires root")))
        .when(~has("field"), "fields must not be empty")
    )
    return rules.withColumn("problem", why)


def live(registry: DataFrame) -> DataFrame:
    """The version in force of each (source_key, page_kind)."""
    return registry.where(F.col("status").isin(*LIVE))


def publish(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after ``new`` (source_key, page_kind, layout_fingerprint, strategy, status, created_by): the version in
    force retires, the new one gets the next number."""
    key = ["source_key", "page_kind"]
    replaced = new.select(*key, F.lit(True).alias("replaced"))
    old = registry.join(replaced, key, "left").withColumn("status", F.when(F.col("replaced") & F.col("status").isin(*LIVE), "retired").otherwise(F.col("status"))).drop("replaced")
    last = registry.groupBy(*key).agg(F.max("version").alias("last"))
    added = new.join(last, key, "left").withColumn("version", (F.coalesce("last", F.lit(0)) + 1).cast("int")).drop("last")
    return old.unionByName(added, allowMissingColumns=True)


def retired_for(registry: DataFrame, layouts: DataFrame) -> DataFrame:
    """Of each wanted (source_key, page_kind, layout_fingerprint) the newest retired version."""
    key = ["source_key", "page_kind", "layout_fingerprint"]
    return registry.where(F.col("status") == "retired").join(layouts.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.max("version").alias("version"))


def seed(registry: DataFrame, built_in: DataFrame) -> DataFrame:
    """``publish`` of the built-in rules of sources and kinds that have none in force, as pinned by hand."""
    missing = built_in.join(live(registry).select("source_key", "page_kind"), ["source_key", "page_kind"], "left_anti")
    return publish(registry, missing.withColumns({"status": F.lit("pinned"), "created_by": F.lit("human")}))


def overlay(extracted: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of ``base`` overlaid by what the page gave; a null from the page changes nothing."""
    fields = sorted((set(base.columns) | set(extracted.columns)) - set(keys))
    b, e = base.alias("b"), extracted.alias("e")
    both = e.join(b, [F.col(f"e.{k}") == F.col(f"b.{k}") for k in keys], "left")
    pick = lambda c: F.coalesce(*[F.col(f"{a}.{c}") for a, df in (("e", extracted), ("b", base)) if c in df.columns]).alias(c)
    return both.select(*[F.col(f"e.{k}").alias(k) for k in keys], *map(pick, fields))


def drift(layouts: DataFrame, by: list[str], at: str) -> DataFrame:
    """Layouts (fingerprint) that differ from the one before."""
    w = Window.partitionBy(*by).orderBy(at)
    return layouts.withColumn("before", F.lag("fingerprint").over(w)).where(F.col("before") != F.col("fingerprint"))


def json_layout_function(depth: int = 4):
    """The function behind ``json_layout``, as it can be registered for SQL.

    Column code over VARIANT has no key listing, so this is an Arrow-batched function."""

    @F.udf("string", useArrow=True)
    def paths(text: str | None) -> str | None:
        import json

        if text is None:
            return None
        try:
            left = [("", json.loads(text), depth)]
        except ValueError:
            return "unparseable"
        found = set()
        names = {"str": "str", "int": "int", "float": "float", "bool": "bool", "NoneType": "NoneType"}
        while left:
            at, value, more = left.pop()
            if more <= 0:
                found.add(f"{at}:…")
            elif isinstance(value, dict) and value:
                left += [(f"{at}.{k}" if at else k, v, more - 1) for k, v in value.items()]
            elif isinstance(value, dict):
                found.add(f"{at}:{{}}")
            elif isinstance(value, list):
                left += [(f"{at}[]", value[0], more - 1)] if value else []
                found |= set() if value else {f"{at}[]:empty"}
            else:
                found.add(f"{at}:{names[type(value).__name__]}")
        return "|".join(sorted(found))

    return paths


def json_layout(payload: Column, depth: int = 4) -> Column:
    """Key paths of a JSON text with the type of each leaf, to ``depth`` levels, of arrays only the first element; a text
    that isn't JSON is ``unparseable``."""
    return json_layout_function(depth)(payload)
