"""URL filter by a path-template tree: rules label urls, templates generalise the labels. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Levels of the tree; what follows the last level's segment stays joined to it.
DEPTH = 4
#: A branching with more children than this, and fewer urls a child than the next, is one variable segment.
MANY_CHILDREN = 20
URLS_PER_CHILD = 5
#: |z| of the two-proportion test below which a branch counts as similar to its labelled siblings.
SIMILAR_Z = 1.96
#: Weight of the prior in a template's smoothed purity, and the purity from which it is rejected.
PRIOR_WEIGHT = 2.0
REJECT_PURITY = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, else null.

    A rule (``host/path``, verdict) fits its host and all subdomains if the path starts with the rule's. The list is a
    literal of the query and is tried on each row.
    """
    tried = []
    for rule, verdict in rules:
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        tried.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*tried))


def _labels(leaves: DataFrame) -> DataFrame:
    """The leaves (host, shape, n, labelled, blocked), each with its template, from the root down, level by level."""
    parts = F.split(F.substr("shape", F.lit(2)), "/", DEPTH)
    tree = leaves.select("*", parts.alias("parts"), F.lit("").alias("template"))
    for level in range(1, DEPTH + 1):
        tree = tree.withColumn("segment", F.try_element_at("parts", F.lit(level)))
        branch = tree.where(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
        sums = branch.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        branch = branch.join(sums, ["host", "template"])
        rest, rest_blocked = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
        pooled = F.col("all_blocked") / F.col("all_labelled")
        gap = F.abs(F.col("blocked") / F.col("labelled") - rest_blocked / rest)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest))
        similar = F.when((F.col("labelled") > 0) & (rest > 0), gap <= F.lit(SIMILAR_Z) * error).otherwise(False)
        variable = (F.col("children") > MANY_CHILDREN) & (F.col("all_n") < F.col("children") * URLS_PER_CHILD)
        branch = branch.select("host", "template", "segment", F.when(variable | similar, F.lit("*")).otherwise(F.col("segment")).alias("label"))
        tree = tree.join(branch, ["host", "template", "segment"], "left").withColumn("template", F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "label"))).drop("label", "segment")
        tree = materialise(tree, "templates")  # each level reads the one before twice
    return tree.drop("parts")


def judge(df: DataFrame, id_col: str, url_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Each row's (``id_col``, host, path, rule, verdict, template, purity).

    Rules label the urls that they fit. Digits in a path are one wildcard; a host's segments that vary freely, and branches
    whose labelled block rates do not differ significantly, become ``*``. A template whose block share, smoothed towards
    the share of blocked urls in the whole table, reaches ``REJECT_PURITY`` is rejected. A fitting rule has the last word.

    A null url, or one without ``://``, has empty host and path; it has no host to learn about and is allowed. Repeated rows are judged
    alike. An empty table gives no rows. Only the id and the url are read.
    """
    url = F.col(url_col)
    pages = df.select(F.col(id_col).alias("row_id"), host(url).alias("host"), path(url).alias("path"))
    pages = pages.withColumn("best", best_rule(rules, F.col("host"), F.col("path")))
    pages = pages.withColumn("shape", F.regexp_replace("path", "[0-9]+", "{n}"))
    block = F.coalesce((F.col("best.verdict") == "block").cast("long"), F.lit(0))
    leaves = materialise(pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("best").alias("labelled"), F.sum(block).alias("blocked")), "leaves")
    tree = _labels(leaves)
    base = leaves.agg((F.sum("blocked") / F.sum("n")).alias("base"))  # one row
    node = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    node = node.crossJoin(F.broadcast(base)).select("host", "template", ((F.col("blocked") + F.lit(PRIOR_WEIGHT) * F.col("base")) / (F.col("labelled") + F.lit(PRIOR_WEIGHT))).alias("purity"))
    known = tree.select("host", "shape", "template").join(node, ["host", "template"])
    rejected = F.when((F.col("host") != "") & (F.col("purity") >= REJECT_PURITY), "block").otherwise("allow")
    return pages.join(known, ["host", "shape"]).select(
        F.col("row_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", rejected).alias("verdict"), "template", F.round("purity", 9).alias("purity"),
    )
