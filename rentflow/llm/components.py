"""Connected components of a table of links, by alternating large and small stars, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Rows of one node meet its smallest neighbour in so many parts, so that a hub's links don't all go to one task.
SALTS = 8


def _meet(links: DataFrame, low: DataFrame) -> DataFrame:
    """``links`` with the value m of their node a, in salted parts."""
    low = low.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return links.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS))).join(low, ["a", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b); root is the smallest id of its component. Loops and repeats are fine."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ids = materialise(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    edges = materialise(edges.where(F.col("a") != F.col("b")), "edges")
    while True:
        # Large star: each node's larger neighbours move to the smallest node around it.
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _meet(both.where(F.col("b") > F.col("a")), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _meet(large, low).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where(F.col("a") != F.col("b")).distinct()
        after = materialise(small, "edges")
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        discard(edges)
        edges = after
        if same:
            return ids.join(edges, ids["id"] == edges["a"], "left").select("id", F.coalesce("b", "id").alias("root"))
