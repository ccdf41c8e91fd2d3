"""Sharding by sampled splitters: balanced range shards of a table, DataFrame operations only.

The shard key is (64-bit hash of the text, row id), so equal texts are neighbours. Size-weighted samples of the keys give
quantile splitters; every range that holds too many bytes or rows is subdivided by splitters of its own, again and again.
The ranges are only units of work: inside each a running sum gives every row its exact byte offset in key order, and the
offset gives the shard. Shards differ by about one row's size, whatever the sample was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

#: Ranges that one subdivision makes, sampled keys per splitter, and how often a range may be subdivided.
FANOUT = 64
OVERSAMPLE = 32
MAX_LEVELS = 8
#: A group of equal texts of more than this part of a shard is large: it gets a place of its own, if one is left.
LARGE_GROUP = 1 / 50
#: Ranges up to which their splitters are broadcast; beyond that the join shuffles.
BROADCAST_RANGES = 100_000


def _small(ranges: DataFrame) -> DataFrame:
    return F.broadcast(ranges) if ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES else ranges


def _pairs(spark: SparkSession, pairs: list[tuple[int, int]], key: str, value: str) -> DataFrame:
    """A table of a few numbers, as a literal of the query."""
    rows = F.array(*[F.struct(F.lit(k).cast("long"), F.lit(v).cast("long")) for k, v in pairs]).cast(f"array<struct<{key}: long, {value}: long>>")
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def _sampled(rows: DataFrame, over: DataFrame, level: int, by: Column) -> DataFrame:
    """Splitters of each overfull range: quantiles of a sample in which a row's chance is proportional to its size."""
    chance = F.col("size") * F.lit(FANOUT * OVERSAMPLE) / F.col("range_bytes")
    draw = F.pmod(F.xxhash64(F.lit(level), F.col("h"), F.col("row_id"), F.col("nth")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(_small(over), "range_id").where(draw < chance).select("range_id", by.alias("at"))
    keys = sample.groupBy("range_id").agg(F.array_sort(F.collect_list("at")).alias("keys"))
    quantiles = F.transform(F.sequence(F.lit(1), F.lit(FANOUT - 1)), lambda i: F.element_at("keys", F.greatest(F.lit(1), (i * F.size("keys") / FANOUT).cast("int"))))
    return keys.select("range_id", F.array_distinct(quantiles).alias("splitters"))


def _ranges(rows: DataFrame, max_rows: int) -> DataFrame:
    """Rows with ``range_id``, of which none that can be divided holds over ``max_rows`` rows or 2/FANOUT of the bytes."""
    total = rows.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    limit = max(1, 2 * total // FANOUT)
    key = F.struct("h", "row_id", "nth")
    ranged = rows.withColumn("range_id", F.array().cast("array<int>"))
    for level in range(MAX_LEVELS):
        counts = ranged.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("range_bytes"), F.min("h").alias("low"), F.max("h").alias("high"), F.min(key).alias("first"), F.max(key).alias("last"))
        over = counts.where(((F.col("n") > max_rows) | (F.col("range_bytes") > limit)) & (F.col("first") < F.col("last"))).select("range_id", "range_bytes", (F.col("low") == F.col("high")).alias("one_text"))
        over = materialise(over, "ranges")
        if over.isEmpty():
            break
        # A range of several texts is cut between texts; a range of one text is cut between rows.
        at = F.when(F.col("one_text"), key).otherwise(F.struct("h", F.lit(None).cast("long").alias("row_id"), F.lit(None).cast("long").alias("nth")))
        cut = _small(materialise(_sampled(ranged, over, level, at), "splitters"))
        part = F.size(F.filter("splitters", lambda s: s <= key))
        ranged = ranged.join(cut, "range_id", "left").withColumn("range_id", F.when(F.col("splitters").isNull(), F.col("range_id")).otherwise(F.concat("range_id", F.array(part)))).drop("splitters")
        ranged = materialise(ranged, "ranged")
    return ranged


def _large_groups(rows: DataFrame, shards: int) -> tuple[int, dict[int, int], list[int]]:
    """(bytes in all, shard of each large group that has a place, bytes placed in each shard).

    At most shards / LARGE_GROUP groups are large. They are placed largest first into the emptiest shard; one that would
    overfill it is cut like other rows."""
    total = rows.agg(F.sum("size").alias("bytes")).first()["bytes"] or 0
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    large = groups.where((F.col("n") > 1) & (F.col("bytes") * shards > total * LARGE_GROUP)).collect()
    place, load = {}, [0] * shards
    for g in sorted(large, key=lambda g: (-g["bytes"], g["h"] is not None, g["h"] or 0)):
        emptiest = min(range(shards), key=lambda i: (load[i], i))
        if (load[emptiest] + g["bytes"]) * shards <= total and g["h"] is not None:
            place[g["h"]] = emptiest
            load[emptiest] += g["bytes"]
    return total, place, load


def shard(df: DataFrame, id_col: str, text_col: str, shards: int, max_rows: int = 1_000_000) -> DataFrame:
    """Every row of ``df`` as (``id_col``, size, text_crc32, law, shard, slot, grown_shard), under the law ``bytes``.

    Size is the text's UTF-8 bytes plus 1. Shards are near equal in bytes. Equal texts stay in one shard; only a group that
    is larger than the room left in every shard is cut, between rows. Large groups are placed first, the rest fills the
    shards in key order. ``slot`` counts each shard's rows from 0: the rest in key order, then the large groups.

    Null and empty texts have size 1 and crc 0 (they hash apart; null texts may be cut between rows). Repeated rows each get
    a slot of their own. A null id is a key like any other and sorts first. An empty table gives no rows. Columns other
    than the id and the text, whatever their names, are not read.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("row_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("nth"),
    )
    rows = materialise(rows, "keys")
    total, place, load = _large_groups(rows, shards)
    where = _pairs(spark, sorted(place.items()), "h", "own")
    ranged = _ranges(rows.join(F.broadcast(where), "h", "left"), max_rows)  # shards / LARGE_GROUP rows at most
    rest = F.col("own").isNull().cast("long")
    sums = ranged.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"), F.sum(rest).alias("rest_n"), F.sum(rest * F.col("size")).alias("rest_bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
    # Running sums over the ranges, in two levels: inside each top range, and over the few top ranges.
    sums = sums.withColumn("top", F.coalesce(F.get("range_id", F.lit(0)), F.lit(-1)))
    tops = sums.groupBy("top").agg(*[F.sum(c).alias(c) for c in ("n", "rest_n", "rest_bytes")])
    def before(w):
        return [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in ("n", "rest_n", "rest_bytes")]

    tops = tops.select("top", *before(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)))  # FANOUT + 1 rows at most
    inner = sums.select("range_id", "top", "rest_bytes", F.when(F.col("low") == F.col("high"), F.col("low")).alias("one_text"), *before(Window.partitionBy("top").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = inner.alias("i").join(F.broadcast(tops).alias("t"), "top").select("range_id", "rest_bytes", "one_text", *[(F.col(f"i.{c}_before") + F.col(f"t.{c}_before")).alias(f"{c}_before") for c in ("n", "rest_n", "rest_bytes")])
    # A group of more than max_rows rows fills several ranges, each of this text alone: it is one group all the same.
    spread = offsets.groupBy("one_text").agg(F.min("rest_bytes_before").alias("spread_start"), F.sum("rest_bytes").alias("spread_bytes"), F.count(F.lit(1)).alias("pieces")).where("one_text IS NOT NULL AND pieces > 1")
    offsets = offsets.join(spread.drop("pieces"), "one_text", "left").drop("one_text", "rest_bytes")
    inside = Window.partitionBy("range_id").orderBy("h", "row_id", "nth")
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range_id", "h")
    placed = ranged.join(_small(offsets), "range_id").withColumns({
        "nth_row": F.col("n_before") + F.row_number().over(inside) - 1,
        "rest_row": F.col("rest_n_before") + F.sum(rest).over(until) - 1,
        "start": F.col("rest_bytes_before") + F.sum(rest * F.col("size")).over(until) - F.col("size"),
    })
    placed = placed.withColumns({"group_start": F.coalesce("spread_start", F.min("start").over(group)), "group_bytes": F.coalesce("spread_bytes", F.sum("size").over(group))})
    whole = F.col("group_bytes") * shards <= F.lit(total) * LARGE_GROUP
    middle = F.when(whole, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("start") + F.col("size") / 2)
    # The rest fills what the large groups left of each shard.
    edges, reached = [], 0.0
    for i in range(shards - 1):
        reached += total / shards - load[i]
        edges.append(F.lit(reached))
    fill = sum(((middle >= edge).cast("int") for edge in edges), F.lit(0))
    placed = placed.withColumn("shard", F.coalesce("own", fill).cast("int"))
    placed = materialise(placed.select("row_id", "h", "size", "text_crc32", "shard", "own", "nth_row", "rest_row"), "placed")
    # Where the rest of each shard and each large group begins; a few rows each.
    first = {r["shard"]: r for r in placed.where("own IS NULL").groupBy("shard").agg(F.min("rest_row").alias("first"), F.count(F.lit(1)).alias("n")).collect()}
    large = placed.where("own IS NOT NULL").groupBy("h", "shard").agg(F.min("nth_row").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    shift, begins = [], {i: first[i]["n"] if i in first else 0 for i in range(shards)}
    for r in sorted(large, key=lambda r: r["h"]):
        shift.append((r["h"], begins[r["shard"]] - r["first"]))
        begins[r["shard"]] += r["n"]
    own = placed.join(F.broadcast(_pairs(spark, shift, "h", "shift")), "h", "left")
    rest_shift = F.coalesce(*[F.when(F.col("shard") == i, F.lit(-r["first"])) for i, r in first.items()], F.lit(0)).cast("long")
    slot = F.when(F.col("own").isNull(), F.col("rest_row") + rest_shift).otherwise(F.col("nth_row") + F.col("shift"))
    return own.select(
        F.col("row_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
