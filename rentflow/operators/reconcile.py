"""A new snapshot against stored state: one full outer join decides every listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELIST_AFTER = 2
# The columns of a listing that are worth an update.
TRACKED = (
    "price_pcm",
    "bedrooms",
    "bathrooms",
    "property_type",
    "furnished",
    "pets_allowed",
    "bills_included",
    "available_from",
    "min_tenancy_months",
    "deposit_pcm",
    "postcode",
    "postcode_district",
    "tfl_zone",
    "title",
    "is_landlord_direct",
)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by aggregation with a map-side part; ``batch_changes`` has what happened before it."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def batch_changes(incoming: DataFrame, state: DataFrame, keys: list[str], order: list[str], value: str = "price_pcm") -> DataFrame:
    """(keys, order, old, new) of every change of ``value`` inside a batch: a first sighting is compared with the stored
    row, a repeated one with the sighting before it; a null carries nothing."""
    seen = incoming.where(F.col(value).isNotNull())
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    rows = seen.withColumn("before", before).join(state.select(*keys, F.col(value).alias("stored")), keys, "left")
    old = F.coalesce("before", "stored")
    return rows.where(old != F.col(value)).select(*keys, *order, old.alias("old"), F.col(value).alias("new"))


def reconcile(state: DataFrame, incoming: DataFrame, keys: list[str], tracked: list[str], mode: str, health: Column, absent: str = "keep") -> DataFrame:
    """A decision for each key: insert, revive, update, unchanged, miss, delist or hold.

    ``state`` has ``status`` and ``miss_count``. Columns compare null-safely. With ``absent='keep'`` a null that comes in is
    a field that the page did not carry, and changes nothing; with ``'overwrite'`` it is a value. ``health`` is an
    expression over the key columns and the stored row.
    """
    old, new = state.alias("o"), incoming.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = old.withColumn("had", F.lit(True)).alias("o").join(new.withColumn("came", F.lit(True)).alias("n"), on, "full_outer")
    differs = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) & (F.lit(True) if absent == "overwrite" else F.col(f"n.{c}").isNotNull())
    changed = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in tracked]))
    had, came = F.col("had").isNotNull(), F.col("came").isNotNull()
    gone = F.col("status") == "delisted"
    misses = F.col("miss_count") + 1
    kind = (
        F.when(~had, "insert").when(came & gone, "revive").when(came & (F.size(changed) > 0), "update").when(came, "unchanged")
        .when((health != "ok") | F.lit(mode != "sweep") | gone, "hold").when(misses >= DELIST_AFTER, "delist").otherwise("miss")
    )
    next_misses = F.when(came, 0).when(kind.isin("miss", "delist"), misses).otherwise(F.col("miss_count"))
    value = lambda c: F.when(~came, F.col(f"o.{c}")).when(F.lit(absent == "keep"), F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"n.{c}"))
    moved = had & came & (differs("price_pcm") if "price_pcm" in tracked else F.lit(False))
    return both.select(
        *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], kind.alias("kind"), F.array_join(F.when(had & came, changed).otherwise(F.array().cast("array<string>")), ",").alias("changed_fields"),
        F.when(moved, F.col("o.price_pcm")).alias("old_price"), F.when(moved, F.col("n.price_pcm")).alias("new_price"),
        next_misses.cast("int").alias("miss_count"), F.when(kind == "delist", "delisted").when(came, "active").otherwise(F.col("status")).alias("status"),
        (kind == "insert").alias("notify"), *[value(c).alias(c) for c in tracked],
    )


def stamped(decisions: DataFrame, stamps: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Decisions with the next first_seen_at, last_seen_at and delisted_at, from the stored ones: what was seen is seen now,
    what is delisted now got its time now, what came back has none."""
    kind = F.col("kind")
    seen = kind.isin("insert", "revive", "update", "unchanged")
    rows = decisions.join(stamps.select(*keys, "first_seen_at", "last_seen_at", "delisted_at"), keys, "left")
    return rows.withColumns({
        "first_seen_at": F.when(kind == "insert", as_of).otherwise(F.col("first_seen_at")),
        "last_seen_at": F.when(seen, as_of).otherwise(F.col("last_seen_at")),
        "delisted_at": F.when(kind == "delist", as_of).when(kind != "revive", F.col("delisted_at")),
    })


def stored(state: DataFrame, keys: list[str], wanted: DataFrame | None = None, only_active: bool = False) -> DataFrame:
    """(keys, status, miss_count, TRACKED) of stored listings: those of the ``wanted`` keys, or all; for a sweep the active
    ones only. Tracked columns that the state doesn't have are null."""
    rows = state.where("status = 'active'") if only_active else state
    rows = rows.join(wanted.select(*keys).distinct(), keys, "left_semi") if wanted is not None else rows
    return rows.select(*keys, "status", "miss_count", *[F.col(c) if c in state.columns else F.lit(None).alias(c) for c in TRACKED])


def summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("new_price").alias("price_changes"))


def price_rows(decisions: DataFrame, seen_at: Column, keys: list[str]) -> DataFrame:
    """First prices and changes, for the append-only log."""
    first = (F.col("kind") == "insert") & F.col("price_pcm").isNotNull()
    return decisions.where(first | F.col("new_price").isNotNull()).select(*keys, "price_pcm", seen_at.alias("seen_at"))


def append_unique(log: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``rows`` that the log doesn't have yet, one a key; the caller appends them."""
    return rows.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti")


def change_points(history: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    return history.withColumns({"previous": before, "first": F.row_number().over(w) == 1}).where(F.col("first") | ~F.col("previous").eqNullSafe(F.col(value)))


def upsert(state: DataFrame, incoming: DataFrame, keys: list[str], keep_old_if_null: list[str] | None = None) -> DataFrame:
    """State after the rows of ``incoming`` replaced or joined it; named columns keep the old value where the new is null."""
    columns = [c for c in state.columns if c not in keys]
    both = state.withColumn("__had", F.lit(1)).alias("o").join(incoming.withColumn("__came", F.lit(1)).alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    value = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in (keep_old_if_null or []) else F.when(F.col("n.__came").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[value(c).alias(c) for c in columns])
