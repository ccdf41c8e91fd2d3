"""Raw listing rows to canonical ones, with quality rules and health gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, money, text

#: Gates of an extraction batch.
VOLUME_RATIO, FILL_FLOOR, IMPLAUSIBLE_CEILING = 0.30, 0.95, 0.10
PRICE_RANGE, BEDROOM_RANGE = (200, 20_000), (0, 10)


def normalise(raw: DataFrame, reference: Column, assume_period: dict[str, str] | None = None, direct_sources: tuple[str, ...] = ("direct",)) -> DataFrame:
    """One projection from raw text columns to typed ones. ``assume_period`` names, by source, the period of a price that
    states none; a source without an entry rather rejects such prices."""
    period = F.lit("unknown")
    for source, default in (assume_period or {"direct": "month"}).items():
        period = F.when(F.col("source_key") == source, default).otherwise(period)
    return raw.select(
        "source_key", "external_id", "url", text.clean(F.col("title")).alias("title"),
        money.to_pcm(F.col("price_raw"), period).alias("price_pcm"), money.reject(F.col("price_raw"), period).alias("price_reject"),
        F.coalesce(text.bedrooms(F.col("bedrooms_raw")), F.when(text.property_type(F.col("property_type_raw")) == "studio", 0)).alias("bedrooms"),
        text.property_type(F.col("property_type_raw")).alias("property_type"), text.furnished(F.coalesce("furnished_raw", F.lit(""))).alias("furnished"),
        text.tri_state(F.col("flag_raw")).alias("pets_allowed"), dates.available_from(F.col("available_raw"), reference).alias("available_from"),
        text.min_tenancy_months(F.col("tenancy_raw")).alias("min_tenancy_months"), geo.split_postcode(F.col("postcode_raw"))["outward"].alias("postcode_district"),
        F.col("source_key").isin(*direct_sources).alias("is_landlord_direct"), "first_seen_at",
    )


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows; a rule is broken where its predicate is false (null passes). Rejects carry the rules' names."""
    told = df.withColumn("reject_reasons", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])))
    return told.where(F.size("reject_reasons") == 0).drop("reject_reasons"), told.where(F.size("reject_reasons") > 0)


def listing_rules(columns: list[str] | None = None) -> dict[str, Column]:
    """Domains of a canonical listing (fixed values), of the ``columns`` that a table has."""
    rules = {
        "price_pcm": F.col("price_pcm").between(100, 100_000),
        "bedrooms": F.col("bedrooms").between(0, 20),
        "bathrooms": F.col("bathrooms").between(0, 20),
        "furnished": F.col("furnished").isin("furnished", "unfurnished", "part", "unknown"),
        "min_tenancy_months": F.col("min_tenancy_months").between(0, 120),
        "tfl_zone": F.col("tfl_zone").between(1, 9),
        "lat": F.col("lat").between(-90, 90),
        "lng": F.col("lng").between(-180, 180),
        "photo_count": F.col("photo_count") >= 0,
        "status": F.col("status").isin("active", "delisted"),
    }
    return rules if columns is None else {name: rule for name, rule in rules.items() if name in columns}


def unique_violations(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that occur more than once among the rows that ``where`` selects (a partial unique index)."""
    return (df.where(where) if where is not None else df).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def health(rows: DataFrame, required: list[str], by: list[str], min_items: int, history: DataFrame | None = None, same_page: bool = False, id_col: str = "external_id", low: DataFrame | None = None) -> DataFrame:
    """A verdict for each batch: items, fill rates, duplicates, implausible rows, notes. ``history`` has ``by`` columns and
    ``recent_average``; a batch named there without rows counts as empty, hence broken. ``low`` (by, low), if given, has the
    required fields that are filled too rarely."""
    price, beds = F.col("price_pcm"), F.col("bedrooms")
    odd = F.coalesce(~price.between(*PRICE_RANGE), F.lit(False)) | F.coalesce(~beds.between(*BEDROOM_RANGE), F.lit(False))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(odd).alias("implausible"),
        (F.count(F.col(id_col)) - F.count_distinct(F.col(id_col))).alias("duplicates"),
        *[F.avg(text.present(F.col(c)).cast("int")).alias(f"fill_{c}") for c in required],
    )
    if history is not None:
        out = out.join(history.select(*by, "recent_average"), by, "full_outer").withColumn("items", F.coalesce("items", F.lit(0)))
    else:
        out = out.withColumn("recent_average", F.lit(None).cast("double"))
    if low is not None:
        out, low = out.join(low, by, "left"), F.coalesce("low", F.array().cast("array<string>"))
    else:
        low = F.array_sort(F.filter(F.array(*[F.when(F.col(f"fill_{c}") < FILL_FLOOR, F.lit(c)) for c in required]).cast("array<string>"), lambda x: x.isNotNull()))
    duplicates = F.col("duplicates") > 0 if same_page else F.lit(False)
    thin = F.col("items") < F.col("recent_average") * VOLUME_RATIO
    steps = [(F.col("items") == 0, "broken", "no items"), (F.col("items") < min_items, "broken", "below floor"), (duplicates, "broken", "duplicate ids"), (F.size(low) > 0, "broken", "low fill"), (F.col("implausible") > F.col("items") * IMPLAUSIBLE_CEILING, "broken", "implausible"), (thin, "degraded", "low volume")]
    verdict = note = None
    for when, name, why in steps:
        verdict = F.when(when, name) if verdict is None else verdict.when(when, name)
        note = F.when(when, why) if note is None else note.when(when, why)
    out = out.withColumns({"verdict": verdict.otherwise("ok"), "note": note, "low_fields": F.array_join(low, ",")})
    return out.drop("low").withColumn("passed", F.col("verdict") != "broken")


def fills(rows: DataFrame, by: list[str], contracts: DataFrame, source: str = "source_key") -> DataFrame:
    """(by, field, required, fill): the share of a batch's rows that give a field of their own source's contract; a field that
    ``rows`` has no column for is never given. ``by`` includes ``source``."""
    named = [c for c in rows.columns if c not in by]
    said = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), text.present(F.col(c).cast("string")).cast("int").alias("given")) for c in named])).alias("f"))
    given = said.groupBy(*by, "f.field").agg(F.sum("f.given").alias("given"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("items"))
    promised = sizes.join(contracts, source)
    return promised.join(given, [*by, "field"], "left").select(*by, "field", "required", (F.coalesce("given", F.lit(0)) / F.col("items")).alias("fill"))


def health_by_contract(rows: DataFrame, by: list[str], contracts: DataFrame, min_items: int, source: str = "source_key", **more) -> DataFrame:
    """``health`` of batches of several sources at once, each by the required fields of its own contract."""
    low = fills(rows, by, contracts, source).where(F.col("required") & (F.col("fill") < FILL_FLOOR)).groupBy(*by).agg(F.array_sort(F.collect_list("field")).alias("low"))  # fields are few
    return health(rows, [], by, min_items, low=low, **more)


def recent_average(counts: DataFrame, by: list[str], order: str, batches: int) -> DataFrame:
    """Each batch's mean ``items`` over the ``batches`` before it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-batches, -1)
    return counts.withColumn("recent_average", F.avg("items").over(w))
