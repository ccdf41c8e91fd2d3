"""Subscribers: forms, commands, tokens, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that stop messages.
STOP_WORDS = ("/stop", "stop", "стоп", "unsubscribe", "отписаться", "отписка", "/unsubscribe")
PRICE_LIMIT, BEDROOM_LIMIT, TENANCY_LIMIT, CAP_LIMIT, CAP_DEFAULT = 20_000, 10, 60, 50, 10


def whole(c: Column) -> Column:
    """A typed number rounded half up; blank, unreadable or infinite is absent, as is what no long holds."""
    read = F.trim(c).try_cast("double")
    return F.when(F.abs(read) < 1e15, F.floor(read + 0.5).cast("long"))


def subset(values: Column, allowed: tuple[str, ...]) -> Column:
    return F.array_distinct(F.array_intersect(F.transform(values, lambda x: F.lower(x)), F.array(*map(F.lit, allowed))))


# What a form may name.
PROPERTY_TYPES = ("flat", "house", "studio", "room", "maisonette")
FURNISHED = ("furnished", "unfurnished", "part")
FORM = {
    "price_min": "string", "price_max": "string", "bedrooms_min": "string", "bedrooms_max": "string", "property_types": "array<string>", "furnished": "array<string>", "districts": "array<string>",
    "pets_allowed": "string", "bills_included": "string", "landlord_direct_only": "string", "min_tenancy_max_months": "string", "cap": "string",
}


def parse_criteria(forms: DataFrame, districts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of forms (id and columns of FORM; those that aren't there are blank), rejects with the first reason.

    Numbers are rounded and must lie in their range, a minimum must not be above its maximum. Kinds and furnishings that aren't
    known are left out, districts that aren't covered are an error. Only a checked box is a wish; an unchecked one is none.
    """
    rows = forms.select("id", *[F.col(c) if c in forms.columns else F.lit(None).cast(kind).alias(c) for c, kind in FORM.items()])
    number = {c: whole(F.col(c)) for c in ("price_min", "price_max", "bedrooms_min", "bedrooms_max", "min_tenancy_max_months", "cap")}
    wanted = F.coalesce(F.array_distinct(F.filter(F.transform("districts", lambda x: F.upper(F.trim(x))), lambda x: x != "")), F.array().cast("array<string>"))
    checked = lambda c: F.when(F.lower(c).isin("true", "on"), True)
    known = lambda c, words: F.coalesce(subset(F.col(c), words), F.array().cast("array<string>"))
    read = rows.select(
        "id", *[v.alias(c) for c, v in number.items()], known("property_types", PROPERTY_TYPES).alias("property_types"), known("furnished", FURNISHED).alias("furnished"), wanted.alias("districts"),
        *[checked(c).alias(c) for c in ("pets_allowed", "bills_included", "landlord_direct_only")],
    )
    outside = lambda c, a, b: F.coalesce(~F.col(c).between(a, b), F.lit(False))
    unknown = F.array_except("districts", F.array(*map(F.lit, districts)).cast("array<string>"))
    why = (
        F.when(outside("price_min", 0, PRICE_LIMIT) | outside("price_max", 0, PRICE_LIMIT), "price out of range").when(F.col("price_min") > F.col("price_max"), "minimum above maximum")
        .when(outside("bedrooms_min", 0, BEDROOM_LIMIT) | outside("bedrooms_max", 0, BEDROOM_LIMIT), "bedrooms out of range").when(F.col("bedrooms_min") > F.col("bedrooms_max"), "minimum above maximum")
        .when(F.size(unknown) > 0, F.concat(F.lit("not covered yet: "), F.array_join(unknown, ", "))).when(outside("min_tenancy_max_months", 1, TENANCY_LIMIT), "tenancy out of range").when(outside("cap", 1, CAP_LIMIT), "cap out of range")
    )
    told = read.withColumn("reject_reason", why).withColumn("cap", F.coalesce("cap", F.lit(CAP_DEFAULT)))
    return told.where("reject_reason IS NULL").drop("reject_reason"), told.where("reject_reason IS NOT NULL")


def parse_forms(forms: DataFrame, districts: list[str]) -> tuple[DataFrame, DataFrame]:
    """``parse_criteria`` of the short form (id, price_min, price_max, districts, cap), districts as one text."""
    listed = F.array_join("districts", ",").alias("districts")
    good, bad = parse_criteria(forms, districts)
    return good.select("id", "price_min", "price_max", listed, "cap"), bad.select("id", "price_min", "price_max", listed, "cap", "reject_reason")


def activate(users: DataFrame, redeemed: DataFrame) -> DataFrame:
    """``users`` (id, status, consent_at, consent_source, stopped_at, start_token, token_expires_at) after tokens were redeemed
    (user_id, ts): active, with the first consent kept, nothing stopped and no token left."""
    first = redeemed.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("__at"))
    now = users.join(first, "id", "left")
    came = F.col("__at").isNotNull()
    cleared = {c: F.when(~came, F.col(c)) for c in ("stopped_at", "start_token", "token_expires_at")}
    return now.withColumns({
        "status": F.when(came, "active").otherwise(F.col("status")), "consent_at": F.when(came, F.coalesce("consent_at", "__at")).otherwise(F.col("consent_at")),
        "consent_source": F.when(came, "chat").otherwise(F.col("consent_source")), **cleared,
    }).select(*users.columns)


def attach_chats(channels: DataFrame, redeemed: DataFrame, channel: str) -> DataFrame:
    """``channels`` (user_id, channel, address, is_primary) after redemptions (user_id, chat, ts): a user's address is the chat of
    the last one; a chat that another user had moves with it."""
    last = redeemed.groupBy("user_id").agg(F.max_by(F.struct("chat", "ts"), F.struct("ts", "chat")).alias("r")).select("user_id", F.col("r.chat").cast("string").alias("chat"), "r.ts")
    owner = last.groupBy("chat").agg(F.max_by("user_id", F.struct("ts", "user_id")).alias("user_id"))
    mine = channels.where(F.col("channel") == channel)
    taken = mine.join(owner.select(F.col("chat").alias("address"), F.lit(True).alias("moved")), "address", "left").where("moved IS NULL").drop("moved")
    kept = taken.join(owner.select("user_id", F.lit(True).alias("new")), "user_id", "left").where("new IS NULL").drop("new")
    fresh = owner.select("user_id", F.lit(channel).alias("channel"), F.col("chat").alias("address"), F.lit(True).alias("is_primary"))
    return channels.where(F.col("channel") != channel).unionByName(kept.select(*channels.columns)).unionByName(fresh.select(*channels.columns))


def command(text: Column) -> Column:
    """Struct (kind, token): stop first, then start with its token, else other."""
    said = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(said)
    start = (low == "/start") | low.startswith("/start ") | low.startswith("/start@")
    kind = F.when(low.isin(*STOP_WORDS), "stop").when(start, "start").otherwise("other")
    return F.struct(kind.alias("kind"), F.when(kind == "start", F.nullif(F.try_element_at(F.split(said, r"\s+"), F.lit(2)), F.lit(""))).alias("token"))


def redeem(commands: DataFrame, pending: DataFrame) -> DataFrame:
    """(token, chat, ts, user_id) of start commands (chat, ts, token) before their token's expiry; a token is spent once,
    by the first."""
    first = commands.join(pending, "token").where(F.col("expires_at").isNull() | (F.col("ts") < F.col("expires_at")))
    return first.groupBy("token", "user_id").agg(F.min_by(F.struct("chat", "ts"), F.struct("ts", "chat")).alias("r")).select("token", "r.chat", "r.ts", "user_id")


def subscriber_state(log: DataFrame, as_of: Column) -> DataFrame:
    """Each chat's last start or stop up to a time."""
    known = log.where(F.col("kind").isin("start", "stop") & (F.col("ts") <= as_of))
    return known.groupBy("chat").agg(F.max_by("kind", F.struct("ts", "ordinal")).alias("state"), F.max("ts").alias("since"))
