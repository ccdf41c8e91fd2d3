"""Control tables as data: coverage, health, schedules, reports, subscribers' life-cycle, delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coverage -----------------------------------------------------------------------------------------------------------


def coverage(source_locations: DataFrame, locations: DataFrame) -> DataFrame:
    """(source_key, location_id, code, zone_min, zone_max) of the enabled scope."""
    here = locations.select(F.col("id").alias("location_id"), "code", "zone_min", "zone_max")
    return source_locations.where("enabled").join(here, "location_id").select("source_key", "location_id", "code", "zone_min", "zone_max")


def enabled_districts(source_locations: DataFrame, locations: DataFrame, sources: DataFrame) -> DataFrame:
    """Upper-cased codes that some enabled source covers, each once."""
    live = sources.where("enabled").select("source_key")
    return coverage(source_locations, locations).join(live, "source_key", "left_semi").select(F.upper("code").alias("code")).distinct()


def zone_bounds(zones: DataFrame) -> DataFrame:
    """(code, zone_min, zone_max) of zone lists (zone, code)."""
    return zones.groupBy("code").agg(F.min("zone").alias("zone_min"), F.max("zone").alias("zone_max"))


def coverage_summary(source_locations: DataFrame, locations: DataFrame) -> DataFrame:
    """Each source's locations: all, enabled, without coordinates."""
    both = source_locations.join(locations.select(F.col("id").alias("location_id"), "lat"), "location_id")
    return both.groupBy("source_key").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("enabled")).alias("enabled"), F.count_if(F.col("lat").isNull()).alias("without_coords"))


def scope_upsert(source_locations: DataFrame, locations: DataFrame, source_key: str, scope: DataFrame) -> DataFrame:
    """The source's scope after every district got a row, enabled if ``scope`` (code) names it; ids it had are kept."""
    districts = locations.where(F.col("kind") == "postcode_district").select(F.col("id").alias("location_id"), "code")
    named = scope.select(F.upper(F.trim("code")).alias("code")).distinct().withColumn("named", F.lit(True))
    had = source_locations.where(F.col("source_key") == source_key).select("location_id", "external_id")
    rows = districts.join(named, "code", "left").join(had, "location_id", "left")
    return rows.select(F.lit(source_key).alias("source_key"), "location_id", F.coalesce("external_id", F.lower("code")).alias("external_id"), F.coalesce("named", F.lit(False)).alias("enabled"))


def scope_copy(source_locations: DataFrame, locations: DataFrame, like: str, to: str) -> DataFrame:
    """Rows that ``to`` lacks, for every district, enabled where ``like`` is."""
    districts = locations.where(F.col("kind") == "postcode_district").select(F.col("id").alias("location_id"), "code")
    has = source_locations.where(F.col("source_key") == to).select("location_id")
    model = source_locations.where(F.col("source_key") == like).select("location_id", "enabled")
    rows = districts.join(has, "location_id", "left_anti").join(model, "location_id", "left")
    return rows.select(F.lit(to).alias("source_key"), "location_id", F.lower("code").alias("external_id"), F.coalesce("enabled", F.lit(False)).alias("enabled"))


# Health and schedules -----------------------------------------------------------------------------------------------


def cooled(sources: DataFrame, as_of: Column) -> DataFrame:
    """Sources whose cool-down has passed are in service again; without an end there is nothing to pass."""
    over = F.coalesce(F.col("health_until") <= as_of, F.lit(False))
    clear = lambda c: F.when(~over, F.col(c))
    return sources.withColumns({"health": F.when(over, "ok").otherwise(F.col("health")), "health_note": clear("health_note"), "health_until": clear("health_until")})


def set_health(sources: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """Sources after ``verdicts`` (source_key, new_health, note, cooldown_seconds, count_failure, reached): a note and an
    end of its own or none, one more failure where counted, no failures where the source was reached."""
    both = sources.join(verdicts, "source_key", "left")
    told = F.col("new_health").isNotNull()
    until = F.when(F.col("cooldown_seconds").isNotNull(), as_of + F.make_dt_interval(secs=F.col("cooldown_seconds").cast("decimal(18,6)")))
    fails = F.when(F.coalesce("reached", F.lit(False)), 0).when(F.coalesce("count_failure", F.lit(False)), F.col("consecutive_fails") + 1).otherwise(F.col("consecutive_fails"))
    return both.select("source_key", F.coalesce("new_health", "health").alias("health"), F.when(told, F.col("note")).otherwise(F.col("health_note")).alias("health_note"), F.when(told, until).otherwise(F.col("health_until")).alias("health_until"), fails.cast("int").alias("consecutive_fails"))


def skip_reasons(wanted: DataFrame, sources: DataFrame, source_locations: DataFrame) -> DataFrame:
    """(source_key, reason) of the wanted sources: unknown, out of service, without a scope, else null."""
    scoped = source_locations.where("enabled").select("source_key").distinct().withColumn("scoped", F.lit(True))
    both = wanted.select("source_key").distinct().join(sources.select("source_key", "health"), "source_key", "left").join(scoped, "source_key", "left")
    why = F.when(F.col("health").isNull(), "not in sources").when(F.col("health").isin("blocked", "broken"), F.concat(F.lit("health="), "health")).when(F.col("scoped").isNull(), "no enabled locations")
    return both.select("source_key", why.alias("reason"))


def due(schedules: DataFrame, as_of: Column, job: str | None = None) -> DataFrame:
    """Enabled schedules whose time has come, earliest first."""
    rows = schedules.where(F.col("enabled") & (F.col("next_run_at") <= as_of))
    return (rows.where(F.col("job") == job) if job else rows).orderBy("next_run_at", "id")


def interval_violations(schedules: DataFrame, least: int = 60, most_jitter: int = 50) -> DataFrame:
    """Schedules whose interval is under ``least`` seconds or whose jitter lies outside 0 to ``most_jitter`` percent."""
    return schedules.where(~((F.col("interval_seconds") >= least) & F.col("jitter_pct").between(0, most_jitter)))


def finish_level(status: Column) -> Column:
    return F.when(status.isin("ok", "skipped_locked"), "info").when(status == "degraded", "warn").otherwise("error")


# Names that a log's context must not carry.
FORBIDDEN = ("chat_id", "phone", "phone_e164", "email", "address", "criteria", "token")


def forbidden(ctx: Column) -> Column:
    """The forbidden keys of a context map, sorted."""
    return F.array_sort(F.array_intersect(F.map_keys(ctx), F.array(*map(F.lit, FORBIDDEN))))


def of_latest(rows: DataFrame, run: str) -> DataFrame:
    """Rows of the largest run number."""
    last = rows.agg(F.max(run).alias("last"))  # one row
    return rows.join(F.broadcast(last), F.col(run) == F.col("last"), "left_semi")


# Subscribers --------------------------------------------------------------------------------------------------------


def deliverable(subscriptions: DataFrame, users: DataFrame, user_channels: DataFrame, channels: DataFrame) -> DataFrame:
    """Active filters of active users with a primary address on an enabled channel; addresses aren't read."""
    live = users.where(F.col("status") == "active").select(F.col("id").alias("user_id"))
    on = channels.where("enabled").select("channel")
    primary = user_channels.where("is_primary").select("user_id", "channel").join(F.broadcast(on), "channel")  # a row a channel
    return subscriptions.where("active").join(live, "user_id").join(primary, "user_id")


def candidates(listings: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The listings named by ``ids`` with the columns that matching and messages read, oldest first."""
    narrow = ["price_pcm", "bedrooms", "property_type", "postcode_district", "tfl_zone", "available_from", "furnished", "pets_allowed", "bills_included", "min_tenancy_months", "is_landlord_direct", "url"]
    return listings.join(ids.select(*keys).distinct(), keys, "left_semi").select(*keys, "first_seen_at", *[c for c in narrow if c in listings.columns]).orderBy("first_seen_at", *keys)


def chat_id(chat: Column, sender: Column) -> Column:
    return F.coalesce(chat, sender).cast("string")


def link_chats(links: DataFrame, user_channels: DataFrame) -> DataFrame:
    """Each address' owner after ``links`` (user_id, channel, address, at): a user has one address a channel, the last one
    linked; an address belongs to the user who linked it last."""
    old = user_channels.select("user_id", "channel", "address", F.lit(None).cast("timestamp").alias("at"))
    every = old.unionByName(links.select("user_id", "channel", "address", "at"))
    newest = lambda c: F.struct(F.coalesce(F.col("at"), F.lit("1900-01-01").cast("timestamp")), F.col(c))
    mine = every.groupBy("user_id", "channel").agg(F.max_by(F.struct("address", "at"), newest("address")).alias("r")).select("user_id", "channel", "r.*")
    return mine.groupBy("channel", "address").agg(F.max_by("user_id", newest("user_id")).alias("user_id"))


def stop(stopped: DataFrame, subscriptions: DataFrame, outbox: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subscriptions, outbox, users) after the users in ``stopped`` (user_id) left: filters and queued messages go, what
    was sent stays, the user is marked."""
    gone = stopped.select("user_id").distinct()
    mark = gone.withColumn("gone", F.lit(True))
    told = users.join(mark, users["id"] == mark["user_id"], "left").withColumn("status", F.when(F.col("gone"), "stopped").otherwise(F.col("status"))).drop("gone", "user_id")
    queued = outbox.join(mark, "user_id", "left").where(F.col("gone").isNull() | (F.col("status") != "queued")).drop("gone")
    return subscriptions.join(gone, "user_id", "left_anti"), queued, told


def block(gone: DataFrame, subscriptions: DataFrame, outbox: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(subscriptions, outbox, users) after the users in ``gone`` (user_id) proved unreachable: filters are kept but off,
    queued messages are skipped with a reason, the user is blocked."""
    mark = gone.select("user_id").distinct().withColumn("gone", F.lit(True))
    off = subscriptions.join(mark, "user_id", "left").withColumn("active", F.col("active") & F.col("gone").isNull()).drop("gone")
    waits = F.coalesce(F.col("gone"), F.lit(False)) & (F.col("status") == "queued")
    skipped = outbox.join(mark, "user_id", "left").withColumn("error", F.when(waits, "recipient unreachable").otherwise(F.col("error"))).withColumn("status", F.when(waits, "skipped").otherwise(F.col("status"))).drop("gone")
    told = users.join(mark, users["id"] == mark["user_id"], "left").withColumn("status", F.when(F.col("gone"), "blocked").otherwise(F.col("status"))).drop("gone", "user_id")
    return off, skipped, told


def enumeration_violations(rows: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """(key, column, value) of every non-null value outside its column's list."""
    pairs = F.array(*[F.when(~F.col(c).isin(values), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, values in allowed.items()])
    return rows.select(key, F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("v")).select(key, "v.column", "v.value")


def erase(users: DataFrame, erased: DataFrame, owned: DataFrame, referring: DataFrame, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, owned rows, referring rows) after an erasure: a user's own rows go, references become null."""
    gone = erased.select("user_id").distinct()
    kept = users.join(gone, users["id"] == gone["user_id"], "left_anti")
    mark = gone.select(F.col("user_id").alias(column), F.lit(True).alias("gone"))
    loose = referring.join(mark, column, "left").withColumn(column, F.when(F.col("gone").isNull(), F.col(column))).drop("gone")
    return kept, owned.join(gone, "user_id", "left_anti"), loose


def start_answer(starts: DataFrame, user_channels: DataFrame, users: DataFrame, channel: str) -> DataFrame:
    """(chat, answer) to a start without a token: already active, or a link is needed."""
    known = user_channels.where(F.col("channel") == channel).join(users.select(F.col("id").alias("user_id"), "status"), "user_id").groupBy(F.col("address").alias("chat")).agg(F.max((F.col("status") == "active").cast("int")).alias("on"))
    return starts.select("chat").distinct().join(known, "chat", "left").select("chat", F.when(F.col("on") == 1, "already active").otherwise("needs link").alias("answer"))


def intake(forms: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Rows of pending users and their filters from accepted forms (id, districts text, cap)."""
    return forms.select("id", F.lit("pending").alias("status"), F.lit("web_form").alias("consent_source"), F.coalesce(F.nullif(F.replace("districts", F.lit(","), F.lit(", ")), F.lit("")), F.lit("London")).alias("label"), "cap", as_of.alias("backfill_from"), (as_of + F.make_dt_interval(mins=F.lit(minutes))).alias("token_expires_at"))


# Delivery -----------------------------------------------------------------------------------------------------------

# The message shape of each kind of event.
SHAPES = {"new_listing": "listing", "price_drop": "listing", "welcome": "welcome", "stopped": "stopped"}


def shape(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SHAPES.items() for x in pair]), kind)


def delivery(claimed: DataFrame, listings: DataFrame, sources: DataFrame, user_channels: DataFrame, channels: DataFrame) -> DataFrame:
    """Claimed messages with listing, source name and address (which may be missing), and the first reason not to send."""
    names = sources.select("source_key", F.col("display_name").alias("source_display"))
    address = user_channels.select("user_id", "channel", "address")
    built = channels.select("channel", "implemented", "shapes")
    rows = claimed.join(listings, ["source_key", "external_id"]).join(names, "source_key").join(address, ["user_id", "channel"], "left").join(F.broadcast(built), "channel", "left")  # a row a channel
    kind = shape(F.col("kind"))
    why = (
        F.when(~F.coalesce("implemented", F.lit(False)), F.concat(F.lit("no notifier for channel "), "channel"))
        .when(F.coalesce("address", F.lit("")) == "", F.concat(F.lit("no "), "channel", F.lit(" address for the user")))
        .when(~F.coalesce(kind == "listing", F.lit(False)), F.concat(F.lit("nothing to render for kind "), "kind"))
        .when(~F.array_contains("shapes", kind), F.concat_ws(" ", "channel", F.lit("does not support"), kind))
    )
    return rows.withColumn("problem", why)


def stage_status(results: DataFrame, by: list[str]) -> DataFrame:
    """degraded if any message of the stage was not sent, else ok; skipped ones don't count."""
    bad = F.max(F.when(F.col("status").isin("sent", "skipped"), 0).otherwise(1))
    return results.groupBy(*by).agg(F.when(bad == 1, "degraded").otherwise("ok").alias("status"), F.count(F.lit(1)).alias("claimed"), F.count_if(F.col("status") == "sent").alias("sent"))


def with_actions(text: Column, actions: Column, limit: int = 4096) -> Column:
    """The text, a blank line and one ``label: url`` line an action, cut."""
    lines = F.array_join(F.transform(actions, lambda a: F.concat(a["label"], F.lit(": "), a["url"])), "\n")
    return F.substring(F.when(F.size(actions) > 0, F.concat(text, F.lit("\n\n"), lines)).otherwise(text), 1, limit)
