"""Queries over listings: scalar rules, normalisation, quality, health, reconciliation, matching, outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, money, text
from ..operators import listings as L
from ..operators import matching as M
from ..operators import reconcile as R
from ..sources.views import spread, table, view, view_sql
from . import sqlparts as S

REF = "DATE '2024-01-15'"
REFERENCE = F.expr
CUT = "DATE '1998-01-01'"
NOW = "TIMESTAMP '2024-01-12 09:30:00'"
SCOPE = ["SE16", "E1", "N1"]
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, *views: str):
    """Registers a query and, with ``sql``, its oracle over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"WITH RECURSIVE {view_sql(*views)}\n{sql}" if views and not sql.lstrip().startswith(",") else f"WITH RECURSIVE {view_sql(*views)}{sql}") if views else sql
        return f

    return add


def _scalar(name: str, column: str, spark_column, sql: str) -> None:
    """A query (source, id, column, value) of one rule over the raw listings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return view(spark, sf_dir, "raw_listing").select("source_key", "external_id", F.col(column).alias("raw"), spark_column(F.col(column)).alias("value"))

    run.__name__ = name
    query(f"SELECT source_key, external_id, {column} AS raw, {sql} AS value FROM raw_listing", "raw_listing")(run)


REFC = lambda: F.expr(REF)
_scalar("price_to_pcm", "price_raw", lambda c: money.to_pcm(c), S.to_pcm("price_raw", "'month'"))
_scalar("price_period", "price_raw", money.period, S.period("price_raw"))
_scalar("price_rejects", "price_raw", lambda c: money.reject(c, "unknown"), S.reject("price_raw", "'unknown'"))
_scalar("deposit_sum", "price_raw", money.deposit, S.amount("price_raw"))
_scalar("bedrooms_norm", "bedrooms_raw", text.bedrooms, S.bedrooms("bedrooms_raw"))
_scalar("furnished_norm", "furnished_raw", lambda c: text.furnished(F.coalesce(c, F.lit(""))), S.furnished("coalesce(furnished_raw, '')"))
_scalar("property_type_norm", "property_type_raw", text.property_type, S.property_type("property_type_raw"))
_scalar("tenancy_norm", "tenancy_raw", text.min_tenancy_months, S.tenancy("tenancy_raw"))
_scalar("flag_tristate", "flag_raw", text.tri_state, S.tri_state("flag_raw"))
_scalar("available_date", "available_raw", lambda c: dates.available_from(c, REFC()), S.available("available_raw", REF))
_scalar("available_iso", "available_raw", dates.iso, S.iso("available_raw"))
_scalar("available_day_first", "available_raw", dates.day_first, S.day_first("available_raw"))
_scalar("available_day_month", "available_raw", lambda c: dates.day_month(c, REFC()), S.day_month("available_raw", REF))
_scalar("available_month_day", "available_raw", lambda c: dates.month_day(c, REFC()), S.month_day("available_raw", REF))
_scalar("outward_from_url", "url", geo.outward_from_url, S.from_url("url"))
_scalar("outward_from_address", "address_raw", geo.outward_from_address, S.address("address_raw"))
_scalar("postcode_outward", "postcode_raw", lambda c: geo.split_postcode(c)["outward"], S.postcode("postcode_raw"))
_scalar("postcode_inward", "postcode_raw", lambda c: geo.split_postcode(c)["inward"], S.inward("postcode_raw"))
_scalar("clean_text", "title", lambda c: text.clean(F.concat(F.lit("  "), c, F.lit("  \n x ")), 12), f"substr({S.clean(chr(40) + chr(39) + '  ' + chr(39) + ' || title || ' + chr(39) + '  ' + chr(39) + ' || chr(10) || ' + chr(39) + ' x ' + chr(39) + ')')}, 1, 12)")
_scalar("scope_flag", "url", lambda c: geo.in_scope(c, SCOPE)["in_scope"], f"({S.from_url('url')} IS NULL OR {S.from_url('url')} IN ('SE16', 'E1', 'N1'))")


# Canonical listings -------------------------------------------------------------------------------------------------

DEFAULT = "(CASE WHEN source_key = 'direct' THEN 'month' ELSE 'unknown' END)"
LISTING_SQL = f""", listing AS (
  SELECT source_key, external_id, url, {S.clean('title')} AS title, {S.to_pcm('price_raw', DEFAULT)} AS price_pcm, {S.reject('price_raw', DEFAULT)} AS price_reject,
    coalesce({S.bedrooms('bedrooms_raw')}, CASE WHEN {S.property_type('property_type_raw')} = 'studio' THEN 0 END) AS bedrooms,
    {S.property_type('property_type_raw')} AS property_type, {S.furnished("coalesce(furnished_raw, '')")} AS furnished, {S.tri_state('flag_raw')} AS pets_allowed,
    {S.available('available_raw', REF)} AS available_from, {S.tenancy('tenancy_raw')} AS min_tenancy_months, {S.postcode('postcode_raw')} AS postcode_district,
    source_key = 'direct' AS is_landlord_direct, first_seen_at FROM raw_listing)
"""
SUBS_SQL = ", sub AS (SELECT * FROM subscription)"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.normalise(spread(spark, sf_dir, "raw_listing"), F.expr(REF))


def subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "subscription").where("active")
    return s.withColumn("districts", F.when(F.col("district").isNotNull(), F.array("district"))).drop("district")


@query(f"{LISTING_SQL} SELECT * FROM listing WHERE source_key = 'direct'", "raw_listing")
def listings_direct(spark, sf_dir):
    return listing(spark, sf_dir).where(F.col("source_key") == "direct")


@query(f"{LISTING_SQL} SELECT * FROM listing WHERE source_key = 'agent'", "raw_listing")
def listings_agent(spark, sf_dir):
    return listing(spark, sf_dir).where(F.col("source_key") == "agent")


@query(f"{LISTING_SQL} SELECT source_key, price_reject, count(*) AS n FROM listing WHERE price_reject IS NOT NULL GROUP BY ALL", "raw_listing")
def listing_rejects(spark, sf_dir):
    return listing(spark, sf_dir).where(F.col("price_reject").isNotNull()).groupBy("source_key", "price_reject").agg(F.count(F.lit(1)).alias("n"))


@query(f"{LISTING_SQL} SELECT source_key, external_id, 'price_pcm' AS reasons FROM listing WHERE price_pcm * 20 NOT BETWEEN 100 AND 60000", "raw_listing")
def domain_violations(spark, sf_dir):
    rows = listing(spark, sf_dir).withColumn("price_pcm", F.col("price_pcm") * 20)
    rules = L.listing_rules(rows.columns) | {"price_pcm": F.col("price_pcm").between(100, 60_000)}
    return L.validate(rows, rules)[1].select("source_key", "external_id", F.array_join("reject_reasons", ",").alias("reasons"))


@query("SELECT user_id, count(*) AS n FROM subscription WHERE active GROUP BY user_id HAVING count(*) > 1", "subscription")
def key_violations(spark, sf_dir):
    return L.unique_violations(view(spark, sf_dir, "subscription"), ["user_id"], F.col("active"))


@query("SELECT DISTINCT notification_id, user_id FROM receipt WHERE user_id NOT IN (SELECT user_id FROM subscription WHERE active AND id % 3 = 0)", "receipt", "subscription")
def orphan_rows(spark, sf_dir):
    return L.orphans(view(spark, sf_dir, "receipt"), view(spark, sf_dir, "subscription").where("active AND id % 3 = 0"), ["user_id"]).select("notification_id", "user_id")


# Health -------------------------------------------------------------------------------------------------------------

HEALTH_SQL = f"""{LISTING_SQL}, b AS (SELECT l.*, r.batch_no FROM listing l JOIN raw_listing r USING (source_key, external_id)),
h AS (SELECT source_key, batch_no, count(*) AS items,
    count(*) FILTER (WHERE price_pcm NOT BETWEEN 200 AND 20000 OR bedrooms NOT BETWEEN 0 AND 10) AS implausible, count(external_id) - count(DISTINCT external_id) AS duplicates,
    avg(CASE WHEN price_pcm IS NOT NULL THEN 1.0 ELSE 0.0 END) AS fill_price_pcm, avg(CASE WHEN title IS NOT NULL THEN 1.0 ELSE 0.0 END) AS fill_title FROM b GROUP BY ALL)
"""


def _batches(spark, sf_dir):
    return listing(spark, sf_dir).join(view(spark, sf_dir, "raw_listing").select("source_key", "external_id", "batch_no"), ["source_key", "external_id"])


@query(f"""{HEALTH_SQL} SELECT source_key, batch_no, items, implausible, duplicates, round(fill_price_pcm, 6) AS fill_price_pcm,
  CASE WHEN items < 12 THEN 'broken' WHEN fill_price_pcm < 0.95 OR fill_title < 0.95 THEN 'broken' WHEN implausible > items * 0.10 THEN 'broken' ELSE 'ok' END AS verdict,
  CASE WHEN items < 12 THEN 'below floor' WHEN fill_price_pcm < 0.95 OR fill_title < 0.95 THEN 'low fill' WHEN implausible > items * 0.10 THEN 'implausible' END AS note,
  CASE WHEN fill_price_pcm < 0.95 THEN 'price_pcm' ELSE '' END AS low_fields FROM h""", "raw_listing")
def health_by_source(spark, sf_dir):
    out = L.health(_batches(spark, sf_dir), ["price_pcm", "title"], ["source_key", "batch_no"], min_items=12)
    return out.select("source_key", "batch_no", "items", "implausible", "duplicates", F.round("fill_price_pcm", 6).alias("fill_price_pcm"), "verdict", "note", "low_fields")


@query(f"{HEALTH_SQL} SELECT source_key, sum(items) AS items, sum(implausible) AS implausible FROM h GROUP BY source_key", "raw_listing")
def implausible_rows(spark, sf_dir):
    return L.health(_batches(spark, sf_dir), ["price_pcm"], ["source_key"], 1).select("source_key", "items", "implausible")


@query("""SELECT source_key, day, items, round(avg_items, 6) AS recent_average, items < avg_items * 0.9 AS thin FROM (
  SELECT source_key, CAST(ts AS DATE) AS day, count(*) AS items, avg(count(*)) OVER (PARTITION BY source_key ORDER BY CAST(ts AS DATE) ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS avg_items
  FROM run_event GROUP BY source_key, CAST(ts AS DATE))""", "run_event")
def volume_anomaly(spark, sf_dir):
    counts = view(spark, sf_dir, "run_event").groupBy("source_key", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("items"))
    out = L.recent_average(counts, ["source_key"], "day", 3)
    return out.select("source_key", "day", "items", F.round("recent_average", 6).alias("recent_average"), (F.col("items") < F.col("recent_average") * 0.9).alias("thin"))


# Reconciliation -----------------------------------------------------------------------------------------------------

DECISION_SQL = f""", old AS (SELECT external_id, arg_max(price_pcm, (run_day, ordinal)) AS price_pcm, arg_max(title, (run_day, ordinal)) AS title, count(*) % 2 AS miss_count,
    CASE WHEN count(*) % 5 = 0 THEN 'delisted' ELSE 'active' END AS status FROM sighting WHERE run_day < {CUT} GROUP BY external_id),
new AS (SELECT external_id, arg_max(price_pcm, (run_day, ordinal)) AS price_pcm, arg_max(title, (run_day, ordinal)) AS title FROM sighting WHERE run_day >= {CUT} GROUP BY external_id),
d AS (SELECT coalesce(o.external_id, n.external_id) AS external_id, o.external_id IS NOT NULL AS had, n.external_id IS NOT NULL AS came, o.price_pcm AS op, n.price_pcm AS np, o.title AS ot, n.title AS nt, o.status AS os, o.miss_count AS om
  FROM old o FULL JOIN new n USING (external_id)),
decision AS (SELECT *, CASE WHEN NOT had THEN 'insert' WHEN came AND os = 'delisted' THEN 'revive' WHEN came AND (op <> np OR ot <> nt) THEN 'update' WHEN came THEN 'unchanged'
    WHEN os = 'delisted' OR CAST(external_id AS BIGINT) % 10 = 0 THEN 'hold' WHEN om + 1 >= 2 THEN 'delist' ELSE 'miss' END AS kind FROM d)
"""


def decisions(spark, sf_dir, mode="sweep"):
    seen = view(spark, sf_dir, "sighting")
    before = seen.where(f"run_day < {CUT}").groupBy("external_id").agg(F.max_by(F.struct("price_pcm", "title"), F.struct("run_day", "ordinal")).alias("r"), F.count(F.lit(1)).alias("n"))
    state = before.select("external_id", "r.*", (F.col("n") % 2).alias("miss_count"), F.when(F.col("n") % 5 == 0, "delisted").otherwise("active").alias("status"))
    incoming = R.latest(seen.where(f"run_day >= {CUT}"), ["external_id"], ["run_day", "ordinal"]).select("external_id", "price_pcm", "title")
    health = F.when(F.col("o.external_id").cast("long") % 10 == 0, "degraded").otherwise("ok")
    return R.reconcile(state, incoming, ["external_id"], ["price_pcm", "title"], mode, health)


@query(f"{DECISION_SQL} SELECT external_id, kind, kind = 'insert' AS notify FROM decision", "sighting")
def reconcile_kind(spark, sf_dir):
    return decisions(spark, sf_dir).select("external_id", "kind", "notify")


@query(f"{DECISION_SQL} SELECT external_id, concat_ws(',', CASE WHEN op <> np THEN 'price_pcm' END, CASE WHEN ot <> nt THEN 'title' END) AS changed_fields FROM decision WHERE had AND came", "sighting")
def changed_fields(spark, sf_dir):
    return decisions(spark, sf_dir).where(F.col("kind").isin("update", "unchanged", "revive")).select("external_id", "changed_fields")


@query(f"{DECISION_SQL} SELECT external_id, op AS old_price, np AS new_price FROM decision WHERE had AND came AND op <> np", "sighting")
def price_changes(spark, sf_dir):
    return decisions(spark, sf_dir).where(F.col("new_price").isNotNull()).select("external_id", "old_price", "new_price")


@query(f"""{DECISION_SQL} SELECT external_id, CASE WHEN kind = 'delist' THEN 'delisted' WHEN came THEN 'active' ELSE os END AS status,
  CAST(CASE WHEN came THEN 0 WHEN kind IN ('miss', 'delist') THEN om + 1 ELSE om END AS INT) AS miss_count, coalesce(np, op) AS price_pcm, coalesce(nt, ot) AS title FROM decision""", "sighting")
def next_state(spark, sf_dir):
    return decisions(spark, sf_dir).select("external_id", "status", "miss_count", "price_pcm", "title")


@query(f"{DECISION_SQL} SELECT kind, count(*) AS n, count(*) FILTER (WHERE had AND came AND op <> np) AS price_changes FROM decision GROUP BY kind", "sighting")
def reconcile_counters(spark, sf_dir):
    return R.summary(decisions(spark, sf_dir))


@query(f"{DECISION_SQL} SELECT external_id, CAST(om AS INT) AS miss_count FROM decision WHERE had AND NOT came", "sighting")
def delist_hold(spark, sf_dir):
    return decisions(spark, sf_dir, mode="hot").where(F.col("kind") == "hold").select("external_id", "miss_count")


@query(f"{DECISION_SQL} SELECT external_id, np AS price_pcm FROM decision WHERE NOT had OR (came AND op <> np)", "sighting")
def price_log_rows(spark, sf_dir):
    return R.price_rows(decisions(spark, sf_dir), F.expr(NOW), ["external_id"]).select("external_id", "price_pcm")


@query("""SELECT external_id, run_day, ordinal, price_pcm, previous FROM (SELECT *, lag(price_pcm) OVER w AS previous, row_number() OVER w AS rn FROM sighting WINDOW w AS (PARTITION BY external_id ORDER BY run_day, ordinal))
  WHERE rn = 1 OR previous IS DISTINCT FROM price_pcm""", "sighting")
def price_history(spark, sf_dir):
    return R.change_points(view(spark, sf_dir, "sighting"), ["external_id"], ["run_day", "ordinal"], "price_pcm").select("external_id", "run_day", "ordinal", "price_pcm", "previous")


@query("SELECT DISTINCT external_id, run_day FROM sighting s WHERE ordinal % 2 = 1 AND NOT EXISTS (SELECT 1 FROM sighting l WHERE l.ordinal % 2 = 0 AND l.external_id = s.external_id AND l.run_day = s.run_day)", "sighting")
def price_log_append(spark, sf_dir):
    seen = view(spark, sf_dir, "sighting")
    return R.append_unique(seen.where("ordinal % 2 = 0"), seen.where("ordinal % 2 = 1"), ["external_id", "run_day"]).select("external_id", "run_day")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, CASE WHEN b.k IS NOT NULL THEN b.w ELSE a.w END AS w
  FROM (SELECT s_suppkey AS k, s_nationkey AS v, s_acctbal AS w FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 99 END AS v, -s_acctbal AS w FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) b USING (k)""")
def location_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 3 <> 0").selectExpr("s_suppkey AS k", "s_nationkey AS v", "s_acctbal AS w")
    new = s.where("s_suppkey % 2 = 0 OR s_suppkey % 3 = 0").selectExpr("s_suppkey AS k", "CASE WHEN s_suppkey % 2 = 0 THEN 99 END AS v", "-s_acctbal AS w")
    return R.upsert(old, new, ["k"], keep_old_if_null=["v"])


# Matching -----------------------------------------------------------------------------------------------------------

MATCH_SQL = f"""{LISTING_SQL}, pairs AS (SELECT s.id AS subscription_id, s.user_id, l.source_key, l.external_id, l.first_seen_at, s.backfill_from, s.cap, l.postcode_district
  FROM listing l JOIN subscription s ON s.active AND l.price_pcm <= s.price_max AND (s.district IS NULL OR l.postcode_district = s.district) AND (s.pets_allowed IS NULL OR l.pets_allowed = s.pets_allowed))
"""
PRIOR_SQL = ", prior AS (SELECT user_id, CAST(notification_id AS VARCHAR) AS external_id, CASE WHEN notification_id % 2 = 0 THEN 'direct' ELSE 'agent' END AS source_key, created_at, CASE WHEN code = 200 THEN 'sent' WHEN code = 429 THEN 'queued' ELSE 'failed' END AS status FROM receipt)"


def pairs(spark, sf_dir):
    return M.match(listing(spark, sf_dir), subs(spark, sf_dir))


def prior(spark, sf_dir):
    status = F.when(F.col("code") == 200, "sent").when(F.col("code") == 429, "queued").otherwise("failed")
    return view(spark, sf_dir, "receipt").select("user_id", F.col("notification_id").cast("string").alias("external_id"), F.when(F.col("notification_id") % 2 == 0, "direct").otherwise("agent").alias("source_key"), "created_at", status.alias("status"))


@query(f"{MATCH_SQL} SELECT subscription_id, source_key, external_id FROM pairs", "raw_listing", "subscription")
def match_pairs(spark, sf_dir):
    return M.match_columns(listing(spark, sf_dir), subs(spark, sf_dir), M.LISTING, ["id"])


@query(f"{MATCH_SQL} SELECT postcode_district, count(*) AS matches, count(DISTINCT subscription_id) AS subscriptions FROM pairs GROUP BY postcode_district", "raw_listing", "subscription")
def match_by_district(spark, sf_dir):
    return M.by_value(listing(spark, sf_dir), subs(spark, sf_dir), "postcode_district")


@query(f"{MATCH_SQL} SELECT source_key, external_id, count(*) AS subscriptions FROM pairs GROUP BY ALL", "raw_listing", "subscription")
def subscriptions_of_listing(spark, sf_dir):
    return M.by_listing(listing(spark, sf_dir), subs(spark, sf_dir))


@query(f"""{LISTING_SQL} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.price_pcm IS NULL THEN 'price_pcm unknown' WHEN l.price_pcm > s.price_max THEN 'price_pcm above'
    WHEN s.district IS NOT NULL AND l.postcode_district IS NULL THEN 'location unknown' WHEN s.district IS NOT NULL AND l.postcode_district <> s.district THEN 'outside areas'
    WHEN s.pets_allowed IS NOT NULL AND l.pets_allowed IS NULL THEN 'pets_allowed not stated' WHEN s.pets_allowed <> l.pets_allowed THEN 'pets_allowed differs' END AS reason
  FROM listing l, subscription s WHERE s.active) GROUP BY reason""", "raw_listing", "subscription")
def match_reasons(spark, sf_dir):
    return M.refusals(listing(spark, sf_dir), subs(spark, sf_dir))


@query(f"""{LISTING_SQL}, lg AS (SELECT price_pcm, postcode_district, pets_allowed, count(*) AS n FROM listing GROUP BY ALL),
sg AS (SELECT price_max, district, pets_allowed, count(*) AS n FROM subscription WHERE active GROUP BY ALL)
SELECT reason, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l.n * s.n AS n, CASE WHEN l.price_pcm IS NULL THEN 'price_pcm unknown' WHEN l.price_pcm > s.price_max THEN 'price_pcm above'
    WHEN s.district IS NOT NULL AND l.postcode_district IS NULL THEN 'location unknown' WHEN s.district IS NOT NULL AND l.postcode_district <> s.district THEN 'outside areas'
    WHEN s.pets_allowed IS NOT NULL AND l.pets_allowed IS NULL THEN 'pets_allowed not stated' WHEN s.pets_allowed <> l.pets_allowed THEN 'pets_allowed differs' END AS reason
  FROM lg l, sg s) GROUP BY reason""", "raw_listing", "subscription")
def match_reasons_all(spark, sf_dir):
    return M.refusals(listing(spark, sf_dir), subs(spark, sf_dir))


@query(f"{MATCH_SQL} SELECT subscription_id, source_key, external_id FROM pairs WHERE first_seen_at > backfill_from", "raw_listing", "subscription")
def eligible_pairs(spark, sf_dir):
    return M.match_eligible(listing(spark, sf_dir), subs(spark, sf_dir)).select("subscription_id", "source_key", "external_id")


LONDON = "timezone('UTC', timezone('Europe/London', date_trunc('day', timezone('Europe/London', timezone('UTC', {})))))"


@query(f"{PRIOR_SQL} SELECT user_id, count(*) AS sent FROM prior WHERE status IN ('queued', 'sent') AND created_at >= {LONDON.format(NOW)} GROUP BY user_id", "receipt")
def sent_today(spark, sf_dir):
    return M.sent_today(prior(spark, sf_dir), F.expr(NOW))


@query(f"SELECT notification_id, {LONDON.format('created_at + INTERVAL 180 DAY')} AS midnight FROM receipt", "receipt")
def london_midnight(spark, sf_dir):
    return view(spark, sf_dir, "receipt").select("notification_id", M.london_midnight(F.col("created_at") + F.expr("INTERVAL 180 DAYS")).alias("midnight"))


QUEUE_SQL = f"""{MATCH_SQL}{PRIOR_SQL}, el AS (SELECT * FROM pairs WHERE first_seen_at > backfill_from),
one AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY user_id, source_key, external_id ORDER BY subscription_id) = 1),
fresh AS (SELECT o.* FROM one o WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE p.user_id = o.user_id AND p.source_key = o.source_key AND p.external_id = o.external_id)),
st AS (SELECT user_id, count(*) AS sent FROM prior WHERE status IN ('queued', 'sent') AND created_at >= {LONDON.format(NOW)} GROUP BY user_id),
pl AS (SELECT f.*, coalesce(sent, 0) AS sent, row_number() OVER (PARTITION BY user_id ORDER BY subscription_id, first_seen_at, CAST(external_id AS BIGINT), source_key, external_id) AS place FROM fresh f LEFT JOIN st USING (user_id))
"""


@query(f"{QUEUE_SQL} SELECT user_id, subscription_id, source_key, external_id, place FROM pl WHERE place + sent <= cap", "raw_listing", "subscription", "receipt")
def alerts_queued(spark, sf_dir):
    before = prior(spark, sf_dir)
    return M.queue_matches(listing(spark, sf_dir), subs(spark, sf_dir), before, M.sent_today(before, F.expr(NOW)))


@query(f"{QUEUE_SQL} SELECT user_id, count(*) AS queued FROM pl WHERE place + sent <= cap GROUP BY user_id", "raw_listing", "subscription", "receipt")
def alerts_capped(spark, sf_dir):
    return alerts_queued(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("queued"))


@query(f"{QUEUE_SQL} SELECT (SELECT count(*) FROM pairs) AS matched, (SELECT count(*) FROM el) AS eligible, (SELECT count(*) FROM pl WHERE place + sent <= cap) AS queued", "raw_listing", "subscription", "receipt")
def match_counters(spark, sf_dir):
    both = M.count_matches(listing(spark, sf_dir), subs(spark, sf_dir))
    return both.join(alerts_queued(spark, sf_dir).agg(F.count(F.lit(1)).alias("queued")))


# All criteria, caps by filter ---------------------------------------------------------------------------------------

OFFER_SQL = f"""{LISTING_SQL}, offer AS (SELECT l.* REPLACE (CASE WHEN s.hidden THEN NULL ELSE l.postcode_district END AS postcode_district), s.bills_included, s.tfl_zone FROM listing l JOIN said s USING (source_key, external_id)),
wish AS (SELECT * REPLACE (list_transform(split(lower(property_types), ','), lambda x: x) AS property_types, split(upper(districts), ',') AS districts, split(lower(furnished), ',') AS furnished, CAST(split(zones, ',') AS INT[]) AS zones) FROM criteria),
judged AS (SELECT w.id AS subscription_id, w.user_id, w.cap, w.backfill_from, o.source_key, o.external_id, o.first_seen_at, CASE
    WHEN (price_min IS NOT NULL OR price_max IS NOT NULL) AND price_pcm IS NULL THEN 'price_pcm unknown' WHEN price_pcm < price_min THEN 'price_pcm below' WHEN price_pcm > price_max THEN 'price_pcm above'
    WHEN (bedrooms_min IS NOT NULL OR bedrooms_max IS NOT NULL) AND bedrooms IS NULL THEN 'bedrooms unknown' WHEN bedrooms < bedrooms_min THEN 'bedrooms below' WHEN bedrooms > bedrooms_max THEN 'bedrooms above'
    WHEN property_types IS NOT NULL AND property_type IS NULL THEN 'property_type unknown' WHEN NOT list_contains(property_types, lower(property_type)) THEN 'property_type not wished'
    WHEN (districts IS NOT NULL OR zones IS NOT NULL) AND NOT coalesce(list_contains(districts, upper(postcode_district)), FALSE) AND NOT coalesce(list_contains(zones, tfl_zone), FALSE)
      THEN CASE WHEN coalesce(postcode_district, '') = '' AND tfl_zone IS NULL THEN 'location unknown' ELSE 'outside areas' END
    WHEN w.furnished IS NOT NULL AND coalesce(o.furnished, 'unknown') = 'unknown' THEN 'furnished unknown' WHEN NOT list_contains(w.furnished, lower(o.furnished)) THEN 'furnished not wished'
    WHEN w.pets_allowed IS NOT NULL AND o.pets_allowed IS NULL THEN 'pets_allowed not stated' WHEN w.pets_allowed <> o.pets_allowed THEN 'pets_allowed differs'
    WHEN w.bills_included IS NOT NULL AND o.bills_included IS NULL THEN 'bills_included not stated' WHEN w.bills_included <> o.bills_included THEN 'bills_included differs'
    WHEN (available_before IS NOT NULL OR available_after IS NOT NULL) AND available_from IS NULL THEN 'availability unknown' WHEN available_from > available_before THEN 'available too late' WHEN available_from < available_after THEN 'available too early'
    WHEN tenancy_max IS NOT NULL AND min_tenancy_months IS NULL THEN 'tenancy unknown' WHEN min_tenancy_months > tenancy_max THEN 'tenancy too long'
    WHEN direct_only AND is_landlord_direct IS NOT TRUE THEN 'not landlord direct' END AS reason
  FROM offer o, wish w)
"""


def offer(spark, sf_dir):
    said = view(spark, sf_dir, "said")
    return listing(spark, sf_dir).join(said, ["source_key", "external_id"]).withColumn("postcode_district", F.when(~F.col("hidden"), F.col("postcode_district"))).drop("hidden")


def criteria(spark, sf_dir):
    lists = {c: F.split(c, ",") for c in ("property_types", "districts", "furnished")} | {"zones": F.split("zones", ",").cast("array<int>")}
    return view(spark, sf_dir, "criteria").withColumns(lists)


@query(f"{OFFER_SQL} SELECT subscription_id, source_key, external_id FROM judged WHERE reason IS NULL", "raw_listing", "said", "criteria")
def criteria_pairs(spark, sf_dir):
    return M.match_columns(offer(spark, sf_dir), criteria(spark, sf_dir), M.LISTING, ["id"])


@query(f"{OFFER_SQL} SELECT reason, count(*) AS n FROM judged GROUP BY reason", "raw_listing", "said", "criteria")
def criteria_reasons(spark, sf_dir):
    return M.refusals(offer(spark, sf_dir), criteria(spark, sf_dir))


#: The run as a loop: a row of recursion a user and step, over the filters' beginnings and their matches in order.
RUN_SQL = f"""{OFFER_SQL}{PRIOR_SQL}, st AS (SELECT user_id, count(*) AS sent FROM prior WHERE status IN ('queued', 'sent') AND created_at >= {LONDON.format(NOW)} GROUP BY user_id),
placed AS (SELECT source_key, external_id, row_number() OVER (ORDER BY first_seen_at NULLS FIRST, source_key, external_id) AS position FROM offer),
found AS MATERIALIZED (SELECT j.*, position, coalesce(first_seen_at <= backfill_from, FALSE) AS late, EXISTS (SELECT 1 FROM prior p WHERE p.user_id = j.user_id AND p.source_key = j.source_key AND p.external_id = j.external_id) AS known
  FROM judged j JOIN placed USING (source_key, external_id) WHERE reason IS NULL),
step AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY subscription_id, position) AS i
  FROM (SELECT user_id, subscription_id, cap, position, late, known, source_key, external_id FROM found UNION ALL SELECT user_id, id, cap, 0, FALSE, FALSE, NULL, NULL FROM wish)),
loop AS (
  SELECT s.user_id, i, subscription_id, position, coalesce(sent, 0) AS tally, []::BIGINT[] AS taken, CASE WHEN coalesce(sent, 0) >= cap THEN subscription_id END AS stopped, FALSE AS queued, coalesce(sent, 0) >= cap AS stop
  FROM step s LEFT JOIN st USING (user_id) WHERE i = 1
  UNION ALL
  SELECT user_id, i, subscription_id, position, tally + new, CASE WHEN new = 1 THEN list_append(taken, position) ELSE taken END,
    CASE WHEN subscription_id IS NOT DISTINCT FROM stopped THEN stopped WHEN tally + new >= cap THEN subscription_id ELSE stopped END, new = 1, subscription_id IS DISTINCT FROM stopped AND tally + new >= cap
  FROM (SELECT s.*, l.tally, l.taken, l.stopped,
      CASE WHEN s.position > 0 AND s.subscription_id IS DISTINCT FROM l.stopped AND NOT s.late AND NOT s.known AND l.tally < s.cap AND NOT list_contains(l.taken, s.position) THEN 1 ELSE 0 END AS new
    FROM loop l JOIN step s ON s.user_id = l.user_id AND s.i = l.i + 1)),
stops AS (SELECT subscription_id, position AS stop_at FROM loop WHERE stop)
"""


@query(f"{RUN_SQL} SELECT l.user_id, l.subscription_id, source_key, external_id FROM loop l JOIN placed USING (position) WHERE queued", "raw_listing", "said", "criteria", "receipt")
def alerts_by_filter(spark, sf_dir):
    before = prior(spark, sf_dir)
    return M.queue_run(offer(spark, sf_dir), criteria(spark, sf_dir), before, M.sent_today(before, F.expr(NOW)))[0]


@query(f"""{RUN_SQL}, a AS (SELECT (SELECT count(*) FROM offer) AS candidates, (SELECT count(*) FROM loop WHERE queued) AS queued,
    (SELECT CAST(sum(coalesce(stop_at, (SELECT count(*) FROM offer))) AS BIGINT) FROM wish LEFT JOIN stops ON subscription_id = id) AS looked, (SELECT count(*) FROM stops WHERE stop_at < (SELECT count(*) FROM offer)) AS capped,
    (SELECT count(*) FROM found LEFT JOIN stops USING (subscription_id) WHERE position <= coalesce(stop_at, position)) AS matched,
    (SELECT count(*) FROM found LEFT JOIN stops USING (subscription_id) WHERE position <= coalesce(stop_at, position) AND late) AS not_eligible)
  SELECT candidates, capped, looked - matched AS not_matched, not_eligible, queued, matched - not_eligible - queued AS already_notified FROM a""", "raw_listing", "said", "criteria", "receipt")
def run_queue_counters(spark, sf_dir):
    before = prior(spark, sf_dir)
    return M.queue_run(offer(spark, sf_dir), criteria(spark, sf_dir), before, M.sent_today(before, F.expr(NOW)))[1]


# Outbox -------------------------------------------------------------------------------------------------------------


@query("SELECT notification_id, user_id, attempts + 1 AS attempts FROM receipt WHERE code = 429 AND attempts < 5 ORDER BY created_at, notification_id LIMIT 50", "receipt")
def claim_batch(spark, sf_dir):
    outbox = view(spark, sf_dir, "receipt").withColumn("status", F.when(F.col("code") == 429, "queued").otherwise("sent"))
    return M.claim(outbox).select("notification_id", "user_id", "attempts")


@query("""SELECT code, attempts, code = 200 AS ok, code = 429 OR code >= 500 AS retryable, code = 403 AS gone,
  CASE WHEN code = 200 THEN 'sent' WHEN code = 403 OR code = 400 THEN 'failed' WHEN attempts >= 5 THEN 'failed' ELSE 'queued' END AS outcome, count(*) AS n FROM receipt GROUP BY code, attempts""", "receipt")
def outcomes(spark, sf_dir):
    r = M.receipt_class(F.col("code"))
    rows = view(spark, sf_dir, "receipt").groupBy("code", "attempts").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("code", "attempts", r["ok"].alias("ok"), r["retryable"].alias("retryable"), r["gone"].alias("gone"), M.outcome(F.col("code"), F.col("attempts")).alias("outcome"), "n")


SETTLE_SQL = """, s AS (SELECT *, coalesce(max(CASE WHEN code = 403 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, notification_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS gone FROM receipt),
settled AS (SELECT *, CASE WHEN gone THEN 'skipped' WHEN code = 200 THEN 'sent' WHEN code IN (400, 403) OR attempts >= 5 THEN 'failed' ELSE 'queued' END AS status FROM s)"""


@query(f"{SETTLE_SQL} SELECT notification_id, user_id, status FROM settled", "receipt")
def settled_outbox(spark, sf_dir):
    return M.settle(view(spark, sf_dir, "receipt")).select("notification_id", "user_id", "status")


@query(f"{SETTLE_SQL} SELECT user_id, count(*) AS skipped FROM settled WHERE status = 'skipped' GROUP BY user_id", "receipt")
def gone_skips(spark, sf_dir):
    return M.settle(view(spark, sf_dir, "receipt")).where("status = 'skipped'").groupBy("user_id").agg(F.count(F.lit(1)).alias("skipped"))


@query("SELECT s.id, s.user_id, s.active AND s.user_id NOT IN (SELECT user_id FROM receipt WHERE code = 403) AS active FROM subscription s", "receipt", "subscription")
def stopped_users(spark, sf_dir):
    gone = view(spark, sf_dir, "receipt").where("code = 403").select("user_id").distinct().withColumn("gone", F.lit(True))
    return view(spark, sf_dir, "subscription").join(gone, "user_id", "left").select("id", "user_id", (F.col("active") & F.col("gone").isNull()).alias("active"))


@query("SELECT notification_id, strftime(timezone('Europe/London', timezone('UTC', created_at)), '%H:%M') >= '22:00' OR strftime(timezone('Europe/London', timezone('UTC', created_at)), '%H:%M') < '07:30' AS quiet FROM receipt", "receipt")
def quiet_hold(spark, sf_dir):
    return view(spark, sf_dir, "receipt").select("notification_id", M.quiet(F.col("created_at"), "Europe/London", "22:00", "07:30").alias("quiet"))


@query(f"""{LISTING_SQL} SELECT source_key, external_id, substr(concat_ws(chr(10), title, '£' || replace(format('{{:,}}', price_pcm), ' ', '') || ' pcm',
  concat_ws(', ', CASE WHEN bedrooms = 0 THEN 'studio' WHEN bedrooms = 1 THEN '1 bedroom' ELSE CAST(bedrooms AS VARCHAR) || ' bedrooms' END, property_type), postcode_district, 'Available ' || strftime(available_from, '%-d %b')), 1, 4096) AS text FROM listing""", "raw_listing")
def alert_text(spark, sf_dir):
    c = F.col
    return listing(spark, sf_dir).select("source_key", "external_id", M.alert_text(c("title"), c("price_pcm"), c("bedrooms"), c("property_type"), c("postcode_district"), c("available_from")).alias("text"))


@query("""SELECT r.notification_id, r.user_id, s.id AS subscription_id, s.district, CASE WHEN s.district IS NULL THEN 'nothing to render' WHEN r.attempts = 0 THEN 'no address' END AS problem
  FROM receipt r JOIN subscription s ON s.user_id = r.user_id AND s.active WHERE r.code = 429""", "receipt", "subscription")
def delivery_view(spark, sf_dir):
    s = view(spark, sf_dir, "subscription").where("active").select("user_id", F.col("id").alias("subscription_id"), "district")
    problem = F.when(F.col("district").isNull(), "nothing to render").when(F.col("attempts") == 0, "no address")
    return view(spark, sf_dir, "receipt").where("code = 429").join(s, "user_id").select("notification_id", "user_id", "subscription_id", "district", problem.alias("problem"))
