"""Queries over all tracked columns, forms, activation, domains, search pages and crawl policies, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import intake as I
from ..operators import listings as L
from ..operators import pages as P
from ..operators import permissions as Q
from ..operators import reconcile as R
from ..sources.contracts import AGENT_RULES
from ..sources.views import table, view, view_sql
from .listing_queries import NOW, OFFER_SQL, offer

QUERIES, ORACLE = {}, {}
AGENT = "listing-monitor/1.0"


def query(sql: str, *views: str):
    """Registers a query and its oracle over the named views; ``sql`` may go on with more table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"WITH {view_sql(*views)} {sql}" if views else sql
        return f

    return add


# Tracked columns ----------------------------------------------------------------------------------------------------

#: Stored rows beside the canonical columns, then what comes in, in SQL that both engines take.
STORED = {
    "bathrooms": "CAST(CAST(external_id AS INT) % 4 AS INT)", "deposit_pcm": "CASE WHEN CAST(external_id AS INT) % 3 > 0 THEN CAST(price_pcm AS DOUBLE) END",
    "postcode": "CASE WHEN CAST(external_id AS INT) % 5 > 0 THEN postcode_district || ' 1AA' END", "status": "CASE WHEN CAST(external_id AS INT) % 13 = 0 THEN 'delisted' ELSE 'active' END", "miss_count": "CAST(CAST(external_id AS INT) % 2 AS INT)",
}
SHIFTED = {
    "price_pcm": "price_pcm + 5", "bedrooms": "bedrooms + 1", "bathrooms": "CASE WHEN bathrooms > 0 THEN bathrooms - 1 END", "property_type": "CASE WHEN property_type = 'flat' THEN NULL ELSE 'flat' END", "furnished": "furnished || '?'",
    "pets_allowed": "CASE WHEN pets_allowed IS NULL THEN FALSE WHEN pets_allowed THEN NULL ELSE FALSE END", "bills_included": "NOT bills_included", "available_from": "CASE WHEN available_from > DATE '2024-01-15' THEN DATE '2024-01-15' ELSE available_from END",
    "min_tenancy_months": "coalesce(min_tenancy_months, 1)", "deposit_pcm": "deposit_pcm / 2", "postcode": "lower(postcode)", "postcode_district": "coalesce(postcode_district, 'E1')", "tfl_zone": "CASE WHEN tfl_zone < 5 THEN tfl_zone + 1 END",
    "title": "title || '.'", "is_landlord_direct": "CASE WHEN is_landlord_direct THEN NULL ELSE TRUE END",
}
#: Which listings come with which column shifted: two columns each, none for some.
INCOMING = {c: f"CASE WHEN CAST(external_id AS INT) % 17 IN ({i}, {(i + 5) % 15}) THEN {e} ELSE {c} END" for i, (c, e) in enumerate(SHIFTED.items())}
STORED_SQL = f"""{OFFER_SQL}, stored0 AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in STORED.items())} FROM offer), stored AS (SELECT source_key, external_id, status, miss_count, {', '.join(R.TRACKED)} FROM stored0),
incoming AS (SELECT source_key, external_id, {', '.join(f'{e} AS {c}' for c, e in INCOMING.items())} FROM stored WHERE CAST(external_id AS INT) % 10 <> 9)"""


def stored(spark, sf_dir):
    rows = offer(spark, sf_dir)
    rows = rows.selectExpr("*", *[f"{e} AS {c}" for c, e in STORED.items()])
    return R.stored(rows, ["source_key", "external_id"])


def incoming(rows):
    """What comes in for the ``stored`` rows."""
    rows = rows.where("CAST(external_id AS INT) % 10 <> 9")
    return rows.selectExpr("source_key", "external_id", *[f"{e} AS {c}" for c, e in INCOMING.items()])


def seen(spark, sf_dir):
    rows = stored(spark, sf_dir).persist()  # both sides of the join come from it
    return R.reconcile(rows, incoming(rows), ["source_key", "external_id"], list(R.TRACKED), "sweep", F.lit("ok"), absent="overwrite")


DIFFER = "concat_ws(',', " + ", ".join(f"CASE WHEN o.{c} IS DISTINCT FROM n.{c} THEN '{c}' END" for c in R.TRACKED) + ")"


@query(f"{STORED_SQL} SELECT source_key, external_id, CASE WHEN status = 'delisted' THEN 'revive' WHEN changed <> '' THEN 'update' ELSE 'unchanged' END AS kind, changed AS changed_fields FROM (SELECT o.source_key, o.external_id, o.status, {DIFFER} AS changed FROM stored o JOIN incoming n USING (source_key, external_id))", "raw_listing", "said", "criteria")
def tracked_changes(spark, sf_dir):
    """All fifteen tracked columns; null, false and true are three values."""
    return seen(spark, sf_dir).where("kind NOT IN ('miss', 'delist', 'hold')").select("source_key", "external_id", "kind", "changed_fields")


@query(f"{STORED_SQL} SELECT field, count(*) AS n FROM (SELECT unnest(string_split({DIFFER}, ',')) AS field FROM stored o JOIN incoming n USING (source_key, external_id)) WHERE field <> '' GROUP BY field", "raw_listing", "said", "criteria")
def tracked_counts(spark, sf_dir):
    rows = seen(spark, sf_dir).where("kind NOT IN ('miss', 'delist', 'hold')").select(F.explode(F.split("changed_fields", ",")).alias("field")).where("field <> ''")
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(f"{STORED_SQL} SELECT external_id, status, miss_count, {', '.join(R.TRACKED)} FROM stored WHERE status = 'active' AND source_key = 'agent'", "raw_listing", "said", "criteria")
def stored_active(spark, sf_dir):
    """What a sweep of one source reads."""
    return R.stored(stored(spark, sf_dir).where("source_key = 'agent'"), ["external_id"], only_active=True)


@query(f"{STORED_SQL} SELECT s.* FROM stored s SEMI JOIN sighting g ON g.external_id = s.external_id", "raw_listing", "said", "criteria", "sighting")
def stored_sighted(spark, sf_dir):
    """Stored rows of the listings of a batch."""
    return R.stored(stored(spark, sf_dir), ["source_key", "external_id"]).join(view(spark, sf_dir, "sighting").select("external_id").distinct(), "external_id", "left_semi")


@query(f"{OFFER_SQL} SELECT l.source_key, l.external_id, l.price_pcm, l.bedrooms, l.postcode_district, l.available_from, l.first_seen_at FROM listing l JOIN said USING (source_key, external_id) WHERE NOT hidden ORDER BY l.first_seen_at DESC, l.source_key, l.external_id LIMIT 20", "raw_listing", "said", "criteria")
def fresh_active(spark, sf_dir):
    """The newest active listings; hidden ones are delisted."""
    from .listing_queries import listing

    status = F.when(F.col("hidden"), "delisted").otherwise("active")
    rows = listing(spark, sf_dir).join(view(spark, sf_dir, "said").select("source_key", "external_id", status.alias("status")), ["source_key", "external_id"])
    rows = rows.where("status = 'active'").orderBy(F.desc("first_seen_at"), "source_key", "external_id").limit(20)
    return rows.select("source_key", "external_id", "price_pcm", "bedrooms", "postcode_district", "available_from", "first_seen_at")


# Domains ------------------------------------------------------------------------------------------------------------

DOMAIN = {
    "price_pcm": "CAST(p_partkey * 53 % 120000 AS INT)", "bedrooms": "CAST(p_partkey % 24 - 2 AS INT)", "bathrooms": "CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 25 - 3 AS INT) END",
    "furnished": "CASE p_partkey % 5 WHEN 0 THEN 'Furnished' WHEN 1 THEN 'part' WHEN 2 THEN 'unknown' WHEN 3 THEN 'unfurnished' END", "min_tenancy_months": "CAST(p_partkey % 130 - 4 AS INT)", "tfl_zone": "CAST(p_partkey % 11 AS INT)",
    "lat": "CAST(p_partkey % 200 - 100 AS DOUBLE)", "lng": "CAST(p_partkey % 400 - 200 AS DOUBLE)", "photo_count": "CAST(p_partkey % 7 - 1 AS INT)", "status": "CASE p_partkey % 6 WHEN 0 THEN 'gone' WHEN 1 THEN NULL ELSE 'active' END",
}
FAULTS = "concat_ws(',', CASE WHEN price_pcm < 100 OR price_pcm > 100000 THEN 'price_pcm' END, CASE WHEN bedrooms < 0 OR bedrooms > 20 THEN 'bedrooms' END, CASE WHEN bathrooms < 0 OR bathrooms > 20 THEN 'bathrooms' END, CASE WHEN furnished NOT IN ('furnished', 'unfurnished', 'part', 'unknown') THEN 'furnished' END, CASE WHEN min_tenancy_months < 0 OR min_tenancy_months > 120 THEN 'min_tenancy_months' END, CASE WHEN tfl_zone < 1 OR tfl_zone > 9 THEN 'tfl_zone' END, CASE WHEN abs(lat) > 90 THEN 'lat' END, CASE WHEN abs(lng) > 180 THEN 'lng' END, CASE WHEN photo_count < 0 THEN 'photo_count' END, CASE WHEN status NOT IN ('active', 'delisted') THEN 'status' END)"


@query(f"SELECT * FROM (SELECT p_partkey AS id, {FAULTS} AS reasons FROM (SELECT p_partkey, {', '.join(f'{e} AS {c}' for c, e in DOMAIN.items())} FROM part)) WHERE reasons <> ''")
def domain_faults(spark, sf_dir):
    """Every domain of a listing, broken alone and together."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", *[f"{e} AS {c}" for c, e in DOMAIN.items()])
    return L.validate(rows, L.listing_rules(rows.columns))[1].select("id", F.array_join("reject_reasons", ",").alias("reasons"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN ts WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 3 THEN ts - INTERVAL 2 HOUR END AS at FROM events""")
def typed_times(spark, sf_dir):
    """Times as text in the forms that are read, and in two that aren't."""
    text = "CASE event_id % 6 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm') WHEN 2 THEN date_format(ts, 'yyyy-MM-dd') WHEN 3 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'\") WHEN 4 THEN date_format(ts, 'dd/MM/yyyy') ELSE '2024-13-45' END"
    return table(spark, sf_dir, "events").select("event_id", dates.as_timestamp(F.expr(text)).alias("at"))


# Forms and activation -----------------------------------------------------------------------------------------------

FORM = {
    "price_min": "CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey * 7 % 3000 AS STRING) ELSE '' END", "price_max": "CASE c_custkey % 29 WHEN 0 THEN 'much' WHEN 1 THEN '20000.4' WHEN 2 THEN '20000.5' ELSE CAST(c_custkey * 13 % 9000 AS STRING) END",
    "bedrooms_min": "CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 6 AS STRING) END", "bedrooms_max": "CASE WHEN c_custkey % 4 < 2 THEN CAST(c_custkey % 12 AS STRING) END",
    "property_types": "CASE c_custkey % 5 WHEN 0 THEN array('Flat', 'castle', 'flat') WHEN 1 THEN array('studio', 'ROOM') END", "furnished": "CASE c_custkey % 6 WHEN 0 THEN array('part', 'Furnished') WHEN 1 THEN array('unknown') END",
    "districts": "CASE c_custkey % 7 WHEN 0 THEN array(' e1', 'E1', 'n1 ') WHEN 1 THEN array('E1', 'zz9', 'ZZ8') WHEN 2 THEN array('', ' ') END",
    "pets_allowed": "CASE c_custkey % 8 WHEN 0 THEN 'on' WHEN 1 THEN 'true' WHEN 2 THEN 'false' END", "bills_included": "CASE c_custkey % 9 WHEN 0 THEN 'on' WHEN 1 THEN 'off' END", "landlord_direct_only": "CASE c_custkey % 10 WHEN 0 THEN 'true' END",
    "min_tenancy_max_months": "CASE WHEN c_custkey % 11 < 4 THEN CAST(c_custkey % 64 AS STRING) END", "cap": "CASE WHEN c_custkey % 12 < 9 THEN CAST(c_custkey % 53 AS STRING) END",
}
NUMBERS = ("price_min", "price_max", "bedrooms_min", "bedrooms_max", "min_tenancy_max_months", "cap")
FORM_SQL = "WITH raw AS (SELECT c_custkey AS id, " + ", ".join(f"{e.replace('array(', 'list_value(')} AS {c}" for c, e in FORM.items()) + " FROM customer), form AS (SELECT id, " + ", ".join(f"CAST(floor(try_cast({c} AS DOUBLE) + 0.5) AS BIGINT) AS {c}" for c in NUMBERS) + """,
  CASE WHEN list_contains(list_transform(property_types, lambda x: lower(x)), 'flat') THEN 'flat' WHEN property_types IS NOT NULL THEN 'studio,room' ELSE '' END AS property_types, CASE WHEN list_contains(furnished, 'part') THEN 'part,furnished' ELSE '' END AS furnished,
  list_sort(list_distinct(list_filter(list_transform(districts, lambda x: upper(trim(x))), lambda x: x <> ''))) AS wanted, CASE WHEN pets_allowed IN ('on', 'true') THEN TRUE END AS pets_allowed, CASE WHEN bills_included IN ('on', 'true') THEN TRUE END AS bills_included,
  CASE WHEN landlord_direct_only IN ('on', 'true') THEN TRUE END AS landlord_direct_only FROM raw),
judged AS (SELECT *, CASE WHEN price_min NOT BETWEEN 0 AND 20000 OR price_max NOT BETWEEN 0 AND 20000 THEN 'price out of range' WHEN price_min > price_max THEN 'minimum above maximum' WHEN bedrooms_min NOT BETWEEN 0 AND 10 OR bedrooms_max NOT BETWEEN 0 AND 10 THEN 'bedrooms out of range'
  WHEN bedrooms_min > bedrooms_max THEN 'minimum above maximum' WHEN list_contains(wanted, 'ZZ9') THEN 'not covered yet: ZZ9, ZZ8' WHEN min_tenancy_max_months NOT BETWEEN 1 AND 60 THEN 'tenancy out of range' WHEN cap NOT BETWEEN 1 AND 50 THEN 'cap out of range' END AS reject_reason FROM form)"""


def parsed(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", *[f"{e} AS {c}" for c, e in FORM.items()])
    return I.parse_criteria(rows, ["E1", "N1", "SE16"])


@query(f"{FORM_SQL} SELECT * EXCLUDE (reject_reason, wanted) REPLACE (coalesce(cap, 10) AS cap), coalesce(array_to_string(wanted, ','), '') AS districts FROM judged WHERE reject_reason IS NULL")
def criteria_accepted(spark, sf_dir):
    lists = {c: F.array_join(c, ",") for c in ("property_types", "furnished")} | {"districts": F.array_join(F.array_sort("districts"), ",")}
    return parsed(spark, sf_dir)[0].withColumns(lists)


@query(f"{FORM_SQL} SELECT id, reject_reason FROM judged WHERE reject_reason IS NOT NULL")
def criteria_rejected(spark, sf_dir):
    return parsed(spark, sf_dir)[1].select("id", "reject_reason")


USER = f"""SELECT id, status, CASE WHEN id % 3 = 0 THEN created_at END AS consent_at, CASE WHEN id % 3 = 0 THEN 'form' END AS consent_source, CASE WHEN status = 'stopped' THEN created_at END AS stopped_at,
  CASE WHEN id % 5 < 4 THEN concat('t', CAST(id AS STRING)) END AS start_token, token_expires_at FROM subscriber"""
SAID_SQL = "SELECT conv_id AS chat, concat('t', CAST(conv_id % 400 AS STRING)) AS token, TIMESTAMP '2024-01-12 06:00:00' + INTERVAL '1' MINUTE * (turn * 41 + conv_id % 97) AS ts FROM {conversations}"
REDEEM_SQL = f""", u AS ({USER}), said AS ({SAID_SQL.format(conversations='conversations')}),
spent AS (SELECT u.id AS user_id, min(ts) AS ts, arg_min(chat, (ts, chat)) AS chat FROM said JOIN u ON u.start_token = said.token WHERE token_expires_at IS NULL OR ts < token_expires_at GROUP BY u.id)"""


def redeemed(spark, sf_dir):
    users = spark.sql(USER.replace("subscriber", "{subscriber}"), subscriber=view(spark, sf_dir, "subscriber"))
    said = spark.sql(SAID_SQL, conversations=table(spark, sf_dir, "conversations"))
    pending = users.where("start_token IS NOT NULL").select(F.col("start_token").alias("token"), F.col("id").alias("user_id"), F.col("token_expires_at").alias("expires_at"))
    return users, I.redeem(said, pending)


@query(f"""{REDEEM_SQL} SELECT u.id, CASE WHEN s.ts IS NOT NULL THEN 'active' ELSE status END AS status, CASE WHEN s.ts IS NOT NULL THEN coalesce(consent_at, s.ts) ELSE consent_at END AS consent_at, CASE WHEN s.ts IS NOT NULL THEN 'chat' ELSE consent_source END AS consent_source,
  CASE WHEN s.ts IS NULL THEN stopped_at END AS stopped_at, CASE WHEN s.ts IS NULL THEN start_token END AS start_token, CASE WHEN s.ts IS NULL THEN token_expires_at END AS token_expires_at FROM u LEFT JOIN spent s ON s.user_id = u.id""", "subscriber")
def activated_users(spark, sf_dir):
    users, spent = redeemed(spark, sf_dir)
    return I.activate(users, spent)


@query(f"""{REDEEM_SQL}, own AS (SELECT chat, arg_max(user_id, (ts, user_id)) AS user_id FROM spent GROUP BY chat), c AS (SELECT user_id, channel, address, is_primary FROM user_channel)
  SELECT * FROM c WHERE channel <> 'telegram' UNION ALL SELECT * FROM c WHERE channel = 'telegram' AND coalesce(address, '') NOT IN (SELECT CAST(chat AS VARCHAR) FROM own) AND user_id NOT IN (SELECT user_id FROM own)
  UNION ALL SELECT user_id, 'telegram', CAST(chat AS VARCHAR), TRUE FROM own""", "subscriber", "user_channel")
def attached_chats(spark, sf_dir):
    return I.attach_chats(view(spark, sf_dir, "user_channel"), redeemed(spark, sf_dir)[1], "telegram")


# Search pages, snapshots, policies ----------------------------------------------------------------------------------

SEARCH = "SELECT batch_no, string_agg(concat('<div data-testid=\"propertyCard-vrt-', CAST(CAST(external_id AS INT) % 9 AS STRING), '\"><a id=\"', CASE WHEN CAST(external_id AS INT) % 6 = 0 THEN 'other' ELSE concat('prop', external_id) END, '\">x</a>', CASE WHEN CAST(external_id AS INT) % 7 > 0 THEN concat('<address> ', address_raw, '</address>') ELSE '' END, '</div>'), '') AS html FROM {raw_listing} GROUP BY batch_no"


@query("SELECT batch_no, CASE WHEN CAST(external_id AS INT) % 6 > 0 THEN external_id END AS external_id, CASE WHEN CAST(external_id AS INT) % 7 > 0 THEN trim(address_raw) END AS address_raw FROM raw_listing", "raw_listing")
def search_cards(spark, sf_dir):
    """Result cards of search pages by the agent's rule set; anchors and addresses may be missing."""
    bodies = spark.sql(SEARCH, raw_listing=view(spark, sf_dir, "raw_listing"))
    got = P.extract(bodies, "batch_no", "html", *AGENT_RULES["search_list"])
    return got.select("batch_no", F.col("fields")["external_id"].alias("external_id"), F.col("fields")["address_raw"].alias("address_raw"))


@query("SELECT n.page_id FROM pages n WHERE NOT EXISTS (SELECT 1 FROM pages b WHERE b.page_id + b.page_id % 2 = n.page_id AND b.html = n.html)")
def pages_changed_since(spark, sf_dir):
    """Against a snapshot in which every second page stood under the next one's id."""
    now = table(spark, sf_dir, "pages").select("page_id", "html")
    before = now.select((F.col("page_id") + F.col("page_id") % 2).alias("page_id"), "html")
    return P.changed(now, before, "page_id", "html").select("page_id")


HOSTS = r"""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM {pages}"""
POLICY = """SELECT host, CAST(CASE length(host) % 5 WHEN 0 THEN 503 ELSE 200 END AS INT) AS status, concat(CASE WHEN length(host) % 3 = 0 THEN 'User-agent: LISTING' ELSE 'User-agent: *' END, chr(10), CASE WHEN length(host) % 4 = 1 THEN concat('Disallow: /', chr(10)) ELSE '' END, string_agg(concat('Disallow: ', path, ' # page', chr(10)), ''),
  'Crawl-delay: ', CAST(length(host) AS STRING), chr(10), 'Sitemap: https://', host, '/map.xml') AS body FROM {hosts} GROUP BY host"""


@query(f"""WITH p AS ({HOSTS.format(pages='pages')}), r AS (SELECT host, count(DISTINCT CASE WHEN path <> '' THEN path END) AS paths, bool_or(path = '/') AS root FROM p GROUP BY host)
  SELECT host, CASE WHEN length(host) % 5 > 0 THEN CASE WHEN length(host) % 3 = 0 THEN 'listing' ELSE '*' END END AS group_tokens, CAST(CASE WHEN length(host) % 5 > 0 THEN paths + CASE WHEN length(host) % 4 = 1 AND NOT root THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS n_rules,
  CASE WHEN length(host) % 5 > 0 THEN length(host)::DOUBLE END AS delay, CAST(CASE WHEN length(host) % 5 > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_sitemaps, length(host) % 5 = 0 OR length(host) % 4 = 1 OR root AS blanket, length(host) % 5 = 0 AS unreadable FROM r""")
def policy_summary(spark, sf_dir):
    """What each host's rules, made of its own pages' paths, say to the agent."""
    return Q.summary(policies(spark, sf_dir), AGENT)


def policies(spark, sf_dir):
    return spark.sql(POLICY, hosts=spark.sql(HOSTS, pages=table(spark, sf_dir, "pages")))


@query("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, 'https://' || regexp_extract(url, '://([^/?#]*)', 1) || '/map.xml' AS url FROM pages")
def named_sitemaps(spark, sf_dir):
    return Q.sitemaps(Q.rules(policies(spark, sf_dir)))
