"""Queries over pages, discovery, permissions, intake and run history."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import extend
from ..functions import geo
from ..operators import intake as I
from ..operators import pages as P
from ..operators import permissions as L
from ..operators import reliability as K
from ..sources.views import table, view, view_sql

QUERIES, ORACLE = {}, {}
AGENT = "listing-monitor/1.0"
PATTERN = "https://portal.test/find?district=%s&index=%d"
MARKERS = ("<article", "__next_data__")
CARD_RULES = {
    "text": {"sel": "self"},
    "href": {"sel": "a", "attr": "href"},
    "first_word": {"sel": "a", "regex": r"^(\S+)"},
    "kind": {"const": "link"},
    "local": {"sel": "self", "true_if": "a[href^=/]", "false_if": "a[href^=http]"},
}


def query(sql: str | None = None, *views: str):
    """Registers a query and, with ``sql``, its oracle; ``sql`` continues the common table expressions of ``views``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"WITH {view_sql(*views)} {sql}" if views else sql
        return f

    return add


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def lines(values: tuple[str, ...]) -> str:
    return " OR ".join("contains(h, '{}')".format(v.replace("'", "''")) for v in values)


STATUS = "CASE page_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 302 WHEN 3 THEN 503 WHEN 4 THEN 404 WHEN 5 THEN NULL ELSE 200 END"
RESPONSE_SQL = f"""WITH resp AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS site, html, CAST({STATUS} AS INT) AS code, lower(substr(html, 1, 8000)) AS h FROM pages),
tri AS (SELECT page_id, site, CASE WHEN code IS NULL THEN 'ERROR' WHEN {lines(P.CHALLENGE)} THEN 'CHALLENGE(' || code || ')' WHEN {lines(P.BLOCKED)} THEN 'BLOCKED(' || code || ')/page'
  WHEN code = 429 THEN 'RATE-LIMITED(429)' WHEN code IN (403, 405, 406) THEN 'BLOCKED(' || code || ')' WHEN code IN (301, 302, 303, 307, 308) THEN 'REDIRECT(' || code || ')'
  WHEN code >= 500 THEN 'SERVER(' || code || ')' WHEN code <> 200 THEN 'HTTP(' || code || ')' WHEN length(html) < 1500 THEN '200/SHORT'
  WHEN NOT (contains(lower(html), '<article') OR contains(lower(html), '__next_data__')) THEN '200/NO-DATA' ELSE '200/OK' END AS verdict FROM resp)
"""


def triaged(spark, sf_dir):
    site = F.regexp_extract("url", "://([^/?#]*)", 1)
    code = F.expr(STATUS).cast("int")
    return pages(spark, sf_dir).select("page_id", site.alias("site"), P.triage(code, F.col("html"), MARKERS, 1500).alias("verdict"))


@query(f"{RESPONSE_SQL} SELECT page_id, verdict FROM tri")
def response_triage(spark, sf_dir):
    return triaged(spark, sf_dir).select("page_id", "verdict")


@query(f"""{RESPONSE_SQL} SELECT site, CASE WHEN bool_or(starts_with(verdict, '200/OK')) THEN 'served' WHEN bool_or(starts_with(verdict, 'CHALLENGE')) THEN 'challenge'
  WHEN bool_or(starts_with(verdict, 'BLOCKED')) THEN 'refused' ELSE 'no fields' END AS verdict, min(page_id) FILTER (WHERE verdict = '200/OK') AS best FROM tri GROUP BY site""")
def site_verdicts(spark, sf_dir):
    return P.site_verdict(triaged(spark, sf_dir).withColumnRenamed("page_id", "ordinal"))


@query(f"SELECT page_id, {lines(P.CHALLENGE)} AS challenged FROM (SELECT page_id, lower(substr(html, 1, 8000)) AS h FROM pages)")
def challenge_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", P.challenged(F.col("html")).alias("challenged"))


@query(r"""SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(html, 1, 8000), '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'),
  '<[^>]+>', ' ', 'gs'), '[ \t\n\x0b\f\r]+', ' ', 'g')), 1, 400) AS snippet FROM pages""")
def page_snippets(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", P.snippet(F.col("html")).alias("snippet"))


@query()
def page_links(spark, sf_dir):
    return P.extract(pages(spark, sf_dir), "page_id", "html", "li", CARD_RULES)


@query()
def page_links_sql(spark, sf_dir):
    """``page_links`` in SQL text, through the table function."""
    extend.register_functions(spark)
    return spark.sql("SELECT p.page_id, x.ordinal, x.fields, x.error FROM {pages} AS p, LATERAL page_items(p.html, 'li', :rules) AS x", args={"rules": json.dumps(CARD_RULES)}, pages=pages(spark, sf_dir))


@query()
def page_layouts(spark, sf_dir):
    return P.layout(pages(spark, sf_dir), "page_id", "html", "body")


@query()
def layout_drift(spark, sf_dir):
    """Pages of a host whose layout differs from the page before."""
    found = P.layout(pages(spark, sf_dir), "page_id", "html", "body").select("page_id", "fingerprint")
    host = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return P.drift(host.join(found, "page_id"), ["host"], "page_id").select("host", "page_id", "previous", "fingerprint")


@query()
def reduced_pages(spark, sf_dir):
    return P.reduce_html(pages(spark, sf_dir), "page_id", "html")


@query("SELECT event_id, props ->> '$.k' AS k FROM events WHERE json_valid(props)")
def payload_fields(spark, sf_dir):
    """Scalar reads of the JSON text that each event carries."""
    return P.json_rows(table(spark, sf_dir, "events"), "props", "api_json", "$", {"k": "$.k"}, ["event_id"])


@query("SELECT n_name AS code, CAST(page AS INT) AS page, 'https://portal.test/find?district=' || n_name || '&index=' || page * 24 AS url FROM nation, range(4) r(page)")
def index_plan_sweep(spark, sf_dir):
    return P.index_plan(table(spark, sf_dir, "nation").select(F.col("n_name").alias("code")), "sweep", PATTERN)


@query("SELECT n_name AS code, CAST(0 AS INT) AS page, 'https://portal.test/find?district=' || n_name || '&index=0' AS url FROM nation")
def index_plan_hot(spark, sf_dir):
    return P.index_plan(table(spark, sf_dir, "nation").select(F.col("n_name").alias("code")), "hot", PATTERN)


SITEMAP_SQL = r"""body AS (SELECT batch_no, string_agg('<url><loc> ' || CASE WHEN CAST(external_id AS INT) % 10 = 0 THEN 'https://portal.test/listings-' || external_id || '.xml' ELSE url END || ' </loc></url>', '') AS body FROM raw_listing GROUP BY batch_no),
found AS (SELECT batch_no, unnest(regexp_extract_all(body, '<loc>\s*([^<\s]+)\s*</loc>', 1)) AS url FROM body),
urls AS (SELECT batch_no, url, CASE WHEN ends_with(url, '.xml') AND contains(url, 'listings') THEN 'child' WHEN regexp_matches(url, '/property-to-rent/.*/\d+/?$') THEN 'listing' ELSE 'other' END AS kind,
  nullif(regexp_extract(url, '/property-to-rent/.*/(\d+)/?$', 1), '') AS external_id FROM found)"""


def sitemap(spark, sf_dir):
    """Sitemap bodies, one a batch, made from the listings' urls."""
    loc = F.when(F.col("external_id").cast("int") % 10 == 0, F.concat(F.lit("https://portal.test/listings-"), "external_id", F.lit(".xml"))).otherwise(F.col("url"))
    entry = F.concat(F.lit("<url><loc> "), loc, F.lit(" </loc></url>"))
    bodies = view(spark, sf_dir, "raw_listing").select("batch_no", entry.alias("body"))
    return P.sitemap_urls(bodies, "body", ["batch_no"])


@query(f", {SITEMAP_SQL} SELECT * FROM urls", "raw_listing")
def sitemap_entries(spark, sf_dir):
    return sitemap(spark, sf_dir)


@query(f", {SITEMAP_SQL}, fresh AS (SELECT u.external_id, u.url FROM urls u WHERE kind = 'listing' AND CAST(external_id AS INT) % 3 <> 0) SELECT * FROM fresh WHERE split_part(split_part(url, '/flat-', 2), '/', 1) IN ('se16', 'e1', 'n1')", "raw_listing")
def discovery_tasks(spark, sf_dir):
    """Listing urls in scope whose ids aren't known; every third id is."""
    urls = sitemap(spark, sf_dir).where("kind = 'listing'").withColumn("source_key", F.lit("direct")).withColumn("ordinal", F.col("external_id").cast("long"))
    known = view(spark, sf_dir, "raw_listing").where(F.col("external_id").cast("int") % 3 == 0).select(F.lit("direct").alias("source_key"), "external_id")
    return P.new_tasks(urls, known, ["SE16", "E1", "N1"], geo.outward_from_url(F.col("url"))).select("external_id", "url")


@query("SELECT page_id FROM pages WHERE page_id % 4 = 0")
def changed_pages(spark, sf_dir):
    """Pages that the snapshot before had with another body (every fourth)."""
    now = pages(spark, sf_dir).select("page_id", "html")
    before = now.withColumn("html", F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    return P.changed(now, before, "page_id", "html").select("page_id")


ROBOTS = "# rules\nUser-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow:\nDisallow: /*utm_source\nCrawl-delay: 2\n\nUser-agent: listing\nUser-agent: other\nDisallow: /de/$\nDisallow: /es/1\nAllow: /es/1*5$\nSitemap: https://x.test/s.xml"
ROBOTS_SQL = r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, url, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT page_id, url, CASE WHEN length(host) % 2 = 0 THEN NOT (regexp_matches(path, '^/de/$') OR starts_with(path, '/es/1')) OR regexp_matches(path, '^/es/1.*5$')
  ELSE NOT ((starts_with(path, '/en/') AND NOT starts_with(path, '/en/1')) OR contains(path, 'utm_source')) END AS allowed FROM p"""


def robots(spark, sf_dir):
    """A rules file for each host of pages: hosts of an even length speak to the agent, the others to all."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    text = F.when(F.length("host") % 2 == 0, F.lit(ROBOTS)).otherwise(F.lit(ROBOTS.split("\n\n")[0]))
    return L.rules(pages(spark, sf_dir).select(host.alias("host")).distinct().select("host", text.alias("body")))


@query(ROBOTS_SQL)
def url_permissions(spark, sf_dir):
    urls = pages(spark, sf_dir).select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "url")
    return L.audit(robots(spark, sf_dir), urls, AGENT).select("page_id", "url", "allowed")


@query("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, 3 AS n_rules, CASE WHEN length(regexp_extract(url, '://([^/?#]*)', 1)) % 2 = 1 THEN 2.0::DOUBLE END AS delay FROM pages")
def permission_policy(spark, sf_dir):
    return L.policy(robots(spark, sf_dir), AGENT).select("host", "n_rules", "delay")


FORM_SQL = """WITH f AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 3000 AS BIGINT) AS price_min, CAST(c_custkey * 13 % 22000 AS BIGINT) AS price_max, c_custkey % 60 AS cap, CASE WHEN c_custkey % 4 = 0 THEN 'ZZ9' ELSE 'E1' END AS districts FROM customer),
r AS (SELECT *, CASE WHEN price_max > 20000 THEN 'price out of range' WHEN price_min > price_max THEN 'minimum above maximum' WHEN districts = 'ZZ9' THEN 'not covered yet: ZZ9' WHEN cap NOT BETWEEN 1 AND 50 THEN 'cap out of range' END AS reject_reason FROM f)"""


def forms(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.when(k % 4 == 0, " zz9 ").otherwise("e1")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7 % 3000).cast("string").alias("price_min"), (k * 13 % 22000).cast("string").alias("price_max"), F.array(code, code).alias("districts"), (k % 60).cast("string").alias("cap"))
    return I.parse_forms(rows, ["E1", "N1", "SE16"])


@query(f"{FORM_SQL} SELECT id, price_min, price_max, districts, cap FROM r WHERE reject_reason IS NULL")
def forms_accepted(spark, sf_dir):
    return forms(spark, sf_dir)[0]


@query(f"{FORM_SQL} SELECT id, reject_reason FROM r WHERE reject_reason IS NOT NULL")
def forms_rejected(spark, sf_dir):
    return forms(spark, sf_dir)[1].select("id", "reject_reason")


SAID = "CASE event_type WHEN 'error' THEN ' /STOP ' WHEN 'click' THEN '/start t' || CAST(event_id % 50 AS STRING) WHEN 'view' THEN '/start' ELSE 'hello' END"


def chat(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(SAID).alias("said"))
    return rows.withColumn("c", I.command(F.col("said"))).select("event_id", "user_id", "ts", "c.kind", "c.token")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'stop' WHEN 'click' THEN 'start' WHEN 'view' THEN 'start' ELSE 'other' END AS kind, CASE WHEN event_type = 'click' THEN 't' || event_id % 50 END AS token FROM events")
def commands(spark, sf_dir):
    return chat(spark, sf_dir).select("event_id", "kind", "token")


@query("SELECT user_id AS chat, max_by(CASE event_type WHEN 'error' THEN 'stop' ELSE 'start' END, (ts, event_id)) AS state, max(ts) AS since FROM events WHERE event_type IN ('error', 'click', 'view') GROUP BY user_id")
def subscriber_states(spark, sf_dir):
    log = chat(spark, sf_dir).select(F.col("user_id").alias("chat"), "ts", "kind", F.col("event_id").alias("ordinal"))
    return I.subscriber_state(log, F.lit("2999-01-01").cast("timestamp"))


@query("SELECT 't' || event_id % 50 AS token, min_by(user_id, (ts, user_id)) AS chat, min(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY event_id % 50")
def tokens_redeemed(spark, sf_dir):
    said = chat(spark, sf_dir).where("token IS NOT NULL").select(F.col("user_id").alias("chat"), "ts", "token")
    pending = chat(spark, sf_dir).where("token IS NOT NULL").select("token").distinct().select("token", F.lit(1).alias("user_id"), F.lit(None).cast("timestamp").alias("expires_at"))
    return I.redeem(said, pending).select("token", "chat", "ts")


STREAK_SQL = """, i AS (SELECT *, sum(CASE WHEN level = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY source_key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM run_event),
s AS (SELECT id, source_key, sum(CASE WHEN level = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, island ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS streak FROM i)"""


@query(f"{STREAK_SQL} SELECT id, source_key, CAST(streak AS BIGINT) AS streak, CAST(least(43200, 1800 * 2 ** least(streak, 10)) AS BIGINT) AS cooldown FROM s", "run_event")
def refusal_streaks(spark, sf_dir):
    rows = K.streaks(view(spark, sf_dir, "run_event"), ["source_key"], ["ts", "id"], F.col("level") == "error")
    return rows.select("id", "source_key", "streak", K.cooldown(F.col("streak")).alias("cooldown"))


@query(""", r AS (SELECT run_id, min(ts) AS started_at, max(ts) AS finished_at, CASE max(CASE level WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status,
  count(*) AS events, min_by(event_type, (ts, id)) AS first_event FROM run_event GROUP BY run_id) SELECT * FROM r""", "run_event")
def run_ledger(spark, sf_dir):
    return K.ledger(view(spark, sf_dir, "run_event"))


@query("SELECT source_key, level, count(*) AS n, round(sum(value), 4) AS total FROM run_event GROUP BY source_key, level", "run_event")
def run_report(spark, sf_dir):
    """Events and their values by source and level."""
    return view(spark, sf_dir, "run_event").groupBy("source_key", "level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
