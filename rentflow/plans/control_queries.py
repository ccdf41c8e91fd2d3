"""Queries over control tables, rules, subscribers, delivery and logs, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from ..operators import pages as P
from ..operators import rules as R
from ..sources.contracts import CONTRACTS, RULES, contracts, rule_table
from ..sources.views import spread, table, view, view_sql
from .listing_queries import DECISION_SQL, LISTING_SQL, NOW, decisions, listing

QUERIES, ORACLE = {}, {}
AS_OF = F.expr


def N():
    return F.count(F.lit(1)).alias("n")



def query(sql: str, *views: str):
    """Registers a query and its oracle over the named views; ``sql`` may go on with more table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = f"WITH {view_sql(*views)} {sql}" if views else sql
        return f

    return add


def now():
    return F.expr(NOW)


# Coverage and scope -------------------------------------------------------------------------------------------------


def scope(spark, sf_dir):
    return view(spark, sf_dir, "source_location"), view(spark, sf_dir, "location")


COVER = "source_location sl JOIN location l ON l.id = sl.location_id"


@query("SELECT * FROM source WHERE source_key = 'src3'", "source")
def source_row(spark, sf_dir):
    return view(spark, sf_dir, "source").where(F.col("source_key") == "src3")


@query(f"SELECT sl.source_key, sl.location_id, l.code, l.zone_min, l.zone_max FROM {COVER} WHERE sl.enabled", "source_location", "location")
def coverage_now(spark, sf_dir):
    return C.coverage(*scope(spark, sf_dir))


@query(f"SELECT sl.location_id, l.code FROM {COVER} WHERE sl.enabled AND sl.source_key = 'src4'", "source_location", "location")
def source_scope(spark, sf_dir):
    links, places = scope(spark, sf_dir)
    return C.coverage(links.where(F.col("source_key") == "src4"), places).select("location_id", "code")


@query("SELECT source_key FROM source WHERE enabled", "source")
def enabled_sources(spark, sf_dir):
    return view(spark, sf_dir, "source").where("enabled").select("source_key")


@query(f"SELECT DISTINCT upper(l.code) AS code FROM {COVER} JOIN source s ON s.source_key = sl.source_key AND s.enabled WHERE sl.enabled", "source_location", "location", "source")
def enabled_districts(spark, sf_dir):
    return C.enabled_districts(*scope(spark, sf_dir), view(spark, sf_dir, "source"))


@query("SELECT code, min(zone) AS zone_min, max(zone) AS zone_max FROM zone_list GROUP BY code", "zone_list")
def zone_bounds(spark, sf_dir):
    return C.zone_bounds(view(spark, sf_dir, "zone_list"))


@query(f"SELECT sl.source_key, count(*) AS total, count(*) FILTER (WHERE sl.enabled) AS enabled, count(*) FILTER (WHERE l.lat IS NULL) AS without_coords FROM {COVER} GROUP BY sl.source_key", "source_location", "location")
def coverage_summary(spark, sf_dir):
    return C.coverage_summary(*scope(spark, sf_dir))


WANTED = "SELECT concat(CASE WHEN id % 3 = 0 THEN ' q' ELSE 'd' END, CAST(id AS STRING), ' ') AS code FROM location WHERE id % 2 = 0"


def wanted_codes(spark, sf_dir):
    return view(spark, sf_dir, "location").where("id % 2 = 0").selectExpr("concat(CASE WHEN id % 3 = 0 THEN ' q' ELSE 'd' END, CAST(id AS STRING), ' ') AS code")


@query(f", w AS ({WANTED}) SELECT DISTINCT upper(trim(code)) AS code FROM w WHERE upper(trim(code)) NOT IN (SELECT code FROM location)", "location")
def unknown_scope(spark, sf_dir):
    return P.narrow_scope(view(spark, sf_dir, "location"), wanted_codes(spark, sf_dir))[1]


@query(f", w AS ({WANTED}) SELECT DISTINCT upper(trim(code)) AS code FROM w WHERE upper(trim(code)) IN (SELECT code FROM location)", "location")
def narrowed_scope(spark, sf_dir):
    return P.narrow_scope(view(spark, sf_dir, "location"), wanted_codes(spark, sf_dir))[0]


@query("SELECT DISTINCT source_key FROM source_location WHERE source_key NOT IN (SELECT source_key FROM source WHERE enabled)", "source_location", "source")
def unknown_sources(spark, sf_dir):
    named = view(spark, sf_dir, "source_location").select("source_key").distinct()
    return named.join(view(spark, sf_dir, "source").where("enabled"), "source_key", "left_anti")


@query(f""", w AS ({WANTED}), s AS (SELECT DISTINCT upper(trim(code)) AS code FROM w) SELECT 'src4' AS source_key, l.id AS location_id, coalesce(h.external_id, lower(l.code)) AS external_id, s.code IS NOT NULL AS enabled
  FROM location l LEFT JOIN s ON s.code = l.code LEFT JOIN source_location h ON h.source_key = 'src4' AND h.location_id = l.id WHERE l.kind = 'postcode_district'""", "location", "source_location")
def scope_upsert(spark, sf_dir):
    return C.scope_upsert(*scope(spark, sf_dir), "src4", wanted_codes(spark, sf_dir))


@query("""SELECT 'src5' AS source_key, l.id AS location_id, lower(l.code) AS external_id, coalesce((SELECT m.enabled FROM source_location m WHERE m.source_key = 'src4' AND m.location_id = l.id), FALSE) AS enabled
  FROM location l WHERE l.kind = 'postcode_district' AND NOT EXISTS (SELECT 1 FROM source_location h WHERE h.source_key = 'src5' AND h.location_id = l.id)""", "location", "source_location")
def scope_copy(spark, sf_dir):
    return C.scope_copy(*scope(spark, sf_dir), "src4", "src5")


# Health, schedules, runs --------------------------------------------------------------------------------------------


@query(f"""SELECT source_key, CASE WHEN health_until <= {NOW} THEN 'ok' ELSE health END AS health, CASE WHEN coalesce(health_until > {NOW}, TRUE) THEN health_note END AS health_note,
  CASE WHEN health_until > {NOW} THEN health_until END AS health_until FROM source""", "source")
def cooldown_elapsed(spark, sf_dir):
    return C.cooled(view(spark, sf_dir, "source"), now()).select("source_key", "health", "health_note", "health_until")


@query(f"""SELECT source_key, CASE id % 3 WHEN 0 THEN 'blocked' WHEN 1 THEN 'broken' ELSE health END AS health, CASE id % 3 WHEN 0 THEN 'challenge' WHEN 1 THEN NULL ELSE health_note END AS health_note,
  CASE id % 3 WHEN 0 THEN {NOW} + INTERVAL '1' SECOND * least(1800 * pow(2, consecutive_fails), 43200)::INT WHEN 1 THEN NULL ELSE health_until END AS health_until,
  CAST(CASE WHEN id % 3 = 0 THEN consecutive_fails + 1 WHEN id % 3 = 1 AND id % 2 = 0 THEN 0 ELSE consecutive_fails END AS INT) AS consecutive_fails FROM source""", "source")
def health_updates(spark, sf_dir):
    from ..operators.reliability import cooldown

    s = view(spark, sf_dir, "source")
    refused = F.col("id") % 3 == 0
    told = s.where("id % 3 < 2").select("source_key", F.when(refused, "blocked").otherwise("broken").alias("new_health"), F.when(refused, "challenge").alias("note"), F.when(refused, cooldown(F.col("consecutive_fails"))).alias("cooldown_seconds"), refused.alias("count_failure"), (~refused & (F.col("id") % 2 == 0)).alias("reached"))
    return C.set_health(s, told, now())


@query("""SELECT w.source_key, CASE WHEN s.health IS NULL THEN 'not in sources' WHEN s.health IN ('blocked', 'broken') THEN 'health=' || s.health
  WHEN w.source_key NOT IN (SELECT source_key FROM source_location WHERE enabled) THEN 'no enabled locations' END AS reason
  FROM (SELECT DISTINCT concat('src', CAST(id % 40 AS STRING)) AS source_key FROM location) w LEFT JOIN source s USING (source_key)""", "source", "source_location", "location")
def skip_reasons(spark, sf_dir):
    wanted = view(spark, sf_dir, "location").select(F.concat(F.lit("src"), (F.col("id") % 40).cast("string")).alias("source_key"))
    return C.skip_reasons(wanted, view(spark, sf_dir, "source"), view(spark, sf_dir, "source_location"))


@query(f"SELECT id, job, source_key, next_run_at FROM schedule WHERE enabled AND next_run_at <= {NOW} AND job = 'hot'", "schedule")
def due_jobs(spark, sf_dir):
    return C.due(view(spark, sf_dir, "schedule"), now(), "hot").select("id", "job", "source_key", "next_run_at")


@query("SELECT job, coalesce(source_key, '*') AS source, enabled, interval_seconds, jitter_pct, strftime(next_run_at, '%Y-%m-%d %H:%M:%S') AS next_run, coalesce(last_status, '-') AS last_status, consecutive_fails FROM schedule", "schedule")
def schedule_overview(spark, sf_dir):
    s = view(spark, sf_dir, "schedule")
    return s.select("job", F.coalesce("source_key", F.lit("*")).alias("source"), "enabled", "interval_seconds", "jitter_pct", F.date_format("next_run_at", "yyyy-MM-dd HH:mm:ss").alias("next_run"), F.coalesce("last_status", F.lit("-")).alias("last_status"), "consecutive_fails")


@query("SELECT id, interval_seconds, jitter_pct FROM schedule WHERE interval_seconds < 60 OR jitter_pct NOT BETWEEN 0 AND 50", "schedule")
def interval_violations(spark, sf_dir):
    return C.interval_violations(view(spark, sf_dir, "schedule")).select("id", "interval_seconds", "jitter_pct")


@query("""SELECT id, bad, CASE WHEN bad THEN row_number() OVER (PARTITION BY source_key, island ORDER BY ts, id) - CASE WHEN island = 0 THEN 0 ELSE 1 END ELSE 0 END AS streak FROM (
  SELECT id, source_key, ts, level = 'error' AS bad, sum(CASE WHEN level <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source_key ORDER BY ts, id) AS island FROM run_event)""", "run_event")
def job_fail_streaks(spark, sf_dir):
    from ..operators.reliability import streaks

    return streaks(view(spark, sf_dir, "run_event"), ["source_key"], ["ts", "id"], F.col("level") == "error").select("id", (F.col("level") == "error").alias("bad"), "streak")


@query("""SELECT t, n FROM (SELECT 'source' AS t, count(*) AS n FROM source UNION ALL SELECT 'location', count(*) FROM location UNION ALL SELECT 'source_location', count(*) FROM source_location
  UNION ALL SELECT 'schedule', count(*) FROM schedule UNION ALL SELECT 'raw_listing', count(*) FROM raw_listing UNION ALL SELECT 'notification', count(*) FROM notification UNION ALL SELECT 'job_run', count(*) FROM job_run)""",
    "source", "location", "source_location", "schedule", "raw_listing", "notification", "job_run")
def table_counts(spark, sf_dir):
    out = None
    for name in ("source", "location", "source_location", "schedule", "raw_listing", "notification", "job_run"):
        n = view(spark, sf_dir, name).agg(N()).select(F.lit(name).alias("t"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@query("SELECT id, status, strftime(started_at, '%Y-%m-%d %H:%M') AS started, round(epoch(finished_at) - epoch(started_at), 1) AS seconds FROM job_run ORDER BY id DESC LIMIT 10", "job_run")
def recent_runs(spark, sf_dir):
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return view(spark, sf_dir, "job_run").orderBy(F.desc("id")).limit(10).select("id", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm").alias("started"), F.round(seconds, 1).alias("seconds"))


@query("SELECT id, ts, level, source_key, event_type FROM run_event WHERE run_id = (SELECT max(run_id) FROM run_event)", "run_event")
def last_run_events(spark, sf_dir):
    return C.of_latest(view(spark, sf_dir, "run_event"), "run_id").select("id", "ts", "level", "source_key", "event_type")


@query("SELECT event_type AS stage, source_key, count(*) AS n, max(CASE level WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS worst FROM run_event WHERE run_id = (SELECT max(run_id) FROM run_event) GROUP BY 1, 2", "run_event")
def last_run_stages(spark, sf_dir):
    worst = F.max(F.when(F.col("level") == "error", 2).when(F.col("level") == "warn", 1).otherwise(0)).alias("worst")
    return C.of_latest(view(spark, sf_dir, "run_event"), "run_id").groupBy(F.col("event_type").alias("stage"), "source_key").agg(N(), worst)


@query("SELECT id, ts, level, source_key FROM run_event WHERE level IN ('warn', 'error') ORDER BY ts DESC, id DESC LIMIT 20", "run_event")
def problems(spark, sf_dir):
    return view(spark, sf_dir, "run_event").where(F.col("level").isin("warn", "error")).orderBy(F.desc("ts"), F.desc("id")).limit(20).select("id", "ts", "level", "source_key")


@query("SELECT id, status, CASE WHEN status IN ('ok', 'skipped_locked') THEN 'info' WHEN status = 'degraded' THEN 'warn' ELSE 'error' END AS level FROM job_run", "job_run")
def finish_levels(spark, sf_dir):
    return view(spark, sf_dir, "job_run").select("id", "status", C.finish_level(F.col("status")).alias("level"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'chat_id,token' END AS leaked FROM run_event WHERE id % 4 < 2", "run_event")
def pii_guard(spark, sf_dir):
    extra = F.when(F.col("id") % 4 == 0, F.create_map(F.lit("email"), F.lit("x"))).when(F.col("id") % 4 == 1, F.create_map(F.lit("token"), F.lit("x"), F.lit("chat_id"), F.lit("y"))).otherwise(F.create_map(F.lit("emails"), F.lit("x")))
    rows = view(spark, sf_dir, "run_event").withColumn("ctx", F.map_concat(F.create_map(F.lit("n"), F.col("value").cast("string")), extra))
    return rows.select("id", F.array_join(C.forbidden(F.col("ctx")), ",").alias("leaked")).where("leaked <> ''")


@query("SELECT concat('{\"run_id\":', run_id, ',\"level\":\"', level, '\"', CASE WHEN level <> 'info' THEN concat(',\"source_key\":\"', source_key, '\"') ELSE '' END, '}') AS line, count(*) AS n FROM run_event GROUP BY 1", "run_event")
def log_lines(spark, sf_dir):
    from ..sources.jsonlines import line

    rows = view(spark, sf_dir, "run_event").select("run_id", "level", F.when(F.col("level") != "info", F.col("source_key")).alias("source_key"))
    return rows.select(line(rows).alias("line")).groupBy("line").agg(N())


@query("SELECT source_key, level, CAST(date_trunc('hour', ts) AS TIMESTAMP) + INTERVAL '10' MINUTE * CAST(floor(minute(ts) / 10) AS INT) AS start, count(*) AS n FROM run_event GROUP BY ALL", "run_event")
def run_events_windowed(spark, sf_dir):
    from ..streaming import event_volume

    return event_volume(view(spark, sf_dir, "run_event"), "10 minutes").select("source_key", "level", "start", "n")


# Rules --------------------------------------------------------------------------------------------------------------


@query("SELECT s.source_key, s.health, s.health_note, p.version, p.strategy, p.created_by FROM source s LEFT JOIN rule_version p ON p.source_key = s.source_key AND p.page_kind = 'detail' AND p.status IN ('active', 'pinned')", "source", "rule_version")
def source_rules(spark, sf_dir):
    rules = R.live(view(spark, sf_dir, "rule_version").where("page_kind = 'detail'")).select("source_key", "version", "strategy", "created_by")
    return view(spark, sf_dir, "source").join(rules, "source_key", "left").select("source_key", "health", "health_note", "version", "strategy", "created_by")


@query("SELECT source_key, page_kind, version, status FROM rule_version WHERE status IN ('active', 'pinned')", "rule_version")
def rules_live(spark, sf_dir):
    return R.live(view(spark, sf_dir, "rule_version")).select("source_key", "page_kind", "version", "status")


NEW_RULES = "SELECT source_key, 'detail' AS page_kind, 'layout9' AS layout_fingerprint, 'dom' AS strategy FROM source WHERE id % 2 = 0"


def new_rules(spark, sf_dir):
    return view(spark, sf_dir, "source").where("id % 2 = 0").select("source_key", F.lit("detail").alias("page_kind"), F.lit("layout9").alias("layout_fingerprint"), F.lit("dom").alias("strategy"))


@query(f""", new AS ({NEW_RULES}) SELECT r.source_key, r.page_kind, r.version, CASE WHEN n.source_key IS NOT NULL AND status IN ('active', 'pinned') THEN 'retired' ELSE status END AS status FROM rule_version r LEFT JOIN new n USING (source_key, page_kind)
  UNION ALL SELECT n.source_key, n.page_kind, CAST(coalesce((SELECT max(version) FROM rule_version r WHERE r.source_key = n.source_key AND r.page_kind = n.page_kind), 0) + 1 AS INT), 'active' FROM new n""", "rule_version", "source")
def rules_published(spark, sf_dir):
    new = new_rules(spark, sf_dir).withColumns({"status": F.lit("active"), "created_by": F.lit("model")})
    return R.publish(view(spark, sf_dir, "rule_version"), new).select("source_key", "page_kind", "version", "status")


@query(f""", new AS ({NEW_RULES}), m AS (SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM rule_version r WHERE r.source_key = n.source_key AND r.page_kind = n.page_kind AND status IN ('active', 'pinned')))
  SELECT n.source_key, n.page_kind, CAST(coalesce((SELECT max(version) FROM rule_version r WHERE r.source_key = n.source_key AND r.page_kind = n.page_kind), 0) + 1 AS INT) AS version, 'pinned' AS status, 'human' AS created_by FROM m n""", "rule_version", "source")
def rules_seeded(spark, sf_dir):
    out = R.seed(view(spark, sf_dir, "rule_version"), new_rules(spark, sf_dir))
    return out.where("layout_fingerprint = 'layout9'").select("source_key", "page_kind", "version", "status", "created_by")


@query("SELECT source_key, page_kind, layout_fingerprint, max(version) AS version FROM rule_version WHERE status = 'retired' AND layout_fingerprint = 'layout1' GROUP BY ALL", "rule_version")
def rules_for_layout(spark, sf_dir):
    v = view(spark, sf_dir, "rule_version")
    return R.retired_for(v, v.where("layout_fingerprint = 'layout1'"))


@query("""SELECT id, CASE WHEN id % 7 = 0 OR id % 7 = 1 THEN 'provide exactly one of: path, sel, label, const' WHEN id % 7 = 2 THEN 'attr applies to sel or label' WHEN id % 7 = 3 AND id % 4 = 3 THEN 'true_if and false_if are for the dom strategy'
  WHEN strategy = 'dom' AND id % 8 = 0 THEN 'dom strategy requires item' WHEN strategy <> 'dom' AND id % 8 = 1 THEN strategy || ' strategy requires root' END AS problem FROM rule_version""", "rule_version")
def rule_check(spark, sf_dir):
    case, text = F.col("id") % 7, lambda when, value: F.when(when, value)
    rules = view(spark, sf_dir, "rule_version").select("id", "strategy", F.lit("price_raw").alias("field"), text(F.col("id") % 8 != 1, "$.items").alias("root"), text(F.col("id") % 8 != 0, "article").alias("item"),
        text(case.isin(0, 2, 3), "$.price").alias("path"), text(case.isin(0, 4, 5), ".price").alias("sel"), text(case == 6, "Price").alias("label"), F.lit(None).cast("string").alias("const"), text(case.isin(2, 4), "href").alias("attr"), text((case == 3) & (F.col("id") % 4 == 3), ".yes").alias("true_if"), F.lit(None).cast("string").alias("false_if"))
    return R.problems(rules).select("id", "problem")


@query(f"{LISTING_SQL} SELECT l.source_key, l.external_id, coalesce(l.title, r.title_raw) AS title, coalesce(l.price_pcm, r.price_pcm) AS price_pcm FROM listing l JOIN (SELECT source_key, external_id, 'from card' AS title_raw, CAST(batch_no * 100 AS INT) AS price_pcm FROM raw_listing) r USING (source_key, external_id)", "raw_listing")
def base_overlay(spark, sf_dir):
    base = view(spark, sf_dir, "raw_listing").select("source_key", "external_id", F.lit("from card").alias("title"), (F.col("batch_no") * 100).cast("int").alias("price_pcm"))
    return R.overlay(listing(spark, sf_dir).select("source_key", "external_id", "title", "price_pcm"), base, ["source_key", "external_id"])


@query("SELECT id, source_key, layout_fingerprint AS fingerprint, before FROM (SELECT *, lag(layout_fingerprint) OVER (PARTITION BY source_key, page_kind ORDER BY version) AS before FROM rule_version) WHERE before <> layout_fingerprint", "rule_version")
def layout_changes(spark, sf_dir):
    rows = view(spark, sf_dir, "rule_version").withColumnRenamed("layout_fingerprint", "fingerprint")
    return R.drift(rows, ["source_key", "page_kind"], "version").select("id", "source_key", "fingerprint", "before")


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'id:int|items[].a:str|ok:bool' ELSE 'id:int|items[]:empty|note:NoneType' END AS layout, count(*) AS n FROM part GROUP BY 1")
def json_layouts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    even = F.concat(F.lit('{"id": '), "p_partkey", F.lit(', "items": [{"a": "x"}, 3], "ok": true}'))
    odd = F.concat(F.lit('{"note": null, "items": [], "id": '), "p_partkey", F.lit("}"))
    return p.select(R.json_layout(F.when(F.col("p_size") % 2 == 0, even).otherwise(odd)).alias("layout")).groupBy("layout").agg(N())


# Discovery ----------------------------------------------------------------------------------------------------------


@query(f"{LISTING_SQL} SELECT external_id, 'https://portal.test/properties/' || external_id AS url FROM listing WHERE source_key = 'agent'", "raw_listing")
def listing_urls(spark, sf_dir):
    return listing(spark, sf_dir).where("source_key = 'agent'").select("external_id", P.listing_url("https://portal.test", F.col("external_id")).alias("url"))


@query("SELECT external_id, 'https://portal.test/properties/' || external_id AS url FROM raw_listing WHERE CAST(external_id AS BIGINT) % 3 <> 0 AND CAST(external_id AS BIGINT) % 8 IN (0, 3, 7)", "raw_listing")
def card_tasks(spark, sf_dir):
    cards = view(spark, sf_dir, "raw_listing").select("external_id", F.col("address_raw"))
    known = cards.where("CAST(external_id AS BIGINT) % 3 = 0")
    return P.card_tasks(cards, known, ["SE16"], "https://portal.test")


@query(r"SELECT page_id, CASE WHEN link LIKE 'http%' THEN link ELSE 'https://portal.test' || link END AS link FROM (SELECT page_id, nullif(regexp_extract(html, '(?:https?://[a-z0-9.]+)?/[a-z]+/[0-9]+', 0), '') AS link FROM pages)")
def first_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.first_link(F.col("html"), "(?:https?://[a-z0-9.]+)?/[a-z]+/[0-9]+", "https://portal.test").alias("link"))


@query(r"""SELECT target, status, body_len, min(page_id) AS ordinal FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS target, CAST(page_id % 3 AS INT) AS status, length(html) // 500 AS body_len, CASE page_id % 4 WHEN 0 THEN '200/OK' WHEN 1 THEN 'SKIPPED(robots)' ELSE 'HTTP(404)' END AS verdict FROM pages)
  WHERE verdict = 'HTTP(404)' GROUP BY ALL""")
def failure_details(spark, sf_dir):
    verdict = F.when(F.col("page_id") % 4 == 0, "200/OK").when(F.col("page_id") % 4 == 1, "SKIPPED(robots)").otherwise("HTTP(404)")
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("target"), (F.col("page_id") % 3).cast("int").alias("status"), F.floor(F.length("html") / 500).alias("body_len"), verdict.alias("verdict"), F.col("page_id").alias("ordinal"))
    return P.failures(rows).select("target", "status", "body_len", "ordinal")


# Subscribers --------------------------------------------------------------------------------------------------------


@query("""SELECT s.id, s.user_id, uc.channel, s.cap FROM subscription s JOIN subscriber u ON u.id = s.user_id JOIN user_channel uc ON uc.user_id = s.user_id AND uc.is_primary JOIN channel c ON c.channel = uc.channel AND c.enabled
  WHERE s.active AND u.status = 'active'""", "subscription", "subscriber", "user_channel", "channel")
def deliverable_subscriptions(spark, sf_dir):
    names = ("subscription", "subscriber", "user_channel", "channel")
    return C.deliverable(*(view(spark, sf_dir, n) for n in names)).select("id", "user_id", "channel", "cap")


@query(f"{LISTING_SQL} SELECT source_key, external_id, first_seen_at, price_pcm, postcode_district FROM listing WHERE (source_key, external_id) IN (SELECT source_key, external_id FROM notification WHERE kind = 'new_listing')", "raw_listing", "notification")
def match_candidates(spark, sf_dir):
    ids = view(spark, sf_dir, "notification").where("kind = 'new_listing'")
    return C.candidates(listing(spark, sf_dir), ids, ["source_key", "external_id"]).select("source_key", "external_id", "first_seen_at", "price_pcm", "postcode_district")


@query("SELECT u.id, u.status, s.id AS subscription_id, s.cap FROM subscriber u LEFT JOIN subscription s ON s.user_id = u.id AND s.active", "subscriber", "subscription")
def subscribers(spark, sf_dir):
    s = view(spark, sf_dir, "subscription").where("active").select(F.col("id").alias("subscription_id"), F.col("user_id").alias("id"), "cap")
    return view(spark, sf_dir, "subscriber").join(s, "id", "left").select("id", "status", "subscription_id", "cap")


@query(f"SELECT id, created_at, token_expires_at FROM subscriber WHERE status = 'pending' AND token_expires_at < {NOW}", "subscriber")
def expired_pending(spark, sf_dir):
    return view(spark, sf_dir, "subscriber").where((F.col("status") == "pending") & (F.col("token_expires_at") < now())).select("id", "created_at", "token_expires_at")


@query("SELECT conv_id, turn, CAST(CASE WHEN turn % 3 = 0 THEN conv_id ELSE conv_id * 10 END AS STRING) AS chat, text FROM conversations")
def bot_updates(spark, sf_dir):
    from ..sources.jsonlines import bot_update

    t = table(spark, sf_dir, "conversations")
    chat = F.when(F.col("turn") % 3 != 0, F.named_struct(F.lit("id"), F.col("conv_id") * 10))
    body = F.to_json(F.struct(F.struct(chat.alias("chat"), F.struct(F.col("conv_id").alias("id")).alias("from"), "text").alias("message")))
    read = t.select("conv_id", "turn", bot_update(body).alias("u"))
    return read.select("conv_id", "turn", C.chat_id(F.col("u.message.chat.id"), F.col("u.message.from.id")).alias("chat"), F.col("u.message.text").alias("text"))


@query("""SELECT channel, address, user_id FROM (SELECT *, row_number() OVER (PARTITION BY channel, address ORDER BY linked DESC NULLS LAST, user_id DESC) AS r FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, channel ORDER BY linked DESC NULLS LAST, address DESC NULLS LAST) AS q FROM (
      SELECT user_id, channel, address, NULL::TIMESTAMP AS linked FROM user_channel UNION ALL SELECT user_id, 'telegram', concat('chat', CAST(id % 100 AS STRING)), created_at FROM notification WHERE status = 'sent')) WHERE q = 1)) WHERE r = 1""", "user_channel", "notification")
def chat_owners(spark, sf_dir):
    links = view(spark, sf_dir, "notification").where("status = 'sent'").select("user_id", F.lit("telegram").alias("channel"), F.concat(F.lit("chat"), (F.col("id") % 100).cast("string")).alias("address"), F.col("created_at").alias("at"))
    return C.link_chats(links, view(spark, sf_dir, "user_channel"))


def stopped(spark, sf_dir):
    return C.stop(view(spark, sf_dir, "notification").where("status = 'failed'"), view(spark, sf_dir, "subscription"), view(spark, sf_dir, "notification"), view(spark, sf_dir, "subscriber"))


GONE = "(SELECT user_id FROM notification WHERE status = 'failed')"


@query(f"SELECT id, user_id FROM subscription WHERE user_id NOT IN {GONE}", "subscription", "notification")
def stop_cascade_filters(spark, sf_dir):
    return stopped(spark, sf_dir)[0].select("id", "user_id")


@query(f"SELECT id, user_id, status FROM notification WHERE status <> 'queued' OR user_id NOT IN {GONE}", "notification")
def stop_cascade_outbox(spark, sf_dir):
    return stopped(spark, sf_dir)[1].select("id", "user_id", "status")


@query(f"SELECT id, CASE WHEN id IN {GONE} THEN 'stopped' ELSE status END AS status FROM subscriber", "subscriber", "notification")
def stop_cascade_users(spark, sf_dir):
    return stopped(spark, sf_dir)[2].select("id", "status")


@query(f"SELECT id, CASE WHEN user_id NOT IN {GONE} THEN user_id END AS user_id FROM notification", "notification")
def erase_references(spark, sf_dir):
    n = view(spark, sf_dir, "notification")
    return C.erase(view(spark, sf_dir, "subscriber"), n.where("status = 'failed'"), view(spark, sf_dir, "subscription"), n, "user_id")[2].select("id", "user_id")


@query(f"SELECT (SELECT count(*) FROM subscriber WHERE id NOT IN {GONE}) AS users, (SELECT count(*) FROM subscription WHERE user_id NOT IN {GONE}) AS filters", "subscriber", "subscription", "notification")
def erase_cascade(spark, sf_dir):
    n = view(spark, sf_dir, "notification")
    users, owned, _ = C.erase(view(spark, sf_dir, "subscriber"), n.where("status = 'failed'"), view(spark, sf_dir, "subscription"), n, "user_id")
    return users.agg(F.count(F.lit(1)).alias("users")).join(owned.agg(F.count(F.lit(1)).alias("filters")))


@query("""SELECT DISTINCT 'chat' || conv_id AS chat, CASE WHEN 'chat' || conv_id IN (SELECT address FROM user_channel uc JOIN subscriber u ON u.id = uc.user_id WHERE uc.channel = 'telegram' AND u.status = 'active' AND address IS NOT NULL) THEN 'already active' ELSE 'needs link' END AS answer
  FROM conversations""", "user_channel", "subscriber")
def start_answers(spark, sf_dir):
    starts = table(spark, sf_dir, "conversations").select(F.concat(F.lit("chat"), "conv_id").alias("chat"))
    return C.start_answer(starts, view(spark, sf_dir, "user_channel"), view(spark, sf_dir, "subscriber"), "telegram")


@query(f"SELECT id, 'pending' AS status, 'web_form' AS consent_source, CASE WHEN district IS NULL THEN 'London' ELSE district || ', E99' END AS label, cap, {NOW} AS backfill_from, {NOW} + INTERVAL '60' MINUTE AS token_expires_at FROM subscription", "subscription")
def intake_rows(spark, sf_dir):
    forms = view(spark, sf_dir, "subscription").select("id", F.concat("district", F.lit(",E99")).alias("districts"), "cap")
    return C.intake(forms, now())


# Delivery -----------------------------------------------------------------------------------------------------------


@query("SELECT status, count(*) AS n FROM notification GROUP BY status", "notification")
def queue_status(spark, sf_dir):
    return view(spark, sf_dir, "notification").groupBy("status").agg(N())


@query("SELECT count(*) AS n FROM notification WHERE status = 'queued'", "notification")
def queue_depth(spark, sf_dir):
    return view(spark, sf_dir, "notification").where("status = 'queued'").agg(N())


@query("SELECT id, user_id, attempts, error FROM notification WHERE status IN ('queued', 'failed') ORDER BY created_at DESC, id DESC LIMIT 20", "notification")
def undelivered(spark, sf_dir):
    return view(spark, sf_dir, "notification").where(F.col("status").isin("queued", "failed")).orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", "user_id", "attempts", "error")


@query(f"{LISTING_SQL} SELECT source_key, external_id, price_pcm, bedrooms, postcode_district, available_from, first_seen_at FROM listing WHERE price_pcm IS NOT NULL ORDER BY first_seen_at DESC, source_key, external_id LIMIT 20", "raw_listing")
def fresh_listings(spark, sf_dir):
    rows = listing(spark, sf_dir).where("price_pcm IS NOT NULL").orderBy(F.desc("first_seen_at"), "source_key", "external_id").limit(20)
    return rows.select("source_key", "external_id", "price_pcm", "bedrooms", "postcode_district", "available_from", "first_seen_at")


@query("SELECT kind, CASE kind WHEN 'new_listing' THEN 'listing' WHEN 'price_drop' THEN 'listing' WHEN 'welcome' THEN 'welcome' WHEN 'stopped' THEN 'stopped' END AS shape, count(*) AS n FROM notification GROUP BY kind", "notification")
def message_shapes(spark, sf_dir):
    return view(spark, sf_dir, "notification").groupBy("kind", C.shape(F.col("kind")).alias("shape")).agg(N())


@query(f"""{LISTING_SQL} SELECT n.id, n.user_id, s.display_name AS source_display, l.price_pcm, uc.address, CASE WHEN n.channel <> 'telegram' THEN 'no notifier for channel ' || n.channel WHEN uc.address IS NULL THEN 'no telegram address for the user'
  WHEN n.kind NOT IN ('new_listing', 'price_drop') THEN 'nothing to render for kind ' || n.kind END AS problem
  FROM notification n JOIN listing l ON l.source_key = n.source_key AND l.external_id = n.external_id JOIN (SELECT CASE id WHEN 1 THEN 'direct' ELSE 'agent' END AS source_key, display_name FROM source WHERE id < 3) s ON s.source_key = n.source_key
  LEFT JOIN user_channel uc ON uc.user_id = n.user_id AND uc.channel = n.channel WHERE n.status = 'queued'""", "raw_listing", "notification", "source", "user_channel")
def presend_checks(spark, sf_dir):
    names = view(spark, sf_dir, "source").where("id < 3").select(F.when(F.col("id") == 1, "direct").otherwise("agent").alias("source_key"), "display_name")
    channels = view(spark, sf_dir, "channel").withColumn("shapes", F.array(F.lit("listing")))
    got = C.delivery(view(spark, sf_dir, "notification").where("status = 'queued'"), listing(spark, sf_dir), names, view(spark, sf_dir, "user_channel"), channels)
    return got.select("id", "user_id", "source_display", "price_pcm", "address", "problem")


@query("SELECT channel, CASE WHEN count(*) FILTER (WHERE status NOT IN ('sent', 'skipped')) > 0 THEN 'degraded' ELSE 'ok' END AS status, count(*) AS claimed, count(*) FILTER (WHERE status = 'sent') AS sent FROM notification GROUP BY channel", "notification")
def stage_rollup(spark, sf_dir):
    return C.stage_status(view(spark, sf_dir, "notification"), ["channel"])


@query(r"""SELECT source_key, external_id, substr(title || CASE WHEN CAST(external_id AS BIGINT) % 2 = 0 THEN chr(10) || chr(10) || 'Open: ' || url || chr(10) || 'Stop: https://portal.test/stop' ELSE '' END, 1, 60) AS text FROM raw_listing""", "raw_listing")
def action_texts(spark, sf_dir):
    links = F.array(F.struct(F.lit("Open").alias("label"), F.col("url").alias("url")), F.struct(F.lit("Stop").alias("label"), F.lit("https://portal.test/stop").alias("url")))
    actions = F.when(F.col("external_id").cast("long") % 2 == 0, links).otherwise(F.slice(links, 1, 0))
    return view(spark, sf_dir, "raw_listing").select("source_key", "external_id", C.with_actions(F.col("title"), actions, 60).alias("text"))


RECEIPT_TEXT = "CASE notification_id % 4 WHEN 0 THEN 'Bad Request: Chat not found' WHEN 1 THEN 'slow down' END"
ODD_CODE = "CAST(CASE WHEN notification_id % 5 = 0 THEN (notification_id // 5) % 8 + 499 WHEN notification_id % 7 = 0 THEN 0 ELSE code END AS INT)"
ODD_SQL = f""", r AS (SELECT notification_id, user_id, created_at, attempts, {ODD_CODE} AS code, {RECEIPT_TEXT} AS text FROM receipt),
k AS (SELECT *, code = 200 AS ok, code IN (0, 429, 500, 502, 503, 504) AS retryable, code <> 200 AND (code = 403 OR coalesce(contains(lower(text), 'chat not found'), FALSE)) AS gone FROM r),
s AS (SELECT *, coalesce(max(gone::INT) OVER (PARTITION BY user_id ORDER BY created_at, notification_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS late FROM k)"""


def odd_receipts(spark, sf_dir):
    """Receipts with all codes around the retried ones, and descriptions."""
    return view(spark, sf_dir, "receipt").selectExpr("notification_id", "user_id", "created_at", "attempts", ODD_CODE.replace("//", "div") + " AS code", RECEIPT_TEXT + " AS text")


@query(f"{ODD_SQL} SELECT code, text, ok, retryable, gone, count(*) AS n FROM k GROUP BY ALL", "receipt")
def receipt_kinds(spark, sf_dir):
    from ..operators.matching import receipt_class

    return odd_receipts(spark, sf_dir).select("code", "text", receipt_class(F.col("code"), F.col("text")).alias("r")).groupBy("code", "text", "r.ok", "r.retryable", "r.gone").agg(N())


@query(f"""{ODD_SQL} SELECT notification_id, CASE WHEN late THEN 'skipped' WHEN ok THEN 'sent' WHEN gone OR NOT retryable OR attempts >= 5 THEN 'failed' ELSE 'queued' END AS status,
  CASE WHEN late THEN 'recipient unreachable' WHEN NOT ok THEN code || ': ' || coalesce(text, 'unknown error') || CASE WHEN retryable AND NOT gone AND attempts >= 5 THEN ' (gave up after ' || attempts || ' attempts)' ELSE '' END END AS error FROM s""", "receipt")
def settled_errors(spark, sf_dir):
    from ..operators.matching import settle

    return settle(odd_receipts(spark, sf_dir)).select("notification_id", "status", "error")


@query("""SELECT external_id, run_day, ordinal, coalesce(before, stored) AS old, price_pcm AS new FROM (SELECT s.*, lag(price_pcm) OVER (PARTITION BY external_id ORDER BY run_day, ordinal) AS before FROM sighting s WHERE run_day >= DATE '1998-01-01') a
  LEFT JOIN (SELECT external_id, arg_max(price_pcm, (run_day, ordinal)) AS stored FROM sighting WHERE run_day < DATE '1998-01-01' GROUP BY external_id) b USING (external_id) WHERE coalesce(before, stored) <> price_pcm""", "sighting")
def batch_price_changes(spark, sf_dir):
    from ..operators.reconcile import batch_changes, latest

    seen = view(spark, sf_dir, "sighting")
    cut = F.expr("DATE '1998-01-01'")
    state = latest(seen.where(F.col("run_day") < cut), ["external_id"], ["run_day", "ordinal"])
    return batch_changes(seen.where(F.col("run_day") >= cut), state, ["external_id"], ["run_day", "ordinal"])


WHOLE_SQL = """, old AS (SELECT external_id, arg_max(price_pcm, (run_day, ordinal)) AS price_pcm, count(*) % 2 AS miss_count FROM sighting WHERE run_day < DATE '1998-01-01' GROUP BY external_id),
new AS (SELECT external_id, arg_max(price_pcm, (run_day, ordinal)) AS price_pcm FROM sighting WHERE run_day >= DATE '1998-01-01' GROUP BY external_id)"""


@query(f"""{WHOLE_SQL} SELECT external_id, CASE WHEN o.external_id IS NULL THEN 'insert' WHEN n.external_id IS NOT NULL THEN CASE WHEN o.price_pcm <> n.price_pcm THEN 'update' ELSE 'unchanged' END
  WHEN o.miss_count + 1 >= 2 THEN 'delist' ELSE 'miss' END AS kind FROM old o FULL JOIN new n USING (external_id)""", "sighting")
def reconcile_whole(spark, sf_dir):
    """Every sighting from the cut on against the state before it; customers without an order since are the misses."""
    from ..operators.reconcile import latest, reconcile

    seen, cut = view(spark, sf_dir, "sighting"), F.expr("DATE '1998-01-01'")
    before = seen.where(F.col("run_day") < cut)
    counts = before.groupBy("external_id").agg((F.count(F.lit(1)) % 2).cast("int").alias("miss_count"))
    state = latest(before, ["external_id"], ["run_day", "ordinal"]).select("external_id", "price_pcm").join(counts, "external_id").withColumn("status", F.lit("active"))
    incoming = latest(seen.where(F.col("run_day") >= cut), ["external_id"], ["run_day", "ordinal"]).select("external_id", "price_pcm")
    return reconcile(state, incoming, ["external_id"], ["price_pcm"], "sweep", F.lit("ok")).select("external_id", "kind")


# Scalar rules and payloads without a query of their own -------------------------------------------------------------


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, CASE p_partkey % 5 WHEN 2 THEN p_size + 0.5 WHEN 3 THEN -1.0 END::DOUBLE AS number, p_partkey % 5 <> 4 AS present,
  CASE WHEN p_partkey % 3 = 0 THEN DATE '2024-02-29' END AS day FROM part""")
def typed_values(spark, sf_dir):
    from ..functions import dates, text

    n = F.col("p_partkey")
    raw = F.when(n % 5 == 0, "true").when(n % 5 == 1, "false").when(n % 5 == 2, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).when(n % 5 == 3, "-1").otherwise("  ")
    day = F.when(n % 3 == 0, "2024-02-29T10:00:00Z").when(n % 3 == 1, "2023-02-29").otherwise("soon")
    return table(spark, sf_dir, "part").select("p_partkey", text.flag(raw).alias("flag"), text.number(raw).alias("number"), text.present(raw).alias("present"), dates.as_date(day).alias("day"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages WHERE url LIKE '%://%'")
def url_origins(spark, sf_dir):
    from ..functions.geo import origin

    return table(spark, sf_dir, "pages").where("url LIKE '%://%'").select("page_id", origin(F.col("url")).alias("origin"))


def _in_script(spark, sf_dir, tag, blocks):
    """Raw listings as pages that carry their fields as JSON in script blocks."""
    item = lambda t: F.concat(F.lit('{"id": "'), "external_id", F.lit(f'", "kind": "{t}", "price": '), F.col("batch_no").cast("string"), F.lit("}"))
    body = F.concat(*[F.concat(F.lit(f"<script {tag}>"), item(b) if len(blocks) > 1 else F.concat(F.lit('{"props": {"items": ['), item(b), F.lit(", "), item(b + "2"), F.lit("]}}")), F.lit("</script><p>x</p>")) for b in blocks])
    return view(spark, sf_dir, "raw_listing").select("source_key", "external_id", F.concat(F.lit("<html>"), body).alias("body"))


@query("SELECT source_key, external_id, external_id AS id, k AS kind, CAST(batch_no AS VARCHAR) AS price FROM raw_listing, (VALUES ('a'), ('a2')) v(k)", "raw_listing")
def nextdata_rows(spark, sf_dir):
    rows = _in_script(spark, sf_dir, 'id="__NEXT_DATA__" type="application/json"', ["a"])
    return P.json_rows(rows, "body", "next_data", "$.props.items", {"id": "$.id", "kind": "$.kind", "price": "$.price"}, ["source_key", "external_id"])


@query("SELECT source_key, external_id, external_id AS id, k AS kind, CAST(batch_no AS VARCHAR) AS price FROM raw_listing, (VALUES ('a'), ('b')) v(k)", "raw_listing")
def jsonld_rows(spark, sf_dir):
    rows = _in_script(spark, sf_dir, 'type="application/ld+json"', ["a", "b"])
    return P.json_rows(rows, "body", "jsonld", "$", {"id": "$.id", "kind": "$.kind", "price": "$.price"}, ["source_key", "external_id"])


NESTED = """{"props": {"pages": [{"no": 1, "cards": [{"id": "%s", "price": %s, "tags": [{"t": "a"}, {"t": "b"}]}, {"id": "%s-2", "price": null, "tags": []}]}, {"no": 2, "cards": {"id": "%s-3", "tags": [{"t": {}}, {"t": "c"}]}}, {"no": 3}]}}"""


@query("""SELECT source_key, external_id, external_id || s AS id, CASE WHEN s = '' THEN CAST(batch_no AS VARCHAR) END AS price, CASE WHEN s = '' THEN 'a' END AS tag, CASE WHEN s <> '-2' THEN f END AS second FROM raw_listing, (VALUES ('', 'b'), ('-2', NULL), ('-3', 'c')) v(s, f)""", "raw_listing")
def nested_rows(spark, sf_dir):
    """Cards of all pages of a payload: lists inside lists, a single object in a list's place, an empty list, a missing one."""
    body = F.format_string(NESTED, "external_id", F.col("batch_no").cast("string"), "external_id", "external_id")
    rows = view(spark, sf_dir, "raw_listing").select("source_key", "external_id", body.alias("body"))
    return P.json_rows(rows, "body", "api_json", "$.props.pages[*].cards", {"id": "$.id", "price": "$.price", "tag": "$.tags[*].t", "second": "$.tags[1].t"}, ["source_key", "external_id"])


@query("SELECT page_id, concat_ws(',', CASE WHEN contains(lower(html), '<nav') THEN '<nav' END, CASE WHEN contains(lower(html), '<script') THEN '<script' END) AS found, len(regexp_extract_all(html, 'href=\"/[a-z]+')) AS links FROM pages")
def page_markers(spark, sf_dir):
    m = P.markers(F.col("html"), ("<nav", "<script"), 'href="/[a-z]+')
    return table(spark, sf_dir, "pages").select("page_id", m.alias("m")).select("page_id", F.array_join("m.found", ",").alias("found"), F.col("m.links").cast("long").alias("links"))


@query("SELECT count(*) - count(DISTINCT external_id) AS dropped FROM sighting", "sighting")
def dropped_tasks(spark, sf_dir):
    return P.dropped_tasks(view(spark, sf_dir, "sighting").select("external_id", F.lit("u").alias("url")))


@query("""SELECT id, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 2 AND t >= '08:00' AND t < '20:00' THEN 'pause' WHEN id % 4 < 2 AND (t >= '23:00' OR t < '07:00') THEN 'queue' END AS held
  FROM (SELECT id, strftime(timezone(CASE id % 4 WHEN 1 THEN 'America/New_York' ELSE 'Europe/London' END, timezone('UTC', created_at)), '%H:%M') AS t FROM notification)""", "notification")
def quiet_modes(spark, sf_dir):
    from ..operators.matching import hold

    n = F.col("id") % 4
    rules = F.struct(F.when(n == 1, "America/New_York").alias("tz"), F.when(n == 2, "08:00").when(n < 2, "23:00").alias("from"), F.when(n == 2, "20:00").otherwise("07:00").alias("to"), F.when(n == 2, "pause").otherwise("queue").alias("mode"))
    return view(spark, sf_dir, "notification").select("id", hold(F.col("created_at"), rules).alias("held"))


@query("SELECT run_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counters FROM (SELECT run_id, event_type, count(*) AS n FROM run_event GROUP BY ALL) GROUP BY run_id", "run_event")
def run_counters(spark, sf_dir):
    from ..operators.reliability import counters

    got = counters(view(spark, sf_dir, "run_event").withColumn("one", F.lit(1)), "run_id", "event_type", "one")
    said = F.transform(F.map_entries("counters"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return got.select("run_id", F.array_join(said, ",").alias("counters"))


@query("SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, length(regexp_extract(url, '://([^/?#]*)', 1)) % 2 = 0 AS blanket FROM pages")
def shut_hosts(spark, sf_dir):
    from ..operators import permissions

    host = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).distinct()
    body = F.when(F.length("host") % 2 == 0, "User-agent: *\nDisallow: /").otherwise("User-agent: *\nDisallow: /private\nAllow: /")
    return permissions.shut_out(permissions.rules(host.select("host", body.alias("body"))), "listing-monitor/1.0")


@query(f"""{LISTING_SQL}, h AS (SELECT source_key, b.batch_no, count(*) AS items, avg(CASE WHEN price_pcm IS NOT NULL THEN 1.0 ELSE 0.0 END) AS fill FROM listing JOIN raw_listing b USING (source_key, external_id) GROUP BY ALL)
  SELECT source_key, batch_no, items >= 12 AND fill >= 0.95 AS passed FROM h""", "raw_listing")
def health_passed(spark, sf_dir):
    from ..operators import listings as L

    raw = view(spark, sf_dir, "raw_listing").select("source_key", "external_id", "batch_no")
    rows = listing(spark, sf_dir).withColumn("bedrooms", F.lit(1)).withColumn("price_pcm", F.when(F.col("price_pcm").isNotNull(), 1000)).join(raw, ["source_key", "external_id"])
    return L.health(rows, ["price_pcm"], ["source_key", "batch_no"], min_items=12).select("source_key", "batch_no", "passed")


# Contracts and rule sets ---------------------------------------------------------------------------------------------

CONTRACT_SQL = ", contract(source_key, field, required) AS (VALUES " + ", ".join(f"('{k}', '{f}', {r})" for k, fields in CONTRACTS.items() for f, r, _ in fields) + """),
given AS (SELECT source_key, batch_no % 4 AS batch, field, v FROM (SELECT source_key, batch_no, external_id, url, title, price_raw, bedrooms_raw, property_type_raw, postcode_raw, available_raw AS available_from_raw, tenancy_raw AS min_tenancy_raw, furnished_raw FROM raw_listing)
  UNPIVOT INCLUDE NULLS (v FOR field IN (external_id, url, title, price_raw, bedrooms_raw, property_type_raw, postcode_raw, available_from_raw, min_tenancy_raw, furnished_raw))),
sizes AS (SELECT source_key, batch_no % 4 AS batch, count(*) AS items FROM raw_listing GROUP BY ALL),
fill AS (SELECT s.source_key, s.batch, c.field, c.required, coalesce(sum(CASE WHEN trim(v) <> '' THEN 1 ELSE 0 END), 0) / any_value(items)::DOUBLE AS fill
  FROM sizes s JOIN contract c USING (source_key) LEFT JOIN given g ON g.source_key = s.source_key AND g.batch = s.batch AND g.field = c.field GROUP BY ALL)"""


def _given(spark, sf_dir):
    raw = view(spark, sf_dir, "raw_listing").withColumn("batch", F.col("batch_no") % 4).withColumnsRenamed({"available_raw": "available_from_raw", "tenancy_raw": "min_tenancy_raw"})
    return raw.select("source_key", "batch", "external_id", "url", "title", "price_raw", "bedrooms_raw", "property_type_raw", "postcode_raw", "available_from_raw", "min_tenancy_raw", "furnished_raw")


@query(f"{CONTRACT_SQL} SELECT source_key, batch, field, required, round(fill, 6) AS fill FROM fill", "raw_listing")
def contract_fill(spark, sf_dir):
    from ..operators import listings as L

    return L.fills(_given(spark, sf_dir), ["source_key", "batch"], contracts(spark)).select("source_key", "batch", "field", "required", F.round("fill", 6).alias("fill"))


@query(f"""{CONTRACT_SQL}, low AS (SELECT source_key, batch, string_agg(field, ',' ORDER BY field) AS low_fields FROM fill WHERE required AND fill < 0.95 GROUP BY ALL)
  SELECT source_key, batch, items, CASE WHEN items < 60 OR low_fields IS NOT NULL THEN 'broken' ELSE 'ok' END AS verdict, CASE WHEN items < 60 THEN 'below floor' WHEN low_fields IS NOT NULL THEN 'low fill' END AS note, coalesce(low_fields, '') AS low_fields
  FROM sizes LEFT JOIN low USING (source_key, batch)""", "raw_listing")
def contract_health(spark, sf_dir):
    """Two sources with different fields in one job."""
    from ..operators import listings as L

    rows = _given(spark, sf_dir).withColumns({"price_pcm": F.lit(None).cast("int"), "bedrooms": F.lit(None).cast("int")})
    return L.health_by_contract(rows, ["source_key", "batch"], contracts(spark), min_items=60).select("source_key", "batch", "items", "verdict", "note", "low_fields")


@query("SELECT source_key, page_kind, count(*) AS fields, 0 AS faults FROM (VALUES " + ", ".join(f"('{k}', '{kind}', '{f}')" for k, kinds in RULES.items() for kind, (_, fields) in kinds.items() for f in fields) + ") v(source_key, page_kind, field) WHERE source_key IN (SELECT source_key FROM raw_listing) GROUP BY ALL", "raw_listing")
def rule_sets(spark, sf_dir):
    """The built-in rule sets of the sources that there are listings of, checked as any other."""
    from ..operators import rules

    here = view(spark, sf_dir, "raw_listing").select("source_key").distinct()
    return rules.problems(rule_table(spark)).join(here, "source_key", "left_semi").groupBy("source_key", "page_kind").agg(F.count(F.lit(1)).alias("fields"), F.count("problem").cast("int").alias("faults"))


HEAD = "concat(coalesce(bedrooms_raw, '4 Beds'), ' ', coalesce(property_type_raw, 'House'), ', Rope Street, ', split_part(postcode_raw, ' ', 1))"
CELL = "<tr><td>{}</td><td>{}</td></tr>"


def _detail(spark, sf_dir):
    """Pages as both sources lay them out, made from the raw listings."""
    cell = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"<tr><th>{label}</th><td>"), value, F.lit("</td></tr>"))).otherwise("")
    tick = F.when(F.col("flag_raw") == "No pets", '<i class="text-danger"></i>').when(F.col("flag_raw").isNotNull(), '<i class="text-success"></i>')
    c, head = F.col, F.expr(HEAD)
    direct = F.concat(F.lit("<html><body><h1> "), head, F.lit("</h1><table>"), cell("Rent PCM", c("price_raw")), cell("Available From", c("available_raw")), cell("Preferred Minimum Tenancy", c("tenancy_raw")), cell("Furnishing", c("furnished_raw")), cell("Pets Allowed", tick), F.lit('</table><p id="descriptionText">Said &amp; done<br>here</p></body></html>'))
    agent = F.concat(
        F.lit('<html><body><h1 itemprop="streetAddress">'), head, F.lit('</h1><div data-testid="primaryPrice"><span>'), c("price_raw"), F.lit("</span><span>£1 pw</span></div>"), F.lit("<dl><dt>Let available date: </dt><dd>"), F.coalesce("available_raw", F.lit("")), F.lit("</dd></dl>"),
        F.coalesce(F.concat(F.lit('<p data-testid="info-reel-BEDROOMS-text">'), c("bedrooms_raw"), F.lit("</p>")), F.lit("")), F.lit('<ul data-testid="keyFeatures"><li>EPC Rating: C</li></ul></body></html>'),
    )
    return spread(spark, sf_dir, "raw_listing").select("source_key", "external_id", F.when(c("source_key") == "direct", direct).otherwise(agent).alias("body"))


@query(rf"""SELECT source_key, external_id, {HEAD} AS title, CASE WHEN source_key = 'direct' THEN price_raw ELSE coalesce(nullif(regexp_extract(price_raw, '(£\s*[0-9,]+(\.[0-9]{{2}})?\s*p(cm|w))', 1), ''), '£1 pw') END AS price_raw, available_raw AS available_from_raw,
  CASE WHEN source_key = 'agent' THEN bedrooms_raw ELSE nullif(regexp_extract({HEAD}, '^\s*([0-9]+\s*Bed|Studio|Room)', 1), '') END AS bedrooms_raw, regexp_extract({HEAD}, '([A-Za-z]{{1,2}}[0-9]{{1,2}}[A-Za-z]?)\s*$', 1) AS postcode_raw,
  CASE WHEN source_key = 'direct' THEN CASE WHEN flag_raw = 'No pets' THEN 'false' WHEN flag_raw IS NOT NULL THEN 'true' END END AS pets_allowed, CASE WHEN source_key = 'agent' THEN 'C' END AS epc_rating,
  CASE WHEN source_key = 'direct' THEN 'Said & done here' END AS description, CAST(source_key = 'direct' AS VARCHAR) AS is_landlord_direct FROM raw_listing""", "raw_listing")
def detail_fields(spark, sf_dir):
    """Both sources' detail pages, each read by its own rule set."""
    from .. import extend

    known = {n: extend.Source(n, lambda df: df, r) for n, r in RULES.items()}
    items = extend.source_items(_detail(spark, sf_dir), "external_id", "body", "detail", known)
    names = ("title", "price_raw", "available_from_raw", "bedrooms_raw", "postcode_raw", "pets_allowed", "epc_rating", "description", "is_landlord_direct")
    return items.select("source_key", "external_id", *[F.col("fields")[n].alias(n) for n in names])


# Life-cycle times, unreachable users, enumerations, stages -----------------------------------------------------------

STAMPS = "SELECT external_id, CAST(min(run_day) AS TIMESTAMP) AS first_seen_at, CAST(max(run_day) AS TIMESTAMP) AS last_seen_at, CASE WHEN count(*) % 5 = 0 THEN CAST(max(run_day) AS TIMESTAMP) END AS delisted_at FROM sighting WHERE run_day < DATE '1998-01-01' GROUP BY external_id"


@query(f"""{DECISION_SQL}, st AS ({STAMPS}) SELECT external_id, kind, CASE WHEN kind = 'insert' THEN {NOW} ELSE first_seen_at END AS first_seen_at, CASE WHEN came THEN {NOW} ELSE last_seen_at END AS last_seen_at,
  CASE WHEN kind = 'delist' THEN {NOW} WHEN kind <> 'revive' THEN delisted_at END AS delisted_at FROM decision LEFT JOIN st USING (external_id)""", "sighting")
def next_state_times(spark, sf_dir):
    from ..operators.reconcile import stamped

    seen = view(spark, sf_dir, "sighting").where("run_day < DATE '1998-01-01'")
    day = lambda f: f("run_day").cast("timestamp")
    stamps = seen.groupBy("external_id").agg(day(F.min).alias("first_seen_at"), day(F.max).alias("last_seen_at"), F.when(F.count(F.lit(1)) % 5 == 0, day(F.max)).alias("delisted_at"))
    return stamped(decisions(spark, sf_dir), stamps, ["external_id"], now()).select("external_id", "kind", "first_seen_at", "last_seen_at", "delisted_at")


def blocked(spark, sf_dir):
    return C.block(view(spark, sf_dir, "receipt").where("code = 403"), view(spark, sf_dir, "subscription"), view(spark, sf_dir, "notification"), view(spark, sf_dir, "subscriber"))


UNREACHABLE = "(SELECT user_id FROM receipt WHERE code = 403)"


@query(f"SELECT id, user_id, active AND user_id NOT IN {UNREACHABLE} AS active FROM subscription", "subscription", "receipt")
def unreachable_filters(spark, sf_dir):
    return blocked(spark, sf_dir)[0].select("id", "user_id", "active")


@query(f"SELECT id, CASE WHEN status = 'queued' AND user_id IN {UNREACHABLE} THEN 'skipped' ELSE status END AS status, CASE WHEN status = 'queued' AND user_id IN {UNREACHABLE} THEN 'recipient unreachable' ELSE error END AS error FROM notification", "notification", "receipt")
def unreachable_outbox(spark, sf_dir):
    return blocked(spark, sf_dir)[1].select("id", "status", "error")


@query(f"SELECT id, CASE WHEN id IN {UNREACHABLE} THEN 'blocked' ELSE status END AS status FROM subscriber", "subscriber", "receipt")
def unreachable_users(spark, sf_dir):
    return blocked(spark, sf_dir)[2].select("id", "status")


@query("SELECT id, 'kind' AS column, kind AS value FROM notification WHERE kind NOT IN ('new_listing', 'price_drop', 'welcome', 'stopped') UNION ALL SELECT id, 'channel', channel FROM notification WHERE channel NOT IN ('telegram', 'email')", "notification")
def enumeration_violations(spark, sf_dir):
    allowed = {"kind": ["new_listing", "price_drop", "welcome", "stopped"], "channel": ["telegram", "email"], "status": ["queued", "sent", "failed", "skipped"]}
    return C.enumeration_violations(view(spark, sf_dir, "notification"), "id", allowed)


@query("""SELECT run_id, event_type AS stage, min(ts) AS started_at, max(ts) AS finished_at, CASE max(CASE level WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status,
  arg_min(source_key, (ts, id)) FILTER (WHERE level = 'error') AS error, count(*) FILTER (WHERE level = 'info') AS n_info, count(*) FILTER (WHERE level = 'warn') AS n_warn, count(*) FILTER (WHERE level = 'error') AS n_error FROM run_event GROUP BY 1, 2""", "run_event")
def stage_ledger(spark, sf_dir):
    from ..operators.reliability import stages

    return stages(view(spark, sf_dir, "run_event").withColumnRenamed("event_type", "stage").withColumnRenamed("source_key", "message"))


@query("SELECT page_id, page_id % 7 = 0 OR contains(lower(substr(html, 1, 8000)), 'captcha') AS challenged FROM pages WHERE NOT regexp_matches(lower(substr(html, 1, 8000)), 'human verification|verify|challenge|just a moment|robot|press and hold|enable javascript')")
def challenge_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where("NOT rlike(lower(substr(html, 1, 8000)), 'human verification|verify|challenge|just a moment|robot|press and hold|enable javascript')")
    return rows.select("page_id", P.challenged(F.col("html"), F.when(F.col("page_id") % 7 == 0, " Challenge")).alias("challenged"))


@query("""SELECT token, chat, user_id FROM (SELECT c.conv_id % 50 AS token, c.conv_id AS chat, u.id AS user_id, row_number() OVER (PARTITION BY c.conv_id % 50, u.id ORDER BY c.turn, c.conv_id) AS r FROM conversations c JOIN subscriber u ON u.id = c.conv_id % 50
  WHERE u.token_expires_at IS NULL OR TIMESTAMP '2024-01-12 06:00:00' + INTERVAL '1' MINUTE * c.turn < u.token_expires_at) WHERE r = 1""", "subscriber")
def tokens_before_expiry(spark, sf_dir):
    from ..operators.intake import redeem

    said = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("token"), F.col("conv_id").alias("chat"), F.expr("TIMESTAMP '2024-01-12 06:00:00' + INTERVAL '1' MINUTE * turn").alias("ts"))
    pending = view(spark, sf_dir, "subscriber").select(F.col("id").alias("token"), F.col("id").alias("user_id"), F.col("token_expires_at").alias("expires_at"))
    return redeem(said, pending).select("token", "chat", "user_id")
