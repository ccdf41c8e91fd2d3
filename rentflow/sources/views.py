"""Domain views over the driver's tables, in SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_LISTING = """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'direct' ELSE 'agent' END AS source_key,
       CAST(p_partkey AS STRING) AS external_id,
       concat('https://portal.test/property-to-rent/town/flat-', lower(split_part('SE16,SE8,E14,E1,N1,W2,SW10,RG30', ',', CAST(p_partkey % 8 + 1 AS INT))), '/', CAST(p_partkey AS STRING)) AS url,
       p_name AS title,
       CASE p_partkey % 7 WHEN 0 THEN 'POA' WHEN 1 THEN concat('£', CAST(100 + (p_partkey * 37) % 900 AS STRING), ' pw')
            WHEN 2 THEN concat('£', CAST(400 + (p_partkey * 37) % 3000 AS STRING), ' pcm')
            WHEN 3 THEN concat('£', CAST(400 + (p_partkey * 37) % 3000 AS STRING), ' per month')
            WHEN 4 THEN concat('£', CAST(400 + (p_partkey * 37) % 3000 AS STRING), '.50 p/m')
            WHEN 5 THEN concat('£', CAST(400 + (p_partkey * 37) % 3000 AS STRING))
            ELSE concat('£1,', CAST(100 + (p_partkey * 37) % 900 AS STRING), ' pcm') END AS price_raw,
       nullif(split_part('Studio|1 Bed|2 Bed|3 Bed|Room in a shared house|', '|', CAST(p_size % 6 + 1 AS INT)), '') AS bedrooms_raw,
       nullif(split_part('Flat|Apartment|End terrace|Maisonette|Studio|Boat', '|', CAST(p_partkey % 6 + 1 AS INT)), '') AS property_type_raw,
       nullif(split_part('Furnished|Unfurnished|Part furnished|Not furnished|', '|', CAST(p_partkey % 5 + 1 AS INT)), '') AS furnished_raw,
       nullif(split_part('Pets allowed|No pets|Pets considered|', '|', CAST(p_size % 4 + 1 AS INT)), '') AS flag_raw,
       nullif(split_part('Now|2024-02-10|12 Sep|01/03/2024|31 Feb 2024|whenever|March 3, 2024|tomorrow', '|', CAST(p_partkey % 8 + 1 AS INT)), '') AS available_raw,
       nullif(split_part('6 Months|12 months minimum|1 year|', '|', CAST(p_partkey % 4 + 1 AS INT)), '') AS tenancy_raw,
       split_part('SE16 7AB,SE8,E14 9zz,E1,N1 0AA,W2,SW10,RG30 1CC', ',', CAST(p_partkey % 8 + 1 AS INT)) AS postcode_raw,
       concat('Rope Street, London, ', split_part('SE16,SE8 4aa,E14,Studio 5,N1,W2,SW10,Reading', ',', CAST(p_partkey % 8 + 1 AS INT))) AS address_raw,
       p_size AS batch_no,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * p_partkey AS first_seen_at
FROM {part}
"""

SUBSCRIPTION = """
SELECT c_custkey AS id, CAST(floor(c_custkey / 2) AS BIGINT) AS user_id,
       CAST(800 + (c_custkey * 13) % 2500 AS INT) AS price_max,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE split_part('SE16,SE8,E14,E1,N1,W2,SW10,RG30', ',', CAST(c_custkey % 8 + 1 AS INT)) END AS district,
       CASE WHEN c_custkey % 5 = 0 THEN TRUE END AS pets_allowed,
       CAST(1 + CAST(floor(c_custkey / 2) AS BIGINT) % 5 AS INT) AS cap,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (c_custkey % 100) AS backfill_from,
       c_custkey % 11 <> 0 AS active
FROM {customer}
"""

#: All ten criteria; lists are joined by commas. Filters of a user have caps of their own.
CRITERIA = """
SELECT c_custkey AS id, CAST(floor(c_custkey / 4) AS BIGINT) AS user_id,
       CASE WHEN c_custkey % 4 = 0 THEN CAST(300 + (c_custkey * 7) % 900 AS INT) END AS price_min,
       CASE WHEN c_custkey % 3 <> 0 THEN CAST(900 + (c_custkey * 13) % 2500 AS INT) END AS price_max,
       CASE WHEN c_custkey % 5 = 1 THEN CAST(c_custkey % 3 AS INT) END AS bedrooms_min,
       CASE WHEN c_custkey % 5 IN (1, 2) THEN CAST(1 + c_custkey % 4 AS INT) END AS bedrooms_max,
       CASE c_custkey % 6 WHEN 0 THEN 'flat,Room' WHEN 3 THEN 'house,maisonette,studio' END AS property_types,
       CASE c_custkey % 7 WHEN 0 THEN 'se16,E1' WHEN 1 THEN 'W2,N1,SW10' WHEN 2 THEN 'RG30' END AS districts,
       CASE c_custkey % 8 WHEN 0 THEN '1,2' WHEN 1 THEN '5' END AS zones,
       CASE c_custkey % 9 WHEN 0 THEN 'furnished,part' WHEN 1 THEN 'Unfurnished' END AS furnished,
       CASE c_custkey % 10 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS pets_allowed,
       CASE c_custkey % 11 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS bills_included,
       CASE WHEN c_custkey % 12 = 0 THEN DATE '2024-02-20' END AS available_before,
       CASE WHEN c_custkey % 12 IN (0, 5) THEN DATE '2024-01-10' END AS available_after,
       CASE WHEN c_custkey % 13 = 0 THEN CAST(6 + c_custkey % 8 AS INT) END AS tenancy_max,
       CASE c_custkey % 14 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS direct_only,
       CAST(1 + (c_custkey * 5) % 7 AS INT) AS cap,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * (c_custkey % 100) AS backfill_from
FROM {customer}
"""

#: What a listing says beside its canonical columns.
SAID = """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'direct' ELSE 'agent' END AS source_key, CAST(p_partkey AS STRING) AS external_id,
       CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS bills_included, CASE WHEN p_partkey % 7 < 6 THEN CAST(1 + p_partkey % 7 AS INT) END AS tfl_zone, p_partkey % 9 = 0 AS hidden
FROM {part}
"""

SIGHTING = """
SELECT CAST(o_custkey AS STRING) AS external_id, CAST(o_orderdate AS DATE) AS run_day, o_orderkey AS ordinal,
       CAST(floor(o_totalprice / 100) AS INT) AS price_pcm, o_orderpriority AS title
FROM {orders}
"""

RECEIPT = """
SELECT event_id AS notification_id, user_id, ts AS created_at, CAST(event_id % 6 AS INT) AS attempts,
       CASE event_type WHEN 'purchase' THEN 200 WHEN 'error' THEN 403 WHEN 'click' THEN 429 WHEN 'view' THEN 500 ELSE 400 END AS code
FROM {events}
"""

RUN = """
SELECT event_id AS id, concat('src', CAST(user_id % 7 AS STRING)) AS source_key, CAST(floor(event_id / 10) AS BIGINT) AS run_id, ts,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warn' ELSE 'info' END AS level, event_type, value
FROM {events}
"""

SOURCE = """
SELECT s_suppkey AS id, concat('src', CAST(s_suppkey AS STRING)) AS source_key, s_name AS display_name, s_suppkey % 4 <> 0 AS enabled,
       CASE s_suppkey % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'broken' WHEN 2 THEN 'degraded' ELSE 'ok' END AS health,
       CASE s_suppkey % 5 WHEN 0 THEN 'refusal' WHEN 1 THEN 'low fill' END AS health_note,
       CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-12 00:00:00' + INTERVAL '1' HOUR * (s_suppkey % 24) END AS health_until,
       CAST(s_suppkey % 6 AS INT) AS consecutive_fails
FROM {supplier}
"""

LOCATION = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 'city' ELSE 'postcode_district' END AS kind, concat('D', CAST(c_custkey AS STRING)) AS code,
       CAST(c_custkey % 3 + 1 AS INT) AS zone_min, CAST(c_custkey % 3 + 1 + c_custkey % 2 AS INT) AS zone_max, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS lat
FROM {customer}
"""

SOURCE_LOCATION = """
SELECT concat('src', CAST(o_orderkey % 10 + 1 AS STRING)) AS source_key, o_custkey AS location_id, concat('x', CAST(o_custkey AS STRING)) AS external_id,
       max(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) = 1 AS enabled
FROM {orders} GROUP BY 1, 2, 3
"""

ZONE_LIST = """
SELECT CAST(o_orderkey % 3 + 1 AS INT) AS zone, concat('D', CAST(o_custkey AS STRING)) AS code FROM {orders}
"""

SCHEDULE = """
SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'sweep' WHEN 1 THEN 'hot' ELSE 'drain' END AS job,
       CASE WHEN s_suppkey % 3 <> 2 THEN concat('src', CAST(s_suppkey AS STRING)) END AS source_key, s_suppkey % 7 <> 0 AS enabled,
       CAST((s_suppkey % 40) * 30 AS INT) AS interval_seconds, CAST(s_suppkey % 60 - 2 AS INT) AS jitter_pct,
       TIMESTAMP '2024-01-12 00:00:00' + INTERVAL '1' MINUTE * ((s_suppkey * 37) % 1440) AS next_run_at,
       CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'ok' END AS last_status, CAST(s_suppkey % 5 AS INT) AS consecutive_fails
FROM {supplier}
"""

SUBSCRIBER = """
SELECT CAST(floor(c_custkey / 2) AS BIGINT) AS id,
       CASE floor(c_custkey / 2) % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'stopped' WHEN 2 THEN 'blocked' ELSE 'active' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * c_custkey AS created_at,
       CASE WHEN floor(c_custkey / 2) % 14 <> 0 THEN TIMESTAMP '2024-01-12 00:00:00' + INTERVAL '1' MINUTE * ((c_custkey * 31) % 1440) END AS token_expires_at
FROM {customer} WHERE c_custkey % 2 = 0
"""

USER_CHANNEL = """
SELECT CAST(floor(c_custkey / 2) AS BIGINT) AS user_id, CASE c_custkey % 2 WHEN 0 THEN 'telegram' ELSE 'email' END AS channel,
       CASE WHEN c_custkey % 11 <> 3 THEN concat('chat', CAST(c_custkey AS STRING)) END AS address, c_custkey % 2 = floor(c_custkey / 2) % 2 AS is_primary
FROM {customer}
"""

CHANNEL = """
SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'telegram' WHEN 1 THEN 'email' ELSE 'sms' END AS channel, c_custkey % 3 <> 2 AS enabled, c_custkey % 3 = 0 AS implemented
FROM {customer}
"""

NOTIFICATION = """
SELECT event_id AS id, user_id, CASE WHEN event_id % 2 = 1 THEN 'direct' ELSE 'agent' END AS source_key, CAST(event_id % 1000 + 1 AS STRING) AS external_id, ts AS created_at,
       CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued' WHEN 'view' THEN 'queued' ELSE 'skipped' END AS status,
       CAST(event_id % 6 AS INT) AS attempts, CASE event_type WHEN 'error' THEN '403: blocked' WHEN 'view' THEN '429: slow down' END AS error,
       CASE event_id % 5 WHEN 0 THEN 'welcome' WHEN 1 THEN 'price_drop' WHEN 2 THEN 'other' ELSE 'new_listing' END AS kind,
       CASE event_id % 9 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' ELSE 'telegram' END AS channel
FROM {events}
"""

JOB_RUN = """
SELECT CAST(floor(event_id / 10) AS BIGINT) AS id, min(ts) AS started_at, max(ts) AS finished_at,
       CASE max(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) WHEN 2 THEN 'failed' WHEN 1 THEN 'degraded' ELSE 'ok' END AS status
FROM {events} GROUP BY 1
"""

RULE_VERSION = """
SELECT p_partkey AS id, concat('src', CAST(p_partkey % 50 AS STRING)) AS source_key, CASE WHEN p_partkey % 100 < 50 THEN 'detail' ELSE 'search_list' END AS page_kind,
       CAST(floor(p_partkey / 100) + 1 AS INT) AS version, concat('layout', CAST(p_partkey % 3 AS STRING)) AS layout_fingerprint,
       CASE p_partkey % 4 WHEN 0 THEN 'dom' WHEN 1 THEN 'jsonld' ELSE 'next_data' END AS strategy,
       CASE WHEN floor(p_partkey / 100) = 1 AND p_partkey % 6 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'pinned' ELSE 'active' END WHEN floor(p_partkey / 100) > 4 THEN 'proposed' ELSE 'retired' END AS status,
       CASE WHEN p_partkey % 2 = 0 THEN 'human' ELSE 'model' END AS created_by
FROM {part}
"""

#: Name, SQL, and the one table that each view reads.
VIEWS = {
    "raw_listing": (RAW_LISTING, "part"), "subscription": (SUBSCRIPTION, "customer"), "sighting": (SIGHTING, "orders"), "criteria": (CRITERIA, "customer"), "said": (SAID, "part"), "receipt": (RECEIPT, "events"), "run_event": (RUN, "events"),
    "source": (SOURCE, "supplier"), "location": (LOCATION, "customer"), "source_location": (SOURCE_LOCATION, "orders"), "zone_list": (ZONE_LIST, "orders"), "schedule": (SCHEDULE, "supplier"),
    "subscriber": (SUBSCRIBER, "customer"), "user_channel": (USER_CHANNEL, "customer"), "channel": (CHANNEL, "customer"), "notification": (NOTIFICATION, "events"), "job_run": (JOB_RUN, "events"), "rule_version": (RULE_VERSION, "part"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver, its local timestamps read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, source = VIEWS[name]
    return spark.sql(sql, **{source: table(spark, sf_dir, source)})


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``view`` over rows dealt to all tasks, for work that costs much a row: a small file is else read by one or two tasks."""
    sql, source = VIEWS[name]
    return spark.sql(sql, **{source: table(spark, sf_dir, source).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))})


def view_sql(*names: str) -> str:
    """The views as DuckDB's common table expressions, to follow WITH."""
    return ",\n".join(f"{n} AS ({VIEWS[n][0].format(**{VIEWS[n][1]: VIEWS[n][1]})})" for n in names)
