"""The same queries in SQL, written against the plain tables.

Each is stated independently of the operators: from the meaning of the query, not
from its Spark plan.
"""

from __future__ import annotations

from textwrap import dedent

ORACLES: dict[str, str] = {}


def sql(name: str, body: str, *ctes: str) -> None:
    """Register ``body`` with the named common tables it needs, in order."""
    head = ",\n".join(f"{c} AS ({dedent(CTES[c]).strip()})" for c in _closure(ctes))
    ORACLES[name] = f"WITH {head}\n{dedent(body).strip()}" if ctes else dedent(body).strip()


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for needed in [*_closure(tuple(NEEDS.get(name, ()))), name]:
            if needed not in out:
                out.append(needed)
    return out


ERROR_TYPES = """CASE e WHEN 0 THEN 'ChaosTriggered' WHEN 1 THEN 'ChaosTriggered' WHEN 2 THEN 'ChaosTriggered'
    WHEN 3 THEN 'ChaosTriggered' WHEN 4 THEN 'ChaosTriggered' WHEN 5 THEN 'HTTPStatusError'
    WHEN 6 THEN 'TimeoutException' WHEN 7 THEN 'DbtRuntimeError' WHEN 8 THEN 'AssertionError'
    WHEN 9 THEN 'ValueError' WHEN 10 THEN '' WHEN 11 THEN 'NotFoundError' WHEN 12 THEN 'SchemaError' END"""
ERROR_TEXTS = """CASE e WHEN 0 THEN 'chaos:tlc_5xx upstream 5xx' WHEN 1 THEN 'chaos:weather_429 rate limit'
    WHEN 2 THEN 'chaos:late_partition not yet published upstream (404)' WHEN 3 THEN 'chaos:duckdb_lock'
    WHEN 4 THEN 'chaos:tlc_schema_drift' WHEN 5 THEN '503 Service Unavailable' WHEN 6 THEN ''
    WHEN 7 THEN 'could not compile' WHEN 8 THEN 'stg_ check failed'
    WHEN 9 THEN 'weather column temperature_2m_mean did not match' WHEN 10 THEN 'oops'
    WHEN 11 THEN 'object missing' WHEN 12 THEN 'vendor_id' END"""

CTES = {
    "weather": """
        SELECT CAST(o_orderdate AS DATE) AS weather_date, max(o_totalprice) / 1000 AS temp_max_c,
               min(o_totalprice) / 1000 AS temp_min_c,
               (max(o_totalprice) + min(o_totalprice)) / 2000 AS temp_mean_c,
               CAST(count(*) AS DOUBLE) AS precipitation_mm,
               CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS rain_mm,
               CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS snowfall_cm,
               CAST(max(o_custkey) AS DOUBLE) AS wind_speed_max_kmh,
               CAST(max(o_orderkey) AS DOUBLE) AS wind_gust_max_kmh
        FROM orders GROUP BY 1""",
    "trips": """
        SELECT l_shipdate AS pickup_ts, l_shipdate + to_hours(l_linenumber) AS dropoff_ts, l_linenumber AS vendor_id,
               CAST(l_quantity / 2 AS INTEGER) AS passenger_count, l_extendedprice / 1000 AS trip_distance,
               CAST(l_suppkey AS INTEGER) AS pickup_zone_id, CAST(l_partkey AS INTEGER) AS dropoff_zone_id,
               l_linenumber AS payment_type, l_extendedprice AS fare_amount, l_discount AS tip_amount,
               l_extendedprice / 100 AS total_amount, CAST(year(o_orderdate) AS INTEGER) AS ingest_year,
               CAST(month(o_orderdate) AS INTEGER) AS ingest_month
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE year(l_shipdate) = year(o_orderdate) AND month(l_shipdate) = month(o_orderdate)""",
    "daily": """
        SELECT t.*, temp_max_c, temp_min_c, precipitation_mm, snowfall_cm
        FROM (SELECT CAST(pickup_ts AS DATE) AS pickup_date, pickup_zone_id, count(*) AS trip_count,
                     CAST(sum(passenger_count) AS BIGINT) AS passengers, sum(trip_distance) / count(trip_distance) AS avg_distance,
                     sum(total_amount) / count(total_amount) AS avg_fare,
                     count(*) FILTER (tip_amount > 0) / count(*)::DOUBLE AS tip_rate
              FROM trips GROUP BY 1, 2) t
        LEFT JOIN weather ON weather_date = pickup_date""",
    "zones": """
        SELECT CAST(s_suppkey AS INTEGER) AS zone_id, r_name AS borough, s_name AS zone_name, n_name AS service_zone
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "log": f"""
        SELECT *, 'run-' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id,
               CASE WHEN event_type = 'view' THEN NULL WHEN k < 35 THEN 'bronze/tlc_yellow'
                    WHEN k < 60 THEN 'bronze/weather_nyc_daily' WHEN k < 75 THEN 'silver/trips_weather'
                    WHEN k < 90 THEN 'stg_tlc_yellow' ELSE 'fct_trips_daily' END AS asset_key,
               CASE WHEN event_type = 'error' THEN {ERROR_TYPES} END AS error_type,
               CASE WHEN event_type = 'error' THEN {ERROR_TEXTS} END AS error_message
        FROM (SELECT *, k % 13 AS e
              FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))""",
    "runs": """
        SELECT run_id, user_id, CAST(ts AS DATE) AS day, max(ts) AS ended_at, min(ts) AS created_at,
               CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
               CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 31 = 0 THEN 'garbage'
                    ELSE '1998-' || lpad(CAST(user_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' END AS partition_key
        FROM log GROUP BY run_id, user_id, CAST(ts AS DATE)""",
    "last_asset": """
        SELECT run_id, asset_key FROM log WHERE asset_key IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) = 1""",
    "last_type": """
        SELECT run_id, error_type FROM log WHERE event_type = 'error' AND error_type <> ''
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) = 1""",
    "last_text": """
        SELECT run_id, error_message FROM log WHERE event_type = 'error' AND error_message <> ''
        QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) = 1""",
    "last_trace": """
        SELECT run_id, 'trace ' || max(event_id) AS stack_trace FROM log WHERE event_type = 'error' GROUP BY 1""",
    "captured": """
        SELECT substr(sha256(run_id || '|' || asset_key), 1, 32) AS incident_id, ended_at AS created_at, asset_key,
               partition_key, coalesce(error_type, 'Unknown') AS error_type,
               coalesce(error_message, '') AS error_message, coalesce(stack_trace, '') AS stack_trace, run_id, user_id,
               day, (user_id + day(ended_at)) AS turn
        FROM runs JOIN last_asset USING (run_id) LEFT JOIN last_type USING (run_id) LEFT JOIN last_text USING (run_id)
             LEFT JOIN last_trace USING (run_id)
        WHERE status = 'FAILURE'""",
    "state": """
        SELECT c.*, f.proposed_fix, r.resolved_at,
               CASE WHEN r.resolved_at IS NULL THEN 'open' ELSE 'resolved' END AS status
        FROM captured c
        LEFT JOIN (SELECT run_id, ts AS resolved_at FROM log WHERE event_type = 'purchase'
                   QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) = 1) r USING (run_id)
        LEFT JOIN (SELECT run_id, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'retry-with-backoff' WHEN 2 THEN 'rerun-dbt'
                                  ELSE 'coerce-to-string' END AS proposed_fix
                   FROM log WHERE event_type = 'signup'
                   QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) = 1) f USING (run_id)""",
    "classified": """
        SELECT *, CASE
            WHEN t LIKE '%chaostriggered%' AND (a LIKE '%tlc#_5xx%' ESCAPE '#' OR m LIKE '%tlc#_5xx%' ESCAPE '#')
                THEN 'upstream_outage'
            WHEN t LIKE '%chaostriggered%' AND contains(a || ' ' || m, 'weather_429') THEN 'upstream_outage'
            WHEN t LIKE '%chaostriggered%' AND contains(a || ' ' || m, 'late_partition') THEN 'upstream_outage'
            WHEN t LIKE '%chaostriggered%' AND contains(a || ' ' || m, 'duckdb_lock') THEN 'infra'
            WHEN t LIKE '%chaostriggered%' AND contains(a || ' ' || m, 'schema') THEN 'schema_drift'
            WHEN contains(t, 'httpstatuserror') OR contains(t, 'timeoutexception') OR contains(t, 'connecterror')
                THEN 'upstream_outage'
            WHEN contains(t, 'dbtruntimeerror') OR contains(t, 'dagsterdbtcliruntimeerror') THEN 'dbt_error'
            WHEN contains(t, 'assertionerror') AND contains(a || ' ' || m, 'stg_') THEN 'data_quality'
            WHEN contains(t, 'valueerror') AND contains(a || ' ' || m, 'weather') THEN 'schema_drift'
            ELSE 'unknown' END AS category_hint
        FROM (SELECT *, lower(error_type) AS t, lower(error_message) AS m, lower(asset_key) AS a FROM captured)""",
    "replies": """
        SELECT *, CASE WHEN turn % 10 IN (0) THEN 'no response' WHEN turn % 10 IN (1, 2) THEN 'model returned non-JSON'
                       WHEN turn % 10 = 3 THEN 'model JSON did not match schema: confidence'
                       WHEN turn % 10 = 4 THEN 'model JSON did not match schema: root_cause' END AS error,
               CASE turn % 10 WHEN 5 THEN 'upstream_outage' WHEN 6 THEN 'upstream_outage' WHEN 7 THEN 'aliens'
                              WHEN 8 THEN 'dbt_error' WHEN 9 THEN 'data_quality' END AS category,
               CASE WHEN turn % 10 >= 5 THEN 'it broke' END AS root_cause,
               CASE turn % 10 WHEN 5 THEN 'retry-with-backoff' WHEN 6 THEN 'partition-window-slip'
                              WHEN 7 THEN 'coerce-to-string' WHEN 8 THEN 'rerun-dbt'
                              WHEN 9 THEN 'retry-with-backoff' END AS proposed_fix,
               CASE turn % 10 WHEN 5 THEN 0.9 WHEN 6 THEN 0.8 WHEN 7 THEN 0.7 WHEN 8 THEN 1.0
                              WHEN 9 THEN 0.0 END::DOUBLE AS confidence,
               CASE WHEN turn % 10 >= 5 THEN turn % 10 <> 9 END AS can_auto_remediate
        FROM classified""",
    "diagnosed": """
        SELECT incident_id, created_at, asset_key, partition_key, error_type, error_message, category_hint,
               error AS diagnosis_error,
               CASE WHEN error IS NOT NULL THEN category_hint WHEN category = 'aliens' THEN 'unknown'
                    ELSE category END AS category,
               CASE WHEN error IS NOT NULL THEN 'agent diagnose failed: ' || error ELSE root_cause END AS root_cause,
               CASE WHEN error IS NOT NULL THEN 'file incident for human review' ELSE proposed_fix END AS proposed_fix,
               CASE WHEN error IS NOT NULL THEN 0.0 ELSE confidence END AS confidence,
               error IS NULL AND can_auto_remediate AND proposed_fix <> 'rerun-dbt' AS can_auto_remediate
        FROM replies""",
    "manifest": """
        SELECT 'tlc' AS dataset, strftime(l_shipdate, '%Y-%m-01') AS object_key,
               strftime(l_shipdate, 'bronze/_quarantine/tlc/yellow/year=%Y/month=%m/') AS target, count(*) AS n_rows
        FROM lineitem GROUP BY ALL
        UNION ALL
        SELECT 'weather', strftime(o_orderdate, '%Y-%m-01'),
               strftime(o_orderdate, 'bronze/_quarantine/weather/nyc/year=%Y/month=%m/'), count(*)
        FROM orders GROUP BY ALL""",
    "guards": """
        SELECT c.*,
               starts_with(asset_key, 'bronze') AND partition_key IS NOT NULL
                   AND (contains(blob, 'tlc_5xx') OR contains(blob, 'tlc_yellow') OR contains(blob, 'weather_429')
                        OR contains(blob, 'weather_nyc_daily')
                        OR error_type IN ('HTTPStatusError', 'TimeoutException', 'ChaosTriggered')) AS retry_ok,
               starts_with(asset_key, 'bronze') AND partition_key IS NOT NULL
                   AND (contains(lower(error_message), '404') OR contains(lower(error_message), 'late_partition')
                        OR contains(error_type, 'NotFound')) AS slip_ok,
               starts_with(asset_key, 'bronze')
                   AND (regexp_matches(lower(error_message), 'schema|vendor_id|temperature_2m|column|type|did not match')
                        OR contains(error_type, 'SchemaError') OR contains(error_type, 'ValidationError')) AS coerce_ok,
               CASE WHEN contains(blob, 'tlc_5xx') OR contains(blob, 'tlc_yellow') THEN 'tlc_5xx'
                    WHEN contains(blob, 'weather_429') OR contains(blob, 'weather_nyc_daily') THEN 'weather_429'
                    END AS flag,
               CASE WHEN try_strptime(partition_key, '%Y-%m-%d') IS NOT NULL
                    THEN strftime(strptime(partition_key, '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m-01') END AS slipped,
               m.target, m.n_rows
        FROM (SELECT *, lower(asset_key || ' ' || error_message || ' ' || error_type) AS blob,
                     CASE WHEN contains(asset_key, 'tlc') THEN 'tlc' WHEN contains(asset_key, 'weather') THEN 'weather' END
                         AS dataset FROM captured) c
        LEFT JOIN manifest m ON m.dataset = c.dataset AND m.object_key = coalesce(
            c.partition_key, (SELECT max(object_key) FROM manifest x WHERE x.dataset = c.dataset))""",
    "flags": """
        SELECT DISTINCT CASE e WHEN 0 THEN 'tlc_5xx' WHEN 2 THEN 'late_partition' END AS flag
        FROM log WHERE event_type = 'error' AND e IN (0, 2)""",
    "judged": """
        SELECT g.incident_id, g.asset_key, g.partition_key, g.created_at, d.category_hint, d.category, d.diagnosis_error,
               d.proposed_fix, d.can_auto_remediate, g.flag, g.slipped, g.target, g.n_rows,
               d.can_auto_remediate AND CASE d.proposed_fix WHEN 'retry-with-backoff' THEN retry_ok
                   WHEN 'partition-window-slip' THEN slip_ok WHEN 'coerce-to-string' THEN coerce_ok END AS runs
        FROM diagnosed d JOIN guards g USING (incident_id)""",
    "decided": """
        SELECT *,
               CASE WHEN NOT can_auto_remediate THEN 'skipped' WHEN NOT runs THEN 'skipped'
                    WHEN proposed_fix = 'partition-window-slip' AND slipped IS NULL THEN 'failed'
                    WHEN proposed_fix = 'coerce-to-string' AND target IS NULL THEN 'execute_returned_failure'
                    ELSE 'executed' END AS action_status,
               CASE WHEN NOT can_auto_remediate THEN 'diagnosis.can_auto_remediate=false'
                    WHEN NOT runs THEN 'guard rejected'
                    WHEN proposed_fix = 'partition-window-slip' AND slipped IS NULL
                        THEN 'unparseable partition_key: ''' || partition_key || '''' END AS action_reason,
               CASE WHEN can_auto_remediate THEN proposed_fix END AS action,
               CASE WHEN runs AND proposed_fix = 'retry-with-backoff' AND flag IN (SELECT flag FROM flags)
                         AND row_number() OVER (PARTITION BY flag, runs AND proposed_fix = 'retry-with-backoff'
                                                ORDER BY created_at DESC, incident_id) = 1
                    THEN flag END AS cleared_flag
        FROM judged""",
    "every_month": """
        SELECT CAST(m AS DATE) AS m
        FROM (SELECT unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-01-01', INTERVAL 1 MONTH)) AS m)""",
    "metric": """
        SELECT event_id, ts, 'asset' || (user_id % 4) AS asset, event_type AS status,
               CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS rows_, value AS seconds,
               'source' || (user_id % 3) AS source, 'check' || (user_id % 25) AS check_name,
               CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS result
        FROM events""",
    "vectors": """
        SELECT incident_id, asset_key, CAST(embedding AS DOUBLE[]) AS v, created_at
        FROM captured JOIN embeddings ON vec_id = user_id""",
    "queue": """
        SELECT incident_id FROM state WHERE status = 'open' AND coalesce(proposed_fix, '') = ''
        ORDER BY created_at DESC, incident_id LIMIT 10""",
    "waiting": """
        SELECT * FROM state WHERE status = 'open' AND coalesce(proposed_fix, '') = ''""",
    "parents": """
        SELECT name, string_agg('source.raw.' || event_type, ',' ORDER BY event_type) AS upstream,
               '[' || string_agg('''source.raw.' || event_type || '''', ', ' ORDER BY event_type) || ']' AS listed
        FROM (SELECT DISTINCT regexp_extract(asset_key, '[^/.]+$') AS name, event_type FROM log WHERE asset_key IS NOT NULL)
        GROUP BY 1""",
    "selected": """
        SELECT r.run_id, r.created_at, r.status, a.asset_key
        FROM runs r JOIN (SELECT DISTINCT run_id, asset_key FROM log WHERE asset_key IS NOT NULL) a USING (run_id)
        WHERE user_id % 50 <> 0""",
    "shared_runs": """
        SELECT run_id, created_at, status FROM runs r
        WHERE user_id % 50 = 0 OR run_id NOT IN (SELECT run_id FROM log WHERE asset_key IS NOT NULL)""",
    "recent": """
        SELECT asset_key, row_number() OVER (PARTITION BY asset_key ORDER BY created_at DESC, run_id) AS position,
               run_id, status
        FROM (SELECT run_id, created_at, status, asset_key FROM selected
              WHERE asset_key IN (SELECT asset_key FROM captured)
              UNION ALL
              SELECT run_id, created_at, status, asset_key
              FROM shared_runs, (SELECT DISTINCT asset_key FROM captured))
        QUALIFY position <= 10""",
    "tails": """
        SELECT run_id, count(*) AS n, string_agg('  ' || concat_ws(' ', error_type, error_message), chr(10)
                                                 ORDER BY event_id) FILTER (pos <= 10) AS shown
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id DESC) AS pos FROM log)
        WHERE pos <= 200 GROUP BY 1""",
}
NEEDS = {
    "daily": ["weather", "trips"],
    "runs": ["log"],
    "last_asset": ["log"],
    "last_type": ["log"],
    "last_text": ["log"],
    "last_trace": ["log"],
    "captured": ["runs", "last_asset", "last_type", "last_text", "last_trace"],
    "state": ["captured"],
    "classified": ["captured"],
    "replies": ["classified"],
    "diagnosed": ["replies"],
    "guards": ["captured", "manifest"],
    "flags": ["log"],
    "judged": ["diagnosed", "guards"],
    "decided": ["judged", "flags"],
    "vectors": ["captured"],
    "queue": ["state"],
    "waiting": ["state"],
    "parents": ["log"],
    "selected": ["runs"],
    "shared_runs": ["runs"],
    "recent": ["captured", "selected", "shared_runs"],
    "tails": ["log"],
}

# --- staging, join, aggregate ------------------------------------------------------

sql("stage_trips", "SELECT * FROM trips", "trips")
sql(
    "stage_weather",
    """
    SELECT weather_date, round(temp_max_c, 8) AS temp_max_c, round(temp_min_c, 8) AS temp_min_c,
           round(temp_mean_c, 8) AS temp_mean_c, precipitation_mm, rain_mm, snowfall_cm, wind_speed_max_kmh,
           wind_gust_max_kmh
    FROM weather
    """,
    "weather",
)
sql("dim_zones", "SELECT * FROM zones", "zones")
sql(
    "trips_weather",
    """
    SELECT t.* REPLACE (round(trip_distance, 8) AS trip_distance, round(fare_amount, 8) AS fare_amount,
                        round(tip_amount, 8) AS tip_amount, round(total_amount, 8) AS total_amount),
           CAST(pickup_ts AS DATE) AS pickup_date, round(temp_max_c, 8) AS temp_max_c,
           round(temp_min_c, 8) AS temp_min_c, round(temp_mean_c, 8) AS temp_mean_c, precipitation_mm, snowfall_cm,
           wind_speed_max_kmh
    FROM trips t LEFT JOIN weather ON CAST(pickup_ts AS DATE) = weather_date
    """,
    "trips",
    "weather",
)
sql(
    "trips_daily",
    """
    SELECT pickup_date, pickup_zone_id, trip_count, passengers, round(avg_distance, 8) AS avg_distance,
           round(avg_fare, 8) AS avg_fare, round(tip_rate, 8) AS tip_rate, round(temp_max_c, 8) AS temp_max_c,
           round(temp_min_c, 8) AS temp_min_c, precipitation_mm, snowfall_cm
    FROM daily
    """,
    "daily",
)
for _name in ("gold_from_partitions", "gold_incremental"):
    ORACLES[_name] = ORACLES["trips_daily"]
sql(
    "dq_from_footers",
    """
    SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, c.column, count(*) AS rows,
           count(*) FILTER (c.column = 'tip_amount' AND l_linenumber > 4 OR c.column = 'DOLocationID' AND l_suppkey % 3 = 0) AS nulls
    FROM lineitem, (SELECT unnest(['tpep_pickup_datetime', 'tpep_dropoff_datetime', 'VendorID', 'passenger_count', 'trip_distance',
        'PULocationID', 'DOLocationID', 'payment_type', 'fare_amount', 'tip_amount', 'total_amount']) AS column) c
    GROUP BY ALL
    """,
)
sql(
    "interim_trips_weather",
    """
    SELECT l_shipdate AS pickup_ts, CAST(l_shipdate AS DATE) AS pickup_date, l_extendedprice AS fare_amount,
           CASE WHEN l_linestatus <> 'O' THEN l_tax END AS surcharge, round(temp_max_c, 8) AS temperature_2m_max,
           round(temp_min_c, 8) AS temperature_2m_min, round(temp_mean_c, 8) AS temperature_2m_mean,
           precipitation_mm AS precipitation_sum, rain_mm AS rain_sum, snowfall_cm AS snowfall_sum,
           wind_speed_max_kmh AS wind_speed_10m_max, wind_gust_max_kmh AS wind_gusts_10m_max
    FROM lineitem LEFT JOIN weather ON CAST(l_shipdate AS DATE) = weather_date
    WHERE l_returnflag <> 'R'
    """,
    "weather",
)

# --- partitions, landing, schema ------------------------------------------------------

sql(
    "partition_calendar",
    """
    SELECT l_suppkey, strftime(m, '%Y-%m-%d') AS partition_key, year(m) AS year, month(m) AS month
    FROM (SELECT l_suppkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1)
    JOIN every_month ON m >= date_trunc('month', a) AND m <= date_trunc('month', b) - INTERVAL 2 MONTH
    """,
    "every_month",
)
sql(
    "missing_partitions",
    """
    SELECT p.l_partkey, strftime(m, '%Y-%m-%d') AS partition_key
    FROM (SELECT l_partkey, min(l_shipdate) AS a FROM lineitem GROUP BY 1) p
    JOIN every_month ON m >= date_trunc('month', a) AND m <= DATE '2001-07-01'
    WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = p.l_partkey
                      AND CAST(date_trunc('month', x.l_shipdate) AS DATE) = m)
    """,
    "every_month",
)
sql(
    "next_partition",
    """
    SELECT l_partkey, strftime(n, '%Y-%m-%d') AS candidate
    FROM (SELECT l_partkey, date_trunc('month', max(l_shipdate)) + INTERVAL 1 MONTH AS n FROM lineitem GROUP BY 1)
    WHERE n <= TIMESTAMP '2001-09-14'
    """,
)
sql(
    "published_candidates",
    """
    SELECT l_suppkey, strftime(n, '%Y-%m-%d') AS candidate
    FROM (SELECT l_suppkey, date_trunc('month', max(l_shipdate)) + INTERVAL 1 MONTH AS n FROM lineitem GROUP BY 1)
    WHERE n <= TIMESTAMP '2002-01-14' AND n IN (SELECT date_trunc('month', o_orderdate) + INTERVAL 3 MONTH FROM orders)
    """,
)
sql(
    "partition_profile",
    """
    SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS rows, min(l_shipdate) AS pickup_min,
           max(l_shipdate) AS pickup_max
    FROM lineitem GROUP BY 1, 2
    """,
)
sql(
    "month_bounds",
    """
    SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day,
           last_day(CAST(o_orderdate AS DATE)) AS last_day,
           strftime(o_orderdate, 'bronze/tlc/yellow/year=%Y/month=%m/') AS folder
    FROM orders
    """,
)
sql(
    "land_new_partitions",
    """
    SELECT year(l_shipdate) AS year, month(l_shipdate) AS month,
           CASE WHEN year(l_shipdate) <= 1997 THEN 'skipped' ELSE 'landed' END AS status, count(*) AS rows,
           count(*) AS stored_rows
    FROM lineitem GROUP BY 1, 2, 3
    """,
)
sql(
    "scan_partitions",
    """
    SELECT l_shipdate AS tpep_pickup_datetime, l_linenumber AS VendorID, l_suppkey AS PULocationID,
           year(l_shipdate) AS year, month(l_shipdate) AS month
    FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') IN ('1996-02', '1997-11')
    """,
)
sql("seed_scan", "SELECT * FROM zones", "zones")
sql(
    "latest_partition",
    "SELECT year(max(l_shipdate)) AS year, month(max(l_shipdate)) AS month FROM lineitem",
)
_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_DESCRIBED = " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS file_name, row_number() OVER () AS place, column_name, column_type FROM (DESCRIBE {t})" for t in _TABLES
)
sql(
    "schema_fingerprint",
    f"""
    SELECT file_name, count(*) AS n_columns, left(sha256(string_agg(column_name || ':' || CASE column_type
               WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
               WHEN 'TIMESTAMP' THEN 'timestamp[us]' WHEN 'FLOAT[]' THEN 'list<element: float>' END, ',' ORDER BY place)), 16)
               AS schema_fingerprint
    FROM ({_DESCRIBED}) GROUP BY 1
    """,
)
sql(
    "schema_drift",
    """
    SELECT DISTINCT y AS year, y BETWEEN 1996 AND 1999 AS changed, CASE y WHEN 1996 THEN 2 ELSE 1 END::BIGINT AS n_schemas,
           CASE WHEN y IN (1996, 1998) THEN 'vendor_id_renamed' WHEN y IN (1997, 1999) THEN 'VendorID' ELSE '' END AS added,
           CASE WHEN y IN (1996, 1998) THEN 'VendorID' WHEN y IN (1997, 1999) THEN 'vendor_id_renamed' ELSE '' END AS removed
    FROM (SELECT year(l_shipdate) AS y FROM lineitem)
    """,
)
sql(
    "dq_expected_columns",
    """
    SELECT DISTINCT year(l_shipdate) AS year, 'VendorID' AS missing_column FROM lineitem
    WHERE year(l_shipdate) IN (1996, 1998)
    """,
)
sql(
    "json_columns_to_rows",
    """
    SELECT weather_date AS date, round(temp_max_c, 8) AS temperature_2m_max, round(temp_min_c, 8) AS temperature_2m_min,
           round(temp_mean_c, 8) AS temperature_2m_mean, precipitation_mm AS precipitation_sum,
           CASE WHEN month(weather_date) NOT IN (5, 10) THEN rain_mm END AS rain_sum,
           CASE WHEN month(weather_date) NOT IN (3, 6, 9, 12) THEN snowfall_cm END AS snowfall_sum,
           wind_speed_max_kmh AS wind_speed_10m_max, wind_gust_max_kmh AS wind_gusts_10m_max
    FROM weather WHERE month(weather_date) NOT IN (7, 11)
    """,
    "weather",
)
sql(
    "json_payload_bounds",
    """
    SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(DISTINCT o_orderdate) AS days,
           strftime(min(o_orderdate), '%Y-%m-%d') AS date_min, strftime(max(o_orderdate), '%Y-%m-%d') AS date_max
    FROM orders WHERE month(o_orderdate) NOT IN (7, 11) GROUP BY 1, 2
    """,
)
sql(
    "json_payload_rejects",
    """
    SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month,
           CASE month(o_orderdate) WHEN 7 THEN 'missing daily.time' ELSE 'malformed payload' END AS reject_reason
    FROM orders WHERE month(o_orderdate) IN (7, 11)
    """,
)

# --- data quality -------------------------------------------------------------------

sql(
    "dq_not_null",
    """
    SELECT 'pickup_ts' AS column_name, count(*) AS failures FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT 'fare_amount', count(*) FROM lineitem WHERE l_extendedprice IS NULL
    UNION ALL SELECT 'surcharge', count(*) FROM lineitem WHERE l_linestatus = 'O' OR l_tax IS NULL
    """,
)
sql("dq_unique", "SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1")
sql(
    "dq_unique_combo",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
sql(
    "dq_accepted_values",
    """
    SELECT c_custkey, c_mktsegment FROM customer
    WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')
    """,
)
sql(
    "dq_relationships",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')
    """,
)
sql(
    "dq_between",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderstatus <> 'P' AND (o_totalprice < 0 OR o_totalprice > 400000)
    """,
)
sql(
    "dq_no_future",
    """
    SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate FROM lineitem
    WHERE l_shipdate > TIMESTAMP '2001-01-01' + INTERVAL 24 HOUR
    """,
)
sql(
    "dq_row_count_tolerance",
    """
    SELECT o_orderpriority, partition_key, n, round(expected, 8) AS expected
    FROM (SELECT *, avg(n) OVER (PARTITION BY o_orderpriority ORDER BY partition_key
                                 ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS expected
          FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-01') AS partition_key, count(*) AS n
                FROM orders GROUP BY 1, 2))
    WHERE n < expected * (1 - 10 / 100.0) OR n > expected * (1 + 10 / 100.0)
    """,
)
sql("dq_row_count_total", "SELECT count(*) AS n FROM customer HAVING count(*) < 900 OR count(*) > 1100")
sql(
    "dq_row_count_positive",
    """
    SELECT user_id, CAST(d AS DATE) AS day
    FROM (SELECT user_id, unnest(generate_series(CAST(min(ts) AS DATE)::TIMESTAMP, CAST(max(ts) AS DATE)::TIMESTAMP,
                                                 INTERVAL 1 DAY)) AS d
          FROM events GROUP BY 1) e
    WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND CAST(x.ts AS DATE) = CAST(e.d AS DATE))
    """,
)
_SUMMARY = """
    SELECT check_name, target, severity, failures, failures = 0 AS passed FROM (
        SELECT 'pickup_ts_not_null' AS check_name, 'bronze' AS target, 'warn' AS severity,
               count(*) FILTER (l_suppkey % 19 = 0 OR l_shipdate IS NULL) AS failures FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL SELECT 'dropoff_ts_not_null', 'bronze', 'error', count(*) FILTER (l_shipdate IS NULL) FROM lineitem
        UNION ALL SELECT 'pickup_zone_not_null', 'bronze', 'error', count(*) FILTER (l_suppkey IS NULL) FROM lineitem
        UNION ALL SELECT 'partition_row_count', 'bronze', 'warn', count(*) FROM (
            SELECT n, avg(n) OVER (ORDER BY m ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS expected FROM (
                SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1))
            WHERE n < expected * 0.9 OR n > expected * 1.1
        UNION ALL SELECT 'silver_pickup_ts_not_null', 'silver', 'error', count(*) FILTER (pickup_ts IS NULL) FROM trips
        UNION ALL SELECT 'silver_pickup_zone_not_null', 'silver', 'error', count(*) FILTER (pickup_zone_id IS NULL) FROM trips
        UNION ALL SELECT 'weather_date_not_null', 'weather', 'error', count(*) FILTER (weather_date IS NULL) FROM weather
        UNION ALL SELECT 'daily_date_not_null', 'daily', 'error', count(*) FILTER (pickup_date IS NULL) FROM daily
        UNION ALL SELECT 'daily_zone_not_null', 'daily', 'error', count(*) FILTER (pickup_zone_id IS NULL) FROM daily
        UNION ALL SELECT 'daily_trip_count_not_null', 'daily', 'error', count(*) FILTER (trip_count IS NULL) FROM daily
        UNION ALL SELECT 'rowcount_positive', 'trips', 'error', CAST(count(*) = 0 AS BIGINT) FROM trips
        UNION ALL SELECT 'pickup_zone_known', 'trips', 'warn', count(*) FROM trips
            WHERE pickup_zone_id NOT IN (SELECT zone_id FROM zones WHERE zone_id % 10 > 0)
        UNION ALL SELECT 'trip_count_positive', 'daily', 'error', count(*) FILTER (trip_count < 0) FROM daily
        UNION ALL SELECT 'avg_fare_range', 'daily', 'warn', count(*) FILTER (avg_fare < 0 OR avg_fare > 500) FROM daily
        UNION ALL SELECT 'pickup_date_not_future', 'daily', 'error',
            count(*) FILTER (pickup_date > TIMESTAMP '2001-01-02') FROM daily
        UNION ALL SELECT 'daily_grain', 'daily', 'error', count(*) FROM (
            SELECT 1 FROM daily GROUP BY pickup_date, pickup_zone_id HAVING count(*) > 1)
        UNION ALL SELECT 'zone_id_not_null', 'zones', 'error', count(*) FILTER (zone_id IS NULL) FROM zones
        UNION ALL SELECT 'zone_id_unique', 'zones', 'error', count(*) - count(DISTINCT zone_id) FROM zones
        UNION ALL SELECT 'borough_accepted', 'zones', 'error',
            count(*) FILTER (borough NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')) FROM zones
        UNION ALL SELECT 'weather_date_unique', 'weather', 'error', count(*) - count(DISTINCT weather_date) FROM weather)
    """
sql("dq_summary", _SUMMARY, "daily", "zones")

# --- faults ---------------------------------------------------------------------------

sql(
    "fault_rename",
    """
    SELECT event_id, user_id AS vendor_id_renamed, ts AS tpep_pickup_datetime, value AS fare_amount FROM events
    """,
)
sql("fault_weather_rename", "SELECT weather_date AS date, round(temp_mean_c, 8) AS temp_2m_mean FROM weather", "weather")
sql(
    "fault_null_spike",
    """
    SELECT event_id, user_id AS VendorID, CASE WHEN event_id % 19 <> 0 THEN ts END AS tpep_pickup_datetime,
           value AS fare_amount, event_id AS ordinal
    FROM events
    """,
)
sql(
    "fault_volume_drop",
    """
    SELECT event_id, user_id AS VendorID, ts AS tpep_pickup_datetime, value AS fare_amount, event_id AS ordinal
    FROM events WHERE event_id < (SELECT greatest(1, floor(count(*) * 0.05)) FROM events)
    """,
)
sql(
    "fault_detection_matrix",
    """
    SELECT fault, check_name,
           CASE WHEN check_name = 'expected_columns' AND fault IN ('trip_schema_drift', 'weather_schema_change') THEN 1
                WHEN check_name = 'not_null' AND fault = 'null_spike'
                    THEN (SELECT count(*) FROM events WHERE event_id % 19 = 0)
                WHEN check_name = 'row_count_tolerance' AND fault = 'volume_drop'
                    THEN (SELECT CAST(count(*) > 1 AS INTEGER) FROM events)
                ELSE 0 END AS failures
    FROM (SELECT unnest(['none', 'trip_schema_drift', 'weather_schema_change', 'null_spike', 'volume_drop']) AS fault)
    CROSS JOIN (SELECT unnest(['expected_columns', 'not_null', 'row_count_tolerance']) AS check_name)
    """,
)

# --- incidents ------------------------------------------------------------------------

sql("capture_incidents", "SELECT * EXCLUDE (user_id, day, turn) FROM captured", "captured")
sql("incident_state", "SELECT incident_id, status, resolved_at, proposed_fix FROM state", "state")
sql("incident_state_incremental", "SELECT incident_id, status, resolved_at, proposed_fix FROM state", "state")
sql(
    "open_incidents",
    """
    SELECT incident_id, asset_key, partition_key, error_type, status, proposed_fix, created_at FROM state
    WHERE status = 'open' ORDER BY created_at DESC, incident_id LIMIT 50
    """,
    "state",
)
sql(
    "incident_listing",
    """
    SELECT incident_id, substr(incident_id, 1, 8) || '  ' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '  '
           || rpad(asset_key, 35, ' ') || '  ' || rpad(error_type, 20, ' ') || '  ' || substr(error_message, 1, 60)
           AS line
    FROM state WHERE status = 'open' ORDER BY created_at DESC, incident_id LIMIT 20
    """,
    "state",
)
sql("append_incidents", "SELECT incident_id, created_at FROM captured WHERE day(created_at) > 15", "captured")
sql("undiagnosed_queue", "SELECT incident_id, created_at, asset_key FROM waiting", "waiting")
sql("diagnosis_queue", "SELECT incident_id, created_at FROM queue JOIN state USING (incident_id)", "queue")
sql("classify_incidents", "SELECT incident_id, error_type, category_hint FROM classified", "classified")
sql(
    "incident_details",
    """
    SELECT incident_id, status, error_message, resolved_at,
           CASE turn % 10
               WHEN 3 THEN '{"category": "infra", "root_cause": "it broke", "proposed_fix": "retry-with-backoff", "confidence": 1.5, "can_auto_remediate": true}'
               WHEN 4 THEN '{"category": "infra", "proposed_fix": "x", "confidence": 0.5, "can_auto_remediate": false}'
               WHEN 6 THEN '{"category": "upstream_outage", "root_cause": "it broke", "proposed_fix": "partition-window-slip", "confidence": 0.8, "can_auto_remediate": true}'
               WHEN 7 THEN ' {"category": "aliens", "root_cause": "it broke", "proposed_fix": "coerce-to-string", "confidence": "0.7", "can_auto_remediate": "yes"}' || chr(10)
               WHEN 8 THEN '{"category": "dbt_error", "root_cause": "it broke", "proposed_fix": "rerun-dbt", "confidence": 1, "can_auto_remediate": true}'
               WHEN 9 THEN '{"category": "data_quality", "root_cause": "it broke", "proposed_fix": "retry-with-backoff", "confidence": 0, "can_auto_remediate": false}'
           END AS incident_report
    FROM state
    """,
    "state",
)

# --- context --------------------------------------------------------------------------

sql(
    "lineage_neighbours",
    """
    SELECT DISTINCT 'silver/customer_' || user_id AS asset_key, 'upstream' AS direction,
           'model.shop.nation_' || c_nationkey AS neighbour
    FROM events JOIN customer ON c_custkey = user_id
    UNION ALL
    SELECT DISTINCT 'silver/customer_' || user_id, 'downstream', 'model.shop.order_' || o_orderkey
    FROM events JOIN customer ON c_custkey = user_id JOIN orders ON o_custkey = user_id
    """,
)
sql(
    "lineage_counts",
    """
    SELECT 'customer_' || c_custkey AS name, 1::BIGINT AS upstream_count, count(o_orderkey) AS downstream_count,
           'model.shop.nation_' || c_nationkey AS upstream,
           coalesce(string_agg('model.shop.order_' || o_orderkey, ',' ORDER BY 'model.shop.order_' || o_orderkey), '')
               AS downstream
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    WHERE c_custkey IN (SELECT user_id FROM events) GROUP BY c_custkey, c_nationkey
    """,
)
sql("recent_runs", "SELECT asset_key, position, run_id, status FROM recent", "recent")
sql(
    "log_tail",
    """
    SELECT conv_id, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY turn) AS log_lines
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS pos FROM conversations)
    WHERE pos <= 3 GROUP BY 1
    """,
)
sql(
    "embedding_text",
    """
    SELECT doc_id, concat_ws(chr(10), nullif(source, ''), nullif(lang, ''), nullif(text, ''),
                             CASE WHEN doc_id % 3 = 0 THEN 'prior fix: retry-with-backoff' END) AS embedding_text
    FROM documents
    """,
)
sql(
    "upsert_vectors",
    """
    SELECT vec_id, CAST(label AS BIGINT) AS label,
           array_to_string(list_transform(embedding, lambda x: CAST(round(
               CAST(x AS DOUBLE) * CASE WHEN label < 5 THEN 2 ELSE 1 END * 1000000) AS BIGINT)), ',') AS millionths
    FROM embeddings
    """,
)
_SIMILAR = """
    SELECT h.incident_id, similar_id, score, rank, s.asset_key, s.error_type,
           coalesce(s.proposed_fix, '') AS prior_fix
    FROM (SELECT q.incident_id, x.incident_id AS similar_id, round(list_cosine_similarity(q.v, x.v), 6) AS score,
                 row_number() OVER (PARTITION BY q.incident_id
                                    ORDER BY round(list_cosine_similarity(q.v, x.v), 6) DESC, x.incident_id) AS rank
          FROM vectors q JOIN vectors x ON {same} x.incident_id <> q.incident_id
          WHERE q.incident_id IN (SELECT incident_id FROM {queue})) h
    JOIN state s ON s.incident_id = h.similar_id
    WHERE rank <= 5
    """
sql("similar_incidents", _SIMILAR.format(same="x.asset_key = q.asset_key AND", queue="queue"), "vectors", "queue")
sql("similar_any_asset", _SIMILAR.format(same="", queue="queue"), "vectors", "queue")
sql("similar_open_incidents", _SIMILAR.format(same="x.asset_key = q.asset_key AND", queue="waiting"), "vectors", "waiting")
sql(
    "tick_prompts",
    f"""
    SELECT w.incident_id, concat_ws(chr(10), 'Heuristic category guess (you may override): ' || category_hint,
           'INCIDENT', 'asset_key: ' || w.asset_key, 'partition_key: ' || coalesce(w.partition_key, ''),
           'error_type: ' || w.error_type, 'error_message: ' || w.error_message, '', 'CONTEXT',
           'upstream: ' || coalesce(p.listed, '[]'), 'downstream: []',
           'recent_runs: ' || coalesce(r.n, 0) || ' entries', 'recent_log_excerpts (tail):', coalesce(t.shown, ''), '',
           'SIMILAR PAST INCIDENTS', coalesce(s.block, '(none)'), '', 'Return JSON only.') AS prompt
    FROM waiting w
    JOIN queue USING (incident_id)
    JOIN (SELECT incident_id, category_hint FROM classified) USING (incident_id)
    LEFT JOIN parents p ON p.name = regexp_extract(w.asset_key, '[^/.]+$')
    LEFT JOIN (SELECT asset_key, count(*) AS n FROM recent GROUP BY 1) r USING (asset_key)
    LEFT JOIN tails t USING (run_id)
    LEFT JOIN (SELECT incident_id, string_agg('- asset=' || asset_key || ' error_type=' || error_type || ' score='
                          || printf('%.2f', score) || ' prior_fix=' || prior_fix, chr(10) ORDER BY rank) AS block
               FROM ({_SIMILAR.format(same="x.asset_key = q.asset_key AND", queue="queue")}) WHERE rank <= 3 GROUP BY 1) s
        USING (incident_id)
    """,
    "waiting",
    "queue",
    "classified",
    "parents",
    "recent",
    "tails",
    "vectors",
)
sql(
    "context_bundle",
    """
    SELECT w.incident_id, w.asset_key, coalesce(p.upstream, '') AS upstream, '' AS downstream,
           coalesce(r.n, 0) AS recent_run_count, coalesce(t.n, 0) AS log_line_count,
           coalesce(s.n, 0) AS similar_incident_count
    FROM waiting w
    LEFT JOIN (SELECT incident_id, least(5, count(*) OVER (PARTITION BY asset_key) - 1) AS n FROM vectors) s USING (incident_id)
    LEFT JOIN parents p ON p.name = regexp_extract(w.asset_key, '[^/.]+$')
    LEFT JOIN (SELECT asset_key, count(*) AS n FROM recent GROUP BY 1) r USING (asset_key)
    LEFT JOIN tails t USING (run_id)
    """,
    "waiting",
    "parents",
    "recent",
    "tails",
    "vectors",
)
sql(
    "build_prompts",
    """
    SELECT w.incident_id, concat_ws(chr(10), 'Heuristic category guess (you may override): ' || category_hint,
           'INCIDENT', 'asset_key: ' || w.asset_key, 'partition_key: ' || coalesce(w.partition_key, ''),
           'error_type: ' || w.error_type, 'error_message: ' || w.error_message, '', 'CONTEXT',
           'upstream: ' || coalesce(p.listed, '[]'), 'downstream: []',
           'recent_runs: ' || coalesce(r.n, 0) || ' entries', 'recent_log_excerpts (tail):', coalesce(t.shown, ''), '',
           'SIMILAR PAST INCIDENTS', '(none)', '', 'Return JSON only.') AS prompt
    FROM waiting w
    JOIN (SELECT incident_id, category_hint FROM classified) USING (incident_id)
    LEFT JOIN parents p ON p.name = regexp_extract(w.asset_key, '[^/.]+$')
    LEFT JOIN (SELECT asset_key, count(*) AS n FROM recent GROUP BY 1) r USING (asset_key)
    LEFT JOIN tails t USING (run_id)
    """,
    "waiting",
    "classified",
    "parents",
    "recent",
    "tails",
)

# --- diagnosis and remediation ----------------------------------------------------------

sql(
    "validate_responses",
    """
    SELECT incident_id, category, root_cause, proposed_fix, confidence, can_auto_remediate, error
    FROM replies WHERE turn % 10 > 0
    """,
    "replies",
)
sql(
    "diagnose_incidents",
    """
    SELECT incident_id, category_hint, category, root_cause, proposed_fix, confidence, can_auto_remediate,
           diagnosis_error
    FROM diagnosed
    """,
    "diagnosed",
)
sql(
    "decide_actions",
    """
    SELECT incident_id, action_status, action_reason, action,
           CASE WHEN action_status NOT IN ('executed', 'execute_returned_failure') THEN NULL
                WHEN action = 'retry-with-backoff' AND cleared_flag IS NOT NULL
                    THEN 'cleared chaos flag ''' || cleared_flag || ''' and queued re-materialization'
                WHEN action = 'retry-with-backoff' THEN 'queued re-materialization (no flag to clear)'
                WHEN action = 'partition-window-slip' THEN 'slipped partition ' || partition_key || ' -> ' || slipped
                WHEN target IS NULL THEN 'could not locate bronze parquet for asset'
                ELSE 'wrote ' || n_rows || ' coerced rows to ' || target || '; queued re-ingest' END AS description,
           cleared_flag,
           CASE WHEN action_status = 'executed'
                THEN CASE WHEN action = 'partition-window-slip' THEN slipped ELSE partition_key END END AS next_partition
    FROM decided
    """,
    "decided",
)
sql(
    "reports",
    """
    SELECT d.incident_id, category_hint, category, action_status, action_reason,
           coalesce(p.n, 0) AS upstream_count, coalesce(r.n, 0) AS recent_run_count,
           coalesce(s.n, 0) AS similar_incident_count,
           coalesce(diagnosis_error, CASE WHEN action_status = 'failed' THEN action_reason END) AS first_error
    FROM decided d
    LEFT JOIN (SELECT name, len(string_split(upstream, ',')) AS n FROM parents) p
        ON p.name = regexp_extract(d.asset_key, '[^/.]+$')
    LEFT JOIN (SELECT asset_key, count(*) AS n FROM recent GROUP BY 1) r ON r.asset_key = d.asset_key
    LEFT JOIN (SELECT incident_id, least(5, count(*) OVER (PARTITION BY asset_key) - 1) AS n FROM vectors) s
        ON s.incident_id = d.incident_id
    """,
    "decided",
    "parents",
    "recent",
    "vectors",
)
sql(
    "second_tick_queue",
    """
    SELECT incident_id, created_at FROM waiting
    WHERE incident_id NOT IN (SELECT incident_id FROM queue JOIN diagnosed USING (incident_id)
                              WHERE coalesce(diagnosed.proposed_fix, '') <> '')
    """,
    "waiting",
    "queue",
    "diagnosed",
)
sql(
    "tick_summary",
    """
    SELECT asset_key, count(*) FILTER (diagnosis_error IS NULL) AS diagnosed,
           count(*) FILTER (action_status = 'executed') AS auto_remediated,
           count(*) FILTER (diagnosis_error IS NOT NULL) AS failed
    FROM decided GROUP BY 1
    """,
    "decided",
)
sql(
    "approvals",
    """
    SELECT approval_id, action, status,
           CASE status WHEN 'not_found' THEN 'no incident ''missing-' || approval_id || ''''
                WHEN 'off_allowlist' THEN 'action ''drop-table'' not on allowlist. Allowed: coerce-to-string, partition-window-slip, retry-with-backoff.'
                WHEN 'guard_failed' THEN 'action ''' || action || ''' was rejected by its guard or failed to execute.'
                ELSE CASE action
                    WHEN 'retry-with-backoff' THEN CASE WHEN cleared IS NULL
                        THEN 'queued re-materialization (no flag to clear)'
                        ELSE 'cleared chaos flag ''' || cleared || ''' and queued re-materialization' END
                    WHEN 'partition-window-slip' THEN 'slipped partition ' || partition_key || ' -> ' || slipped
                    ELSE CASE WHEN target IS NULL THEN 'could not locate bronze parquet for asset'
                         ELSE 'wrote ' || n_rows || ' coerced rows to ' || target || '; queued re-ingest' END END
           END AS detail
    FROM (SELECT *, CASE WHEN status = 'applied' AND action = 'retry-with-backoff' AND flag IN (SELECT flag FROM flags)
                              AND row_number() OVER (PARTITION BY flag, status = 'applied' AND action = 'retry-with-backoff'
                                                     ORDER BY created_at DESC, incident_id) = 1 THEN flag END AS cleared
          FROM (SELECT *, CASE WHEN incident_id IS NULL THEN 'not_found' WHEN action = 'drop-table' THEN 'off_allowlist'
                               WHEN NOT CASE action WHEN 'retry-with-backoff' THEN retry_ok
                                        WHEN 'partition-window-slip' THEN slip_ok ELSE coerce_ok END THEN 'guard_failed'
                               WHEN action = 'partition-window-slip' AND slipped IS NULL THEN 'guard_failed'
                               ELSE 'applied' END AS status
                FROM (SELECT r.run_id AS approval_id,
                             CASE (r.user_id + day(r.created_at)) % 4 WHEN 0 THEN 'retry-with-backoff'
                                  WHEN 1 THEN 'partition-window-slip' WHEN 2 THEN 'coerce-to-string'
                                  ELSE 'drop-table' END AS action,
                             g.incident_id, g.created_at, g.flag, g.partition_key, g.slipped, g.target, g.n_rows,
                             g.retry_ok, g.slip_ok, g.coerce_ok
                      FROM runs r LEFT JOIN guards g USING (run_id))))
    """,
    "guards",
    "flags",
)
sql(
    "flags_after_actions",
    """
    SELECT flag, flag NOT IN (SELECT cleared_flag FROM decided WHERE cleared_flag IS NOT NULL)
           AND NOT (flag = 'late_partition' AND EXISTS (SELECT 1 FROM decided WHERE action_status = 'executed'
                                                                                AND action = 'partition-window-slip')) AS raised
    FROM flags
    """,
    "decided",
)
sql(
    "approved_fixes",
    f"""
    SELECT c.incident_id, a.action AS proposed_fix
    FROM ({ORACLES["approvals"]}) a JOIN captured c ON c.run_id = a.approval_id WHERE a.status = 'applied'
    """,
    "captured",
)
sql(
    "forced_reingest",
    """
    SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, count(*) AS rows, count(*) AS stored_rows,
           CASE WHEN strftime(l_shipdate, '%Y-%m-01') IN (SELECT partition_key FROM guards WHERE coerce_ok AND target IS NOT NULL)
                THEN 'landed' ELSE 'skipped' END AS status
    FROM lineitem GROUP BY 1, 2, 5
    """,
    "guards",
)
sql(
    "plan_retry",
    """
    SELECT incident_id, asset_key, partition_key, cleared_flag, 2::BIGINT + CAST(cleared_flag IS NOT NULL AS BIGINT) AS n_tags,
           CASE WHEN cleared_flag IS NULL THEN 'queued re-materialization (no flag to clear)'
                ELSE 'cleared chaos flag ''' || cleared_flag || ''' and queued re-materialization' END AS description
    FROM (SELECT *, CASE WHEN flag IN (SELECT flag FROM flags)
                          AND row_number() OVER (PARTITION BY flag ORDER BY created_at DESC, incident_id) = 1
                     THEN flag END AS cleared_flag
          FROM guards WHERE retry_ok)
    """,
    "guards",
    "flags",
)
sql(
    "retry_guard_strict",
    """
    SELECT incident_id, retry_ok AS loose,
           retry_ok AND (error_type IN ('HTTPStatusError', 'TimeoutException', 'ChaosTriggered')
                         OR regexp_matches(lower(error_message || ' ' || error_type),
                                           'tlc_5xx|tlc_yellow|weather_429|weather_nyc_daily')) AS strict
    FROM guards
    """,
    "guards",
)
sql(
    "plan_slip",
    """
    SELECT incident_id, CASE WHEN slipped IS NOT NULL THEN true END AS success,
           'slipped partition ' || partition_key || ' -> ' || slipped AS description,
           CASE WHEN slipped IS NULL THEN 'unparseable partition_key: ''' || partition_key || '''' END AS action_error,
           slipped AS next_partition, CASE WHEN slipped IS NOT NULL THEN partition_key END AS slipped_from
    FROM guards WHERE slip_ok
    """,
    "guards",
)
sql(
    "plan_coerce",
    """
    SELECT incident_id, target IS NOT NULL AS success, target AS quarantine_key,
           CASE WHEN target IS NULL THEN 'could not locate bronze parquet for asset'
                ELSE 'wrote ' || n_rows || ' coerced rows to ' || target || '; queued re-ingest' END AS description
    FROM guards WHERE coerce_ok
    """,
    "guards",
)
sql(
    "coerce_quarantine",
    """
    SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS tpep_pickup_datetime, CAST(l_linenumber AS VARCHAR) AS VendorID,
           CAST(l_quantity / 2 AS VARCHAR) AS passenger_count, CAST(l_suppkey AS VARCHAR) AS PULocationID,
           CAST(l_partkey AS VARCHAR) AS DOLocationID, CAST(l_extendedprice AS VARCHAR) AS fare_amount,
           year(l_shipdate) AS year, month(l_shipdate) AS month
    FROM lineitem
    WHERE strftime(l_shipdate, 'bronze/_quarantine/tlc/yellow/year=%Y/month=%m/')
          IN (SELECT target FROM guards WHERE coerce_ok AND target IS NOT NULL)
    """,
    "guards",
)
sql(
    "rollback_plans",
    """
    SELECT incident_id, CASE WHEN action = 'coerce-to-string' THEN 'tombstone' WHEN cleared_flag IS NOT NULL
                             THEN 'reset_flag' ELSE 'none' END AS undo,
           CASE WHEN action = 'coerce-to-string' THEN target ELSE cleared_flag END AS subject
    FROM decided WHERE action_status = 'executed'
    """,
    "decided",
)
sql(
    "rollback_quarantine",
    """
    SELECT DISTINCT target AS quarantine_key, n_rows AS bronze_rows FROM guards
    WHERE coerce_ok AND target IS NOT NULL AND NOT contains(asset_key, 'weather')
    """,
    "guards",
)
sql(
    "pending_runs",
    """
    SELECT incident_id, d.asset_key,
           CASE WHEN action = 'partition-window-slip' THEN slipped ELSE d.partition_key END AS partition_key
    FROM decided d JOIN state s USING (incident_id)
    WHERE action_status = 'executed' AND s.status = 'open'
    """,
    "decided",
    "state",
)

# --- metrics --------------------------------------------------------------------------


def _sliding(labels: str, size_s: int, slide_s: int, value: str, name: str, where: str = "true") -> str:
    """Every event spread over all windows that contain it."""
    return f"""
    SELECT {labels}, window_start, {value} AS {name}
    FROM (SELECT *, unnest(generate_series(
                        time_bucket(INTERVAL {slide_s} SECOND, ts, TIMESTAMP '1970-01-01')
                            - INTERVAL {size_s - slide_s} SECOND,
                        time_bucket(INTERVAL {slide_s} SECOND, ts, TIMESTAMP '1970-01-01'),
                        INTERVAL {slide_s} SECOND)) AS window_start
          FROM metric WHERE {where})
    GROUP BY ALL
    """


sql("metric_increase", _sliding("status", 3600, 300, "count(*)", "increase"), "metric")
sql(
    "metric_increase_day",
    _sliding("check_name", 86400, 3600, "count(*)", "increase", "result = 'fail'"),
    "metric",
)
sql("metric_rate", _sliding("asset, status", 300, 60, "round(count(*) / 300.0::DOUBLE, 8)", "rate"), "metric")
sql("metric_rate_rows", _sliding("asset", 300, 60, "round(sum(rows_) / 300.0::DOUBLE, 8)", "rate"), "metric")
sql(
    "metric_rate_checks",
    _sliding("check_name, result", 600, 60, "round(count(*) / 600.0::DOUBLE, 8)", "rate"),
    "metric",
)
sql(
    "latency_histogram",
    """
    SELECT source, bucket, le, count(*) FILTER (le IS NULL OR seconds <= le) AS cumulative
    FROM metric CROSS JOIN (
        SELECT unnest(range(10)) AS bucket, unnest([0.5, 1, 2, 5, 10, 30, 60, 120, 300, NULL]::DOUBLE[]) AS le)
    WHERE seconds IS NOT NULL GROUP BY 1, 2, 3
    """,
    "metric",
)
sql(
    "latency_p95",
    """
    SELECT source, day, round(CASE WHEN le IS NULL THEN 300.0
                                   ELSE low + (le - low) * (r - before) / (cum - before) END, 8) AS quantile
    FROM (SELECT source, CAST(ts AS DATE) AS day, low, le, 0.95::DOUBLE * count(*) AS r,
                 count(*) FILTER (le IS NULL OR seconds <= le) AS cum, count(*) FILTER (bucket > 0 AND seconds <= low) AS before
          FROM metric CROSS JOIN (
              SELECT unnest(range(10)) AS bucket, unnest([0, 0.5, 1, 2, 5, 10, 30, 60, 120, 300]::DOUBLE[]) AS low,
                     unnest([0.5, 1, 2, 5, 10, 30, 60, 120, 300, NULL]::DOUBLE[]) AS le)
          WHERE seconds IS NOT NULL GROUP BY source, day, bucket, low, le)
    WHERE cum >= r AND before < r
    """,
    "metric",
)
sql(
    "dq_pass_rate",
    """
    SELECT CAST(ts AS DATE) AS day, round(count(*) FILTER (result = 'pass') / count(*)::DOUBLE, 8) AS pass_rate
    FROM metric GROUP BY 1
    """,
    "metric",
)
sql(
    "top_failing_checks",
    """
    SELECT check_name, count(*) AS failures FROM metric WHERE result = 'fail' GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 10
    """,
    "metric",
)
sql(
    "latency_p95_5m",
    """
    SELECT source, window_start, round(CASE WHEN le IS NULL THEN 300.0
                                            ELSE low + (le - low) * (r - before) / (cum - before) END, 8) AS quantile
    FROM (SELECT source, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, low, le, 0.95::DOUBLE * count(*) AS r,
                 count(*) FILTER (le IS NULL OR seconds <= le) AS cum, count(*) FILTER (bucket > 0 AND seconds <= low) AS before
          FROM metric CROSS JOIN (
              SELECT unnest(range(10)) AS bucket, unnest([0, 0.5, 1, 2, 5, 10, 30, 60, 120, 300]::DOUBLE[]) AS low,
                     unnest([0.5, 1, 2, 5, 10, 30, 60, 120, 300, NULL]::DOUBLE[]) AS le)
          WHERE seconds IS NOT NULL GROUP BY source, window_start, bucket, low, le)
    WHERE cum >= r AND before < r
    """,
    "metric",
)
_LAST_DAY = f"""
    FROM (SELECT ts, check_name, result FROM metric
          UNION ALL SELECT (SELECT max(ts) FROM metric) + INTERVAL 1 HOUR, check_name, CASE WHEN passed THEN 'pass' ELSE 'fail' END
          FROM ({_SUMMARY}))
    WHERE ts > (SELECT max(ts) FROM metric) - INTERVAL 23 HOUR"""
sql(
    "dq_pass_rate_24h",
    f"""
    SELECT check_name, round(count(*) FILTER (result = 'pass') / count(*)::DOUBLE, 8) AS pass_rate {_LAST_DAY} GROUP BY 1
    """,
    "metric",
    "daily",
    "zones",
)
sql(
    "top_failing_24h",
    f"""
    SELECT check_name, count(*) AS failures {_LAST_DAY} AND result = 'fail' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
    """,
    "metric",
    "daily",
    "zones",
)
sql(
    "landing_totals",
    """
    SELECT asset, status, count(*) AS materializations, CAST(sum(rows_) AS BIGINT) AS rows_landed
    FROM metric GROUP BY 1, 2
    """,
    "metric",
)
sql(
    "error_log_lines",
    """
    SELECT event_id, 'worker-' || user_id AS container, event_type || ' ' || props AS line FROM events
    WHERE user_id % 2 = 0 AND (contains(event_type || props, 'error') OR contains(event_type || props, 'ERROR'))
    """,
)
_PLAN = """
    SELECT request, event_id, attempt, retryable,
           retryable AND attempt >= {last} AS exhausted,
           CASE WHEN retryable AND attempt < {last}
                THEN least(greatest(pow(2, attempt - 1), 2), {cap})::DOUBLE END AS wait_seconds
    FROM (SELECT {request} AS request, event_id, {retryable} AS retryable,
                 row_number() OVER (PARTITION BY {request} ORDER BY event_id) AS attempt FROM events)
    """
sql(
    "retry_plan",
    _PLAN.format(
        last=5, cap=30, request="user_id || '-' || strftime(ts, '%Y%m%d')", retryable="event_type <> 'purchase'"
    ),
)
sql(
    "model_retry_plan",
    _PLAN.format(last=4, cap=15, request="CAST(user_id AS VARCHAR)", retryable="event_id % 7 < 6"),
)
sql(
    "late_samples",
    """
    SELECT asset, count(*) FILTER (rows_ * 2 > 168) AS rejected, count(*) FILTER (rows_ * 2 <= 168) AS accepted
    FROM metric GROUP BY 1
    """,
    "metric",
)

# --- streaming ------------------------------------------------------------------------

sql(
    "stream_landing",
    "SELECT year(ts) AS year, month(ts) AS month, event_type, count(*) AS rows FROM events GROUP BY 1, 2, 3",
)
sql(
    "stream_incidents",
    "SELECT incident_id, asset_key, error_type, error_message, stack_trace FROM captured",
    "captured",
)
sql("stream_diagnosis", "SELECT action_status, count(*) AS n FROM decided GROUP BY 1", "decided")
sql(
    "stream_metric_windows",
    _sliding("event_type", 300, 60, "count(*)", "total").replace("FROM metric", "FROM events"),
)
sql(
    "stream_late_rows",
    """
    SELECT event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) * 2 > 168 AS rejected, count(*) AS n
    FROM events GROUP BY 1, 2
    """,
)

# --- kept tables, samples, exact quantiles ----------------------------------------------

ORACLES["vector_table"] = ORACLES["upsert_vectors"]
ORACLES["report_store"] = f"SELECT incident_id, category_hint, category, action_status FROM ({ORACLES['reports']})"
sql(
    "report_lookup",
    f"""
    SELECT incident_id, status, asset_key, category_hint, category, action_status
    FROM state JOIN (SELECT incident_id, category_hint, category, action_status FROM ({ORACLES["reports"]})) USING (incident_id)
    WHERE incident_id = (SELECT max(incident_id) FROM state)
    """,
    "state",
)
sql(
    "latency_p95_exact",
    """
    SELECT source, day, seconds AS quantile, true AS same_bucket
    FROM (SELECT source, CAST(ts AS DATE) AS day, seconds, row_number() OVER (PARTITION BY source, CAST(ts AS DATE) ORDER BY seconds) AS place,
                 count(*) OVER (PARTITION BY source, CAST(ts AS DATE)) AS n
          FROM metric WHERE seconds IS NOT NULL)
    WHERE place = greatest(ceil(n * 0.95::DOUBLE), 1)
    """,
    "metric",
)
_SAMPLES = """
    SELECT check_name, coalesce(failures, 0) AS failures, coalesce(names, []) AS names
    FROM (SELECT unnest(['tip_below_a_tenth', 'total_in_range', 'vendor_known']) AS check_name)
    LEFT JOIN (SELECT check_name, count(*) AS failures FROM failing GROUP BY 1) USING (check_name)
    LEFT JOIN (SELECT check_name, list(name ORDER BY name) AS names
               FROM (SELECT check_name, any_value(name) AS name FROM failing SEMI JOIN
                       (SELECT check_name, min(h) AS h FROM failing GROUP BY check_name, h % 3) USING (check_name, h) GROUP BY check_name, h)
               GROUP BY 1) USING (check_name)"""
CTES["failing"] = """
    SELECT c.check_name, name, ('0x' || substr(md5(name), 1, 15))::BIGINT AS h
    FROM (SELECT *, pickup_zone_id || '|' || dropoff_zone_id || '|' || vendor_id || '|' || strftime(pickup_ts, '%Y%m%d') AS name FROM trips),
         (SELECT unnest(['tip_below_a_tenth', 'total_in_range', 'vendor_known']) AS check_name) c
    WHERE CASE check_name WHEN 'tip_below_a_tenth' THEN tip_amount >= 0.1
          WHEN 'total_in_range' THEN total_amount NOT BETWEEN 20 AND 1000000 ELSE vendor_id > 1000 END"""
NEEDS["failing"] = ["trips"]
sql("dq_sample_rows", f"SELECT check_name, failures, array_to_string(names, ',') AS sample_names FROM ({_SAMPLES})", "failing")
sql(
    "incident_records",
    f"""
    SELECT incident_id, coalesce(p.upstream, '') AS upstream_lineage,
           'job_name=job' || user_id % 3 || ';partition=' || coalesce(partition_key, '') || ';run_id=' || c.run_id
               || ';selected=' || CASE WHEN user_id % 50 = 0 THEN 0 ELSE n_assets END || ';user=' || user_id AS metadata,
           CASE WHEN c.asset_key = 'stg_tlc_yellow'
                THEN (SELECT array_to_string(list_sort(flatten(list(names))), ',') FROM ({_SAMPLES})) ELSE '' END AS sample_names
    FROM captured c JOIN (SELECT run_id, count(DISTINCT asset_key) AS n_assets FROM log GROUP BY 1) USING (run_id)
    LEFT JOIN parents p ON p.name = regexp_extract(c.asset_key, '[^/.]+$')
    """,
    "captured",
    "parents",
    "failing",
)
sql(
    "incident_index",
    """
    WITH words AS (
      SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS w FROM documents
    ), counted AS (
      SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS d, count(*) AS n FROM words GROUP BY ALL
    ), scaled AS (
      SELECT doc_id, d, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS v FROM counted
    )
    SELECT doc_id, 384::BIGINT AS dims, round(sqrt(sum(v * v)), 3) AS length, round(sum(v * (d + 1)), 3) AS weight FROM scaled GROUP BY doc_id
    """,
)
