"""DuckDB SQL equal in result to each registered query (same column names)."""

from __future__ import annotations

EVENT_COLS = "event_id, ts, user_id, event_type, value, props"
ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

LATEST_EVENT = """
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id
                                   ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1"""

LATEST_ORDER = """
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey
                                   ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
      FROM orders) WHERE rn = 1"""

# Decoded fields of the damaged records: none, or all but the user.
DAMAGED_FIELDS = """
               CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE event_id END AS event_id,
               CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE ts END AS ts,
               CASE WHEN event_id % 10 IN (0, 1, 2, 3) THEN NULL ELSE user_id END AS user_id,
               CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE event_type END AS event_type,
               CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE value END AS value,
               CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE props END AS props,
               CASE WHEN event_id % 10 = 2 THEN 'null value'
                    WHEN event_id % 10 IN (0, 1) THEN 'malformed' END AS _bad_reason,
               CASE event_id % 10
                    WHEN 0 THEN left({record}, length({record}) // 2)
                    WHEN 1 THEN {wrong} END
                 AS _corrupt_record"""


def _record(value: str) -> str:
    """An event as a JSON record."""
    return f"""('{{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","user_id":' || user_id
               || ',"event_type":' || to_json(event_type) || ',"value":' || {value} || ',"props":' || to_json(props) || '}}')"""


DAMAGED_FIELDS = DAMAGED_FIELDS.format(record=_record("value"), wrong=_record("'\"not a number\"'"))

ORACLES: dict[str, str] = {
    "topic_decode": f"SELECT {EVENT_COLS} FROM events",
    "topic_decode_bad_rows": f"""
        SELECT '{{"event_id":' || event_id || '}}' AS key, {DAMAGED_FIELDS},
               event_id % 10 IN (0, 1, 2) AS _is_bad
        FROM events""",
    "archive_bad_rows": f"""
        SELECT '{{"event_id":' || event_id || '}}' AS key, {DAMAGED_FIELDS} FROM events""",
    "json_files_failfast": f"SELECT {EVENT_COLS} FROM events",
    "json_files_stream": f"SELECT {EVENT_COLS} FROM events",
    "stream_identity": f"SELECT {EVENT_COLS} FROM events",
    "archive_replay": """
        SELECT event_type,
               CAST(SUM(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total_value,
               count(*) AS n_events
        FROM events GROUP BY event_type""",
    "archive_folded_replay": """
        SELECT phase, event_type,
               CAST(SUM(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total_value,
               count(*) AS n_events
        FROM events, (SELECT unnest(['before', 'during', 'after']) AS phase) GROUP BY phase, event_type""",
    "archive_ordered_windows": """
        SELECT date_trunc('day', ts) AS window_start,
               date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
               user_id, count(*) AS n_events
        FROM events GROUP BY ALL""",
    "dual_fanout": f"""
        SELECT 'topic' AS sink, {EVENT_COLS} FROM events
        UNION ALL SELECT 'changelog', {EVENT_COLS} FROM events
        UNION ALL SELECT 'latest', {EVENT_COLS} FROM ({LATEST_EVENT})""",
    "dual_fanout_outbox": f"""
        SELECT 'topic' AS sink, {EVENT_COLS} FROM events
        UNION ALL SELECT 'table', {EVENT_COLS} FROM events""",
    "topic_encode": f"""
        SELECT 'events_latest_v1' AS topic, '{{"user_id":' || user_id || '}}' AS key, {EVENT_COLS}
        FROM ({LATEST_EVENT})""",
    "feature_latest": f"SELECT {EVENT_COLS} FROM ({LATEST_EVENT})",
    "feature_latest_compacted": f"SELECT {EVENT_COLS} FROM ({LATEST_EVENT})",
    "feature_latest_composite": f"""
        SELECT {EVENT_COLS} FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, event_type
                                       ORDER BY ts DESC, event_id DESC) AS rn
          FROM events) WHERE rn = 1""",
    "feature_scan": f"SELECT {ORDER_COLS} FROM ({LATEST_ORDER})",
    "feature_lookup": f"""
        SELECT l.o_orderkey, c.c_custkey AS o_custkey, l.o_orderstatus, l.o_totalprice,
               l.o_orderdate, l.o_orderpriority
        FROM customer c LEFT JOIN ({LATEST_ORDER}) l ON l.o_custkey = c.c_custkey
        WHERE c.c_mktsegment = 'BUILDING'""",
    "feature_lookup_compacted": f"""
        SELECT l.o_orderkey, c.c_custkey AS o_custkey, l.o_orderstatus, l.o_totalprice,
               l.o_orderdate, l.o_orderpriority
        FROM customer c LEFT JOIN ({LATEST_ORDER}) l ON l.o_custkey = c.c_custkey
        WHERE c.c_nationkey = 7""",
    "feature_lookup_missing": f"""
        WITH k AS (SELECT c_custkey AS k FROM customer
                   UNION ALL SELECT -c_custkey - 1 FROM customer)
        SELECT l.o_orderkey, k.k AS o_custkey, l.o_orderstatus, l.o_totalprice,
               l.o_orderdate, l.o_orderpriority
        FROM k LEFT JOIN ({LATEST_ORDER}) l ON l.o_custkey = k.k""",
    "feature_lookup_list": f"""
        WITH k AS (SELECT c_custkey AS k FROM customer
                   WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 3
                   ORDER BY c_custkey LIMIT 1000)
        SELECT l.o_orderkey, k.k AS o_custkey, l.o_orderstatus, l.o_totalprice,
               l.o_orderdate, l.o_orderpriority
        FROM (SELECT k FROM k UNION ALL SELECT -1) k LEFT JOIN ({LATEST_ORDER}) l ON l.o_custkey = k.k""",
    "feature_last_write": """
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN event_type = 'purchase' THEN -value ELSE value END AS value, props
        FROM events""",
    "rolling_count": """
        SELECT event_id, user_id, ts,
               count(*) OVER (PARTITION BY user_id ORDER BY ts
                              RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)
                 AS n_events_7d
        FROM events""",
    "rolling_count_stream": """
        SELECT event_id, user_id, ts,
               count(*) OVER (PARTITION BY user_id ORDER BY ts
                              RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)
                 AS n_events_7d
        FROM events""",
    "late_rows_stream": """
        WITH m AS (SELECT max(ts) AS newest, date_trunc('day', max(ts)) - INTERVAL 9 DAYS AS first_day FROM events)
        SELECT date_trunc('day', ts) AS window_start, user_id,
               count(*) FILTER (ts >= first_day) AS n_counted,
               count(*) FILTER (ts < first_day AND date_trunc('day', ts) + INTERVAL 1 DAY
                                <= date_trunc('millisecond', newest) - INTERVAL 1 DAY) AS n_late
        FROM events, m GROUP BY ALL""",
    "windowed_count_stream": """
        SELECT date_trunc('day', ts) AS window_start,
               date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
               user_id, count(*) AS n_events
        FROM events GROUP BY ALL""",
    "multi_input_union": f"""
        SELECT {EVENT_COLS},
               CASE WHEN event_type IN ('click', 'view') THEN 'interactions'
                    ELSE 'others' END AS source
        FROM events""",
    "multi_input_join": """
        SELECT s.user_id, s.event_id AS signup_id, s.ts AS signup_ts,
               p.event_id AS purchase_id, p.ts AS purchase_ts
        FROM events s JOIN events p
          ON s.user_id = p.user_id AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 1 DAY
        WHERE s.event_type = 'signup' AND p.event_type = 'purchase'""",
    "registry_assign": """
        SELECT 'acme' AS org, CAST(o_custkey AS VARCHAR) AS app, o_orderkey AS request_id,
               CAST(row_number() OVER (PARTITION BY o_custkey
                                       ORDER BY o_orderdate, o_orderkey) AS INTEGER)
                 AS code_version,
               '[{"name": "o_orderkey", "type": "long"}, {"name": "o_orderstatus", '
                 || '"type": "string"}, {"name": "priority_' || substr(o_orderpriority, 1, 1)
                 || '", "type": "string"}]' AS avro_schema
        FROM orders""",
    "registry_current": """
        WITH k AS (SELECT c_custkey AS k FROM customer
                   UNION ALL SELECT -c_custkey - 1 FROM customer),
             v AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
        SELECT 'acme' AS org, CAST(k.k AS VARCHAR) AS app,
               CAST(coalesce(v.n, 0) AS INTEGER) AS code_version
        FROM k LEFT JOIN v ON v.o_custkey = k.k""",
    "job_status_project": """
        SELECT 'app_' || o_custkey AS job_name, 'spark_' || o_orderkey AS spark_name,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING'
                                  WHEN 'P' THEN 'SUBMITTED' END AS state,
               o_orderkey AS id,
               strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS start_time,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS container_start_time,
               CASE WHEN o_orderstatus = 'F'
                    THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') END
                 AS stop_time,
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS execution_attempts,
               CAST(1 AS BIGINT) AS submission_attempts
        FROM orders""",
    "assertion_report": """
        WITH kept AS (SELECT * FROM customer WHERE c_acctbal >= 0),
             actual AS (
               SELECT c_custkey,
                      CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN lower(c_name)
                           ELSE c_name END AS c_name,
                      c_nationkey, c_acctbal, c_mktsegment FROM kept
               UNION ALL SELECT * FROM kept WHERE c_mktsegment = 'MACHINERY'),
             tagged AS (SELECT *, 1 AS d, TRUE AS exact FROM customer
                        UNION ALL SELECT *, -1 AS d, c_mktsegment <> 'FURNITURE' FROM actual)
        SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
               CASE WHEN sum(d) > 0 THEN 'missing' ELSE 'extra' END AS side,
               CAST(abs(sum(d)) AS BIGINT) AS n_rows
        FROM tagged GROUP BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, exact
        HAVING sum(d) <> 0""",
    "assertion_report_tolerance": """
        SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment, side, 1::BIGINT AS n_rows, differs
        FROM (
          SELECT *, 'missing' AS side, 'c_acctbal' AS differs FROM customer WHERE c_mktsegment = 'AUTOMOBILE' AND c_nationkey IS DISTINCT FROM 3
          UNION ALL
          SELECT * REPLACE (c_acctbal + 0.25 AS c_acctbal), 'extra', CASE WHEN c_nationkey IS DISTINCT FROM 3 THEN 'c_acctbal' END
          FROM customer WHERE c_mktsegment = 'AUTOMOBILE'
          UNION ALL
          SELECT *, 'extra', NULL FROM customer WHERE c_nationkey = 3 AND c_mktsegment <> 'AUTOMOBILE')""",
}
