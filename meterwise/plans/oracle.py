"""The registered queries as plain SQL over the given tables, for checking results in another engine.

Credits are handled as whole ten-thousandths (``_u``), so that every comparison and rounding below is exact.
"""

from __future__ import annotations

from meterwise.functions import compliance_texts as C
from meterwise.functions import wording as W

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
FIRST_RUN_END = "TIMESTAMP '2024-01-16 00:00:00'"
MID_MONTH = "TIMESTAMP '2024-01-17 12:00:00'"


def num(value: str) -> str:
    return f"CAST(ROUND({value}, 9) AS DOUBLE)"


def big(value: str) -> str:
    return f"CAST({value} AS BIGINT)"


def ts(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def minute(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M')"


def dec(units: str, digits: int, scale: int | None = None) -> str:
    """A whole number of 10^-digits as a decimal of the given scale."""
    unit = "0." + "0" * (digits - 1) + "1"
    return f"CAST(CAST({units} AS BIGINT) * {unit} AS DECIMAL(18,{digits if scale is None else scale}))"


def half_up(numerator: str, denominator: str) -> str:
    """numerator / denominator, both positive whole numbers, rounded half up to a whole number."""
    return f"((2 * ({numerator}) + ({denominator})) // (2 * ({denominator})))"


def fill(template: str, **values: str) -> str:
    """The SQL concatenation that fills a text template."""
    from string import Formatter

    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append("'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        if field:
            parts.append(f"({values[field]})")
    return " || ".join(parts)


def select(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- derived tables -------------------------------------------------------------------------------------------


def wh(bucket: str) -> str:
    return f"(CASE WHEN {bucket} % 4 = 3 THEN 'ETL_WH_' ELSE 'WH_' END || lpad(CAST({bucket} AS VARCHAR), 9, '0'))"


USAGE = f"""usage AS (
  SELECT event_id, user_id, event_type, ts, user_id AS bucket, {wh('user_id')} AS warehouse_name,
         {big('round(value * 100)')} AS cents
  FROM events)"""

METERING = f"""metering AS (
  SELECT warehouse_name, bucket AS warehouse_id, date_trunc('hour', ts) AS start_time,
         date_trunc('hour', ts) + INTERVAL 1 HOUR AS end_time,
         {big('sum(cents)')} AS used_u,
         {big("coalesce(sum(cents) FILTER (WHERE event_type <> 'error'), 0)")} AS compute_u,
         {big("coalesce(sum(cents) FILTER (WHERE event_type = 'error'), 0)")} AS cloud_u
  FROM usage GROUP BY ALL)"""

BASELINE = """baseline AS (
  SELECT *, CAST(sum(used_u) OVER w AS BIGINT) AS s, count(*) OVER w AS n
  FROM metering
  WINDOW w AS (PARTITION BY warehouse_name ORDER BY start_time ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""

WAREHOUSES = f"""warehouses AS (
  SELECT {wh('c_custkey')} AS name,
         CASE WHEN c_custkey % 3 = 0 THEN 'SUSPENDED' ELSE 'STARTED' END AS state,
         ['X-Small', 'Small', 'Medium', 'Large', 'X-Large'][c_nationkey % 5 + 1] AS size,
         CASE WHEN c_custkey % 7 <> 3 THEN c_custkey % 25 * 60 END AS auto_suspend,
         CASE WHEN c_custkey % 4 <> 0 THEN 'true' ELSE 'false' END AS auto_resume,
         c_custkey % 2 AS running, c_custkey % 5 AS queued
  FROM customer)"""

QUERIES = f"""query_history AS (
  SELECT event_id AS query_id, warehouse_name, 'USER_' || user_id AS user_name, 'ROLE_' || (user_id % 5) AS role_name,
         ts AS start_time, cents AS cloud_u
  FROM usage)"""

# --- detection ------------------------------------------------------------------------------------------------

_idle_words = dict(
    warehouse="warehouse_name",
    start=minute("start_time"),
    end=minute("end_time"),
    credits=f"CAST({dec('cloud_u', 4, 6)} AS VARCHAR)",
)
IDLE_SEVERITY = "CASE WHEN cloud_u > 10000 THEN 'HIGH' WHEN cloud_u > 1000 THEN 'MEDIUM' ELSE 'LOW' END"
IDLE = f"""idle AS (
  SELECT warehouse_name, end_time AS detected_at, start_time AS anomaly_start, end_time AS anomaly_end,
         'IDLE_COMPUTE' AS anomaly_type, {IDLE_SEVERITY} AS severity, {dec('cloud_u', 4, 9)} AS credits_wasted,
         {fill(W.IDLE_DESCRIPTION, **_idle_words)} AS description,
         {fill(W.IDLE_SUGGESTION, **_idle_words)} AS suggested_fix
  FROM metering WHERE compute_u = 0 AND cloud_u > 0)"""

SPIKE_SEVERITY = "CASE WHEN used_u * n > 8 * s THEN 'CRITICAL' WHEN used_u * n > 4 * s THEN 'HIGH' ELSE 'MEDIUM' END"
SPIKE = f"""spike AS (
  SELECT warehouse_name, end_time AS detected_at, start_time AS anomaly_start, end_time AS anomaly_end,
         'COST_SPIKE' AS anomaly_type, {SPIKE_SEVERITY} AS severity,
         {dec(half_up('(used_u * n - s) * 100000', 'n'), 9)} AS credits_wasted,
         {fill(
             W.SPIKE_DESCRIPTION,
             warehouse='warehouse_name',
             start=minute('start_time'),
             used=f"CAST({dec(half_up('used_u', '10'), 3)} AS VARCHAR)",
             average=f"CAST({dec(half_up('s', '10 * n'), 3)} AS VARCHAR)",
             ratio=f"CAST({dec(half_up('10 * used_u * n', 's'), 1)} AS VARCHAR)",
         )} AS description,
         {fill(
             W.SPIKE_SUGGESTION,
             warehouse='warehouse_name',
             start="strftime(start_time, '%H:%M')",
             end="strftime(end_time, '%H:%M')",
         )} AS suggested_fix
  FROM baseline WHERE n >= 2 AND s > 0 AND 10 * used_u * n >= 25 * s)"""

FOUND = "found AS (SELECT * FROM idle UNION ALL SELECT * FROM spike)"


def numbered(source: str) -> str:
    seconds = big(f"epoch({source}.anomaly_start)")
    return f"""row_number() OVER (ORDER BY {seconds} // 86400,
           substr(md5(warehouse_name || '|' || CAST({seconds} AS VARCHAR)), 1, 2),
           warehouse_name, anomaly_start, anomaly_type)"""


DETECTED = f"detected AS (SELECT {numbered('found')} AS anomaly_id, *, 'OPEN' AS status FROM found)"
DETECTION = [USAGE, METERING, BASELINE, IDLE, SPIKE, FOUND, DETECTED]

# --- remediation ----------------------------------------------------------------------------------------------

FIXED = """anomalies AS (
  SELECT * EXCLUDE (status),
         CASE WHEN severity IN ('LOW', 'MEDIUM') THEN 'RESOLVED' ELSE 'ACKNOWLEDGED' END AS status,
         CASE WHEN severity IN ('LOW', 'MEDIUM') THEN detected_at END AS resolved_at,
         CASE WHEN severity IN ('LOW', 'MEDIUM') THEN 'FINOPS_AGENT (auto)' END AS resolved_by
  FROM detected)"""


def rounded_text(column: str, digits: int) -> str:
    return f"CAST(CAST(ROUND({column}, {digits}) AS DECIMAL(18,{digits})) AS VARCHAR)"


def by_type(idle: str, spike: str) -> str:
    return f"CASE WHEN anomaly_type = 'IDLE_COMPUTE' THEN {idle} ELSE {spike} END"


FIXES = f"""fixes AS (
  SELECT anomaly_id, detected_at, warehouse_name, anomaly_type, severity, credits_wasted,
         {by_type(fill(W.IDLE_FIX, warehouse='warehouse_name'), fill(W.SPIKE_FIX, warehouse='warehouse_name'))}
           AS sql_executed,
         {by_type(
             fill(W.IDLE_FIX_DETAILS, warehouse='warehouse_name', credits=rounded_text('credits_wasted', 4)),
             fill(W.SPIKE_FIX_DETAILS, warehouse='warehouse_name', credits=rounded_text('credits_wasted', 2)),
         )} AS action_details,
         CASE WHEN severity IN ('LOW', 'MEDIUM') THEN 'COMPLETED' ELSE 'PENDING_APPROVAL' END AS fix_status
  FROM detected)"""

FIX_AUDIT = """fix_audit AS (
  SELECT 2 + row_number() OVER (ORDER BY anomaly_id) AS log_id, detected_at AS logged_at,
         CASE WHEN fix_status = 'COMPLETED' THEN 'AUTO_ACTION' ELSE 'RECOMMENDATION' END AS action_type,
         anomaly_id, warehouse_name, action_details, sql_executed,
         CASE WHEN fix_status = 'COMPLETED' THEN 'FINOPS_AGENT' END AS approved_by, fix_status AS status
  FROM fixes)"""

SCANS = f"""scans AS (
  SELECT 1 AS log_id, {AS_OF} AS logged_at, 'DETECTION' AS action_type, NULL::BIGINT AS anomaly_id,
         NULL::VARCHAR AS warehouse_name, {fill(W.IDLE_FULL_SCAN_AUDIT, rows='count(*)')} AS action_details,
         NULL::VARCHAR AS sql_executed, NULL::VARCHAR AS approved_by, 'COMPLETED' AS status
  FROM detected WHERE anomaly_type = 'IDLE_COMPUTE'
  UNION ALL
  SELECT 2, {AS_OF}, 'DETECTION', NULL, NULL, {fill(W.SPIKE_SCAN_AUDIT, rows='count(*)', parameter="'2.5'")},
         NULL, NULL, 'COMPLETED'
  FROM detected WHERE anomaly_type = 'COST_SPIKE')"""

AUDIT = "audit_log AS (SELECT * FROM scans UNION ALL SELECT * FROM fix_audit)"
STATE = [*DETECTION, FIXED, FIXES, FIX_AUDIT, SCANS, AUDIT]

PENDING = "pending AS (SELECT anomaly_id FROM audit_log WHERE status = 'PENDING_APPROVAL')"
APPROVED = [
    PENDING,
    "approved AS (SELECT anomaly_id FROM pending WHERE anomaly_id % 2 = 0)",
    f"""anomalies2 AS (
  SELECT a.* EXCLUDE (status, resolved_at, resolved_by),
         CASE WHEN p.anomaly_id IS NOT NULL THEN 'RESOLVED' ELSE a.status END AS status,
         CASE WHEN p.anomaly_id IS NOT NULL THEN {AS_OF} ELSE a.resolved_at END AS resolved_at,
         CASE WHEN p.anomaly_id IS NOT NULL THEN 'alice' ELSE a.resolved_by END AS resolved_by
  FROM anomalies a LEFT JOIN approved p USING (anomaly_id))""",
    f"""audit_log2 AS (
  SELECT l.* EXCLUDE (approved_by, status),
         CASE WHEN p.anomaly_id IS NOT NULL AND l.status = 'PENDING_APPROVAL' THEN 'alice' ELSE l.approved_by END
           AS approved_by,
         CASE WHEN p.anomaly_id IS NOT NULL AND l.status = 'PENDING_APPROVAL' THEN 'COMPLETED' ELSE l.status END
           AS status
  FROM audit_log l LEFT JOIN approved p ON p.anomaly_id = l.anomaly_id
  UNION ALL BY NAME
  SELECT (SELECT max(log_id) FROM audit_log) + row_number() OVER (ORDER BY anomaly_id) AS log_id,
         {AS_OF} AS logged_at, 'USER_ACTION' AS action_type, anomaly_id, NULL::VARCHAR AS warehouse_name,
         {fill(W.APPROVAL_DETAILS, anomaly='anomaly_id', approver="'alice'")} AS action_details,
         NULL::VARCHAR AS sql_executed, 'alice' AS approved_by, 'COMPLETED' AS status
  FROM approved)""",
]
AFTER = [*STATE, *APPROVED]

DISMISSED = [
    PENDING,
    "dismissed AS (SELECT anomaly_id FROM pending WHERE anomaly_id % 10 = 1)",
]

# --- shared output lists --------------------------------------------------------------------------------------

FOUND_COLUMNS = f"""warehouse_name, {ts(AS_OF)} AS detected_at, {ts('anomaly_start')} AS anomaly_start,
       {ts('anomaly_end')} AS anomaly_end, anomaly_type, severity, {num('credits_wasted')} AS credits_wasted,
       description, suggested_fix, 'OPEN' AS status, NULL::VARCHAR AS resolved_at, NULL::VARCHAR AS resolved_by"""
AUDIT_COLUMNS = f"""{big('log_id')} AS log_id, {ts('logged_at')} AS logged_at, action_type, anomaly_id, warehouse_name,
       action_details, sql_executed, approved_by, status"""
DECISION_COLUMNS = f"""anomaly_id, warehouse_name, severity, status, {ts('resolved_at')} AS resolved_at, resolved_by"""
SEVERITY_BODY = f"""SELECT warehouse_name, severity, count(*) AS anomaly_count, {num('sum(credits_wasted)')} AS credits
FROM {{source}} GROUP BY ALL"""
# Idle hours of some warehouses come once more, with half a credit more.
WITH_REVISED = """received AS (
  SELECT * FROM metering UNION ALL
  SELECT * REPLACE (used_u + 5000 AS used_u, cloud_u + 5000 AS cloud_u) FROM metering
  WHERE compute_u = 0 AND cloud_u > 0 AND warehouse_id % 5 = 0)"""
JUDGED_COLUMNS = f"""warehouse_name, {ts('anomaly_start')} AS anomaly_start, anomaly_type, severity,
       {num('credits_wasted')} AS credits_wasted, description"""
STREAM_COLUMNS = f"""anomaly_id, warehouse_name, {ts('anomaly_start')} AS anomaly_start, anomaly_type, severity,
       {num('credits_wasted')} AS credits_wasted, status"""

SAVED = "coalesce(sum(credits_wasted) FILTER (WHERE status = 'RESOLVED'), 0)"

DAILY_SAVINGS = f"""savings AS (
  SELECT day, CAST(ROUND(sum(credits) OVER (ORDER BY day) * 3.00, 2) AS DECIMAL(18,2)) AS saved
  FROM (SELECT CAST(resolved_at AS DATE) AS day, sum(credits_wasted) AS credits
        FROM anomalies WHERE status = 'RESOLVED' GROUP BY ALL))"""
SAVINGS_COLUMNS = "strftime(day, '%Y-%m-%d') AS snapshot_date, CAST(saved AS DOUBLE) AS dollar_saved"

RECENT = f"""recent AS (
  SELECT warehouse_name, count(*) AS anomaly_count
  FROM anomalies WHERE detected_at >= {AS_OF} - INTERVAL 7 DAY AND detected_at <= {AS_OF} GROUP BY ALL)"""

BAND = "CASE WHEN score >= 80 THEN 'Healthy' WHEN score >= 50 THEN 'Needs Attention' ELSE 'Critical' END"

DOLLARS = f"{num('ROUND(credits_wasted * 3.00, 2)')} AS dollar_saved"

WAITING = """waiting AS (
  SELECT a.anomaly_id, a.warehouse_name, a.anomaly_type, a.severity, a.credits_wasted, a.description,
         l.sql_executed AS proposed_fix, l.action_details
  FROM anomalies a JOIN audit_log l ON l.anomaly_id = a.anomaly_id
  WHERE a.status = 'ACKNOWLEDGED' AND l.status = 'PENDING_APPROVAL')"""

DRILLDOWN = """drilldown AS (
  SELECT a.anomaly_id, a.warehouse_name, a.anomaly_start, a.anomaly_end, q.query_id, q.user_name, q.role_name,
         q.start_time, q.cloud_u
  FROM anomalies a JOIN query_history q
    ON q.warehouse_name = a.warehouse_name AND q.start_time >= a.anomaly_start AND q.start_time < a.anomaly_end
  WHERE a.anomaly_type = 'COST_SPIKE')"""

# --- alerts ---------------------------------------------------------------------------------------------------

RULES = f"""rules AS (
  SELECT alert_id, metric, threshold, warehouse, condition,
         'Notify me if ' || CASE WHEN warehouse = 'ANY' THEN 'any warehouse' ELSE warehouse END || ' has ' ||
         CASE metric WHEN 'daily_spend' THEN 'spend in dollars per day' WHEN 'weekly_spend' THEN
           'spend in dollars per week' WHEN 'credits_per_hour' THEN 'credits per hour' WHEN 'idle_minutes' THEN
           'idle minutes per day' ELSE 'queries per day' END ||
         ' ' || replace(condition, '_', ' ') || ' ' || threshold_text AS rule, threshold_text
  FROM (
    SELECT *, CAST(units / 100 AS DOUBLE) AS threshold, CAST({dec('units', 2)} AS VARCHAR) AS threshold_text
    FROM (
      SELECT s_suppkey AS alert_id,
        ['daily_spend', 'weekly_spend', 'credits_per_hour', 'idle_minutes', 'query_count'][s_suppkey % 5 + 1] AS metric,
        CASE WHEN s_suppkey % 5 = 4 THEN 100 * ({big('abs(round(s_acctbal * 100))')} % 20)
             ELSE {big('abs(round(s_acctbal * 100))')} % 40000 END AS units,
        CASE WHEN s_suppkey % 7 = 0 THEN 'ANY' ELSE {wh('s_nationkey')} END AS warehouse,
        ['greater_than', 'less_than', 'equals'][(s_suppkey // 5) % 3 + 1] AS condition
      FROM supplier)))"""

# What a reader of each answer's shape understands: shape 4 names no usable number, 5 is no JSON, 6 has none.
PARSED = """parsed AS (
  SELECT alert_id, rule, shape NOT IN (4, 5, 6) AS is_valid,
         CASE WHEN shape IN (4, 5, 6) THEN NULL WHEN shape = 7 THEN 'daily_spend' ELSE metric END AS parsed_metric,
         CASE WHEN shape IN (4, 5, 6) THEN NULL WHEN shape = 7 THEN 0.0::DOUBLE ELSE threshold END AS parsed_threshold,
         CASE WHEN shape IN (4, 5, 6) THEN NULL WHEN shape IN (2, 7) THEN 'ANY' ELSE warehouse END AS parsed_warehouse,
         CASE WHEN shape IN (4, 5, 6) THEN NULL WHEN shape IN (2, 3, 7) THEN 'greater_than' ELSE condition END
           AS parsed_condition
  FROM (SELECT *, alert_id % 8 AS shape FROM rules))"""
SYMBOL = "CASE parsed_condition WHEN 'greater_than' THEN '>' WHEN 'less_than' THEN '<' WHEN 'equals' THEN '=' END"

ALERTS = f"""alerts AS (
  SELECT row_number() OVER (ORDER BY alert_id) AS alert_id, rule AS natural_language_rule, parsed_metric,
         parsed_threshold, parsed_warehouse, parsed_condition, true AS is_active, {AS_OF} AS created_at
  FROM parsed WHERE is_valid)"""

METRICS = """metrics AS (
  SELECT 'daily_spend' AS metric, warehouse_name, date_trunc('day', start_time)::TIMESTAMP AS period_start,
         CAST(sum(used_u) AS BIGINT) * 0.0003 AS value
  FROM metering GROUP BY ALL
  UNION ALL
  SELECT 'weekly_spend', warehouse_name, date_trunc('week', start_time)::TIMESTAMP, CAST(sum(used_u) AS BIGINT) * 0.0003
  FROM metering GROUP BY ALL
  UNION ALL
  SELECT 'credits_per_hour', warehouse_name, start_time, used_u * 0.0001 FROM metering
  UNION ALL
  SELECT 'idle_minutes', warehouse_name, date_trunc('day', start_time)::TIMESTAMP,
         60 * count(*) FILTER (WHERE compute_u = 0 AND cloud_u > 0)
  FROM metering GROUP BY ALL
  UNION ALL
  SELECT 'query_count', warehouse_name, date_trunc('day', start_time)::TIMESTAMP, count(*)
  FROM query_history GROUP BY ALL)"""

TRIGGERS = """triggers AS (
  SELECT r.alert_id, m.metric, m.warehouse_name, m.period_start, m.value, r.parsed_condition, r.parsed_threshold
  FROM metrics m JOIN alerts r ON r.parsed_metric = m.metric
   AND (r.parsed_warehouse = 'ANY' OR r.parsed_warehouse = m.warehouse_name)
  WHERE m.period_start + CASE m.metric WHEN 'weekly_spend' THEN INTERVAL 7 DAY WHEN 'credits_per_hour' THEN INTERVAL 1 HOUR
          ELSE INTERVAL 1 DAY END <= TIMESTAMP '2024-01-31 00:00:00'
    AND CASE r.parsed_condition WHEN 'greater_than' THEN CAST(m.value AS DOUBLE) > r.parsed_threshold
             WHEN 'less_than' THEN CAST(m.value AS DOUBLE) < r.parsed_threshold
             ELSE CAST(m.value AS DOUBLE) = r.parsed_threshold END)"""
EVALUATION = [USAGE, METERING, QUERIES, RULES, PARSED, ALERTS, METRICS, TRIGGERS]
COUNTS = """counts AS (
  SELECT a.*, (SELECT count(*) FROM triggers t WHERE t.alert_id = a.alert_id) AS trigger_count FROM alerts a)"""

# --- context table --------------------------------------------------------------------------------------------

_CONTEXT = ("warehouse_name", "anomaly_type", "severity", "credits_wasted", "status")
CONTEXT = f"""newest AS (
  SELECT anomaly_id, detected_at, {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _CONTEXT)},
         CASE WHEN status = 'RESOLVED' THEN credits_wasted END AS saved
  FROM anomalies ORDER BY detected_at DESC, anomaly_id DESC LIMIT 15),
widths AS (SELECT {", ".join(f"greatest({len(c)}, max(length({c}))) AS {c}" for c in _CONTEXT)} FROM newest),
context AS (
  SELECT count(*) AS row_count, coalesce(sum(saved), 0) AS credits_saved,
         any_value({" || ' ' || ".join(f"lpad('{c.upper()}', CAST(w.{c} AS INT), ' ')" for c in _CONTEXT)}) || chr(10) ||
         string_agg({" || ' ' || ".join(f"lpad(n.{c}, CAST(w.{c} AS INT), ' ')" for c in _CONTEXT)}, chr(10)
                    ORDER BY n.detected_at DESC, n.anomaly_id DESC) AS "table"
  FROM newest n CROSS JOIN widths w)"""

# --- notifications --------------------------------------------------------------------------------------------

_KIND = """CASE WHEN l.status = 'PENDING_APPROVAL' THEN 'APPROVAL_NEEDED' WHEN l.action_type = 'USER_ACTION'
       THEN 'APPROVED' WHEN l.action_type = 'AUTO_ACTION' AND a.anomaly_type = 'COST_SPIKE' THEN 'WARNING'
       ELSE 'INFO' END"""
NOTICES = f"""notices AS (
  SELECT *, CASE notification_type {" ".join(
      f"WHEN '{kind}' THEN {fill(text, warehouse='warehouse_name')}" for kind, text in W.NOTICE_TITLES.items()
  )} END AS title, notification_id % 3 = 0 AS is_read
  FROM (
    SELECT row_number() OVER (ORDER BY l.log_id) AS notification_id, l.logged_at AS created_at,
           {_KIND} AS notification_type, l.action_details AS message, a.warehouse_name
    FROM audit_log2 l JOIN anomalies2 a ON a.anomaly_id = l.anomaly_id
    WHERE l.action_type <> 'DETECTION'))"""
NOTIFICATIONS = [*AFTER, NOTICES]

MINUTES = f"date_diff('second', created_at, {AS_OF}) // 60"
AGE = f"""CASE WHEN {MINUTES} < 60 THEN ({MINUTES}) || 'm ago' WHEN {MINUTES} < 1440 THEN ({MINUTES} // 60) || 'h ago'
       ELSE ({MINUTES} // 1440) || 'd ago' END"""
BADGE = """CASE notification_type WHEN 'APPROVAL_NEEDED' THEN 'High' WHEN 'APPROVED' THEN 'Success'
       WHEN 'WARNING' THEN 'Warning' ELSE 'Info' END"""


def feed(where: str = "true") -> str:
    return f"""feed AS (SELECT * FROM notices WHERE {where}
  ORDER BY created_at DESC, notification_id DESC LIMIT 30)"""


FEED_BODY = f"""SELECT notification_id, {ts('created_at')} AS created_at, notification_type, title, message,
       warehouse_name, is_read, {BADGE} AS badge, {AGE} AS age
FROM feed"""

# --- compliance -----------------------------------------------------------------------------------------------

FINDINGS = f"""findings AS (
  SELECT name AS warehouse_name, '{C.SUSPEND_CHECK}' AS check_name, 'FAIL' AS status,
         CASE WHEN coalesce(auto_suspend, 0) > 600 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         coalesce(auto_suspend, 0) || 's' AS current_value, '{C.SUSPEND_ADVICE}' AS recommended,
         {fill(W.IDLE_FIX, warehouse='name')} AS fix
  FROM warehouses WHERE coalesce(auto_suspend, 0) > 300
  UNION ALL
  SELECT name, '{C.RESUME_CHECK}', 'FAIL', 'LOW', 'false', '{C.RESUME_ADVICE}', {fill(W.RESUME_FIX, warehouse='name')}
  FROM warehouses WHERE lower(auto_resume) <> 'true'
  UNION ALL
  SELECT name, '{C.SIZE_CHECK}', 'WARN', 'MEDIUM', size, '{C.SIZE_ADVICE}', {fill(W.OVERSIZE_FIX, warehouse='name')}
  FROM warehouses WHERE size IN ('Large', 'X-Large', '2X-Large', '3X-Large', '4X-Large') AND NOT contains(upper(name), 'ETL'))"""

# --- week over week -------------------------------------------------------------------------------------------

_MONDAY = f"date_trunc('week', {AS_OF})"
WEEKS = f"""weeks AS (
  SELECT warehouse_name,
         {big(f"coalesce(sum(used_u) FILTER (WHERE start_time >= {_MONDAY}), 0)")} AS this_u,
         {big(f"coalesce(sum(used_u) FILTER (WHERE start_time < {_MONDAY} AND start_time >= {_MONDAY} - INTERVAL 7 DAY), 0)")}
           AS last_u
  FROM metering
  WHERE start_time >= {AS_OF} - INTERVAL 14 DAY AND start_time < {AS_OF} AND warehouse_name <> 'CLOUD_SERVICES_ONLY'
  GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    idle_base = [USAGE, METERING, IDLE]
    spike_base = [USAGE, METERING, BASELINE, SPIKE]
    last_day = f"anomaly_start >= {AS_OF} - INTERVAL 24 HOUR AND anomaly_start < {AS_OF}"
    stream_idle = [*idle_base, f"numbered AS (SELECT {numbered('idle')} AS anomaly_id, *, 'OPEN' AS status FROM idle)"]
    stream_spike = [*spike_base, f"numbered AS (SELECT {numbered('spike')} AS anomaly_id, *, 'OPEN' AS status FROM spike)"]
    slices = f"""CASE WHEN anomaly_start < TIMESTAMP '2024-01-11' THEN 1
           WHEN anomaly_start < TIMESTAMP '2024-01-21' THEN 2 ELSE 3 END"""
    sql = {
        "metering_scan": select(
            [USAGE, METERING],
            f"""SELECT {ts('start_time')} AS start_time, {ts('end_time')} AS end_time, warehouse_id, warehouse_name,
       {num(dec('used_u', 4, 9))} AS credits_used, {num(dec('compute_u', 4, 9))} AS credits_used_compute,
       {num(dec('cloud_u', 4, 9))} AS credits_used_cloud_services
FROM metering WHERE start_time >= {AS_OF} - INTERVAL 24 HOUR AND start_time < {AS_OF} AND warehouse_name <> 'CLOUD_SERVICES_ONLY'""",
        ),
        "detect_idle_lookback": select(idle_base, f"SELECT {FOUND_COLUMNS} FROM idle WHERE {last_day}"),
        "detect_idle": select(idle_base, f"SELECT {FOUND_COLUMNS} FROM idle"),
        "rolling_baseline": select(
            [USAGE, METERING, BASELINE],
            f"""SELECT warehouse_name, {ts('start_time')} AS start_time, {num(dec('used_u', 4, 9))} AS credits_used,
       {num(dec('s', 4, 9))} AS baseline_sum, n AS baseline_count, n AS preceding_rows,
       {num(dec(half_up('s * 100000', 'n'), 9))} AS rolling_average
FROM baseline""",
        ),
        "detect_cost_spike": select(spike_base, f"SELECT {FOUND_COLUMNS} FROM spike"),
        "detect_cost_spike_lookback": select(spike_base, f"SELECT {FOUND_COLUMNS} FROM spike WHERE {last_day}"),
        "idle_severity": select(idle_base, SEVERITY_BODY.format(source="idle")),
        "spike_severity": select(spike_base, SEVERITY_BODY.format(source="spike")),
        "anomaly_text": select(
            DETECTION,
            f"SELECT warehouse_name, {ts('anomaly_start')} AS anomaly_start, anomaly_type, description, suggested_fix"
            " FROM found",
        ),
        "detect_incremental": select(
            DETECTION,
            f"""SELECT warehouse_name, {ts('anomaly_start')} AS anomaly_start, anomaly_type, severity FROM found f
WHERE NOT EXISTS (
  SELECT 1 FROM detected d WHERE d.warehouse_name = f.warehouse_name AND d.anomaly_start = f.anomaly_start
     AND d.anomaly_type = f.anomaly_type AND d.anomaly_start < {FIRST_RUN_END})""",
        ),
        "scan_audit": select(
            DETECTION,
            f"""SELECT log_id, {ts(AS_OF)} AS logged_at, 'DETECTION' AS action_type, action_details,
       'COMPLETED' AS status
FROM (
  SELECT 1::BIGINT AS log_id, {fill(W.IDLE_SCAN_AUDIT, parameter="'24'", rows='count(*)')} AS action_details
  FROM idle WHERE {last_day}
  UNION ALL SELECT 2, {fill(W.IDLE_FULL_SCAN_AUDIT, rows='count(*)')} FROM idle
  UNION ALL SELECT 3, {fill(W.SPIKE_SCAN_AUDIT, parameter="'2.5'", rows='count(*)')} FROM spike)""",
        ),
        "anomaly_ids": select(
            DETECTION,
            f"SELECT anomaly_id, warehouse_name, {ts('anomaly_start')} AS anomaly_start, anomaly_type FROM detected",
        ),
        "full_rebuild": select(
            STATE,
            f"""SELECT anomaly_id, warehouse_name, {ts('detected_at')} AS detected_at,
       {ts('anomaly_start')} AS anomaly_start, {ts('anomaly_end')} AS anomaly_end, anomaly_type, severity,
       {num('credits_wasted')} AS credits_wasted, description, suggested_fix, status,
       {ts('resolved_at')} AS resolved_at, resolved_by
FROM anomalies""",
        ),
        # Ids follow the day an anomaly began, so those of the last day continue where the days before ended.
        "live_cycle": select(
            STATE,
            f"""SELECT anomaly_id, warehouse_name, {ts('anomaly_start')} AS anomaly_start, anomaly_type, severity, status,
       {ts(f"CASE WHEN resolved_at IS NOT NULL AND {last_day} THEN {AS_OF} ELSE resolved_at END")} AS resolved_at
FROM anomalies""",
        ),
        "generate_fixes": select(
            [*DETECTION, FIXES],
            f"""SELECT anomaly_id, warehouse_name, anomaly_type, severity, {num('credits_wasted')} AS credits_wasted,
       sql_executed, action_details, fix_status
FROM fixes""",
        ),
        "apply_fixes_anomalies": select([*DETECTION, FIXED], f"SELECT {DECISION_COLUMNS} FROM anomalies"),
        "apply_fixes_audit": select([*DETECTION, FIXES, FIX_AUDIT], f"SELECT {AUDIT_COLUMNS} FROM fix_audit"),
        "apply_fixes_summary": select(
            [*DETECTION, FIXES],
            f"""SELECT auto_applied, pending_approval,
       {fill(W.FIX_SUMMARY, applied='auto_applied', pending='pending_approval')} AS message
FROM (SELECT count(*) FILTER (WHERE fix_status = 'COMPLETED') AS auto_applied,
             count(*) FILTER (WHERE fix_status <> 'COMPLETED') AS pending_approval FROM fixes)""",
        ),
        "approve_fix_anomalies": select(AFTER, f"SELECT {DECISION_COLUMNS} FROM anomalies2"),
        "approve_fix_audit": select(AFTER, f"SELECT {AUDIT_COLUMNS} FROM audit_log2"),
        "approve_fix_results": select(
            [*STATE, PENDING],
            f"""SELECT anomaly_id, approved_by, {ts('requested_at')} AS requested_at, granted,
       CASE WHEN granted THEN {fill(W.APPROVAL_RESULT, anomaly='anomaly_id', approver='approved_by')}
            WHEN approved_by IS NULL THEN 'The approval of anomaly ' || anomaly_id || ' names nobody'
            ELSE {fill(W.APPROVAL_MISSING, anomaly='anomaly_id')} END AS message
FROM (
  SELECT *, approved_by IS NOT NULL AND anomaly_id IN (SELECT anomaly_id FROM pending)
         AND row_number() OVER (PARTITION BY anomaly_id, approved_by IS NULL ORDER BY requested_at, approved_by) = 1 AS granted
  FROM (
    SELECT anomaly_id, 'alice' AS approved_by, {AS_OF} AS requested_at FROM anomalies WHERE anomaly_id % 2 = 0
    UNION ALL SELECT anomaly_id, 'carol', {AS_OF} - INTERVAL 5 MINUTE FROM anomalies WHERE anomaly_id % 6 = 0
    UNION ALL SELECT anomaly_id, NULL, {AS_OF} - INTERVAL 9 MINUTE FROM anomalies WHERE anomaly_id % 4 = 0
    UNION ALL SELECT anomaly_id, NULL, {AS_OF} FROM anomalies WHERE anomaly_id % 5 = 1
    UNION ALL SELECT -anomaly_id, 'dave', {AS_OF} FROM anomalies WHERE anomaly_id % 50 = 0))""",
        ),
        "dismiss_fix_anomalies": select(
            [*STATE, *DISMISSED],
            f"""SELECT {DECISION_COLUMNS} FROM (
  SELECT * REPLACE (CASE WHEN anomaly_id IN (SELECT anomaly_id FROM dismissed) THEN 'DISMISSED' ELSE status END
                    AS status) FROM anomalies)""",
        ),
        "dismiss_fix_audit": select(
            [*STATE, *DISMISSED],
            f"""SELECT {big('log_id')} AS log_id, action_type, anomaly_id,
       CASE WHEN hit THEN 'bob' ELSE approved_by END AS approved_by,
       CASE WHEN hit THEN 'COMPLETED' ELSE status END AS status
FROM (SELECT l.*, d.anomaly_id IS NOT NULL AND l.status = 'PENDING_APPROVAL' AS hit
      FROM audit_log l LEFT JOIN dismissed d ON d.anomaly_id = l.anomaly_id)""",
        ),
        "kpi_summary": select(
            [*DETECTION, FIXED],
            f"""SELECT count(*) AS total_anomalies, {num('coalesce(sum(credits_wasted), 0)')} AS credits_wasted,
       {num(SAVED)} AS credits_saved, count(*) FILTER (WHERE status IN ('OPEN', 'ACKNOWLEDGED')) AS open_issues,
       {num(f"{SAVED} * 3.00")} AS dollars_saved
FROM anomalies""",
        ),
        "environment_impact": select(
            [*DETECTION, FIXED],
            f"""SELECT {num('saved')} AS credits_saved, {num('saved * 3.8')} AS kwh_saved,
       {num('saved * 3.8 * 0.39')} AS co2_kg_avoided,
       greatest(1, {big("floor(saved * 3.8 * 0.39 / 21.77)")}) AS trees
FROM (SELECT CAST({SAVED} AS DECIMAL(24,9)) AS saved FROM anomalies)""",
        ),
        "snapshot_savings": select([*DETECTION, FIXED, DAILY_SAVINGS], f"SELECT {SAVINGS_COLUMNS} FROM savings"),
        "savings_trend": select(
            [*DETECTION, FIXED, DAILY_SAVINGS],
            f"SELECT {SAVINGS_COLUMNS} FROM savings ORDER BY day",
        ),
        "savings_trend_days": select(
            [*DETECTION, FIXED, DAILY_SAVINGS],
            f"SELECT {SAVINGS_COLUMNS} FROM savings WHERE day BETWEEN DATE '2024-01-25' AND DATE '2024-01-31' ORDER BY day",
        ),
        "anomalies_by_warehouse": select(
            [*DETECTION, FIXED],
            f"""SELECT warehouse_name, anomaly_type, count(*) AS anomaly_count, {num('sum(credits_wasted)')} AS credits
FROM anomalies GROUP BY ALL ORDER BY credits DESC""",
        ),
        "recent_anomaly_counts": select([*DETECTION, FIXED, RECENT], "SELECT * FROM recent"),
        "health_scores": select(
            [*DETECTION, FIXED, RECENT, WAREHOUSES],
            f"""SELECT name, state, anomaly_count, score, {BAND} AS band
FROM (
  SELECT name, state, coalesce(anomaly_count, 0) AS anomaly_count,
         {big('''greatest(0, 100 - CASE WHEN suspend > 300 THEN 15 ELSE 0 END - CASE WHEN suspend > 600 THEN 10 ELSE 0 END
           - CASE WHEN state = 'STARTED' AND running = 0 THEN 20 ELSE 0 END
           - least(40, 8 * coalesce(anomaly_count, 0)))''')} AS score
  FROM (SELECT *, coalesce(nullif(auto_suspend, 0), 600) AS suspend FROM warehouses) w
  LEFT JOIN recent r ON r.warehouse_name = w.name)""",
        ),
        "quick_stats": select(
            [*NOTIFICATIONS, WAREHOUSES],
            """SELECT (SELECT count(*) FROM notices WHERE NOT is_read) AS unread_notifications,
       (SELECT count(*) FROM anomalies2 WHERE status IN ('OPEN', 'ACKNOWLEDGED')) AS open_issues,
       (SELECT count(*) FROM warehouses) AS warehouses_total""",
        ),
        "warehouse_status": select(
            [WAREHOUSES],
            f"""SELECT name, CASE state WHEN 'STARTED' THEN 'Running' WHEN 'SUSPENDED' THEN 'Suspended' ELSE state END
         AS status, size, {big('auto_suspend')} AS auto_suspend, auto_suspend || 's' AS suspend_text,
       {big('running')} AS running, {big('queued')} AS queued
FROM warehouses""",
        ),
        "auto_fix_history": select(
            STATE,
            f"""SELECT {big('l.log_id')} AS log_id, {ts('l.logged_at')} AS logged_at, a.warehouse_name, a.anomaly_type,
       a.severity, {DOLLARS}, l.action_details, l.sql_executed
FROM audit_log l JOIN anomalies a ON a.anomaly_id = l.anomaly_id
WHERE l.action_type = 'AUTO_ACTION' AND l.status = 'COMPLETED'
ORDER BY l.logged_at DESC, l.log_id DESC LIMIT 10""",
        ),
        "pending_approvals": select(
            [*STATE, WAITING],
            f"""SELECT anomaly_id, warehouse_name, anomaly_type, severity, {num('credits_wasted')} AS credits_wasted,
       description, proposed_fix, action_details, {num('credits_wasted * 3.00')} AS dollars_at_risk
FROM waiting""",
        ),
        "approval_kpis": select(
            [*STATE, WAITING],
            f"""SELECT count(*) AS total_pending, {num('coalesce(sum(credits_wasted), 0) * 3.00')} AS dollars_at_risk,
       count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS high_count
FROM waiting""",
        ),
        "recently_approved": select(
            AFTER,
            f"""SELECT {big('l.log_id')} AS log_id, {ts('l.logged_at')} AS logged_at, a.warehouse_name, a.anomaly_type,
       a.severity, {DOLLARS}, l.approved_by
FROM audit_log2 l JOIN anomalies2 a ON a.anomaly_id = l.anomaly_id
WHERE l.action_type = 'USER_ACTION' AND l.status = 'COMPLETED' AND l.approved_by IS NOT NULL
ORDER BY l.logged_at DESC, l.log_id DESC LIMIT 5""",
        ),
        "spike_query_drilldown": select(
            [*DETECTION, FIXED, QUERIES, DRILLDOWN],
            f"""SELECT anomaly_id, warehouse_name, {ts('anomaly_start')} AS anomaly_start,
       {ts('anomaly_end')} AS anomaly_end, query_id, user_name, role_name, {ts('start_time')} AS start_time,
       {num(dec('cloud_u', 4, 9))} AS credits_used_cloud_services
FROM drilldown""",
        ),
        "spike_query_top": select(
            [*DETECTION, FIXED, QUERIES, DRILLDOWN],
            f"""SELECT anomaly_id, cost_rank, query_id, user_name, {num(dec('cloud_u', 4, 9))} AS credits_used_cloud_services
FROM (SELECT *, row_number() OVER (PARTITION BY anomaly_id ORDER BY cloud_u DESC, query_id) AS cost_rank FROM drilldown)
WHERE cost_rank <= 5""",
        ),
        "alert_prompts": select(
            [RULES], f"SELECT alert_id, rule, {fill(W.ALERT_PROMPT, rule='rule')} AS prompt FROM rules"
        ),
        "alert_parse": select(
            [RULES, PARSED],
            f"""SELECT alert_id, is_valid, parsed_metric, parsed_threshold, parsed_warehouse, parsed_condition,
       {SYMBOL} AS condition_symbol,
       CASE WHEN contains(parsed_metric, 'spend') THEN 'spend' WHEN contains(parsed_metric, 'idle')
         OR contains(parsed_metric, 'hour') THEN 'time' WHEN parsed_metric IS NOT NULL THEN 'other' END AS metric_class
FROM parsed""",
        ),
        "alert_activate": select(
            [RULES, PARSED, ALERTS],
            f"""SELECT alert_id, natural_language_rule, parsed_metric, parsed_threshold, parsed_warehouse,
       parsed_condition, is_active, {ts('created_at')} AS created_at, 0::BIGINT AS trigger_count,
       NULL::VARCHAR AS evaluated_until
FROM alerts""",
        ),
        "alert_deactivate": select(
            [RULES, PARSED, ALERTS],
            "SELECT alert_id, parsed_condition, parsed_condition <> 'equals' AS is_active FROM alerts",
        ),
        "alert_metrics": select(
            [USAGE, METERING, QUERIES, METRICS],
            f"SELECT metric, warehouse_name, {ts('period_start')} AS period_start, {num('value')} AS value FROM metrics",
        ),
        "alert_triggers": select(
            EVALUATION,
            f"""SELECT alert_id, metric, warehouse_name, {ts('period_start')} AS period_start, {num('value')} AS value,
       parsed_condition, parsed_threshold
FROM triggers""",
        ),
        "evaluate_alerts": select(
            [*EVALUATION, COUNTS],
            f"SELECT alert_id, parsed_metric, parsed_warehouse, trigger_count, {ts(AS_OF)} AS evaluated_until FROM counts",
        ),
        "evaluate_alerts_again": select(
            [*EVALUATION, COUNTS],
            f"SELECT alert_id, parsed_metric, parsed_warehouse, trigger_count, {ts(AS_OF)} AS evaluated_until FROM counts",
        ),
        "alert_triggers_new": select(
            EVALUATION,
            f"""SELECT alert_id, metric, warehouse_name, {ts('period_start')} AS period_start, {num('value')} AS value,
       parsed_condition, parsed_threshold
FROM triggers WHERE period_start + CASE metric WHEN 'weekly_spend' THEN INTERVAL 7 DAY WHEN 'credits_per_hour' THEN
  INTERVAL 1 HOUR ELSE INTERVAL 1 DAY END > {MID_MONTH}""",
        ),
        "active_alerts": select(
            [*EVALUATION, COUNTS],
            f"""SELECT alert_id, natural_language_rule, {SYMBOL} AS condition_symbol,
       CASE WHEN trigger_count = 0 THEN 'Active' ELSE 'Triggered (' || trigger_count || 'x)' END AS badge
FROM counts WHERE parsed_condition <> 'equals' ORDER BY alert_id DESC""",
        ),
        "high_severity_outbox": select(
            [*DETECTION, FIXED],
            f"""SELECT anomaly_id, warehouse_name, severity, {ts('detected_at')} AS created_at,
       {fill(W.OUTBOX_SUBJECT, severity='severity', kind='anomaly_type', warehouse='warehouse_name')} AS subject,
       {fill(W.OUTBOX_BODY, description='description', suggestion='suggested_fix')} AS body
FROM anomalies WHERE severity IN ('HIGH', 'CRITICAL')""",
        ),
        "ask_context": select(
            [*DETECTION, FIXED, CONTEXT],
            f'SELECT row_count, "table", {num("credits_saved")} AS credits_saved FROM context',
        ),
        "ask_prompts": select(
            [*DETECTION, FIXED, CONTEXT, WAREHOUSES],
            f"""SELECT question, {fill(
                W.QUESTION_PROMPT,
                table='(SELECT "table" FROM context)',
                rate="'3.00'",
                saved=f"(SELECT {rounded_text('credits_saved', 2)} FROM context)",
                question='question',
            )} AS prompt
FROM (SELECT 'What drives the cost of ' || name || '?' AS question FROM warehouses)""",
        ),
        "cost_attribution": select(
            [USAGE, QUERIES],
            f"""SELECT user_name, role_name, count(*) AS queries, {num(dec('sum(cloud_u)', 4))} AS credits,
       {num(dec(half_up('sum(cloud_u) * 3', '100'), 2))} AS dollars
FROM query_history WHERE start_time >= {AS_OF} - INTERVAL 7 DAY AND start_time < {AS_OF} AND cloud_u > 0
GROUP BY user_name, role_name ORDER BY sum(cloud_u) DESC, user_name, role_name LIMIT 10""",
        ),
        "week_over_week": select(
            [USAGE, METERING, WEEKS],
            f"""SELECT warehouse_name, {num(dec('this_u', 4, 9))} AS this_week, {num(dec('last_u', 4, 9))} AS last_week,
       CASE WHEN last_u > 0 THEN CASE WHEN this_u < last_u THEN '-' ELSE '+' END ||
         CAST({dec(half_up('abs(this_u - last_u) * 1000', 'greatest(last_u, 1)'), 1)} AS VARCHAR) || '%'
       ELSE 'new' END AS change
FROM weeks WHERE this_u > 0 OR last_u > 0""",
        ),
        "compliance_findings": select([WAREHOUSES, FINDINGS], "SELECT * FROM findings"),
        "compliance_score": select(
            [WAREHOUSES, FINDINGS],
            f"""SELECT checks_total - issues_found AS checks_passed, checks_total, issues_found, score, {BAND} AS band
FROM (SELECT *, {big("(checks_total - issues_found) * 100 // checks_total")} AS score
      FROM (SELECT (SELECT count(*) * 3 FROM warehouses) AS checks_total, count(*) AS issues_found FROM findings))""",
        ),
        "generate_notifications": select(
            NOTIFICATIONS,
            f"""SELECT notification_id, {ts('created_at')} AS created_at, notification_type, title, message,
       warehouse_name, false AS is_read
FROM notices""",
        ),
        "notification_feed": select([*NOTIFICATIONS, feed()], FEED_BODY),
        "notification_feed_by_type": select([*NOTIFICATIONS, feed("notification_type = 'WARNING'")], FEED_BODY),
        "notification_counts": select(
            [*NOTIFICATIONS, feed()],
            """SELECT count(*) FILTER (WHERE NOT is_read) AS unread,
       count(*) FILTER (WHERE notification_type = 'APPROVAL_NEEDED') AS approvals_needed,
       count(*) FILTER (WHERE notification_type = 'INFO') AS infos,
       count(*) FILTER (WHERE notification_type = 'APPROVED') AS approved,
       count(*) FILTER (WHERE notification_type = 'WARNING') AS warnings
FROM feed""",
        ),
        "notifications_mark_read": select(
            NOTIFICATIONS,
            "SELECT notification_type, true AS is_read, count(*) AS notifications FROM notices GROUP BY ALL",
        ),
        "audit_stats": select(
            AFTER,
            """SELECT count(*) AS total_entries, count(*) FILTER (WHERE action_type = 'AUTO_ACTION') AS auto_actions,
       count(*) FILTER (WHERE action_type = 'USER_ACTION') AS manual_actions,
       count(*) FILTER (WHERE status = 'PENDING_APPROVAL') AS pending
FROM audit_log2""",
        ),
        "audit_warehouses": select(
            AFTER,
            "SELECT DISTINCT warehouse_name FROM audit_log2 WHERE warehouse_name IS NOT NULL ORDER BY 1",
        ),
        "audit_log_filtered": select(
            AFTER,
            f"""SELECT {AUDIT_COLUMNS} FROM (
  SELECT * FROM audit_log2 WHERE status = 'COMPLETED' AND action_type = 'AUTO_ACTION'
  ORDER BY logged_at DESC, log_id DESC LIMIT 50)""",
        ),
        "audit_log_of_warehouse": select(
            AFTER,
            f"""SELECT {AUDIT_COLUMNS} FROM (
  SELECT * FROM audit_log2 WHERE warehouse_name = 'WH_000000004' ORDER BY logged_at DESC, log_id DESC LIMIT 50)""",
        ),
        "stream_idle": select(stream_idle, f"SELECT {STREAM_COLUMNS} FROM numbered"),
        "stream_spike": select(stream_spike, f"SELECT {STREAM_COLUMNS} FROM numbered"),
        "stream_late": select(DETECTION, f"SELECT {JUDGED_COLUMNS} FROM found"),
        "stream_repeats": select(
            [USAGE, METERING, WITH_REVISED, IDLE.replace("FROM metering", "FROM received")],
            f"SELECT {JUDGED_COLUMNS} FROM idle",
        ),
        "stream_fixes": select(
            STATE,
            f"SELECT {STREAM_COLUMNS}, {ts('resolved_at')} AS resolved_at, resolved_by FROM anomalies",
        ),
        # Each of the three runs logs its two scans before its fixes, whose ids continue.
        "stream_fixes_audit": select(
            STATE,
            f"""SELECT * FROM (
  SELECT {big('anomaly_id + 2 * slice')} AS log_id, {ts('detected_at')} AS logged_at,
         CASE WHEN fix_status = 'COMPLETED' THEN 'AUTO_ACTION' ELSE 'RECOMMENDATION' END AS action_type, anomaly_id,
         action_details, fix_status AS status
  FROM (SELECT f.*, d.slice FROM fixes f JOIN (SELECT anomaly_id, {slices} AS slice FROM detected) d USING (anomaly_id))
  UNION ALL
  SELECT {big('(SELECT count(*) FROM detected WHERE ' + slices + ' < r.slice) + 2 * (slice - 1) + place')},
         {ts(AS_OF)}, 'DETECTION', NULL,
         CASE place WHEN 1 THEN {fill(W.IDLE_FULL_SCAN_AUDIT, rows='hits')}
                    ELSE {fill(W.SPIKE_SCAN_AUDIT, parameter="'2.5'", rows='hits')} END, 'COMPLETED'
  FROM (SELECT slice, place,
               (SELECT count(*) FROM detected WHERE {slices} = g.slice
                  AND anomaly_type = CASE g.place WHEN 1 THEN 'IDLE_COMPUTE' ELSE 'COST_SPIKE' END) AS hits
        FROM (SELECT unnest([1, 1, 2, 2, 3, 3]) AS slice, unnest([1, 2, 1, 2, 1, 2]) AS place) g) r)""",
        ),
    }
    sql["rebuild_after_cycles"] = sql["full_rebuild"]
    sql["live_cycle_days"] = sql["live_cycle"]
    sql["audit_log_newest_days"] = sql["audit_log_filtered"]
    sql["auto_fix_history_days"] = sql["auto_fix_history"]
    sql["recently_approved_days"] = sql["recently_approved"]
    sql["notification_feed_days"] = sql["notification_feed"].replace(", is_read,", ", false AS is_read,")
    sql["notification_feed_unread"] = select([*NOTIFICATIONS, feed("NOT is_read")], FEED_BODY)
    sql["notifications_mark_one"] = select(
        NOTIFICATIONS,
        """SELECT notification_id,
       is_read OR notification_id = (SELECT min(notification_id) FROM notices WHERE NOT is_read) AS is_read
FROM notices""",
    )
    # Every anomaly has one notification so far, and the last cycle's follow in the order of their ids.
    last_cycle = f"""last_cycle AS (
  SELECT l.anomaly_id AS notification_id, {AS_OF} AS created_at, {_KIND} AS notification_type, l.action_details AS message, a.warehouse_name
  FROM audit_log l JOIN anomalies a USING (anomaly_id)
  WHERE l.action_type <> 'DETECTION' AND a.anomaly_start >= {AS_OF} - INTERVAL 24 HOUR)"""
    titles = " ".join(f"WHEN '{kind}' THEN {fill(text, warehouse='warehouse_name')}" for kind, text in W.NOTICE_TITLES.items())
    sql["cycle_notifications"] = select(
        [*STATE, last_cycle],
        f"""SELECT notification_id, {ts('created_at')} AS created_at, notification_type, CASE notification_type {titles} END AS title, message,
       warehouse_name, false AS is_read
FROM last_cycle""",
    )
    sql["savings_snapshot_day"] = select(
        [*AFTER, DAILY_SAVINGS.replace("FROM anomalies ", "FROM anomalies2 ")], f"SELECT {SAVINGS_COLUMNS} FROM savings"
    )
    # The end of a period decides in which of the two evaluations it was judged.
    sql["alert_history"] = select(
        EVALUATION,
        f"""SELECT alert_id, metric, warehouse_name, {ts('period_start')} AS period_start, {num('value')} AS value,
       parsed_condition, parsed_threshold,
       CASE WHEN period_start + CASE metric WHEN 'weekly_spend' THEN INTERVAL 7 DAY WHEN 'credits_per_hour' THEN INTERVAL 1 HOUR
                 ELSE INTERVAL 1 DAY END <= {MID_MONTH} THEN '2024-01-17 12:00:00' ELSE '2024-01-31 00:00:00' END AS evaluated_at
FROM triggers""",
    )
    sql["approve_fix_days"] = sql["approve_fix_anomalies"]
    sql["approve_fix_days_audit"] = sql["approve_fix_audit"]
    sql["dismiss_fix_days"] = sql["dismiss_fix_anomalies"]
    sql["outbox_second_cycle"] = sql["high_severity_outbox"] + " AND anomaly_start >= TIMESTAMP '2024-01-16'"
    # A scan of the past is the same scan at another time. Only the day's floor differs in the weekly one.
    for name, at in (
        ("metering_scan", AS_OF), ("detect_idle_lookback", AS_OF), ("recent_anomaly_counts", AS_OF), ("cost_attribution", AS_OF),
        ("week_over_week", AS_OF),
    ):
        moved = sql[name].replace(f"{at} - INTERVAL 14 DAY", "TIMESTAMP '2024-01-03 00:00:00'").replace(at, MID_MONTH)
        sql[f"{name.removesuffix('_lookback')}_mid_month"] = moved
    return sql
