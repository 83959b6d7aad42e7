"""DuckDB SQL for the registered queries, written apart from the Spark plans: plain windows, no slices.

CTES holds one common table expression per model; sql() puts the ones that a query needs in front of it.
"""

from __future__ import annotations

import re

CTES = {
    "silver": """
SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS event_ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ingest_ts,
  'line_' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS line_id, 'Line ' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS line_name,
  CASE user_id % 4 WHEN 0 THEN 'metro' WHEN 1 THEN 'tram' WHEN 2 THEN 'rail' ELSE 'river' END AS mode, sev AS status_severity,
  CASE WHEN k % 10 <> 9 THEN CASE sev WHEN 10 THEN 'Good Service' WHEN 9 THEN 'Minor Delays' WHEN 6 THEN 'Severe Delays' WHEN 3 THEN 'Part Suspended' WHEN 20 THEN 'Service Closed' END END AS status_desc,
  CASE WHEN event_type = 'view' THEN NULL WHEN k < 20 THEN '  Signal   failure at  X ' WHEN k < 40 THEN 'Train cancellations on the line' WHEN k < 55 THEN 'Power supply problem' WHEN k < 70 THEN 'Customer incident at Y' WHEN k < 80 THEN '   ' WHEN k < 90 THEN 'Planned closure' ELSE 'Something else happened' END AS reason,
  CASE WHEN event_type IN ('error', 'purchase') THEN date_trunc('minute', ts) END AS valid_from,
  CASE WHEN event_type IN ('error', 'signup') THEN ts + to_seconds(CAST(floor(value * 60 + 0.5) AS BIGINT)) END AS valid_to,
  CASE WHEN k % 10 <> 7 THEN sev <> 10 END AS is_disrupted, sha256(props) AS payload_hash, ts AS producer_ingest_ts, CAST(event_id AS VARCHAR) AS producer_request_id, 1 AS schema_version
FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 9 WHEN 'purchase' THEN 6 WHEN 'error' THEN 3 WHEN 'signup' THEN 20 END AS sev FROM events)
""",
    "stg": "SELECT * REPLACE (coalesce(status_desc, 'Unknown') AS status_desc) FROM silver WHERE line_id IS NOT NULL",
    "dim_line": """
SELECT line_id, arg_max(line_name, event_ts) AS line_name, arg_max(mode, event_ts) AS mode, min(event_ts) AS first_seen_ts, max(event_ts) AS last_seen_ts, max(ingest_ts) AS last_ingest_ts FROM stg GROUP BY line_id
""",
    "dim_status": """
SELECT status_severity, status_desc,
  CASE status_severity WHEN 10 THEN 'Good Service' WHEN 9 THEN 'Minor Delays' WHEN 7 THEN 'Reduced Service' WHEN 6 THEN 'Severe Delays' WHEN 5 THEN 'Part Closure' WHEN 4 THEN 'Planned Closure' WHEN 3 THEN 'Part Suspended' WHEN 2 THEN 'Suspended' WHEN 20 THEN 'Service Closed' ELSE 'Other' END AS status_category,
  CAST(CASE status_severity WHEN 10 THEN 0 WHEN 9 THEN 1 WHEN 7 THEN 2 WHEN 6 THEN 3 WHEN 5 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 2 THEN 5 WHEN 20 THEN 5 ELSE 2 END AS DOUBLE) AS severity_weight,
  coalesce(status_severity = 10, false) AS is_good_service, last_ingest_ts
FROM (SELECT status_severity, status_desc, max(ingest_ts) OVER (PARTITION BY status_severity) AS last_ingest_ts, row_number() OVER (PARTITION BY status_severity ORDER BY ingest_ts DESC NULLS LAST, status_desc DESC NULLS LAST) AS rn FROM stg) WHERE rn = 1
""",
    "dim_datetime": """
SELECT date_key, CAST(h AS INTEGER) AS hour_of_day, CAST(dayofweek(date_key) + 1 AS INTEGER) AS day_of_week, dayname(date_key) AS day_name, CAST(weekofyear(date_key) AS INTEGER) AS week_of_year, CAST(month(date_key) AS INTEGER) AS month_num, monthname(date_key) AS month_name, CAST(quarter(date_key) AS INTEGER) AS quarter_num, CAST(year(date_key) AS INTEGER) AS year_num, dayofweek(date_key) IN (0, 6) AS is_weekend, source_ingest_ts
FROM (SELECT CAST(coalesce(valid_from, event_ts) AS DATE) AS date_key, max(ingest_ts) AS source_ingest_ts FROM stg GROUP BY 1), (SELECT unnest(range(24)) AS h)
""",
    "prepared": """
SELECT * REPLACE (coalesce(is_disrupted, NOT coalesce(status_severity = 10, false)) AS is_disrupted),
  CASE WHEN coalesce(is_disrupted, NOT coalesce(status_severity = 10, false)) THEN coalesce(valid_from, event_ts) ELSE event_ts END AS interval_start_ts FROM stg
""",
    "newest": "SELECT * FROM prepared QUALIFY row_number() OVER (PARTITION BY line_id, interval_start_ts ORDER BY event_ts DESC NULLS LAST, ingest_ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1",
    "ended": """
SELECT *, coalesce(lead(interval_start_ts) OVER (PARTITION BY line_id ORDER BY interval_start_ts NULLS FIRST), CASE WHEN is_disrupted AND valid_to > interval_start_ts THEN valid_to END) AS interval_end_ts FROM newest
""",
    "intervals": """
SELECT line_id, event_id, event_ts, valid_from AS source_valid_from, valid_to AS source_valid_to, interval_start_ts, interval_end_ts,
  CASE WHEN interval_end_ts IS NOT NULL THEN CAST(greatest(1, ceil((epoch_us(interval_end_ts) // 1000 - epoch_us(interval_start_ts) // 1000) / 1000.0)) AS BIGINT) END AS interval_seconds,
  status_severity, coalesce(status_severity = 10, false) AS is_good_service, is_disrupted,
  CASE WHEN lower(reason) LIKE '%signal%' THEN 'Signal Failure' WHEN lower(reason) LIKE '%train cancellation%' THEN 'Train Cancellations' WHEN lower(reason) LIKE '%customer incident%' THEN 'Customer Incident' WHEN lower(reason) LIKE '%power%' THEN 'Power Issue' WHEN lower(reason) LIKE '%staff%' THEN 'Staffing' WHEN lower(reason) LIKE '%weather%' THEN 'Weather' WHEN lower(reason) LIKE '%engineering%' THEN 'Engineering Work' WHEN lower(reason) LIKE '%planned closure%' THEN 'Planned Closure' WHEN reason IS NULL OR trim(reason) = '' THEN 'Unknown' ELSE 'Other' END AS disruption_category,
  reason, sha256(regexp_replace(lower(trim(coalesce(reason, ''))), '\\s+', ' ', 'g')) AS reason_text_hash, ingest_ts
FROM ended
""",
    "flagged": """
SELECT *, CASE WHEN was_severity IS NULL OR status_severity <> was_severity OR reason_text_hash <> was_hash THEN 1 ELSE 0 END AS flag
FROM (SELECT *, lag(status_severity) OVER w AS was_severity, lag(reason_text_hash) OVER w AS was_hash FROM intervals WINDOW w AS (PARTITION BY line_id ORDER BY interval_start_ts NULLS FIRST, ingest_ts NULLS FIRST, status_severity NULLS FIRST, reason_text_hash NULLS FIRST))
""",
    "runs": "SELECT *, sum(flag) OVER (PARTITION BY line_id ORDER BY interval_start_ts NULLS FIRST, ingest_ts NULLS FIRST, status_severity NULLS FIRST, reason_text_hash NULLS FIRST ROWS UNBOUNDED PRECEDING) AS run FROM flagged",
    "collapsed": """
SELECT line_id, min(interval_start_ts) AS change_ts, max(ingest_ts) AS source_ingest_ts, max(status_severity) AS new_status_severity, max(reason_text_hash) AS new_reason_text_hash,
  CASE WHEN count(*) = count(interval_seconds) THEN CAST(sum(interval_seconds) AS BIGINT) END AS time_in_new_state_seconds FROM runs GROUP BY line_id, run
""",
    "changes": """
SELECT line_id, change_ts, prev_change_ts, epoch_us(change_ts) // 1000000 - epoch_us(prev_change_ts) // 1000000 AS time_since_prev_seconds, prev_status_severity, new_status_severity, prev_reason_text_hash, new_reason_text_hash,
  prev_status_severity <> 10 AND coalesce(new_status_severity = 10, false) AS recovery_flag, time_in_new_state_seconds, source_ingest_ts
FROM (SELECT *, lag(change_ts) OVER w AS prev_change_ts, lag(new_status_severity) OVER w AS prev_status_severity, lag(new_reason_text_hash) OVER w AS prev_reason_text_hash FROM collapsed WINDOW w AS (PARTITION BY line_id ORDER BY change_ts NULLS FIRST))
WHERE prev_status_severity IS NOT NULL
""",
    "scored": "SELECT i.*, coalesce(d.severity_weight, 0.0) AS severity_weight FROM intervals i LEFT JOIN dim_status d USING (status_severity) WHERE interval_end_ts IS NOT NULL",
    "pieces": """
SELECT *, epoch_us(least(interval_end_ts, bucket_hour + INTERVAL 1 HOUR)) // 1000000 - epoch_us(greatest(interval_start_ts, bucket_hour)) // 1000000 AS s
FROM (SELECT *, unnest(generate_series(date_trunc('hour', interval_start_ts), date_trunc('hour', interval_end_ts), INTERVAL 1 HOUR)) AS bucket_hour FROM scored)
WHERE least(interval_end_ts, bucket_hour + INTERVAL 1 HOUR) > greatest(interval_start_ts, bucket_hour)
""",
    "hours": """
SELECT bucket_hour, CAST(bucket_hour AS DATE) AS service_date, line_id, severity_weighted_seconds, incident_count, worst_status_severity, max_source_ingest_ts, least(t, 3600) AS total_seconds, least(g, t, 3600) AS good_service_seconds, least(b, t, 3600) AS disruption_seconds
FROM (SELECT bucket_hour, line_id, CAST(sum(s) AS BIGINT) AS t, CAST(sum(CASE WHEN is_good_service THEN s ELSE 0 END) AS BIGINT) AS g, CAST(sum(CASE WHEN is_disrupted THEN s ELSE 0 END) AS BIGINT) AS b, sum(s * severity_weight) AS severity_weighted_seconds, count(*) FILTER (is_disrupted) AS incident_count, min(status_severity) AS worst_status_severity, max(ingest_ts) AS max_source_ingest_ts FROM pieces GROUP BY 1, 2)
""",
    "line_hours": """
SELECT h.bucket_hour, h.service_date, h.line_id, l.line_name, l.mode, total_seconds, good_service_seconds, disruption_seconds, severity_weighted_seconds, incident_count, worst_status_severity, coalesce(c.n, 0) AS state_change_count, CASE WHEN total_seconds > 0 THEN good_service_seconds / total_seconds END AS good_service_pct, max_source_ingest_ts
FROM hours h LEFT JOIN dim_line l USING (line_id) LEFT JOIN (SELECT line_id, date_trunc('hour', change_ts) AS bucket_hour, count(*) AS n FROM changes GROUP BY 1, 2) c USING (line_id, bucket_hour)
""",
    "line_days": """
SELECT d.service_date, d.line_id, line_name, mode, least(t, 86400) AS total_seconds, least(g, t, 86400) AS good_service_seconds, least(b, t, 86400) AS disruption_seconds, severity_weighted_seconds, incident_count, mean_incident_duration_seconds, p50_incident_duration_seconds, p95_incident_duration_seconds, max_incident_duration_seconds, coalesce(n, 0) AS num_state_changes, time_in_state_avg_seconds, time_to_recover_avg_seconds, worst_status_severity, CASE WHEN least(t, 86400) > 0 THEN least(g, t, 86400) / least(t, 86400) END AS good_service_pct, greatest(ts, its, cts) AS max_source_ingest_ts
FROM (SELECT service_date, line_id, max(line_name) AS line_name, max(mode) AS mode, CAST(sum(total_seconds) AS BIGINT) AS t, CAST(sum(good_service_seconds) AS BIGINT) AS g, CAST(sum(disruption_seconds) AS BIGINT) AS b, sum(severity_weighted_seconds) AS severity_weighted_seconds, CAST(sum(incident_count) AS BIGINT) AS incident_count, min(worst_status_severity) AS worst_status_severity, max(max_source_ingest_ts) AS ts FROM line_hours GROUP BY 1, 2) d
LEFT JOIN (SELECT line_id, CAST(interval_start_ts AS DATE) AS service_date, avg(interval_seconds) AS mean_incident_duration_seconds, quantile_disc(interval_seconds, 0.5) AS p50_incident_duration_seconds, quantile_disc(interval_seconds, 0.95) AS p95_incident_duration_seconds, max(interval_seconds) AS max_incident_duration_seconds, max(ingest_ts) AS its FROM scored WHERE is_disrupted GROUP BY 1, 2) i USING (line_id, service_date)
LEFT JOIN (SELECT line_id, CAST(change_ts AS DATE) AS service_date, count(*) AS n, avg(time_in_new_state_seconds) AS time_in_state_avg_seconds, avg(CASE WHEN recovery_flag THEN time_since_prev_seconds END) AS time_to_recover_avg_seconds, max(source_ingest_ts) AS cts FROM changes GROUP BY 1, 2) c USING (line_id, service_date)
""",
    "network_hours": "SELECT bucket_hour, service_date, {network} FROM line_hours GROUP BY 1, 2",
    "network_days": "SELECT service_date, {network} FROM line_days GROUP BY 1",
    "current": """
SELECT r.line_id, l.line_name, l.mode, r.status_severity, s.status_desc, is_disrupted, disruption_category, reason, interval_start_ts AS status_valid_from, interval_end_ts AS status_valid_to, ingest_ts AS last_ingest_ts, round((epoch_us(TIMESTAMP '{as_of}') // 1000000 - epoch_us(interval_start_ts) // 1000000) / 60.0, 6) AS last_changed_minutes_ago
FROM (SELECT * FROM intervals QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY interval_start_ts DESC NULLS LAST, ingest_ts DESC NULLS LAST, status_severity ASC NULLS LAST) = 1) r LEFT JOIN dim_line l USING (line_id) LEFT JOIN dim_status s ON r.status_severity = s.status_severity
""",
}
NETWORK = "count(DISTINCT line_id) AS lines_reporting, count(DISTINCT CASE WHEN disruption_seconds > 0 THEN line_id END) AS lines_impacted, CAST(sum(total_seconds) AS BIGINT) AS total_seconds, CAST(sum(good_service_seconds) AS BIGINT) AS good_service_seconds, CAST(sum(disruption_seconds) AS BIGINT) AS disruption_seconds, sum(severity_weighted_seconds) AS severity_weighted_seconds, CASE WHEN sum(total_seconds) > 0 THEN sum(good_service_seconds) / sum(total_seconds) END AS network_good_service_pct, max(max_source_ingest_ts) AS max_source_ingest_ts"
AS_OF = "2024-02-01 00:00:00"


def sql(query: str) -> str:
    """The query behind the CTEs that it needs."""
    texts = {k: v.replace("{network}", NETWORK).replace("{as_of}", AS_OF).strip() for k, v in CTES.items()}
    needed, todo = set(), [query]
    while todo:
        text = todo.pop()
        for name in texts:
            if name not in needed and re.search(rf"(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(texts[name])
    named = ",\n".join(f"{k} AS ({v})" for k, v in texts.items() if k in needed)
    return (f"WITH {named}\n" if named else "") + query
