"""The registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sql as fsql
from .functions import status
from .operators import incremental, neighbours, quality, store
from .oracle import AS_OF, sql
from .plans import gold
from .plans.registry import derive
from .session import Config, pinned, scratch
from .sources import delimited, events, messages
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pinned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.silver(table(spark, sf_dir, "events"))


def plain(df: DataFrame) -> DataFrame:
    """Types as DuckDB has them: timestamps without a zone, decimals as doubles."""
    kinds = {"timestamp": "timestamp_ntz"}
    return df.select(*[F.col(c).cast(kinds[t]).alias(c) if t in kinds else F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


#: The texts of the registered SQL, for queries that must give the rows of another by a longer way.
SQL_OF: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under the function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        SQL_OF[f.__name__] = oracle or ""
        QUERIES[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def _gold(name: str, model: str, cte: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return derive(silver(spark, sf_dir), model, F.lit(AS_OF).cast("timestamp"))

    run.__name__ = name
    query(f"SELECT * FROM {cte}")(run)


for _name, _model, _cte in (
    ("gold_stg_events", "stg_events", "stg"),
    ("gold_dim_line", "dim_line", "dim_line"),
    ("gold_dim_status", "dim_status", "dim_status"),
    ("gold_dim_datetime", "dim_datetime", "dim_datetime"),
    ("gold_fact_interval", "fact_line_status_interval", "intervals"),
    ("gold_fact_change", "fact_line_status_change", "changes"),
    ("gold_int_scored", "int_line_interval_scored", "scored"),
    ("gold_int_hour", "int_line_hour_aggregate", "hours"),
    ("gold_line_hour", "mart_line_hour", "line_hours"),
    ("gold_line_day", "mart_line_day", "line_days"),
    ("gold_network_hour", "mart_network_hour", "network_hours"),
    ("gold_network_day", "mart_network_day", "network_days"),
    ("gold_current_status", "current_line_status", "current"),
):
    _gold(_name, _model, _cte)


# expressions


@query("""
SELECT l_orderkey, l_linenumber, sev,
  CASE sev WHEN 10 THEN 'Good Service' WHEN 9 THEN 'Minor Delays' WHEN 7 THEN 'Reduced Service' WHEN 6 THEN 'Severe Delays' WHEN 5 THEN 'Part Closure' WHEN 4 THEN 'Planned Closure' WHEN 3 THEN 'Part Suspended' WHEN 2 THEN 'Suspended' WHEN 20 THEN 'Service Closed' ELSE 'Other' END AS category,
  CAST(CASE sev WHEN 10 THEN 0 WHEN 9 THEN 1 WHEN 7 THEN 2 WHEN 6 THEN 3 WHEN 5 THEN 4 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 2 THEN 5 WHEN 20 THEN 5 ELSE 2 END AS DOUBLE) AS weight, coalesce(sev = 10, false) AS good
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 22 THEN CAST(l_quantity AS INTEGER) END AS sev FROM lineitem)
""")
def expr_status_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.when(F.col("l_quantity") < 22, F.col("l_quantity").cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", sev.alias("sev"), status.status_category(sev).alias("category"), status.severity_weight(sev).alias("weight"), status.is_good_service(sev).alias("good"))


@query("SELECT status_severity, severity_weight, status_category, is_good_service FROM dim_status")
def expr_severity_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.col("status_severity")
    return silver(spark, sf_dir).select("status_severity").distinct().select("status_severity", status.severity_weight(sev).alias("severity_weight"), status.status_category(sev).alias("status_category"), status.is_good_service(sev).alias("is_good_service"))


@query("""
SELECT event_id, reason, CASE WHEN lower(reason) LIKE '%signal%' THEN 'Signal Failure' WHEN lower(reason) LIKE '%train cancellation%' THEN 'Train Cancellations' WHEN lower(reason) LIKE '%customer incident%' THEN 'Customer Incident' WHEN lower(reason) LIKE '%power%' THEN 'Power Issue' WHEN lower(reason) LIKE '%staff%' THEN 'Staffing' WHEN lower(reason) LIKE '%weather%' THEN 'Weather' WHEN lower(reason) LIKE '%engineering%' THEN 'Engineering Work' WHEN lower(reason) LIKE '%planned closure%' THEN 'Planned Closure' WHEN trim(coalesce(reason, '')) = '' THEN 'Unknown' ELSE 'Other' END AS category
FROM silver
""")
def expr_disruption_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver(spark, sf_dir).select("event_id", "reason", status.disruption_category(F.col("reason")).alias("category"))


@query("SELECT line_id, change_ts, prev_status_severity, new_status_severity, coalesce(prev_status_severity <> 10 AND new_status_severity = 10, false) AS recovered FROM changes")
def expr_recovery_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = derive(silver(spark, sf_dir), "fact_line_status_change")
    return changes.select("line_id", "change_ts", "prev_status_severity", "new_status_severity", status.recovery_flag(F.col("prev_status_severity"), F.col("new_status_severity")).alias("recovered"))


# windows


@query("SELECT line_id, start_ts, event_id, event_ts FROM (SELECT *, coalesce(valid_from, event_ts) AS start_ts FROM silver) QUALIFY row_number() OVER (PARTITION BY line_id, start_ts ORDER BY event_ts DESC NULLS LAST, ingest_ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1")
def win_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver(spark, sf_dir).withColumn("start_ts", F.coalesce("valid_from", "event_ts"))
    w = Window.partitionBy("line_id", "start_ts").orderBy(F.desc("event_ts"), F.desc("ingest_ts"), F.desc("event_id"))
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").select("line_id", "start_ts", "event_id", "event_ts")


@query("SELECT o_custkey, o_orderkey, lag(o_orderdate) OVER w AS prev_date, lead(o_orderdate) OVER w AS next_date FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey)")
def win_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderdate").over(w).alias("prev_date"), F.lead("o_orderdate").over(w).alias("next_date"))


@query("SELECT line_id, event_id, lead(event_id) OVER w AS next_id, lag(event_id) OVER w AS prev_id FROM silver WINDOW w AS (PARTITION BY line_id ORDER BY event_ts, event_id)")
def win_sliced_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours along a line's whole history, from windows over its days."""
    rows = neighbours.sliced(silver(spark, sf_dir).select("line_id", "event_id", "event_ts"), "event_ts")
    both = neighbours.preceding(neighbours.following(rows, "line_id", ["event_ts", "event_id"], {"next_id": "event_id"}), "line_id", ["event_ts", "event_id"], {"prev_id": "event_id"})
    return both.select("line_id", "event_id", "next_id", "prev_id")


@query("SELECT o_custkey, o_orderkey, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM orders")
def win_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum(F.when(F.col("o_totalprice") > 100000, 1).otherwise(0)).over(w).alias("running"))


# joins


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01')")
def join_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") > F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(changed, "c_custkey", "left_semi").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_left_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT a.event_id, d.status_desc AS described FROM silver a LEFT JOIN (SELECT status_severity AS s, status_desc FROM silver GROUP BY ALL) d ON a.status_severity = d.s AND a.status_desc IS NOT DISTINCT FROM d.status_desc")
def join_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver(spark, sf_dir)
    known = rows.select(F.col("status_severity").alias("s"), F.col("status_desc").alias("described")).distinct()
    return rows.join(known, (F.col("status_severity") == F.col("s")) & F.col("status_desc").eqNullSafe(F.col("described")), "left").select("event_id", "described")


@query("SELECT date_key, hour_of_day FROM (SELECT DISTINCT CAST(ts AS DATE) AS date_key FROM events), (SELECT CAST(unnest(range(24)) AS INTEGER) AS hour_of_day)")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by hours: each date spreads over a fixed sequence, so no join is needed."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("date_key")).distinct().select("date_key", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour_of_day"))


# aggregates


@query("SELECT l_returnflag, l_linestatus, sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) AS discounted, sum(l_quantity) AS quantity, count(*) FILTER (l_tax > 0.04) AS taxed, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, avg(CASE WHEN l_discount > 0.05 THEN l_quantity END) AS mean_discounted FROM lineitem GROUP BY 1, 2")
def agg_sum_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond, quantity = F.col("l_discount") > 0.05, F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(fsql.sum_when(cond, quantity).alias("discounted"), F.sum(quantity).alias("quantity"), F.count_if(F.col("l_tax") > 0.04).alias("taxed"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.avg(F.when(cond, quantity)).alias("mean_discounted"))


@query("SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS failing, CASE WHEN count(DISTINCT user_id) > 0 THEN count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) / count(DISTINCT user_id) END AS share FROM events GROUP BY 1")
def agg_count_distinct_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = F.count_distinct("user_id")
    failing = fsql.count_distinct_when(F.col("user_id"), F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(users.alias("users"), failing.alias("failing"), fsql.safe_divide(failing, users).alias("share"))


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY 1")
def agg_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of a column of few distinct values: the values are counted first, so that a group's state stays small."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("l_returnflag")
    ranked = counted.withColumns({"upto": F.sum("n").over(w.orderBy("l_quantity")), "total": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("l_quantity")))
    return ranked.groupBy("l_returnflag").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS last_status FROM orders GROUP BY 1")
def agg_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(gold.latest("o_orderstatus", "o_orderdate").alias("last_status"))


@query("SELECT l_orderkey, count(*) AS row_count FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def agg_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 5")


@query("SELECT count(*) AS total_rows, CAST(sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_reason, min(event_ts) AS first_ts, max(event_ts) AS last_ts FROM silver")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_rows"), fsql.sum_when(F.col("reason").isNull(), F.lit(1)).alias("no_reason"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


# subqueries and sets


@query("SELECT event_id, ingest_ts FROM silver WHERE ingest_ts > (SELECT coalesce(max(ingest_ts), TIMESTAMP '1900-01-01') FROM silver WHERE event_ts < TIMESTAMP '2024-01-20')")
def filter_watermark_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver(spark, sf_dir)
    seen = rows.filter(F.col("event_ts") < F.lit("2024-01-20").cast("timestamp"))
    return incremental.newer_than(rows, "ingest_ts", seen, "ingest_ts").select("event_id", "ingest_ts")


@query("SELECT service_date, network_good_service_pct, (SELECT quantile_disc(b.network_good_service_pct, 0.5) FROM network_days b WHERE b.service_date < d.service_date) AS baseline_p50, (SELECT count(b.network_good_service_pct) FROM network_days b WHERE b.service_date < d.service_date) AS baseline_days FROM network_days d")
def subq_correlated_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = Window.orderBy("service_date").rowsBetween(Window.unboundedPreceding, -1)  # a row per day
    days = derive(silver(spark, sf_dir), "mart_network_day")
    return days.select("service_date", "network_good_service_pct", F.percentile_approx("network_good_service_pct", 0.5).over(past).alias("baseline_p50"), F.count("network_good_service_pct").over(past).alias("baseline_days"))


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal < 0 UNION ALL BY NAME SELECT s_acctbal AS balance, s_name AS name, s_suppkey AS key FROM supplier WHERE s_acctbal < 0")
def set_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return customers.unionByName(suppliers)


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_of(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@query("SELECT DISTINCT line_id, mode FROM silver")
def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver(spark, sf_dir).select("line_id", "mode").distinct()


@query("SELECT * FROM line_days WHERE service_date = (SELECT max(service_date) FROM line_days)")
def topk_latest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = derive(silver(spark, sf_dir), "mart_line_day")
    last = days.agg(F.max("service_date").alias("service_date"))
    return days.join(F.broadcast(last), "service_date", "left_semi")  # one row


# json, arrays, functions


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def bronze_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze messages made from events: each holds one line, with a status, with an empty list of them, or without one; some
    are empty, some not JSON."""
    rows = events.silver(table(spark, sf_dir, "events")).withColumn("n", F.col("bronze_kafka_offset"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    none = F.lit(None).cast("array<struct<fromDate:string,toDate:string>>")
    periods = F.when(F.col("valid_from").isNotNull(), F.array(F.struct(text("valid_from").alias("fromDate"), text("valid_to").alias("toDate")))).otherwise(none)
    state = F.struct(F.col("line_id").alias("lineId"), F.when(F.col("n") % 17 != 3, F.col("status_severity")).alias("statusSeverity"), F.col("status_desc").alias("statusSeverityDescription"), "reason", periods.alias("validityPeriods"))
    line = F.struct(F.when(F.col("n") % 19 != 4, F.col("line_id")).alias("id"), F.col("line_name").alias("name"), F.col("mode").alias("modeName"), F.when(F.col("n") % 13 != 5, F.array(state)).alias("lineStatuses"))
    whole = F.to_json(F.struct(text("event_ts").alias("ingested_at"), F.col("producer_request_id").alias("request_id"), F.create_map(F.lit("etag"), F.concat(F.lit("W/"), "event_id")).alias("response_headers"), F.array(line).alias("payload"), F.lit(1).alias("schema_version")))
    payload = F.when(F.col("n") % 23 == 6, F.lit("")).when(F.col("n") % 29 == 7, F.lit("not json")).otherwise(whole)
    return rows.select(F.col("bronze_kafka_topic").alias("kafka_topic"), F.col("bronze_kafka_partition").alias("kafka_partition"), F.col("n").alias("kafka_offset"), F.col("bronze_kafka_ts").alias("kafka_ts"), F.col("bronze_kafka_key").alias("kafka_key"), payload.alias("payload"), "ingest_ts", F.col("payload_hash"))


MEASURED = "2024-03-01 00:00:00"
#: What bronze_of makes of an event: empty, malformed, or a status whose line, severity or whole list may be missing.
KIND = "CASE WHEN n % 23 = 6 THEN 'empty' WHEN n % 29 = 7 THEN 'malformed' ELSE 'status' END"
SENT = f"(SELECT *, {KIND} AS kind, n % 19 <> 4 AS has_line, n % 17 <> 3 AND n % 13 <> 5 AS has_severity FROM (SELECT *, CAST(event_id AS BIGINT) AS n FROM silver))"


@query(f"SELECT n AS kafka_offset, CASE WHEN kind = 'status' AND has_line THEN line_id END AS line_id, CASE WHEN kind = 'status' AND has_severity THEN status_severity END AS status_severity, CASE WHEN kind = 'status' AND n % 13 <> 5 THEN reason END AS reason, CASE WHEN kind = 'status' AND n % 13 <> 5 THEN valid_from END AS valid_from, CASE WHEN kind = 'status' AND n % 13 <> 5 AND valid_from IS NOT NULL THEN valid_to END AS valid_to, event_ts FROM {SENT} WHERE kind <> 'empty'")
def json_envelope_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = messages.statuses(messages.parsed(bronze_of(spark, sf_dir)), F.lit(MEASURED).cast("timestamp"))
    return found.select(F.col("bronze_kafka_offset").alias("kafka_offset"), "line_id", "status_severity", "reason", "valid_from", "valid_to", "event_ts")


@query(f"SELECT n AS kafka_offset, CASE WHEN kind = 'empty' THEN 'JSON_PARSE_FAILED' ELSE 'REQUIRED_FIELD_MISSING' END AS error_reason FROM {SENT} WHERE kind <> 'status' OR NOT has_line OR NOT has_severity")
def silver_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(MEASURED).cast("timestamp")
    rows = messages.parsed(bronze_of(spark, sf_dir))
    return messages.quarantined(messages.statuses(rows, now), messages.parse_failures(rows, now), now).select("kafka_offset", "error_reason")


@query(f"SELECT n AS bronze_kafka_offset, line_id, status_severity, status_desc, reason, is_disrupted FROM (SELECT n, line_id, status_severity, status_desc, reason, status_severity <> 10 AS is_disrupted FROM {SENT} WHERE kind = 'status' AND has_line AND has_severity)")
def silver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = messages.statuses(messages.parsed(bronze_of(spark, sf_dir)), F.lit(MEASURED).cast("timestamp"))
    return messages.clean_events(found).select("bronze_kafka_offset", "line_id", "status_severity", "status_desc", "reason", "is_disrupted")


@query(f"SELECT CAST(7 AS BIGINT) AS batch_id, 'line_status_events' AS dataset, count(*) FILTER (kind <> 'empty') AS total_rows, count(*) FILTER (kind = 'status' AND has_line AND has_severity) AS good_rows, count(*) FILTER (kind <> 'empty' AND NOT (kind = 'status' AND has_line AND has_severity)) AS bad_rows, count(*) FILTER (kind <> 'empty' AND NOT (kind = 'status' AND has_line)) AS null_line_id, count(*) FILTER (kind <> 'empty' AND NOT (kind = 'status' AND has_severity)) AS null_status_severity, count(*) FILTER (kind = 'empty') AS parse_fail_rows, min(event_ts) FILTER (kind <> 'empty') AS min_event_ts, max(event_ts) FILTER (kind <> 'empty') AS max_event_ts, TIMESTAMP '{MEASURED}' AS measured_at FROM {SENT}")
def silver_dq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(MEASURED).cast("timestamp")
    rows = messages.parsed(bronze_of(spark, sf_dir))
    return messages.metrics(messages.statuses(rows, now), messages.parse_failures(rows, now), 7, now)


@query("SELECT o_orderkey, dayofweek(o_orderdate) + 1 AS dow, dayname(o_orderdate) AS day_name, weekofyear(o_orderdate) AS week, month(o_orderdate) AS month, monthname(o_orderdate) AS month_name, quarter(o_orderdate) AS quarter, year(o_orderdate) AS year, dayofweek(o_orderdate) IN (0, 6) AS weekend, date_trunc('day', o_orderdate) AS day, strftime(o_orderdate, '%H') AS hour, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def fn_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.dayofweek(d).cast("long").alias("dow"), F.date_format(d, "EEEE").alias("day_name"), F.weekofyear(d).cast("long").alias("week"), F.month(d).cast("long").alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).cast("long").alias("quarter"), F.year(d).cast("long").alias("year"), fsql.is_weekend(d).alias("weekend"), F.date_trunc("day", d).alias("day"), F.date_format(d, "HH").alias("hour"), F.datediff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"))


@query("SELECT event_id, ts AS micros, date_trunc('second', ts) AS seconds, CAST(NULL AS TIMESTAMP) AS broken FROM events")
def fn_timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return rows.select("event_id", fsql.parse_iso_ts(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("micros"), fsql.parse_iso_ts(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("seconds"), fsql.parse_iso_ts(F.concat(F.lit("at "), F.col("event_id").cast("string"))).alias("broken"))


@query("SELECT event_id, ts AS six, date_trunc('milliseconds', ts) AS three, date_trunc('second', ts) AS none, ts AS six_bare, date_trunc('milliseconds', ts) AS three_bare, date_trunc('second', ts) AS none_bare, date_trunc('day', ts) AS day FROM events")
def fn_timestamp_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each format that messages use, with and without an offset, and a bare date."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    parsed = {n: fsql.parse_iso_ts(F.date_format("t", f)).alias(n) for n, f in zip(("six", "three", "none", "six_bare", "three_bare", "none_bare", "day"), (*fsql.ISO_FORMATS, "yyyy-MM-dd"), strict=True)}
    return rows.select("event_id", *parsed.values())


@query("SELECT event_id, CASE WHEN n % 23 <> 6 AND n % 29 <> 7 THEN 'W/' || event_id END AS etag FROM (SELECT event_id, CAST(event_id AS BIGINT) AS n FROM silver)")
def json_response_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header out of the map of response headers of a message."""
    found = messages.parsed(bronze_of(spark, sf_dir))
    return found.select(F.col("kafka_offset").cast("string").alias("event_id"), F.try_element_at("env.response_headers", F.lit("etag")).alias("etag"))


@query("SELECT event_id, sha256(props) AS payload_hash, sha256(regexp_replace(lower(trim(coalesce(reason, ''))), '\\s+', ' ', 'g')) AS reason_hash FROM (SELECT s.event_id, reason, props FROM silver s JOIN events e ON s.event_id = CAST(e.event_id AS VARCHAR))")
def fn_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver(spark, sf_dir).select("event_id", "payload_hash", status.reason_hash(F.col("reason")).alias("reason_hash"))


@query()
def fn_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of events: a 64-bit hash that DuckDB doesn't have."""
    found = messages.statuses(messages.parsed(bronze_of(spark, sf_dir)), F.lit(MEASURED).cast("timestamp"))
    return messages.clean_events(found).select("event_id", "bronze_kafka_offset", "line_id")


@query("SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS most, least(l_discount, l_tax) AS least, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS thousands, abs(l_discount - l_tax) AS apart FROM lineitem")
def fn_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(d, t).alias("most"), F.least(d, t).alias("least"), F.ceil(F.col("l_extendedprice") / 1000).alias("thousands"), F.abs(d - t).alias("apart"))


# data quality: how many rows violate each check


def _failures(spark: SparkSession, sf_dir: str, checks: list) -> DataFrame:
    made = {"silver": silver(spark, sf_dir)}
    return quality.counts(checks, lambda n: derive(made["silver"], n, F.lit(AS_OF).cast("timestamp"), made))


TODAY = AS_OF[:10]
CTE_OF = {"silver": "silver", "dim_line": "dim_line", "dim_status": "dim_status", "dim_datetime": "dim_datetime", "fact_line_status_interval": "intervals", "fact_line_status_change": "changes", "int_line_hour_aggregate": "hours", "mart_line_hour": "line_hours", "mart_line_day": "line_days", "mart_network_hour": "network_hours", "mart_network_day": "network_days", "current_line_status": "current"}


def _checks(prefix: str) -> list:
    return [c for c in quality.suite(F.lit(TODAY).cast("date")) if c.name.startswith(prefix)]


def _count(name: str, rows: str) -> str:
    return f"SELECT '{name}' AS \"check\", count(*) AS failures FROM {rows}"


def _list(values: list) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


@query(" UNION ALL ".join(_count(f"not_null_{t}_{c}", f"{CTE_OF[t]} WHERE {c} IS NULL") for t, cs in quality.NOT_NULL.items() for c in cs))
def dq_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass per table: the nulls of all its columns are counted together."""
    base = silver(spark, sf_dir)
    made = {"silver": base}
    parts = []
    for t, columns in quality.NOT_NULL.items():
        df = derive(base, t, F.lit(AS_OF).cast("timestamp"), made)
        sums = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        parts.append(sums.select(F.explode(F.array(*[F.struct(F.lit(f"not_null_{t}_{c}").alias("check"), F.col(c).alias("failures")) for c in columns])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionAll, parts)


@query(" UNION ALL ".join(_count(f"unique_{t}_{c}", f"(SELECT {c} FROM {CTE_OF[t]} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)") for t, c in quality.UNIQUE.items()))
def dq_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir, _checks("unique_"))


@query(" UNION ALL ".join(_count(f"accepted_values_{t}_{c}", f"{CTE_OF[t]} WHERE {c} NOT IN ({_list(v)})") for t, c, v in quality.ACCEPTED))
def dq_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir, _checks("accepted_values_"))


@query(" UNION ALL ".join([_count(f"relationships_{t}_line_id", f"{CTE_OF[t]} WHERE line_id IS NOT NULL AND line_id NOT IN (SELECT line_id FROM dim_line)") for t in quality.LINES] + [_count(f"relationships_{t}_{c}", f"{CTE_OF[t]} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT status_severity FROM dim_status)") for t, c in quality.SEVERITIES]))
def dq_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir, _checks("relationships_"))


@query(f"SELECT newest, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(newest)) / 1000000 AS age_seconds, CASE WHEN TIMESTAMP '{AS_OF}' - newest > INTERVAL 2 HOUR THEN 'error' WHEN TIMESTAMP '{AS_OF}' - newest > INTERVAL 30 MINUTE THEN 'warn' ELSE 'pass' END AS status FROM (SELECT max(ingest_ts) AS newest FROM silver)")
def dq_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.freshness(silver(spark, sf_dir), "ingest_ts", F.lit(AS_OF).cast("timestamp"))


SECONDS_SQL = "total_seconds < 0 OR total_seconds > {} OR good_service_seconds NOT BETWEEN 0 AND total_seconds OR disruption_seconds NOT BETWEEN 0 AND total_seconds"
NETWORK_SQL = "lines_impacted > lines_reporting OR least(lines_reporting, lines_impacted, total_seconds, good_service_seconds, disruption_seconds) < 0 OR abs(total_seconds - good_service_seconds - disruption_seconds) > 1 OR network_good_service_pct NOT BETWEEN 0 AND 1"
INVARIANTS = {
    "trend_regression": f"(SELECT *, lag(bad) OVER w AS prev_bad, lag(service_date) OVER w AS prev_date, max(service_date) OVER () AS last_date FROM (SELECT d.service_date, count(b.network_good_service_pct) >= 7 AND any_value(d.lines_reporting) >= 5 AND coalesce(any_value(d.network_good_service_pct) < quantile_disc(b.network_good_service_pct, 0.5) - 0.2, false) AS bad FROM network_days d LEFT JOIN network_days b ON b.service_date < d.service_date WHERE d.service_date < DATE '{TODAY}' GROUP BY 1) WINDOW w AS (ORDER BY service_date)) WHERE service_date = last_date AND bad AND prev_bad AND date_diff('day', prev_date, service_date) = 1",
    "interval_bounds": "intervals WHERE interval_seconds < 1 OR interval_end_ts <= interval_start_ts OR status_severity NOT BETWEEN 0 AND 20",
    "no_consecutive_duplicate_state": "(SELECT *, lag(new_status_severity) OVER w AS s, lag(new_reason_text_hash) OVER w AS h FROM changes WINDOW w AS (PARTITION BY line_id ORDER BY change_ts, source_ingest_ts, new_status_severity, new_reason_text_hash)) WHERE s = new_status_severity AND h IS NOT DISTINCT FROM new_reason_text_hash",
    "prev_alignment": "changes c LEFT JOIN (SELECT line_id, change_ts, count(*) AS n, min(new_status_severity) AS s, min(new_reason_text_hash) AS h FROM changes GROUP BY 1, 2) p ON p.line_id = c.line_id AND p.change_ts IS NOT DISTINCT FROM c.prev_change_ts JOIN (SELECT line_id, min(change_ts) AS first FROM changes GROUP BY 1) f ON f.line_id = c.line_id WHERE NOT (coalesce(n = 1 AND s IS NOT DISTINCT FROM prev_status_severity AND h IS NOT DISTINCT FROM prev_reason_text_hash, false) OR coalesce(n IS NULL AND prev_change_ts < first, false))",
    "change_timing_bounds": "changes WHERE time_since_prev_seconds IS NULL OR time_since_prev_seconds < 0 OR time_in_new_state_seconds < 1",
    "no_duplicate_windows": "(SELECT 1 FROM intervals GROUP BY line_id, interval_start_ts, interval_end_ts HAVING count(*) > 1)",
    "continuity": "(SELECT interval_end_ts, lead(interval_start_ts) OVER (PARTITION BY line_id ORDER BY interval_start_ts, ingest_ts, status_severity) AS n FROM intervals) WHERE n IS NOT NULL AND interval_end_ts IS DISTINCT FROM n",
    "day_component_balance": "line_days WHERE abs(total_seconds - good_service_seconds - disruption_seconds) > 1",
    "day_seconds_bounds": "line_days WHERE " + SECONDS_SQL.format(86400),
    "day_unique_grain": "(SELECT 1 FROM line_days GROUP BY service_date, line_id HAVING count(*) > 1)",
    "hour_component_balance": "line_hours WHERE abs(total_seconds - good_service_seconds - disruption_seconds) > 1",
    "hour_seconds_bounds": "line_hours WHERE " + SECONDS_SQL.format(3600),
    "hour_unique_grain": "(SELECT 1 FROM line_hours GROUP BY bucket_hour, line_id HAVING count(*) > 1)",
    "network_day_bounds": "network_days WHERE " + NETWORK_SQL,
    "network_hour_bounds": "network_hours WHERE " + NETWORK_SQL,
}


def _invariant(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _failures(spark, sf_dir, [c for c in quality.suite(F.lit(TODAY).cast("date")) if c.name == name])

    run.__name__ = f"dq_{name}"
    query(_count(name, INVARIANTS[name]))(run)


for _name in INVARIANTS:
    _invariant(_name)


# keyed tables, refreshes, streams, files


def _cut() -> Column:
    return F.lit("2024-01-20").cast("timestamp")


@query("SELECT * FROM line_days")
def inc_full_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built from the events before a cut, then refreshed with all of them; the day mart is that of a full build."""
    rows = silver(spark, sf_dir)
    built = incremental.Gold(spark, Config(warehouse=scratch(spark, "gold")), names={"mart_line_day"})
    built.full(rows.filter(F.col("ingest_ts") < _cut()))
    built.refresh(rows)
    return built.table("mart_line_day").read()


@query("SELECT line_id FROM (SELECT line_id, max(ingest_ts) AS m, max(ingest_ts) FILTER (event_ts < TIMESTAMP '2024-01-20') AS seen FROM silver GROUP BY 1) WHERE seen IS NULL OR m > seen")
def inc_changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver(spark, sf_dir)
    return incremental.changed_keys(rows, "line_id", "ingest_ts", rows.filter(F.col("event_ts") < _cut()), "ingest_ts")


def _prices(spark: SparkSession, sf_dir: str) -> tuple[store.Table, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    held = store.Table(spark, scratch(spark, "orders"), orders.schema, "o_orderstatus")
    held.overwrite(orders.filter("o_orderkey % 3 <> 0"))
    return held, orders.filter("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(-1.0))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, news = _prices(spark, sf_dir)
    held.upsert(news, ["o_orderstatus", "o_orderkey"])
    held.upsert(news, ["o_orderstatus", "o_orderkey"])
    return held.read()


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, news = _prices(spark, sf_dir)
    held.upsert(news, ["o_orderstatus", "o_orderkey"], update=["o_totalprice"])
    return held.read()


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 ELSE o_orderkey % 3 <> 0 END")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, news = _prices(spark, sf_dir)
    held.replace_parts(news.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)))
    return held.read()


def _records(spark: SparkSession, sf_dir: str) -> str:
    """A topic's records as files."""
    path = scratch(spark, "topic")
    b = bronze_of(spark, sf_dir)
    b.select(F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.col("kafka_ts").alias("timestamp"), F.col("kafka_key").cast("binary").alias("key"), F.col("payload").cast("binary").alias("value")).write.parquet(path)
    return path


ONCE = {"availableNow": True}


def _stream_bronze(spark: SparkSession, sf_dir: str) -> str:
    at = scratch(spark, "bronze")
    jobs.append_bronze(jobs.streams.files(spark, _records(spark, sf_dir)), at, scratch(spark, "offsets"), ONCE).awaitTermination()
    return at


@query(f"SELECT n AS kafka_offset, 'line_status' AS kafka_topic, event_ts AS kafka_ts, kind FROM {SENT}")
def stream_bronze_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("payload") == "", "empty").when(F.col("payload") == "not json", "malformed").otherwise("status")
    return pinned(spark).read.parquet(_stream_bronze(spark, sf_dir)).filter(F.col("payload_hash") == F.sha2("payload", 256)).select("kafka_offset", "kafka_topic", "kafka_ts", kind.alias("kind"))


@query(f"SELECT n AS kafka_offset, event_ts AS kafka_ts, kind FROM {SENT}")
def stream_raw_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(pinned(spark), "raw")
    jobs.land_raw(jobs.streams.files(spark, _records(spark, sf_dir)), at, scratch(spark, "offsets"), ONCE).awaitTermination()
    kind = F.when(F.col("payload") == "", "empty").when(F.col("payload") == "not json", "malformed").otherwise("status")
    return spark.read.parquet(at).filter(F.col("ingest_date") == F.to_date("ingest_ts")).select("kafka_offset", "kafka_ts", kind.alias("kind"))


@query(f"SELECT n AS bronze_kafka_offset, line_id, status_severity, reason, event_ts FROM {SENT} WHERE kind = 'status' AND has_line AND has_severity")
def stream_silver_foreachbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze through the silver job twice, from new offsets: the second run changes nothing."""
    config, at = Config(warehouse=scratch(pinned(spark), "lake")), _stream_bronze(spark, sf_dir)
    job = jobs.Silver(spark, config)
    for _ in range(2):
        job.start(jobs.bronze_stream(spark, at), scratch(spark, "offsets"), ONCE).awaitTermination()
    return job.events.read().select("bronze_kafka_offset", "line_id", "status_severity", "reason", "event_ts")


def _measured_silver(spark: SparkSession, sf_dir: str) -> jobs.Silver:
    """Bronze through a catalog table and the silver job, measured at a literal time."""
    name = f"bronze_{uuid.uuid4().hex}"
    jobs.append_bronze_table(jobs.streams.files(pinned(spark), _records(spark, sf_dir)), name, scratch(spark, "offsets"), ONCE).awaitTermination()
    job = jobs.Silver(spark, Config(warehouse=scratch(spark, "lake")), clock=lambda: datetime.fromisoformat(MEASURED))
    job.start(jobs.streams.table(spark, name), scratch(spark, "offsets"), ONCE).awaitTermination()
    spark.sql(f"DROP TABLE {name}")
    return job


@query(SQL_OF["silver_quarantine"])
def stream_quarantine_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantine table after a batch of the table stream."""
    return _measured_silver(spark, sf_dir).quarantine.read().select("kafka_offset", "error_reason")


@query(SQL_OF["silver_dq_metrics"].replace("CAST(7 AS BIGINT)", "CAST(0 AS BIGINT)"))
def stream_metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table after a batch of the table stream; a batch without rows adds nothing."""
    job = _measured_silver(spark, sf_dir)
    job.process(spark.createDataFrame([], messages.BRONZE), 1)
    return job.metrics.read()


@query("SELECT CAST(c_custkey AS VARCHAR) AS customer_key, c_name AS name, c_mktsegment AS name_2, 'a, \"b\"' AS name_3 FROM customer")
def csv_loader_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited file with repeated headers and quoted text, loaded as a table."""
    at = scratch(pinned(spark), "customers")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Customer Key"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("NAME "), F.lit('a, "b"').alias("näme"))
    rows.coalesce(1).write.option("header", True).option("escape", '"').csv(at)
    return delimited.load(spark, at, scratch(spark, "lake")).read()


@query("SELECT line_id, CAST(count(*) AS BIGINT) AS n FROM line_days GROUP BY 1")
def view_adhoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a view of a built table."""
    built = store.Table(spark, scratch(pinned(spark), "days"), incremental.Gold(spark).schema("mart_line_day"))
    built.overwrite(derive(silver(spark, sf_dir), "mart_line_day"))
    built.read().createOrReplaceTempView("gold_mart_line_day")
    return spark.sql("SELECT line_id, count(*) AS n FROM gold_mart_line_day GROUP BY line_id")
