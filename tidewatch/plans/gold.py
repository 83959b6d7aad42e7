"""The gold models as functions of DataFrames.

Intervals of a line follow one another: one starts at each distinct start and ends where the next one does. Everything else is
derived from them. All orders are total, so results don't depend on how rows are laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import count_distinct_when, floor_ts, is_weekend, safe_divide, seconds_between, seconds_up, sum_when
from ..functions.status import UNKNOWN, disruption_category, is_good_service, reason_hash, recovery_flag, severity_weight, status_category
from ..operators.neighbours import following, islands, sliced

STAGED = ["event_id", "event_ts", "ingest_ts", "line_id", "line_name", "mode", "status_severity", "reason", "valid_from", "valid_to", "is_disrupted", "payload_hash", "producer_ingest_ts", "producer_request_id", "schema_version"]
HOUR, DAY = 3600, 86_400


def staged(silver: DataFrame) -> DataFrame:
    """Silver events that name a line, with a description."""
    return silver.filter(F.col("line_id").isNotNull()).select(*STAGED, F.coalesce("status_desc", F.lit(UNKNOWN)).alias("status_desc"))


def latest(value: str, ts: str) -> Column:
    """The value at the latest time; of several the largest, null last."""
    return F.max(F.struct(ts, value))[value]


def dim_line(stg: DataFrame) -> DataFrame:
    return stg.groupBy("line_id").agg(latest("line_name", "event_ts").alias("line_name"), latest("mode", "event_ts").alias("mode"), F.min("event_ts").alias("first_seen_ts"), F.max("event_ts").alias("last_seen_ts"), F.max("ingest_ts").alias("last_ingest_ts"))


def dim_status(stg: DataFrame) -> DataFrame:
    severity = F.col("status_severity")
    seen = stg.groupBy("status_severity").agg(latest("status_desc", "ingest_ts").alias("status_desc"), F.max("ingest_ts").alias("last_ingest_ts"))
    return seen.select("status_severity", "status_desc", status_category(severity).alias("status_category"), severity_weight(severity).alias("severity_weight"), is_good_service(severity).alias("is_good_service"), "last_ingest_ts")


def dim_datetime(stg: DataFrame) -> DataFrame:
    """24 hours of each date on which a status began."""
    dates = stg.groupBy(F.to_date(F.coalesce("valid_from", "event_ts")).alias("date_key")).agg(F.max("ingest_ts").alias("source_ingest_ts"))
    d = F.col("date_key")
    hours = dates.withColumn("hour_of_day", F.explode(F.sequence(F.lit(0), F.lit(23))))
    calendar = {"day_of_week": F.dayofweek(d), "day_name": F.date_format(d, "EEEE"), "week_of_year": F.weekofyear(d), "month_num": F.month(d), "month_name": F.date_format(d, "MMMM"), "quarter_num": F.quarter(d), "year_num": F.year(d), "is_weekend": is_weekend(d)}
    return hours.select("date_key", "hour_of_day", *[c.alias(n) for n, c in calendar.items()], "source_ingest_ts")


def fact_interval(stg: DataFrame) -> DataFrame:
    """One interval per line and start, from the latest version of its event; the last of a line may be open."""
    bad = F.coalesce("is_disrupted", ~is_good_service(F.col("status_severity")))
    prepared = stg.withColumn("is_disrupted", bad).withColumn("interval_start_ts", F.when(F.col("is_disrupted"), F.coalesce("valid_from", "event_ts")).otherwise(F.col("event_ts")))
    version = F.struct("event_ts", "ingest_ts", "event_id", "valid_from", "valid_to", "status_severity", "is_disrupted", "reason")
    newest = prepared.groupBy("line_id", "interval_start_ts").agg(F.max(version).alias("v")).select("line_id", "interval_start_ts", "v.*")
    ordered = following(sliced(newest, "interval_start_ts"), "line_id", ["interval_start_ts"], {"next_start_ts": "interval_start_ts"})
    declared = F.when(F.col("is_disrupted") & (F.col("valid_to") > F.col("interval_start_ts")), F.col("valid_to"))
    closed = ordered.withColumn("interval_end_ts", F.coalesce("next_start_ts", declared))
    return closed.select("line_id", "event_id", "event_ts", F.col("valid_from").alias("source_valid_from"), F.col("valid_to").alias("source_valid_to"), "interval_start_ts", "interval_end_ts", seconds_up(F.col("interval_start_ts"), F.col("interval_end_ts")).alias("interval_seconds"), "status_severity", is_good_service(F.col("status_severity")).alias("is_good_service"), "is_disrupted", disruption_category(F.col("reason")).alias("disruption_category"), "reason", reason_hash(F.col("reason")).alias("reason_text_hash"), "ingest_ts")


def fact_change(intervals: DataFrame) -> DataFrame:
    """Runs of intervals in one state (severity and reason), each against the run before; a line's first run has none."""
    rows = sliced(intervals.select("line_id", "interval_start_ts", "status_severity", "reason_text_hash", "ingest_ts", "interval_seconds"), "interval_start_ts")
    runs = islands(rows, "line_id", ["interval_start_ts", "ingest_ts"], ["status_severity", "reason_text_hash"])
    changes = runs.groupBy("line_id", F.col("run.interval_start_ts").alias("change_ts")).agg(F.max("before").alias("before"), F.max("ingest_ts").alias("source_ingest_ts"), F.max("status_severity").alias("new_status_severity"), F.max("reason_text_hash").alias("new_reason_text_hash"), F.when(F.count_if(F.col("interval_seconds").isNull()) == 0, F.sum("interval_seconds")).alias("time_in_new_state_seconds"))
    changes = changes.withColumns({"prev_change_ts": F.col("before.interval_start_ts"), "prev_status_severity": F.col("before.status_severity"), "prev_reason_text_hash": F.col("before.reason_text_hash")})
    return changes.filter(F.col("prev_status_severity").isNotNull()).select("line_id", "change_ts", "prev_change_ts", seconds_between(F.col("prev_change_ts"), F.col("change_ts")).alias("time_since_prev_seconds"), "prev_status_severity", "new_status_severity", "prev_reason_text_hash", "new_reason_text_hash", recovery_flag(F.col("prev_status_severity"), F.col("new_status_severity")).alias("recovery_flag"), "time_in_new_state_seconds", "source_ingest_ts")


def scored(intervals: DataFrame, statuses: DataFrame) -> DataFrame:
    """Closed intervals with the weight of their severity (0 if it is unknown)."""
    closed = intervals.filter(F.col("interval_end_ts").isNotNull())
    weights = statuses.select("status_severity", "severity_weight")
    return closed.join(weights, "status_severity", "left").select(*intervals.columns, F.coalesce("severity_weight", F.lit("0.0").cast("decimal(2,1)")).alias("severity_weight"))


def hour_aggregate(scored_: DataFrame) -> DataFrame:
    """Seconds of each line in each hour that its intervals reach into."""
    start, end, hour = F.col("interval_start_ts"), F.col("interval_end_ts"), F.col("bucket_hour")
    each = scored_.select("line_id", "status_severity", "is_good_service", "is_disrupted", "ingest_ts", "severity_weight", "interval_start_ts", "interval_end_ts", F.explode(F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", end), F.expr("INTERVAL 1 HOUR"))).alias("bucket_hour"))
    parts = each.withColumns({"from": F.greatest(start, hour), "to": F.least(end, hour + F.expr("INTERVAL 1 HOUR"))}).filter(F.col("to") > F.col("from")).withColumn("s", seconds_between(F.col("from"), F.col("to")))
    s = F.col("s")
    sums = parts.groupBy("bucket_hour", "line_id").agg(F.sum(s).alias("total"), sum_when(F.col("is_good_service"), s).alias("good"), sum_when(F.col("is_disrupted"), s).alias("bad"), F.sum(s * F.col("severity_weight")).alias("severity_weighted_seconds"), F.count_if("is_disrupted").alias("incident_count"), F.min("status_severity").alias("worst_status_severity"), F.max("ingest_ts").alias("max_source_ingest_ts"))
    return sums.select("bucket_hour", F.to_date("bucket_hour").alias("service_date"), "line_id", "severity_weighted_seconds", "incident_count", "worst_status_severity", "max_source_ingest_ts", *capped(HOUR))


def capped(most: int) -> list[Column]:
    """Totals of at most the bucket's length, parts of at most the total."""
    total = F.least(F.col("total"), F.lit(most))
    return [total.alias("total_seconds"), F.least(F.col("good"), total).alias("good_service_seconds"), F.least(F.col("bad"), total).alias("disruption_seconds")]


def mart_line_hour(hours: DataFrame, lines: DataFrame, changes: DataFrame) -> DataFrame:
    counts = changes.groupBy("line_id", F.date_trunc("hour", "change_ts").alias("bucket_hour")).agg(F.count(F.lit(1)).alias("changed"))
    both = hours.join(counts, ["line_id", "bucket_hour"], "left").join(lines.select("line_id", "line_name", "mode"), "line_id", "left")
    return both.select("bucket_hour", "service_date", "line_id", "line_name", "mode", "total_seconds", "good_service_seconds", "disruption_seconds", "severity_weighted_seconds", "incident_count", "worst_status_severity", F.coalesce("changed", F.lit(0).cast("long")).alias("state_change_count"), safe_divide(F.col("good_service_seconds"), F.col("total_seconds")).alias("good_service_pct"), "max_source_ingest_ts")


def mart_line_day(hours: DataFrame, scored_: DataFrame, changes: DataFrame) -> DataFrame:
    """Hours of a day summed, with the incidents that began and the changes that fell on it.

    Percentiles are exact: intervals of a line don't overlap, so those that begin on a day have some 420 lengths in whole seconds
    at most, which is what a group holds.
    """
    days = hours.groupBy("service_date", "line_id").agg(F.max("line_name").alias("line_name"), F.max("mode").alias("mode"), F.sum("total_seconds").alias("total"), F.sum("good_service_seconds").alias("good"), F.sum("disruption_seconds").alias("bad"), F.sum("severity_weighted_seconds").alias("severity_weighted_seconds"), F.sum("incident_count").alias("incident_count"), F.min("worst_status_severity").alias("worst_status_severity"), F.max("max_source_ingest_ts").alias("hours_ts"))
    length = F.col("interval_seconds")
    incidents = scored_.filter(F.col("is_disrupted")).groupBy("line_id", F.to_date("interval_start_ts").alias("service_date")).agg(F.avg(length).alias("mean_incident_duration_seconds"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY interval_seconds)").cast("long").alias(f"p{round(100 * q)}_incident_duration_seconds") for q in (0.5, 0.95)], F.max(length).alias("max_incident_duration_seconds"), F.max("ingest_ts").alias("incidents_ts"))
    moves = changes.groupBy("line_id", F.to_date("change_ts").alias("service_date")).agg(F.count(F.lit(1)).alias("moved"), F.avg("time_in_new_state_seconds").alias("time_in_state_avg_seconds"), F.avg(F.when(F.col("recovery_flag"), F.col("time_since_prev_seconds"))).alias("time_to_recover_avg_seconds"), F.max("source_ingest_ts").alias("moves_ts"))
    both = days.join(incidents, ["line_id", "service_date"], "left").join(moves, ["line_id", "service_date"], "left")
    total, good, bad = capped(DAY)
    return both.withColumns({"t": total, "g": good, "b": bad}).select(
        "service_date", "line_id", "line_name", "mode", F.col("t").alias("total_seconds"), F.col("g").alias("good_service_seconds"), F.col("b").alias("disruption_seconds"), "severity_weighted_seconds", "incident_count",
        "mean_incident_duration_seconds", "p50_incident_duration_seconds", "p95_incident_duration_seconds", "max_incident_duration_seconds", F.coalesce("moved", F.lit(0).cast("long")).alias("num_state_changes"), "time_in_state_avg_seconds", "time_to_recover_avg_seconds", "worst_status_severity",
        safe_divide(F.col("g"), F.col("t")).alias("good_service_pct"), F.greatest("hours_ts", F.coalesce("incidents_ts", floor_ts()), F.coalesce("moves_ts", floor_ts())).alias("max_source_ingest_ts"),
    )


def _network(by: list[str], lines: DataFrame) -> DataFrame:
    good, total = F.sum("good_service_seconds"), F.sum("total_seconds")
    return lines.groupBy(*by).agg(F.count_distinct("line_id").alias("lines_reporting"), count_distinct_when(F.col("line_id"), F.col("disruption_seconds") > 0).alias("lines_impacted"), total.alias("total_seconds"), good.alias("good_service_seconds"), F.sum("disruption_seconds").alias("disruption_seconds"), F.sum("severity_weighted_seconds").alias("severity_weighted_seconds"), safe_divide(good, total).alias("network_good_service_pct"), F.max("max_source_ingest_ts").alias("max_source_ingest_ts"))


def mart_network_hour(line_hours: DataFrame) -> DataFrame:
    return _network(["bucket_hour", "service_date"], line_hours)


def mart_network_day(line_days: DataFrame) -> DataFrame:
    return _network(["service_date"], line_days)


def current_status(intervals: DataFrame, lines: DataFrame, statuses: DataFrame, as_of: Column) -> DataFrame:
    """The newest interval of each line, open or not, and how long it was there at a time."""
    rest = ["status_severity", "is_disrupted", "disruption_category", "reason", "interval_end_ts"]
    rank = F.struct("interval_start_ts", "ingest_ts", (-F.col("status_severity")).alias("up"), *rest)
    newest = intervals.groupBy("line_id").agg(F.max(rank).alias("r")).select("line_id", "r.*")
    both = newest.join(lines.select("line_id", "line_name", "mode"), "line_id", "left").join(statuses.select("status_severity", "status_desc"), "status_severity", "left")
    minutes = seconds_between(F.col("interval_start_ts"), as_of) / F.lit("60.0").cast("decimal(3,1)")
    return both.select("line_id", "line_name", "mode", "status_severity", "status_desc", "is_disrupted", "disruption_category", "reason", F.col("interval_start_ts").alias("status_valid_from"), F.col("interval_end_ts").alias("status_valid_to"), F.col("ingest_ts").alias("last_ingest_ts"), minutes.alias("last_changed_minutes_ago"))
