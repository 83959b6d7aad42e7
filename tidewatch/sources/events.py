"""The events table as clean status events (the silver schema)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.status import CATEGORIES, is_disrupted

SILVER = "event_id string, event_ts timestamp, ingest_ts timestamp, line_id string, line_name string, mode string, status_severity int, status_desc string, reason string, valid_from timestamp, valid_to timestamp, is_disrupted boolean, payload_hash string, bronze_kafka_topic string, bronze_kafka_partition int, bronze_kafka_offset bigint, bronze_kafka_ts timestamp, bronze_kafka_key string, producer_ingest_ts timestamp, producer_request_id string, schema_version int"
SILVER_COLUMNS = [x.split()[0] for x in SILVER.split(", ")]
MODES = ["metro", "tram", "rail", "river"]
SEVERITIES = {"view": 10, "click": 9, "purchase": 6, "error": 3, "signup": 20}
#: Upper bounds of props.k, and the reason below each.
REASONS = [(20, "  Signal   failure at  X "), (40, "Train cancellations on the line"), (55, "Power supply problem"), (70, "Customer incident at Y"), (80, "   "), (90, "Planned closure"), (100, "Something else happened")]
TOPIC = "line_status"


def silver(events: DataFrame) -> DataFrame:
    """One status event per row of events; timestamps without a zone are taken as UTC."""
    events = events.withColumn("k", F.from_json("props", "k int")["k"])  # a column of its own, so that it's parsed once
    ts, k = F.col("ts").cast("timestamp"), F.col("k")
    line = F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")
    severity = F.create_map(*[x for pair in SEVERITIES.items() for x in map(F.lit, pair)])[F.col("event_type")]
    reason = F.lit(None).cast("string")
    for below, text in reversed(REASONS):
        reason = F.when(k < below, text).otherwise(reason)
    described = F.create_map(*[x for pair in CATEGORIES.items() for x in map(F.lit, pair)])[severity]
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        ts.alias("event_ts"),
        (F.date_trunc("hour", ts) + F.expr("INTERVAL 1 HOUR")).alias("ingest_ts"),
        F.concat(F.lit("line_"), line).alias("line_id"),
        F.concat(F.lit("Line "), line).alias("line_name"),
        F.get(F.array(*map(F.lit, MODES)), (F.col("user_id") % 4).cast("int")).alias("mode"),
        severity.alias("status_severity"),
        F.when(k % 10 != 9, described).alias("status_desc"),
        F.when(kind != "view", reason).alias("reason"),
        F.when(kind.isin("error", "purchase"), F.date_trunc("minute", ts)).alias("valid_from"),
        F.when(kind.isin("error", "signup"), F.timestamp_micros(F.unix_micros(ts) + F.floor(F.col("value") * 60 + 0.5).cast("long") * 1_000_000)).alias("valid_to"),
        F.when(k % 10 != 7, is_disrupted(severity)).alias("is_disrupted"),
        F.sha2(F.col("props"), 256).alias("payload_hash"),
        F.lit(TOPIC).alias("bronze_kafka_topic"),
        F.lit(0).alias("bronze_kafka_partition"),
        F.col("event_id").alias("bronze_kafka_offset"),
        ts.alias("bronze_kafka_ts"),
        F.lit(TOPIC + "|all").alias("bronze_kafka_key"),
        ts.alias("producer_ingest_ts"),
        F.col("event_id").cast("string").alias("producer_request_id"),
        F.lit(1).alias("schema_version"),
    )
