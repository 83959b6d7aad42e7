"""Message envelopes: their schema, the poller that makes them, and their parsing into status events."""

from __future__ import annotations

import argparse
import hashlib
import json
import os
import random
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import parse_iso_ts
from ..functions.status import is_disrupted
from ..operators.store import first_of
from .events import SILVER_COLUMNS

STATUS = "struct<lineId:string,statusSeverity:int,statusSeverityDescription:string,reason:string,validityPeriods:array<struct<fromDate:string,toDate:string>>>"
LINE = f"struct<id:string,name:string,modeName:string,created:string,modified:string,lineStatuses:array<{STATUS}>>"
ENVELOPE = f"source string, endpoint string, modes array<string>, request_id string, ingested_at string, http_status int, duration_ms bigint, response_headers map<string,string>, payload_hash string, payload array<{LINE}>, schema_version int"
BRONZE = "kafka_topic string, kafka_partition int, kafka_offset bigint, kafka_ts timestamp, kafka_key string, payload string, ingest_ts timestamp, payload_hash string"
QUARANTINE = "ingest_ts timestamp, kafka_topic string, kafka_partition int, kafka_offset bigint, kafka_key string, payload string, error_reason string, measured_at timestamp"
METRICS = "batch_id bigint, dataset string, total_rows bigint, good_rows bigint, bad_rows bigint, null_line_id bigint, null_status_severity bigint, parse_fail_rows bigint, min_event_ts timestamp, max_event_ts timestamp, measured_at timestamp"
PARSE_FAILED, FIELD_MISSING = "JSON_PARSE_FAILED", "REQUIRED_FIELD_MISSING"
OFFSET = ["kafka_topic", "kafka_partition", "kafka_offset"]
EVENT_KEY = ["bronze_kafka_topic", "bronze_kafka_partition", "bronze_kafka_offset", "line_id", "status_severity"]


def names(ddl: str) -> list[str]:
    """Column names of a flat schema."""
    return [x.split()[0] for x in ddl.split(", ")]


# parsing


def parsed(bronze: DataFrame, strict: bool = False) -> DataFrame:
    """bronze with env, the message as a struct, null where there is no message.

    By default only an empty or null payload has none, and text that isn't a JSON object gives a struct of nulls, so that its
    row is missing its required fields. With strict, such text counts as not parsed too.
    """
    types = dict(bronze.dtypes)
    time = lambda c: (F.col(c) if types[c] == "timestamp" else parse_iso_ts(F.col(c))).alias(c)
    rows = bronze.select(time("ingest_ts"), "kafka_topic", F.col("kafka_partition").cast("int"), F.col("kafka_offset").cast("bigint"), time("kafka_ts"), F.col("kafka_key").cast("string"), F.col("payload").cast("string"), F.col("payload_hash").cast("string"))
    env = F.from_json("payload", ENVELOPE)
    if strict:
        env = F.when(F.json_object_keys("payload").isNotNull(), env)
    return rows.withColumn("env", env)


def rejected(rows: DataFrame, reason: str, measured_at: Column) -> DataFrame:
    return rows.select("ingest_ts", *OFFSET, "kafka_key", "payload", F.lit(reason).alias("error_reason"), measured_at.alias("measured_at"))


def parse_failures(rows: DataFrame, measured_at: Column) -> DataFrame:
    return rejected(rows.filter(F.col("env").isNull()), PARSE_FAILED, measured_at)


def statuses(rows: DataFrame, measured_at: Column) -> DataFrame:
    """One row per status of each line of each message, and one with nulls for a message or line without any."""
    return outcomes(rows.filter(F.col("env").isNotNull()), measured_at).drop("_failed")


def outcomes(rows: DataFrame, measured_at: Column) -> DataFrame:
    """statuses() of all messages, and one row for each that didn't parse, with _failed; a payload only where it goes to
    quarantine. This is all that the silver job needs, so a batch is kept once and without its complete messages."""
    sent = parse_iso_ts(F.col("env.ingested_at"))
    base = rows.select("*", sent.alias("producer_ingest_ts"), F.explode_outer("env.payload").alias("line"))
    each = base.select("*", F.explode_outer("line.lineStatuses").alias("status"))
    period = F.when(F.size("status.validityPeriods") > 0, F.get("status.validityPeriods", F.lit(0)))
    severity = F.col("status.statusSeverity")
    return each.select(
        F.xxhash64(*OFFSET, "line.id", severity).cast("string").alias("event_id"),
        F.coalesce("producer_ingest_ts", "kafka_ts", "ingest_ts").alias("event_ts"),
        measured_at.alias("ingest_ts"),
        F.col("line.id").alias("line_id"),
        F.col("line.name").alias("line_name"),
        F.col("line.modeName").alias("mode"),
        severity.alias("status_severity"),
        F.col("status.statusSeverityDescription").alias("status_desc"),
        F.col("status.reason").alias("reason"),
        parse_iso_ts(period["fromDate"]).alias("valid_from"),
        parse_iso_ts(period["toDate"]).alias("valid_to"),
        is_disrupted(severity).alias("is_disrupted"),
        F.coalesce("env.payload_hash", "payload_hash").alias("payload_hash"),
        F.col("kafka_topic").alias("bronze_kafka_topic"),
        F.col("kafka_partition").alias("bronze_kafka_partition"),
        F.col("kafka_offset").alias("bronze_kafka_offset"),
        F.col("kafka_ts").alias("bronze_kafka_ts"),
        F.col("kafka_key").alias("bronze_kafka_key"),
        "producer_ingest_ts",
        F.col("env.request_id").alias("producer_request_id"),
        F.coalesce("env.schema_version", F.lit(1)).alias("schema_version"),
        F.col("ingest_ts").alias("_arrived"),
        F.when(F.col("env").isNull() | F.col("line.id").isNull() | severity.isNull(), F.col("payload")).alias("_payload"),
        F.col("env").isNull().alias("_failed"),
    )


def of_outcomes(found: DataFrame, measured_at: Column) -> tuple[DataFrame, DataFrame]:
    """The statuses() and the parse_failures() of the messages that outcomes() were made from."""
    failed = found.filter("_failed").select(F.col("_arrived").alias("ingest_ts"), *[F.col(f"bronze_{c}").alias(c) for c in (*OFFSET, "kafka_key")], F.col("_payload").alias("payload"))
    return found.filter("NOT _failed").drop("_failed"), rejected(failed, PARSE_FAILED, measured_at)


def complete() -> Column:
    return F.col("line_id").isNotNull() & F.col("status_severity").isNotNull()


def clean_events(rows: DataFrame) -> DataFrame:
    """The complete statuses, one per message, line and severity (the earliest valid_from, then the other columns decide)."""
    return first_of(rows.filter(complete()).select(*SILVER_COLUMNS), EVENT_KEY, [F.col("valid_from"), F.col("reason")])


def quarantined(rows: DataFrame, failures: DataFrame, measured_at: Column) -> DataFrame:
    """Messages that didn't parse and messages with an incomplete status, one row per offset and reason."""
    bad = rows.filter(~complete()).select(F.col("_arrived").alias("ingest_ts"), *[F.col(f"bronze_{c}").alias(c) for c in (*OFFSET, "kafka_key")], F.col("_payload").alias("payload"), F.lit(FIELD_MISSING).alias("error_reason"), measured_at.alias("measured_at"))
    return first_of(failures.unionByName(bad), [*OFFSET, "error_reason"])


def metrics(rows: DataFrame, failures: DataFrame, batch_id: int, measured_at: Column, dataset: str = "line_status_events") -> DataFrame:
    """One row about a batch; sums over no statuses are null, as are its good and bad rows."""
    missing = lambda c: F.sum(F.when(F.col(c).isNull(), 1).otherwise(0))
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"), missing("line_id").alias("null_line_id"), missing("status_severity").alias("null_status_severity"), F.sum(F.when(complete(), 0).otherwise(1)).alias("bad_rows"), F.min("event_ts").alias("min_event_ts"), F.max("event_ts").alias("max_event_ts"), F.lit(0).alias("_one"))
    failed = failures.agg(F.count(F.lit(1)).alias("parse_fail_rows"), F.lit(0).alias("_one"))
    return total.join(failed, "_one").select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(dataset).alias("dataset"), "total_rows", (F.col("total_rows") - F.col("bad_rows")).alias("good_rows"), "bad_rows", "null_line_id", "null_status_severity", "parse_fail_rows", "min_event_ts", "max_event_ts", measured_at.alias("measured_at"))


# producing


@dataclass(frozen=True)
class Settings:
    """What the poller needs: arguments win over the environment, which wins over defaults."""

    bootstrap: str
    app_key: str
    modes: str
    status_topic: str = "line_status_raw"
    severity_topic: str = "severity_meta_raw"
    fetch_severity: bool = True
    timeout_s: float = 15.0
    base_url: str = "http://localhost"

    def __post_init__(self) -> None:
        for name in ("bootstrap", "app_key", "modes"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} is empty")


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("produce", description="Polls line statuses once and sends them as messages")
    parser.add_argument("--kafka-bootstrap")
    parser.add_argument("--modes", help="comma-separated")
    parser.add_argument("--topic-raw-line-status")
    parser.add_argument("--topic-raw-severity-meta")
    parser.add_argument("--fetch-severity", action=argparse.BooleanOptionalAction, default=None)
    parser.add_argument("--http-timeout-s", type=float)
    return parser


def settings(args: argparse.Namespace, env: dict[str, str] | None = None) -> Settings:
    env = dict(os.environ if env is None else env)
    pick = lambda arg, name, default: arg if arg is not None else env.get(name, default)
    return Settings(
        pick(args.kafka_bootstrap, "KAFKA_BOOTSTRAP", "localhost:9092"), env.get("STATUS_APP_KEY", ""), pick(args.modes, "STATUS_MODES", ",".join(("metro", "tram"))),
        pick(args.topic_raw_line_status, "STATUS_TOPIC", Settings.status_topic), pick(args.topic_raw_severity_meta, "SEVERITY_TOPIC", Settings.severity_topic),
        args.fetch_severity if args.fetch_severity is not None else env.get("FETCH_SEVERITY", "true").lower() in ("1", "true", "yes"), float(pick(args.http_timeout_s, "HTTP_TIMEOUT_S", 15)), env.get("STATUS_BASE_URL", Settings.base_url),
    )


KEPT_HEADERS = ("date", "etag", "cache-control")
ATTEMPTS, LEAST_WAIT, MOST_WAIT = 3, 1.0, 10.0


def http_get_json(url: str, params: dict, timeout_s: float, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> tuple[object, int, int, dict[str, str]]:
    """(json, status, milliseconds, headers kept); failed attempts are repeated after a random, growing wait."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    for attempt in range(ATTEMPTS):
        began = time.monotonic()
        try:
            with opener(full, timeout=timeout_s) as answer:
                body = json.loads(answer.read())
                headers = {k.lower(): v for k, v in answer.headers.items() if k.lower() in KEPT_HEADERS}
                return body, answer.status, int(1000 * (time.monotonic() - began)), headers
        except (urllib.error.URLError, TimeoutError, ValueError):
            if attempt + 1 == ATTEMPTS:
                raise
            sleep(min(MOST_WAIT, random.uniform(LEAST_WAIT, LEAST_WAIT * 2 ** (attempt + 1))))
    raise AssertionError


def canonical_hash(payload: object) -> str:
    """SHA-256 of the payload as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def envelope(endpoint: str, modes: str, answer: tuple, now: datetime | None = None, source: str = "status-api") -> dict:
    payload, status, ms, headers = answer
    at = (now or datetime.now(timezone.utc)).isoformat()
    return {"source": source, "endpoint": endpoint, "modes": modes, "request_id": str(uuid.uuid4()), "ingested_at": at, "http_status": status, "duration_ms": ms, "response_headers": headers, "payload_hash": canonical_hash(payload), "payload": payload, "schema_version": 1}


def fetch_line_status(s: Settings, get: Callable = http_get_json) -> dict:
    path = f"/Line/Mode/{s.modes}/Status"
    return envelope(path, s.modes, get(s.base_url + path, {"app_key": s.app_key}, s.timeout_s))


def fetch_severity_meta(s: Settings, get: Callable = http_get_json) -> dict:
    path = "/Line/Meta/Severity"
    return envelope(path, s.modes, get(s.base_url + path, {"app_key": s.app_key}, s.timeout_s))


#: What a broker client is asked for: no loss, no repeats within a session, small batches.
PRODUCER = {"enable.idempotence": True, "acks": "all", "retries": 10, "compression.type": "snappy", "linger.ms": 25}
FLUSH_S = 30


def produce(s: Settings, send: Callable[[str, str, bytes], None], flush: Callable[[float], int], get: Callable = http_get_json) -> dict:
    """Sends one round of messages and returns a summary. All must have left after FLUSH_S."""
    status = fetch_line_status(s, get)
    sent = [(s.status_topic, f"line_status|{s.modes}", status)]
    if s.fetch_severity:
        sent.append((s.severity_topic, "severity_meta", fetch_severity_meta(s, get)))
    for topic, key, message in sent:
        send(topic, key, json.dumps(message, ensure_ascii=False).encode())
    if left := flush(FLUSH_S):
        raise RuntimeError(f"{left} messages were not delivered in {FLUSH_S} s")
    return {"sent_messages": len(sent), "modes": s.modes, "topics": [t for t, _, _ in sent], "fetch_severity": s.fetch_severity, "ingested_at": status["ingested_at"]}
