"""The three jobs: records to raw files, records to bronze, bronze to silver with quarantine and metrics.

All writes of a silver batch are keyed upserts, so a batch that is run again leaves the tables as they were.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Table, ensure_table
from ..session import Config
from ..sources import messages, streams
from ..sources.events import SILVER

TRIGGER = {"processingTime": "30 seconds"}
#: Offsets of a part of the quarantine table, batches of one of the metrics table.
OFFSETS, BATCHES = 1_000_000, 1_000
#: Messages, and bytes of their payloads, that a task parses and keeps, however large the batch and its files are.
PIECE_ROWS, PIECE_BYTES = 50_000, 1 << 24


def _started(writer, name: str, checkpoint: str, trigger: dict | None):
    return writer.queryName(name).option("checkpointLocation", checkpoint).trigger(**(trigger or TRIGGER))


def land_raw(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends records as they are, in folders by date and hour of arrival."""
    now = F.current_timestamp()
    rows = streams.kept(records).withColumns({"ingest_ts": now, "ingest_date": F.to_date(now), "ingest_hour": F.date_format(now, "HH")})
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("ingest_date", "ingest_hour").option("path", path)
    return _started(writer, "raw", checkpoint, trigger).start()


def append_bronze(records: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends records with time of arrival and a hash of the payload, in folders by date of arrival."""
    rows = streams.kept(records).withColumn("ingest_ts", F.current_timestamp()).withColumn("payload_hash", F.sha2("payload", 256)).withColumn("ingest_date", F.to_date("ingest_ts"))
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("ingest_date").option("path", path)
    return _started(writer, "bronze", checkpoint, trigger).start()


def append_bronze_table(records: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The same into a catalog table, which is created if it isn't there."""
    spark = records.sparkSession
    ensure_table(spark, table, messages.BRONZE + ", ingest_date date", partitioned_by="ingest_date")
    rows = streams.kept(records).withColumn("ingest_ts", F.current_timestamp()).withColumn("payload_hash", F.sha2("payload", 256)).withColumn("ingest_date", F.to_date("ingest_ts"))
    return _started(rows.writeStream.outputMode("append").partitionBy("ingest_date"), "bronze", checkpoint, trigger).toTable(table)


class Silver:
    """Writes bronze batches to the silver, quarantine and metrics tables."""

    def __init__(self, spark: SparkSession, config: Config, strict: bool = False, clock: Callable[[], datetime] | None = None):
        self.config, self.strict = config, strict
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        self.events = Table(spark, config.silver, SILVER + ", event_date date", "event_date")
        offsets = f"concat_ws('/', kafka_topic, kafka_partition, kafka_offset div {OFFSETS})"  # a batch touches the last parts alone
        self.quarantine = Table(spark, config.path("quarantine", "bad_records"), messages.QUARANTINE, offsets)
        self.metrics = Table(spark, config.path("ops", "dq_metrics"), messages.METRICS, f"batch_id div {BATCHES}")

    def process(self, bronze: DataFrame, batch_id: int) -> None:
        """One batch. All its rows have one measuring time, whichever action computes them."""
        n, size = bronze.agg(F.count(F.lit(1)), F.sum(F.octet_length("payload").cast("long"))).first()
        if not n:
            return
        now = F.lit(self.clock())
        pieces = bronze.repartition(max(math.ceil(n / PIECE_ROWS), math.ceil((size or 0) / PIECE_BYTES)), *messages.OFFSET)
        kept = messages.outcomes(messages.parsed(pieces, self.strict), now).persist()
        try:
            kept.count()  # once it's there, what is made from it knows that keys aren't spread over pieces, and isn't dealt out again
            found, failures = messages.of_outcomes(kept, now)
            self.quarantine.upsert(messages.quarantined(found, failures, now), [*messages.OFFSET, "error_reason"], unique=True)
            events = messages.clean_events(found).withColumn("event_date", F.to_date("event_ts"))
            self.events.upsert(events, messages.EVENT_KEY, unique=True)
            measured = messages.metrics(found, failures, batch_id, now)
            self.metrics.upsert(measured, ["batch_id", "dataset"], [c for c in messages.names(messages.METRICS) if c not in ("batch_id", "dataset")])
        finally:
            kept.unpersist()

    def start(self, bronze: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        return _started(bronze.writeStream.foreachBatch(self.process), "silver", checkpoint, trigger).start()


def bronze_stream(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    return streams.files(spark, path, messages.BRONZE + ", ingest_date date", most_files)
