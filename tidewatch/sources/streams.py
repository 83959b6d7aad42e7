"""Streaming sources by configuration: a broker's topic, or files that stand in for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a topic's records.
RECORD = "topic string, partition int, offset bigint, timestamp timestamp, key binary, value binary"


def topic(spark: SparkSession, bootstrap: str, name: str, most_offsets: int | None = None) -> DataFrame:
    """All records of a topic from the earliest; gaps in retention don't fail it. Needs the connector's jar."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap).option("subscribe", name).option("startingOffsets", "earliest").option("failOnDataLoss", "false")
    return (reader.option("maxOffsetsPerTrigger", most_offsets) if most_offsets else reader).load()


def files(spark: SparkSession, path: str, schema: str = RECORD, most_files: int | None = None) -> DataFrame:
    """Parquet files as they come into a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).parquet(path)


def table(spark: SparkSession, name: str, most_files: int | None = None) -> DataFrame:
    """Rows as they are appended to a catalog table."""
    return (spark.readStream.option("maxFilesPerTrigger", most_files) if most_files else spark.readStream).table(name)


def to_topic(messages: DataFrame, bootstrap: str, name: str) -> None:
    """Sends rows (key, value) to a topic; each is there when this returns. Needs the connector's jar."""
    options = {"kafka.bootstrap.servers": bootstrap, "topic": name, "kafka.enable.idempotence": "true", "kafka.acks": "all", "kafka.retries": "10", "kafka.compression.type": "snappy", "kafka.linger.ms": "25"}
    messages.select(F.col("key").cast("binary"), F.col("value").cast("binary")).write.format("kafka").options(**options).save()


def kept(records: DataFrame) -> DataFrame:
    """A record's place, time, key and value under the names that tables use."""
    return records.select(F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_ts"), F.col("key").cast("string").alias("kafka_key"), F.col("value").cast("string").alias("payload"))
