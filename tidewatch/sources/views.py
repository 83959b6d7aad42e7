"""Read-only views over the warehouse for ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.incremental import Gold
from ..operators.store import Table
from ..session import Config
from .events import SILVER
from .messages import METRICS, QUARANTINE



def register(spark: SparkSession, config: Config) -> list[str]:
    """Creates a temporary view of each table that is there, and returns the names."""
    found = {"silver_line_status_events": Table(spark, config.silver, SILVER), "quarantine": Table(spark, config.path("quarantine", "bad_records"), QUARANTINE), "dq_metrics": Table(spark, config.path("ops", "dq_metrics"), METRICS)}
    gold = Gold(spark, config)
    found |= {f"gold_{n}": gold.table(n) for n in gold.models}
    names = []
    for name, table in found.items():
        if table.exists():
            table.read().createOrReplaceTempView(name)
            names.append(name)
    bronze = config.path("bronze", "line_status")
    if Table(spark, bronze, "x int")._fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(bronze)):
        spark.read.parquet(bronze).createOrReplaceTempView("bronze_line_status")
        names.append("bronze_line_status")
    return sorted(names)
