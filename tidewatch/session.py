"""Session settings and the engine's configuration."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: What results depend on. The rest is left to the cluster.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(name: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS and whatever else is asked for."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | conf).getOrCreate()


def pinned(spark: SparkSession) -> SparkSession:
    """The session with the settings that results depend on."""
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        if spark.conf.get(k, None) != SETTINGS[k]:
            spark.conf.set(k, SETTINGS[k])
    return spark


@dataclass(frozen=True)
class Config:
    """Where tables are and what they are called; each field may come from an environment variable."""

    warehouse: str = field(default_factory=lambda: os.environ.get("TIDEWATCH_WAREHOUSE", "warehouse"))
    silver_schema: str = field(default_factory=lambda: os.environ.get("TIDEWATCH_SILVER_SCHEMA", "silver"))
    silver_table: str = field(default_factory=lambda: os.environ.get("TIDEWATCH_SILVER_TABLE", "line_status_events"))
    gold_schema: str = field(default_factory=lambda: os.environ.get("TIDEWATCH_GOLD_SCHEMA", "gold"))
    warn_minutes: int = 30
    error_minutes: int = 120

    def path(self, schema: str, table: str) -> str:
        return f"{self.warehouse.rstrip('/')}/{schema}/{table}"

    @property
    def silver(self) -> str:
        return self.path(self.silver_schema, self.silver_table)

    def gold(self, table: str) -> str:
        return self.path(self.gold_schema, table)

    def schema_for(self, custom: str | None) -> str:
        """A model's own schema name as it is, else the target schema."""
        return custom.strip() if custom else self.gold_schema


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors reach, removed when the driver ends."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
