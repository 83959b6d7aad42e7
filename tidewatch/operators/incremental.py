"""Which keys a refresh must make anew, and the refresh itself."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sql import floor_ts
from ..plans.registry import Model, models, ordered
from ..session import Config
from ..sources.events import SILVER
from .store import Table


def newer_than(source: DataFrame, watermark: str, target: DataFrame, marks: str) -> DataFrame:
    """Rows of source past the largest mark in target (all rows of an empty target's source)."""
    return source.filter(F.col(watermark) > target.agg(F.coalesce(F.max(marks), floor_ts())).scalar())


def changed_keys(source: DataFrame, key: str, watermark: str, target: DataFrame, marks: str, per_key: bool = True) -> DataFrame:
    """Distinct keys of source with rows that target hasn't seen.

    Per key, a key's own newest mark is compared, so that one line's news can't hide another's; otherwise the newest mark of the
    whole target is, which misses late rows of equal or smaller watermarks. Keys that left the source count as changed per key.
    """
    if not per_key:
        return newer_than(source, watermark, target, marks).select(key).distinct()
    new = source.groupBy(key).agg(F.max(watermark).alias("_new"), F.count(F.lit(1)).alias("_rows"))
    old = target.groupBy(F.col(key).alias("_key")).agg(F.max(marks).alias("_old"))
    both = new.join(old, F.col(key).eqNullSafe(F.col("_key")), "full_outer")
    changed = F.col("_old").isNull() | F.col("_new").isNull() | (F.col("_new") > F.col("_old"))
    return both.filter(changed).select(F.coalesce(key, "_key").alias(key))


def needed(every: dict[str, Model], names: set[str] | None) -> dict[str, Model]:
    """The named models (all if None) and those that they are made from."""
    todo, found = list(every if names is None else names), set()
    while todo:
        name = todo.pop()
        if name in every and name not in found:
            found.add(name)
            todo += every[name].needs
    return {n: m for n, m in every.items() if n in found}


class Gold:
    """The gold tables in a warehouse, built in full or refreshed; all of them, or some with what they need."""

    def __init__(self, spark: SparkSession, config: Config | None = None, as_of: Column | None = None, names: set[str] | None = None):
        self.spark, self.config = spark, config or Config()
        self.models = needed(models(as_of), names)
        self._schemas: dict[str, T.StructType] = {}
        self._run = uuid.uuid4().hex

    def schema(self, name: str) -> T.StructType:
        """A table's schema, from its model over empty inputs."""
        if name not in self._schemas:
            self._schemas[name] = self._empty(name).schema
        return self._schemas[name]

    def _empty(self, name: str) -> DataFrame:
        return self.models[name].make(*[self.spark.createDataFrame([], SILVER if n == "silver" else self.schema(n)) for n in self.models[name].needs])

    def table(self, name: str) -> Table:
        """Intervals are kept in a part per line, the others in one."""
        at = self.config.path(self.config.schema_for(self.models[name].schema), name)
        return Table(self.spark, at, self.schema(name), "line_id" if name == "fact_line_status_interval" else None)

    def read(self, name: str, silver: DataFrame) -> DataFrame:
        return silver if name == "silver" else self.table(name).read()

    def _inputs(self, model: Model, silver: DataFrame) -> list[DataFrame]:
        return [self.read(n, silver) for n in model.needs]

    def full(self, silver: DataFrame) -> None:
        """Every model from all of its inputs."""
        for model in ordered(self.models):
            self.table(model.name).overwrite(model.make(*self._inputs(model, silver)))

    def refresh(self, silver: DataFrame, per_key: bool = True) -> None:
        """Each model for the keys that have news; all rows of such a key are replaced.

        Per key, lines whose newest event is newer than what is staged of them are made anew in every model, and so are the
        hours, days and severities that those lines had rows in, before or now: the result is that of a full build. Otherwise
        each model compares one watermark over all keys, which is cheaper and skips late rows until their key has newer ones.
        """
        if not all(self.table(n).exists() for n in self.models):
            return self.full(silver)
        if not per_key:
            for model in ordered(self.models):
                inputs = self._inputs(model, silver)
                keys = None
                if model.scope:
                    keys = changed_keys(inputs[model.needs.index(model.watched)], model.scope, model.watermark, self.table(model.name).read(), model.marks, per_key=False)
                self._remake(model, inputs, keys)
            return None
        try:
            return self._refresh(silver)
        finally:
            self._forget()

    def _refresh(self, silver: DataFrame) -> None:
        lines = self._kept(changed_keys(silver, "line_id", "ingest_ts", self.read("stg_events", silver), "ingest_ts"))
        if lines.isEmpty():
            return
        others = [m for m in self.models.values() if m.scope not in (None, "line_id")]
        before = {m.name: self._kept(self._of(self.read(m.watched, silver), lines, m.scope)) for m in others}
        for model in ordered(self.models):
            inputs = self._inputs(model, silver)
            keys = lines if model.scope == "line_id" else None
            if model.name in before:
                keys = before[model.name].union(self._of(inputs[model.needs.index(model.watched)], lines, model.scope)).distinct()
            self._remake(model, inputs, keys)

    def _of(self, df: DataFrame, lines: DataFrame, key: str) -> DataFrame:
        return df.join(lines, "line_id", "left_semi").select(key).distinct()

    def _kept(self, keys: DataFrame) -> DataFrame:
        """Keys as they are now, whatever happens to the tables that they come from."""
        path = f"{self.config.warehouse.rstrip('/')}/_refresh/{self._run}/{uuid.uuid4().hex}"
        keys.write.parquet(path)
        return self.spark.read.schema(keys.schema).parquet(path)

    def _forget(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.config.warehouse.rstrip('/')}/_refresh/{self._run}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _remake(self, model: Model, inputs: list[DataFrame], keys: DataFrame | None) -> None:
        if keys is None:
            self.table(model.name).overwrite(model.make(*inputs))
            return
        scoped = [x.join(keys, model.scope, "left_semi") if model.scope in x.columns else x for x in inputs]
        self.table(model.name).replace_keys(model.make(*scoped), keys, model.scope)
