"""The models by name: what each is made from, how it is keyed, and the order to build them in."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gold


@dataclass(frozen=True)
class Model:
    """make takes the inputs in the order of needs. Rows are unique by unique; a refresh replaces all rows of a scope key.

    watched is the input whose watermark column tells which keys have changed, marks the model's own column to compare it to.
    A model without a scope is made anew each time.
    """

    name: str
    needs: tuple[str, ...]
    make: Callable[..., DataFrame]
    unique: tuple[str, ...]
    scope: str | None = None
    watched: str | None = None
    watermark: str | None = None
    marks: str | None = None
    schema: str | None = None  # of its own, where its table isn't in the target schema


def models(as_of: Column | None = None) -> dict[str, Model]:
    """All models; as_of is the time that the current status is told at (by default the clock's)."""
    at = lambda: F.current_timestamp() if as_of is None else as_of
    found = [
        Model("stg_events", ("silver",), gold.staged, ("line_id", "event_id", "status_severity"), "line_id", "silver", "ingest_ts", "ingest_ts"),
        Model("dim_line", ("stg_events",), gold.dim_line, ("line_id",), "line_id", "stg_events", "ingest_ts", "last_ingest_ts"),
        Model("dim_status", ("stg_events",), gold.dim_status, ("status_severity",), "status_severity", "stg_events", "ingest_ts", "last_ingest_ts"),
        Model("dim_datetime", ("stg_events",), gold.dim_datetime, ("date_key", "hour_of_day")),
        Model("fact_line_status_interval", ("stg_events",), gold.fact_interval, ("line_id", "interval_start_ts"), "line_id", "stg_events", "ingest_ts", "ingest_ts"),
        Model("fact_line_status_change", ("fact_line_status_interval",), gold.fact_change, ("line_id", "change_ts", "new_status_severity"), "line_id", "fact_line_status_interval", "ingest_ts", "source_ingest_ts"),
        Model("int_line_interval_scored", ("fact_line_status_interval", "dim_status"), gold.scored, ("line_id", "interval_start_ts")),
        Model("int_line_hour_aggregate", ("int_line_interval_scored",), gold.hour_aggregate, ("bucket_hour", "line_id"), "line_id", "int_line_interval_scored", "ingest_ts", "max_source_ingest_ts"),
        Model("mart_line_hour", ("int_line_hour_aggregate", "dim_line", "fact_line_status_change"), gold.mart_line_hour, ("bucket_hour", "line_id"), "line_id", "int_line_hour_aggregate", "max_source_ingest_ts", "max_source_ingest_ts"),
        Model("mart_line_day", ("mart_line_hour", "int_line_interval_scored", "fact_line_status_change"), gold.mart_line_day, ("service_date", "line_id"), "line_id", "mart_line_hour", "max_source_ingest_ts", "max_source_ingest_ts"),
        Model("mart_network_hour", ("mart_line_hour",), gold.mart_network_hour, ("bucket_hour",), "bucket_hour", "mart_line_hour", "max_source_ingest_ts", "max_source_ingest_ts"),
        Model("mart_network_day", ("mart_line_day",), gold.mart_network_day, ("service_date",), "service_date", "mart_line_day", "max_source_ingest_ts", "max_source_ingest_ts"),
        Model("current_line_status", ("fact_line_status_interval", "dim_line", "dim_status"), lambda i, l, s: gold.current_status(i, l, s, at()), ("line_id",), "line_id", "fact_line_status_interval", "ingest_ts", "last_ingest_ts"),
    ]
    return {m.name: m for m in found}


def ordered(chosen: Mapping[str, Model] | None = None) -> list[Model]:
    """Models after what they need."""
    chosen = chosen or models()
    graph = {m.name: {n for n in m.needs if n in chosen} for m in chosen.values()}
    return [chosen[n] for n in TopologicalSorter(graph).static_order()]


def derive(silver: DataFrame, name: str, as_of: Column | None = None, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """One model straight from silver, as a single plan, with no tables in between."""
    made = {"silver": silver} if made is None else made
    chosen = models(as_of)

    def get(n: str) -> DataFrame:
        if n not in made:
            made[n] = chosen[n].make(*map(get, chosen[n].needs))
        return made[n]

    return get(name)
