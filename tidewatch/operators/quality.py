"""Data-quality checks as DataFrames of violating rows, the freshness check, and the suite over the gold tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import CATEGORIES, NO_REASON, OTHER_CATEGORY, OTHER_REASON, REASONS
from .neighbours import following, preceding, sliced

# generic checks


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values that are there more than once, and how often; null values are not looked at in a single column."""
    rows = df if len(columns) > 1 else df.filter(F.col(columns[0]).isNotNull())
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows with another value; null is not looked at."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(values))


def relationships(df: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Rows whose value the parent doesn't have; null is not looked at."""
    known = parent.select(F.col(field).alias("_known")).distinct()
    return df.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti")


def freshness(df: DataFrame, column: str, as_of: Column, warn_minutes: int = 30, error_minutes: int = 120) -> DataFrame:
    """One row: newest, age_seconds and status (pass, warn or error; error where there are no rows)."""
    age = (F.unix_micros(as_of) - F.unix_micros("newest")) / F.lit(1_000_000)
    status = F.when(F.col("age_seconds").isNull() | (F.col("age_seconds") > error_minutes * 60), "error").when(F.col("age_seconds") > warn_minutes * 60, "warn").otherwise("pass")
    return df.agg(F.max(column).alias("newest")).withColumn("age_seconds", age).withColumn("status", status)


# invariants of the models


def outside(low: int, column: str, high: str | int | None = None) -> Column:
    out = F.col(column) < low
    return out if high is None else out | (F.col(column) > (F.col(high) if isinstance(high, str) else F.lit(high)))


def interval_bounds(intervals: DataFrame) -> DataFrame:
    return intervals.filter((F.col("interval_seconds") < 1) | (F.col("interval_end_ts") <= F.col("interval_start_ts")) | outside(0, "status_severity", 20))


def no_duplicate_windows(intervals: DataFrame) -> DataFrame:
    return unique(intervals, "line_id", "interval_start_ts", "interval_end_ts")


def interval_continuity(intervals: DataFrame) -> DataFrame:
    """Intervals that don't end where the line's next one starts."""
    rows = sliced(intervals.select("line_id", "interval_start_ts", "interval_end_ts", "ingest_ts", "status_severity"), "interval_start_ts")
    beside = following(rows, "line_id", ["interval_start_ts", "ingest_ts", "status_severity"], {"next_start_ts": "interval_start_ts"})
    return beside.filter(F.col("next_start_ts").isNotNull() & ~F.col("interval_end_ts").eqNullSafe(F.col("next_start_ts"))).drop("slice")


CHANGE_ORDER = ["change_ts", "source_ingest_ts", "new_status_severity", "new_reason_text_hash"]


def no_repeated_state(changes: DataFrame) -> DataFrame:
    """Changes into the state that the line was in."""
    beside = preceding(sliced(changes.select("line_id", *CHANGE_ORDER), "change_ts"), "line_id", CHANGE_ORDER, {"was_severity": "new_status_severity", "was_hash": "new_reason_text_hash"})
    return beside.filter((F.col("new_status_severity") == F.col("was_severity")) & F.col("new_reason_text_hash").eqNullSafe(F.col("was_hash"))).drop("slice")


def prev_alignment(changes: DataFrame) -> DataFrame:
    """Changes whose previous state isn't the one change at prev_change_ts, nor lies before the line's first change."""
    at = changes.groupBy(F.col("line_id").alias("_line"), F.col("change_ts").alias("_ts")).agg(F.count(F.lit(1)).alias("prev_rows"), F.min("new_status_severity").alias("expected_severity"), F.min("new_reason_text_hash").alias("expected_hash"))
    firsts = changes.groupBy("line_id").agg(F.min("change_ts").alias("first_change_ts"))
    both = changes.join(at, (F.col("line_id") == F.col("_line")) & F.col("prev_change_ts").eqNullSafe(F.col("_ts")), "left").join(firsts, "line_id", "left")
    same = (F.col("prev_rows") == 1) & F.col("prev_status_severity").eqNullSafe(F.col("expected_severity")) & F.col("prev_reason_text_hash").eqNullSafe(F.col("expected_hash"))
    early = F.col("prev_rows").isNull() & (F.col("prev_change_ts") < F.col("first_change_ts"))
    return both.filter(~(F.coalesce(same, F.lit(False)) | F.coalesce(early, F.lit(False)))).drop("_line", "_ts")


def change_timing(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("time_since_prev_seconds").isNull() | (F.col("time_since_prev_seconds") < 0) | (F.col("time_in_new_state_seconds") < 1))


PARTS = ("good_service_seconds", "disruption_seconds")


def unbalanced() -> Column:
    return F.abs(F.col("total_seconds") - sum(map(F.col, PARTS[1:]), F.col(PARTS[0]))) > 1


def component_balance(mart: DataFrame) -> DataFrame:
    return mart.filter(unbalanced())


def seconds_bounds(mart: DataFrame, most: int) -> DataFrame:
    return mart.filter(outside(0, "total_seconds", most) | outside(0, PARTS[0], "total_seconds") | outside(0, PARTS[1], "total_seconds"))


def network_bounds(mart: DataFrame) -> DataFrame:
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in ("lines_reporting", "lines_impacted", "total_seconds", *PARTS)])
    return mart.filter(negative | (F.col("lines_impacted") > F.col("lines_reporting")) | unbalanced() | outside(0, "network_good_service_pct", 1))


def trend_regression(days: DataFrame, today: Column, drop: float = 0.20, least_days: int = 7, least_lines: int = 5) -> DataFrame:
    """The last full day, if it and the day before are both more than drop below the median of all days before each.

    Days are few (one row each), so one window over them all will do.
    """
    every = Window.orderBy("service_date")
    past = every.rowsBetween(Window.unboundedPreceding, -1)
    full = days.filter(F.col("service_date") < today).select("service_date", "network_good_service_pct", "lines_reporting")
    base = full.withColumns({"baseline_p50": F.percentile_approx("network_good_service_pct", 0.5).over(past), "baseline_days": F.count("network_good_service_pct").over(past), "last_date": F.max("service_date").over(Window.partitionBy())})
    bad = (F.col("baseline_days") >= least_days) & (F.col("lines_reporting") >= least_lines) & F.coalesce(F.col("network_good_service_pct") < F.col("baseline_p50") - drop, F.lit(False))
    flagged = base.withColumn("bad", bad).withColumns({"prev_date": F.lag("service_date").over(every), "prev_bad": F.lag("bad").over(every)})
    hit = (F.col("service_date") == F.col("last_date")) & F.col("bad") & F.col("prev_bad") & (F.datediff("service_date", "prev_date") == 1)
    return flagged.filter(hit).select("service_date", "network_good_service_pct", "baseline_p50", "baseline_days", "lines_reporting")


# the suite


@dataclass(frozen=True)
class Check:
    """find gives the violating rows, from a reader of tables by name."""

    name: str
    find: Callable[[Callable[[str], DataFrame]], DataFrame]


SECONDS = ["total_seconds", *PARTS]
REASON_CATEGORIES = [c for _, c in REASONS] + [NO_REASON, OTHER_REASON]
NOT_NULL = {
    "silver": ["ingest_ts", "line_id", "status_severity"],
    "dim_line": ["line_id"],
    "dim_status": ["status_severity", "severity_weight"],
    "dim_datetime": ["date_key", "hour_of_day"],
    "fact_line_status_interval": ["line_id", "status_severity", "interval_start_ts"],
    "fact_line_status_change": ["line_id", "new_status_severity"],
    "int_line_hour_aggregate": ["line_id", "bucket_hour", "service_date", *SECONDS],
    "mart_line_hour": ["line_id", "bucket_hour", "service_date", *SECONDS],
    "mart_line_day": ["line_id", "service_date", *SECONDS],
    "current_line_status": ["line_id", "status_severity"],
}
UNIQUE = {"dim_line": "line_id", "dim_status": "status_severity", "current_line_status": "line_id"}
ACCEPTED = [
    ("dim_status", "status_severity", list(range(21))),
    ("dim_status", "status_category", [*CATEGORIES.values(), OTHER_CATEGORY]),
    ("dim_status", "severity_weight", [0, 1, 2, 3, 4, 5]),
    ("dim_datetime", "hour_of_day", list(range(24))),
    ("fact_line_status_interval", "disruption_category", REASON_CATEGORIES),
    ("current_line_status", "disruption_category", REASON_CATEGORIES),
]
LINES = ["fact_line_status_interval", "fact_line_status_change", "int_line_hour_aggregate", "mart_line_hour", "mart_line_day", "current_line_status"]
SEVERITIES = [("fact_line_status_interval", "status_severity"), ("fact_line_status_change", "new_status_severity"), ("fact_line_status_change", "prev_status_severity"), ("current_line_status", "status_severity")]


def suite(today: Column) -> list[Check]:
    """All checks: 32 not_null, 3 unique, 6 accepted_values, 10 relationships and 15 invariants."""
    found = [Check(f"not_null_{t}_{c}", lambda read, t=t, c=c: not_null(read(t), c)) for t, columns in NOT_NULL.items() for c in columns]
    found += [Check(f"unique_{t}_{c}", lambda read, t=t, c=c: unique(read(t), c)) for t, c in UNIQUE.items()]
    found += [Check(f"accepted_values_{t}_{c}", lambda read, t=t, c=c, v=v: accepted_values(read(t), c, v)) for t, c, v in ACCEPTED]
    found += [Check(f"relationships_{t}_line_id", lambda read, t=t: relationships(read(t), "line_id", read("dim_line"), "line_id")) for t in LINES]
    found += [Check(f"relationships_{t}_{c}", lambda read, t=t, c=c: relationships(read(t), c, read("dim_status"), "status_severity")) for t, c in SEVERITIES]
    interval, change = "fact_line_status_interval", "fact_line_status_change"
    found += [
        Check("trend_regression", lambda read: trend_regression(read("mart_network_day"), today)),
        Check("interval_bounds", lambda read: interval_bounds(read(interval))),
        Check("no_consecutive_duplicate_state", lambda read: no_repeated_state(read(change))),
        Check("prev_alignment", lambda read: prev_alignment(read(change))),
        Check("change_timing_bounds", lambda read: change_timing(read(change))),
        Check("no_duplicate_windows", lambda read: no_duplicate_windows(read(interval))),
        Check("continuity", lambda read: interval_continuity(read(interval))),
        Check("day_component_balance", lambda read: component_balance(read("mart_line_day"))),
        Check("day_seconds_bounds", lambda read: seconds_bounds(read("mart_line_day"), 86_400)),
        Check("day_unique_grain", lambda read: unique(read("mart_line_day"), "service_date", "line_id")),
        Check("hour_component_balance", lambda read: component_balance(read("mart_line_hour"))),
        Check("hour_seconds_bounds", lambda read: seconds_bounds(read("mart_line_hour"), 3600)),
        Check("hour_unique_grain", lambda read: unique(read("mart_line_hour"), "bucket_hour", "line_id")),
        Check("network_day_bounds", lambda read: network_bounds(read("mart_network_day"))),
        Check("network_hour_bounds", lambda read: network_bounds(read("mart_network_hour"))),
    ]
    return found


def counts(checks: list[Check], read: Callable[[str], DataFrame]) -> DataFrame:
    """check and failures (violating rows) of each check, as one plan."""
    each = [c.find(read).agg(F.count(F.lit(1)).alias("failures")).select(F.lit(c.name).alias("check"), "failures") for c in checks]
    return reduce(DataFrame.unionAll, each)
