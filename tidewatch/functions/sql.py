"""Conditional aggregates, safe division, calendar and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Before every watermark.
FLOOR = "1900-01-01 00:00:00"


def sum_when(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def count_distinct_when(value: Column, condition: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def is_weekend(date: Column) -> Column:
    return F.dayofweek(date).isin(1, 7)


def floor_ts() -> Column:
    return F.lit(FLOOR).cast("timestamp")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, each end floored to its second."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def seconds_up(start: Column, end: Column) -> Column:
    """Whole seconds of a span in milliseconds, rounded up, one at least; null for an open span."""
    whole = -F.floor((F.unix_millis(start) - F.unix_millis(end)) / F.lit(1000.0)).cast("long")
    return F.when(end.isNotNull(), F.greatest(F.lit(1).cast("long"), whole))


#: The timestamp formats that messages use, tried in this order.
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss")


def parse_iso_ts(value: Column) -> Column:
    """A timestamp in Spark's own form, which most ISO texts are, or in any of ISO_FORMATS; null for anything else."""
    text = value.cast("string")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in ISO_FORMATS])
