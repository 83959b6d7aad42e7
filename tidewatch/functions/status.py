"""Expressions over status severities and reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities, their categories and weights; reason fragments and their categories, in order of precedence.
GOOD_SERVICE = 10
CATEGORIES = {10: "Good Service", 9: "Minor Delays", 7: "Reduced Service", 6: "Severe Delays", 5: "Part Closure", 4: "Planned Closure", 3: "Part Suspended", 2: "Suspended", 20: "Service Closed"}
OTHER_CATEGORY = "Other"
WEIGHTS = {10: "0.0", 9: "1.0", 7: "2.0", 6: "3.0", 5: "4.0", 3: "4.0", 4: "5.0", 2: "5.0", 20: "5.0"}
OTHER_WEIGHT = "2.0"
REASONS = [
    ("signal", "Signal Failure"),
    ("train cancellation", "Train Cancellations"),
    ("customer incident", "Customer Incident"),
    ("power", "Power Issue"),
    ("staff", "Staffing"),
    ("weather", "Weather"),
    ("engineering", "Engineering Work"),
    ("planned closure", "Planned Closure"),
]
NO_REASON, OTHER_REASON = "Unknown", "Other"
UNKNOWN = "Unknown"


def _mapped(key: Column, values: dict, otherwise: Column, kind: str) -> Column:
    """A literal map's value for a key; one lookup, whatever the number of entries."""
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))])
    return F.coalesce(F.try_element_at(table, key.cast("int")), otherwise.cast(kind))


def status_category(severity: Column) -> Column:
    return _mapped(severity, CATEGORIES, F.lit(OTHER_CATEGORY), "string")


def severity_weight(severity: Column) -> Column:
    return _mapped(severity, WEIGHTS, F.lit(OTHER_WEIGHT), "decimal(2,1)")


def is_good_service(severity: Column) -> Column:
    """False for a null severity."""
    return severity.eqNullSafe(F.lit(GOOD_SERVICE))


def is_disrupted(severity: Column) -> Column:
    """Null for a null severity."""
    return severity != GOOD_SERVICE


def recovery_flag(previous: Column, new: Column) -> Column:
    return previous.isNotNull() & ~is_good_service(previous) & is_good_service(new)


def disruption_category(reason: Column) -> Column:
    """The first fragment in REASONS that the reason has, case aside."""
    text = F.lower(F.coalesce(reason, F.lit("")))
    out = F.when(F.trim(text) == "", NO_REASON).otherwise(OTHER_REASON)
    for fragment, category in reversed(REASONS):
        out = F.when(F.contains(text, F.lit(fragment)), category).otherwise(out)
    return out


def reason_hash(reason: Column) -> Column:
    """SHA-256 of the reason, trimmed, lowered, and with single spaces; a null reason counts as empty."""
    return F.sha2(F.regexp_replace(F.lower(F.trim(F.coalesce(reason, F.lit("")))), r"\s+", " "), 256)
