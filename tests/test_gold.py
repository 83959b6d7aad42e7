"""The gold models on hand-made frames: one test per corner of the semantics."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import sql as fsql
from tidewatch.functions import status
from tidewatch.operators import quality
from tidewatch.plans import gold
from tidewatch.plans.registry import derive, models, ordered

T0 = datetime(2024, 1, 1, 10, 0)
DDL = "event_id string, event_ts timestamp, ingest_ts timestamp, line_id string, line_name string, mode string, status_severity int, status_desc string, reason string, valid_from timestamp, valid_to timestamp, is_disrupted boolean, payload_hash string, producer_ingest_ts timestamp, producer_request_id string, schema_version int"


def event(minute, severity, line="a", reason=None, valid_from=None, valid_to=None, disrupted=None, id_=None, ingest=None, name="A", desc=None):
    at = lambda m: None if m is None else T0 + timedelta(minutes=m)
    ts = at(minute)
    return (id_ or f"{line}{minute}", ts, at(ingest) or ts, line, name, "metro", severity, desc, reason, at(valid_from), at(valid_to), disrupted, "h", ts, "r", 1)


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), DDL)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def minutes(ts):
    return None if ts is None else (ts - T0).total_seconds() / 60


def test_macros(spark):
    df = spark.createDataFrame([(s,) for s in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 19, 20, 21, None)], "s int")
    s = F.col("s")
    got = {r[0]: r[1:] for r in df.select("s", status.status_category(s), status.severity_weight(s), status.is_good_service(s), status.is_disrupted(s)).collect()}
    assert got[10] == ("Good Service", 0, True, False)
    assert got[None] == ("Other", 2, False, None)
    assert got[20][0] == "Service Closed" and got[8][0] == "Other" and float(got[3][1]) == 4.0 and float(got[4][1]) == 5.0


@pytest.mark.parametrize(
    ("reason", "category"),
    [(None, "Unknown"), ("   ", "Unknown"), ("SIGNAL and power", "Signal Failure"), ("power and staff", "Power Issue"), ("a customer incident, planned closure", "Customer Incident"), ("Engineering", "Engineering Work"), ("planned closure", "Planned Closure"), ("bad weather", "Weather"), ("x", "Other")],
)
def test_reason_categories_in_order(spark, reason, category):
    assert spark.createDataFrame([(reason,)], "r string").select(status.disruption_category(F.col("r"))).first()[0] == category


def test_reasons_that_differ_in_case_and_spacing_hash_alike(spark):
    df = spark.createDataFrame([("  Signal   failure ",), ("signal failure",), (None,), ("",)], "r string")
    a, b, c, d = [r[0] for r in df.select(status.reason_hash(F.col("r"))).collect()]
    assert a == b and c == d and a != c


def test_intervals_follow_one_another_and_the_last_is_open(make):
    got = gold.fact_interval(gold.staged(make(event(0, 10), event(30, 9, disrupted=True), event(90, 10))))
    assert [(minutes(a), minutes(b), s) for a, b, s in rows(got, "interval_start_ts", "interval_end_ts", "interval_seconds")] == [(0, 30, 1800), (30, 90, 3600), (90, None, None)]


def test_a_disrupted_tail_is_closed_by_its_declared_end_only_after_its_start(make):
    for end, closed in ((50, 50), (30, None), (10, None), (None, None)):
        got = gold.fact_interval(gold.staged(make(event(0, 10), event(30, 6, valid_to=end)))).filter("status_severity = 6").first()
        assert minutes(got["interval_end_ts"]) == closed
    good = gold.fact_interval(gold.staged(make(event(30, 10, valid_to=50)))).first()
    assert good["interval_end_ts"] is None


def test_disrupted_intervals_start_where_they_are_declared_and_the_latest_version_counts(make):
    got = gold.fact_interval(gold.staged(make(event(30, 6, valid_from=20, id_="9"), event(40, 3, valid_from=20, id_="1"), event(50, 10, valid_from=5))))
    assert [(minutes(a), s) for a, s in rows(got, "interval_start_ts", "status_severity")] == [(20, 3), (50, 10)]


def test_ties_go_to_the_largest_event_id_as_text(make):
    got = gold.fact_interval(gold.staged(make(event(0, 6, id_="10"), event(0, 3, id_="9"))))
    assert rows(got, "event_id") == [("9",)]


def test_subsecond_intervals_last_a_second(make, spark):
    base = event(0, 10)
    later = list(event(0, 9, id_="x"))
    later[1] = T0 + timedelta(microseconds=400)
    assert rows(gold.fact_interval(gold.staged(make(base, tuple(later)))).filter("interval_end_ts is not null"), "interval_seconds") == [(1,)]


def test_repeated_states_are_one_change_and_the_first_has_none(make):
    stg = gold.staged(make(event(0, 10), event(10, 10), event(20, 9, reason="signal"), event(30, 9, reason=" SIGNAL "), event(40, 9, reason="power"), event(50, 10)))
    got = gold.fact_change(gold.fact_interval(stg))
    assert [(minutes(t), minutes(p), a, b, r, s) for t, p, a, b, r, s in sorted(tuple(x[c] for c in ("change_ts", "prev_change_ts", "prev_status_severity", "new_status_severity", "recovery_flag", "time_in_new_state_seconds")) for x in got.collect())] == [(20, 0, 10, 9, False, 1200), (40, 20, 9, 9, False, 600), (50, 40, 9, 10, True, None)]


def test_runs_over_days_are_one_change(make):
    day = 24 * 60
    stg = gold.staged(make(event(0, 10), *[event(day * d + 5, 9) for d in range(1, 6)], event(day * 9, 10)))
    got = gold.fact_change(gold.fact_interval(stg))
    assert [(minutes(t), s) for t, s in sorted((r["change_ts"], r["time_in_new_state_seconds"]) for r in got.collect() if r["time_in_new_state_seconds"])] == [(day + 5, (day * 8 - 5) * 60)]


def hours(make, *events):
    stg = gold.staged(make(*events))
    return gold.hour_aggregate(gold.scored(gold.fact_interval(stg), gold.dim_status(stg)))


def test_an_interval_that_ends_on_the_hour_stays_out_of_the_next(make):
    assert [(minutes(h), s) for h, s in rows(hours(make, event(30, 10), event(60, 9)), "bucket_hour", "total_seconds")] == [(0, 1800)]


def test_intervals_over_midnight_fill_the_hours_of_both_days(make):
    got = hours(make, event(0, 10), event(24 * 60, 9))
    assert got.count() == 24 and rows(got.groupBy("service_date").agg(F.sum("total_seconds").alias("s")), "service_date", "s") == [(date(2024, 1, 1), 14 * 3600), (date(2024, 1, 2), 10 * 3600)]


def test_weights_count_unclamped_and_the_lowest_severity_is_worst(make):
    got = hours(make, event(0, 9, disrupted=True), event(30, 20, disrupted=True), event(60, 10)).first()
    assert (got["incident_count"], got["worst_status_severity"], float(got["severity_weighted_seconds"])) == (2, 9, 1800 * 1.0 + 1800 * 5.0)


def test_severities_without_a_dimension_row_weigh_nothing(make):
    stg = gold.staged(make(event(0, 6), event(30, 10)))
    assert float(gold.scored(gold.fact_interval(stg), gold.dim_status(stg).limit(0)).first()["severity_weight"]) == 0.0


def test_dimensions_take_the_latest_and_default_the_description(make):
    stg = gold.staged(make(event(0, 9, name="Old"), event(10, 9, name="New", desc="Minor"), event(5, 9, name="Mid")))
    assert rows(gold.dim_line(stg), "line_name") == [("New",)]
    assert rows(gold.dim_status(stg), "status_desc", "status_category") == [("Minor", "Minor Delays")]
    assert gold.dim_datetime(stg).count() == 24


def test_percentiles_of_many_incidents_are_exact(spark):
    n = 200_000
    ids = spark.range(n, numPartitions=7)
    length = F.col("id") * 7_919 % n + 1  # 1 to n in no order
    scored = ids.select(F.lit("a").alias("line_id"), F.lit(T0).alias("interval_start_ts"), length.alias("interval_seconds"), F.lit(True).alias("is_disrupted"), F.lit(T0).alias("ingest_ts"))
    hours = spark.createDataFrame([(T0.date(), "a", "A", "metro", 1, 1, 0, 0.0, 1, 3, T0)], "service_date date, line_id string, line_name string, mode string, total_seconds long, good_service_seconds long, disruption_seconds long, severity_weighted_seconds double, incident_count long, worst_status_severity int, max_source_ingest_ts timestamp")
    changes = spark.createDataFrame([], "line_id string, change_ts timestamp, time_in_new_state_seconds long, recovery_flag boolean, time_since_prev_seconds long, source_ingest_ts timestamp")
    got = gold.mart_line_day(hours, scored, changes)
    assert rows(got, "p50_incident_duration_seconds", "p95_incident_duration_seconds") == [(n // 2, n * 95 // 100)]
    assert dict(got.dtypes)["p50_incident_duration_seconds"] == "bigint"


def test_current_status_is_told_at_a_given_time(make):
    stg = gold.staged(make(event(0, 10), event(30, 3, reason="signal")))
    got = gold.current_status(gold.fact_interval(stg), gold.dim_line(stg), gold.dim_status(stg), F.lit(T0 + timedelta(minutes=45))).first()
    assert (got["status_severity"], got["disruption_category"], float(got["last_changed_minutes_ago"])) == (3, "Signal Failure", 15.0)


def test_empty_silver_gives_empty_tables(make):
    for name in models():
        assert derive(make(), name, F.lit(T0)).count() == 0


def test_models_come_after_what_they_need():
    seen = {"silver"}
    for m in ordered():
        assert set(m.needs) <= seen
        seen.add(m.name)


def test_safe_divide_and_iso_timestamps(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(fsql.safe_divide(F.col("a"), F.col("b"))).collect()] == [None, 0.5, None]
    texts = {"2026-02-04T16:58:53Z": 53, "2026-02-02T17:32:23.84Z": 23, "2026-02-02T17:32:23.827Z": 23, "2026-02-02T17:32:23.123456+00:00": 23, "0001-01-01T00:00:00": 0, "2026-02-02": 0, "garbage": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", F.second(fsql.parse_iso_ts(F.col("t")))).collect()} == texts


def test_checks_find_what_is_wrong(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z", 3)], "k string, v int")
    parent = spark.createDataFrame([("a",)], "k string")
    assert quality.not_null(df, "k").count() == 1
    assert rows(quality.unique(df, "k"), "k", "row_count") == [("a", 2)]
    assert rows(quality.accepted_values(df, "k", ["a"]), "k") == [("z",)]
    assert rows(quality.relationships(df, "k", parent, "k"), "k") == [("z",)]


def test_freshness_levels(spark):
    df = spark.createDataFrame([(T0,)], "t timestamp")
    for minutes_, state in ((30, "pass"), (31, "warn"), (121, "error")):
        assert quality.freshness(df, "t", F.lit(T0 + timedelta(minutes=minutes_))).first()["status"] == state
    assert quality.freshness(df.limit(0), "t", F.lit(T0)).first()["status"] == "error"


def days(spark, shares, gap=None):
    day = date(2024, 1, 1)
    rows_ = [(day + timedelta(days=i + (gap is not None and i >= gap)), s, 6) for i, s in enumerate(shares)]
    return spark.createDataFrame(rows_, "service_date date, network_good_service_pct double, lines_reporting int")


def test_trend_needs_two_bad_days_in_a_row(spark):
    today = F.lit("2025-01-01").cast("date")
    good = [0.9] * 8
    assert quality.trend_regression(days(spark, [*good, 0.5, 0.5]), today).count() == 1
    assert quality.trend_regression(days(spark, [*good, 0.9, 0.5]), today).count() == 0
    assert quality.trend_regression(days(spark, [*good, 0.5, 0.5], gap=9), today).count() == 0
    assert quality.trend_regression(days(spark, [0.9] * 5 + [0.5, 0.5]), today).count() == 0


def test_invariants_find_planted_violations(make, spark):
    stg = gold.staged(make(event(0, 10), event(30, 9), event(90, 10)))
    intervals = gold.fact_interval(stg)
    assert quality.interval_continuity(intervals).count() == quality.interval_bounds(intervals).count() == 0
    broken = intervals.withColumn("interval_end_ts", F.col("interval_start_ts"))
    assert quality.interval_continuity(broken).count() == 2 and quality.interval_bounds(broken).count() == 3
    changes = gold.fact_change(intervals)
    assert quality.prev_alignment(changes).count() == quality.no_repeated_state(changes).count() == 0
    assert quality.prev_alignment(changes.withColumn("prev_status_severity", F.lit(1))).count() == 1
    assert quality.no_repeated_state(changes.withColumn("new_status_severity", F.lit(1)).withColumn("new_reason_text_hash", F.lit("x"))).count() == 1
    assert len(quality.suite(F.current_date())) == 66
