"""Keyed tables, refreshes, message parsing, streams, the loader and the commands."""

import json
import os
import subprocess
import zipfile
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch import __main__ as commands
from tidewatch.operators import incremental, store
from tidewatch.operators.store import Conflict, Table, create_table_sql, first_of
from tidewatch.session import Config
from tidewatch.sources import delimited, events, messages, views
from tidewatch.streaming import jobs

def now():
    return F.lit(datetime(2024, 3, 1))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return lambda parts=None: Table(spark, str(tmp_path / "t"), "k int, p string, v int", parts)


@pytest.mark.parametrize("parts", [None, "p"])
def test_upserts(spark, table, parts):
    t = table(parts)
    frame = lambda *r: spark.createDataFrame(list(r), "k int, p string, v int")
    assert rows(t.read()) == []
    t.upsert(frame((1, "a", 1), (2, "b", 2), (None, "a", 3)), ["p", "k"])
    t.upsert(frame((1, "a", 9), (3, "a", 3), (None, "a", 9)), ["p", "k"])
    assert rows(t.read()) == rows(frame((1, "a", 1), (2, "b", 2), (None, "a", 3), (3, "a", 3)))
    t.upsert(frame((1, "a", 9), (4, None, 4)), ["p", "k"], update=["v"])
    assert rows(t.read()) == rows(frame((1, "a", 9), (2, "b", 2), (None, "a", 3), (3, "a", 3), (4, None, 4)))
    assert rows(t.read(version=1)) == rows(frame((1, "a", 1), (2, "b", 2), (None, "a", 3)))
    t.replace_keys(frame((7, "a", 7)), frame((0, "a", 0)).select("p"), "p")
    assert rows(t.read()) == rows(frame((2, "b", 2), (4, None, 4), (7, "a", 7)))
    t.vacuum(1)
    assert rows(t.read()) == rows(frame((2, "b", 2), (4, None, 4), (7, "a", 7))) and len(t.versions()) == 1


def test_partial_updates_keep_other_columns(spark, table):
    t = table()
    t.overwrite(spark.createDataFrame([(1, "a", 1)], "k int, p string, v int"))
    t.upsert(spark.createDataFrame([(1, "z", 5), (2, "n", 6)], "k int, p string, v int"), ["k"], update=["v"])
    assert rows(t.read()) == [(1, "a", 5), (2, "n", 6)]


def test_a_second_writer_of_a_version_fails_and_changes_nothing(spark, table):
    t = table()
    t.overwrite(spark.createDataFrame([(1, "a", 1)], "k int, p string, v int"))
    with pytest.raises(Conflict):
        t._publish({"version": 0}, [])
    assert t.read().count() == 1


def written(t):
    """Bytes under the table's folder of data."""
    return sum(f.stat().st_size for f in Path(t.path, "data").rglob("*.parquet"))


@pytest.mark.parametrize("update", [None, ["p", "v"], ["v"]])
def test_what_a_batch_writes_does_not_grow_with_the_table(spark, tmp_path, update):
    cost = []
    for n in (1_000, 100_000):
        t = Table(spark, str(tmp_path / f"{n}"), "k int, p string, v int")
        t.overwrite(spark.range(n).selectExpr("cast(id as int) k", "sha2(cast(id as string), 256) p", "cast(id as int) v").coalesce(1))
        before = written(t)
        t.upsert(spark.range(n - 50, n + 50).selectExpr("cast(id as int) k", "'new' p", "7 v").coalesce(1), ["k"], update)
        cost.append(written(t) - before)
        found = t.read()
        assert found.count() == n + 50 and found.filter("v = 7").count() == 1 + (100 if update else 50)
    assert 0 < cost[1] < 2 * cost[0] + 10_000


def test_replaced_keys_write_their_rows_alone_and_many_marks_are_compacted(spark, table, monkeypatch):
    monkeypatch.setattr(store, "MOST_MARKS", 3)
    t, frame = table(), lambda *r: spark.createDataFrame(list(r), "k int, p string, v int")
    t.overwrite(frame(*[(i, "abc"[i % 3], i) for i in range(30)]))
    want = {(i, "abc"[i % 3], i) for i in range(30)}
    for step in range(6):
        p = "abc"[step % 3]
        t.replace_keys(frame((100 + step, p, step)), frame((0, p, 0)).select("p"), "p")
        t.upsert(frame((200, "z", step), (201 + step, "z", step)), ["k"], ["p", "v"])
        want = {r for r in want if r[1] != p and r[0] != 200} | {(100 + step, p, step), (200, "z", step), (201 + step, "z", step)}
        assert rows(t.read()) == sorted(want, key=repr)
        assert sum(e["gone"] is not None for e in t.manifest()["entries"]) <= 4
    t.replace_keys(frame(), frame((0, "z", 0)).select("p"), "p")
    assert rows(t.read()) == sorted((r for r in want if r[1] != "z"), key=repr)


def test_parts_with_many_folders_are_compacted_and_old_versions_go(spark, table, monkeypatch):
    monkeypatch.setattr(store, "MOST_FOLDERS", 4)
    monkeypatch.setattr(store, "KEPT", 3)
    t = table("p")
    for i in range(12):
        t.upsert(spark.createDataFrame([(i, "a", i), (100 + i, "b" if i else "c", i)], "k int, p string, v int"), ["p", "k"])
    assert t.read().count() == 24 and max(len(v) for e in t.manifest()["entries"] for v in e["parts"].values()) <= 5
    assert len(t.versions()) <= 7 and t.read(parts=["c"]).count() == 1


def test_a_batch_is_computed_once(spark, table):
    t, seen = table("p"), spark.sparkContext.accumulator(0)
    t.overwrite(spark.createDataFrame([(1, "a", 1)], "k int, p string, v int"))

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    t.upsert(spark.createDataFrame([(1, "a", 2), (2, "b", 2), (3, "a", 3)], "k int, p string, v int").mapInPandas(count, "k int, p string, v int"), ["p", "k"])
    assert seen.value == 3 and t.read().count() == 3


def test_of_several_rows_with_one_key_the_first_counts(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "c", 1)], "k int, p string, v int")
    assert rows(first_of(df, ["k"])) == [(1, "a", 3), (2, "c", 1)]
    assert rows(first_of(df, ["k"], [F.desc("p")])) == [(1, "b", 2), (2, "c", 1)]


def test_table_ddl():
    assert create_table_sql("s.t", "a int", "iceberg", "days(ts)", {"format-version": "2"}) == "CREATE TABLE IF NOT EXISTS s.t (a int) USING iceberg PARTITIONED BY (days(ts)) TBLPROPERTIES ('format-version' = '2')"


def test_catalog_tables(spark):
    store.ensure_table(spark, "made_here.t", "a int, b string, c int", partitioned_by="b")
    store.ensure_table(spark, "made_here.t", "a int, b string, c int")
    spark.sql("INSERT INTO made_here.t VALUES (1, 2, 'x')")
    assert spark.table("made_here.t").count() == 1 and store.drop_columns(spark, "made_here.t", ["old"]) == []
    spark.sql("DROP TABLE made_here.t")
    spark.sql("DROP NAMESPACE made_here")


def test_dropped_columns_are_those_that_are_there(spark):
    class Session:
        said = []
        table = staticmethod(lambda name: spark.createDataFrame([], "a int, old int"))
        sql = said.append

    assert store.drop_columns(Session, "s.t", ["old", "older"]) == ["old"] and Session.said == ["ALTER TABLE s.t DROP COLUMNS (old)"]


def test_database(spark):
    """Into a database that Spark brings along, twice; the second load replaces the first."""
    url, how = "jdbc:derby:memory:loader;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for n in (3, 2):
        delimited.to_database(spark.createDataFrame([(f"a{i}", None if i else "x") for i in range(n)], "name string, more string"), url, "things", how)
        assert sorted(r[0] for r in spark.read.jdbc(url, "things", properties=how).collect()) == [f"a{i}" for i in range(n)]


def test_changed_keys_per_key_and_by_one_watermark(spark):
    day = lambda d: datetime(2024, 1, d)
    source = spark.createDataFrame([("a", day(3)), ("b", day(2)), ("c", day(9))], "k string, w timestamp")
    target = spark.createDataFrame([("a", day(3)), ("b", day(1)), ("gone", day(1))], "k string, m timestamp")
    assert rows(incremental.changed_keys(source, "k", "w", target, "m")) == [("b",), ("c",), ("gone",)]
    assert rows(incremental.changed_keys(source, "k", "w", target, "m", per_key=False)) == [("c",)]
    assert incremental.changed_keys(source, "k", "w", target.limit(0), "m", per_key=False).count() == 3


NAMES = ["fact_line_status_interval", "fact_line_status_change", "mart_line_hour", "mart_network_hour", "mart_network_day", "dim_status"]


def test_refresh_equals_full_build_with_late_rows_and_shortened_intervals(spark, data, tmp_path):
    silver = events.silver(spark.read.parquet(f"{data}/events.parquet")).filter("event_ts < '2024-01-06'")
    first = silver.filter((F.col("ingest_ts") < "2024-01-04") & (F.col("bronze_kafka_offset") % 7 != 0))
    as_of = F.lit(datetime(2024, 2, 1))
    step, whole = (incremental.Gold(spark, Config(warehouse=str(tmp_path / x)), as_of) for x in "ab")
    assert set(incremental.needed(step.models, {"dim_line"})) == {"stg_events", "dim_line"}
    step.full(first)
    late = silver.withColumn("ingest_ts", F.when(F.col("bronze_kafka_offset") % 7 == 0, F.lit(datetime(2024, 1, 9))).otherwise(F.col("ingest_ts")))
    step.refresh(late)
    whole.full(late)
    for name in NAMES:
        assert rows(step.table(name).read()) == rows(whole.table(name).read()), name
    version = step.table("mart_line_hour").versions()
    step.refresh(late)
    assert step.table("mart_line_hour").versions() == version


def test_refreshed_days_have_exact_percentiles(spark, tmp_path):
    n, at = 200_000, datetime(2024, 1, 1, 10)
    built = incremental.Gold(spark, Config(warehouse=str(tmp_path)), names={"mart_line_day"})
    scored = spark.range(n, numPartitions=7).select(F.lit("a").alias("line_id"), F.lit(at).alias("interval_start_ts"), (F.col("id") * 7_919 % n + 1).alias("interval_seconds"), F.lit(True).alias("is_disrupted"), F.lit(at).alias("ingest_ts"))
    hours = spark.createDataFrame([(at.date(), "a", "A", "metro", 1, 1, 0, Decimal(0), 1, 3, at)], "service_date date, line_id string, line_name string, mode string, total_seconds long, good_service_seconds long, disruption_seconds long, severity_weighted_seconds decimal(20,1), incident_count long, worst_status_severity int, max_source_ingest_ts timestamp")
    changes = spark.createDataFrame([], "line_id string, change_ts timestamp, time_in_new_state_seconds long, recovery_flag boolean, time_since_prev_seconds long, source_ingest_ts timestamp")
    built._remake(built.models["mart_line_day"], [hours, scored, changes], hours.select("line_id"))
    assert built.table("mart_line_day").read().select("p50_incident_duration_seconds", "p95_incident_duration_seconds").first()[:] == (n // 2, n * 95 // 100)


def message(lines, **more):
    return json.dumps({"ingested_at": "2024-01-01T10:00:00Z", "request_id": "r", "payload": lines} | more)


def bronze(spark, *payloads):
    at = datetime(2024, 1, 1, 9)
    return spark.createDataFrame([("t", 0, i, at, "k", p, at, "h") for i, p in enumerate(payloads)], messages.BRONZE)


GOOD = {"id": "a", "name": "A", "modeName": "metro", "lineStatuses": [{"statusSeverity": 10, "statusSeverityDescription": "Good Service", "validityPeriods": []}]}


@pytest.mark.parametrize(
    ("payload", "good", "reasons"),
    [
        (message([GOOD]), 1, []),
        (message([GOOD], modes="metro,tram"), 1, []),
        (None, 0, ["JSON_PARSE_FAILED"]),
        ("", 0, ["JSON_PARSE_FAILED"]),
        ("{not json", 0, ["REQUIRED_FIELD_MISSING"]),
        ("null", 0, ["REQUIRED_FIELD_MISSING"]),
        ("[1]", 0, ["REQUIRED_FIELD_MISSING"]),
        ("{}", 0, ["REQUIRED_FIELD_MISSING"]),
        (message([]), 0, ["REQUIRED_FIELD_MISSING"]),
        (message([GOOD | {"lineStatuses": []}]), 0, ["REQUIRED_FIELD_MISSING"]),
        (message([GOOD | {"lineStatuses": [{"statusSeverity": "x"}]}]), 0, ["REQUIRED_FIELD_MISSING"]),
        (message([GOOD, {"id": None, "lineStatuses": [{"statusSeverity": 3}]}, {"id": None}]), 1, ["REQUIRED_FIELD_MISSING"]),
        (message([GOOD | {"lineStatuses": [{"statusSeverity": 9, "reason": "b"}, {"statusSeverity": 9, "reason": "a"}, {"statusSeverity": 3}]}]), 2, []),
    ],
)
def test_parsing(spark, payload, good, reasons):
    parsed = messages.parsed(bronze(spark, payload))
    found = messages.statuses(parsed, now())
    assert messages.clean_events(found).count() == good
    assert [r["error_reason"] for r in messages.quarantined(found, messages.parse_failures(parsed, now()), now()).collect()] == reasons


def test_strict_parsing_tells_malformed_text(spark):
    parsed = messages.parsed(bronze(spark, "{not json", "[1]", message([GOOD])), strict=True)
    assert messages.parse_failures(parsed, now()).count() == 2


def test_event_fields(spark):
    state = {"statusSeverity": 6, "reason": "x", "validityPeriods": [{"fromDate": "2024-01-01T08:00:00Z", "toDate": "2024-01-01T12:00:00.5Z"}, {"fromDate": "2025-01-01T08:00:00Z"}]}
    got = messages.clean_events(messages.statuses(messages.parsed(bronze(spark, message([GOOD | {"lineStatuses": [state]}]))), now())).first()
    assert got["valid_from"] == datetime(2024, 1, 1, 8) and got["valid_to"] == datetime(2024, 1, 1, 12, 0, 0, 500000)
    assert got["is_disrupted"] and got["event_ts"] == datetime(2024, 1, 1, 10) and got["schema_version"] == 1 and got["payload_hash"] == "h"
    assert got.asDict().keys() == dict.fromkeys(events.SILVER_COLUMNS).keys()


def test_metrics_over_no_statuses_are_null(spark):
    parsed = messages.parsed(bronze(spark, None))
    got = messages.metrics(messages.statuses(parsed, now()), messages.parse_failures(parsed, now()), 3, now()).first()
    assert (got["batch_id"], got["total_rows"], got["good_rows"], got["bad_rows"], got["parse_fail_rows"]) == (3, 0, None, None, 1)


def test_streams_and_replay(spark, tmp_path):
    records = [("t", 0, i, datetime(2024, 1, 1), bytearray(b"k"), bytearray(p.encode())) for i, p in enumerate([message([GOOD]), "", message([GOOD | {"id": "b"}])])]
    spark.createDataFrame(records, jobs.streams.RECORD).coalesce(1).write.parquet(str(tmp_path / "topic"))
    once, config = {"availableNow": True}, Config(warehouse=str(tmp_path / "lake"))
    read = lambda: jobs.streams.files(spark, str(tmp_path / "topic"))
    jobs.append_bronze(read(), config.path("bronze", "line_status"), str(tmp_path / "c1"), once).awaitTermination()
    jobs.land_raw(read(), config.path("raw", "line_status"), str(tmp_path / "c2"), once).awaitTermination()
    assert spark.read.parquet(config.path("raw", "line_status")).count() == 3
    states = []
    for i in range(2):
        job = jobs.Silver(spark, config, clock=lambda: datetime(2024, 1, 2))
        job.start(jobs.bronze_stream(spark, config.path("bronze", "line_status")), str(tmp_path / f"s{i}"), once).awaitTermination()
        states.append([rows(job.events.read()), rows(job.quarantine.read()), rows(job.metrics.read())])
    assert states[0] == states[1] and [len(x) for x in states[0]] == [2, 1, 1]
    job.process(spark.createDataFrame([], messages.BRONZE), 9)
    assert rows(job.metrics.read()) == states[0][2]
    assert {"silver_line_status_events", "quarantine", "dq_metrics", "bronze_line_status"} <= set(views.register(spark, config))
    assert spark.sql("select count(*) from silver_line_status_events").first()[0] == 2


@pytest.mark.parametrize("limit", [{"PIECE_ROWS": 10}, {"PIECE_BYTES": 3000}])
def test_a_batch_in_one_file_is_kept_in_pieces_by_offset(spark, tmp_path, monkeypatch, limit):
    for k, v in limit.items():
        monkeypatch.setattr(jobs, k, v, raising=False)
    pieces, keep = [], messages.clean_events
    monkeypatch.setattr(messages, "clean_events", lambda found: pieces.append(found.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) or keep(found))
    job = jobs.Silver(spark, Config(warehouse=str(tmp_path / "lake")), clock=lambda: datetime(2024, 1, 2))
    payloads = [message([GOOD, GOOD | {"id": "b"}]) if i % 10 else None for i in range(100)]
    job.process(bronze(spark, *payloads).coalesce(1), 0)
    assert len(pieces[0]) >= 8 and sum(pieces[0]) == 180 and max(pieces[0]) <= 60
    assert job.events.read().count() == 180 and job.quarantine.read().count() == 10
    assert job.metrics.read().select("total_rows", "parse_fail_rows").first()[:] == (180, 10)


@pytest.mark.parametrize("strict", [False, True])
def test_outcomes_hold_statuses_and_failures(spark, strict):
    parsed = messages.parsed(bronze(spark, None, "", "{not json", "[1]", message([GOOD]), message([GOOD | {"id": None}]), message([])), strict)
    found, failures = messages.of_outcomes(messages.outcomes(parsed, now()), now())
    assert rows(found) == rows(messages.statuses(parsed, now()))
    assert rows(failures) == rows(messages.parse_failures(parsed, now())) and failures.count() == (4 if strict else 2)
    assert [r["_payload"] is None for r in found.orderBy("bronze_kafka_offset").collect()][-3:] == [True, False, False]


def test_stream_commands_with_a_limit_and_a_bronze_table(spark, tmp_path):
    for i, p in enumerate([message([GOOD]), "", message([GOOD | {"id": "b"}])]):
        spark.createDataFrame([("t", 0, i, datetime(2024, 1, 1), bytearray(b"k"), bytearray(p.encode()))], jobs.streams.RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "topic"))
    base, config = ["--warehouse", str(tmp_path / "lake"), "stream"], Config(warehouse=str(tmp_path / "lake"))
    name = f"bronze_{tmp_path.name}".replace("-", "_")
    assert commands.main([*base, "bronze", "--input", str(tmp_path / "topic"), "--bronze-table", name, "--max-files", "1", "--once"]) == 0
    assert len(list((tmp_path / "lake/_checkpoints/bronze/commits").glob("[0-9]"))) == 3 and spark.table(name).count() == 3
    assert commands.main([*base, "silver", "--bronze-table", name, "--once"]) == 0
    assert Table(spark, config.silver, events.SILVER).read().count() == 2
    spark.sql(f"DROP TABLE {name}")


def test_topic_options(monkeypatch):
    class Reader:
        def __init__(self):
            self.options = {}

        def option(self, k, v):
            self.options[k] = v
            return self

        def format(self, name):
            self.options["format"] = name
            return self

        def load(self):
            return self.options

    class Session:
        readStream = property(lambda self: Reader())

    assert jobs.streams.topic(Session(), "b:1", "t", 5000) == {"format": "kafka", "kafka.bootstrap.servers": "b:1", "subscribe": "t", "startingOffsets": "earliest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": 5000}


def test_column_names():
    assert delimited.column_names(["A b", "a-b", "A B", "é!", "", "a_b_2"]) == ["a_b", "a_b_2", "a_b_3", "e", "column", "a_b_2_2"]


def test_loader(spark, tmp_path):
    at = tmp_path / "things.csv"
    at.write_text('Name,name,Größe\n"a, ""b""",x,1\n,y,é\n', encoding="utf-8")
    got = delimited.load(spark, str(at), str(tmp_path / "lake"))
    assert got.path.endswith("public/things") and got.read().columns == ["name", "name_2", "grosse"] or got.read().columns == ["name", "name_2", "groe"]
    assert sorted(map(tuple, got.read().collect()), key=repr) == [('a, "b"', "x", "1"), (None, "y", "é")]
    at.write_text("q\n1\n", encoding="utf-8")
    assert delimited.load(spark, str(at), str(tmp_path / "lake")).read().columns == ["q"]


class Answer:
    status, headers = 200, {"Date": "d", "X": "y"}

    def __init__(self, body):
        self.body = body

    def read(self):
        return self.body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def test_poll_retries_then_gives_up():
    calls, waits = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise TimeoutError
        return Answer(b'[{"b": 1, "a": 2}]')

    body, status_, ms, headers = messages.http_get_json("http://x", {"q": 1}, 5, opener, waits.append)
    assert body == [{"b": 1, "a": 2}] and status_ == 200 and headers == {"date": "d"} and len(waits) == 2 and all(1 <= w <= 10 for w in waits) and calls[0] == "http://x?q=1"
    calls[:] = []
    with pytest.raises(TimeoutError):
        messages.http_get_json("http://x", {}, 5, lambda *a, **k: (_ for _ in ()).throw(TimeoutError()), waits.append)


def test_produce_and_settings():
    parse = messages.arguments().parse_args
    env = {"STATUS_APP_KEY": "k", "STATUS_MODES": "tram", "KAFKA_BOOTSTRAP": "b:1"}
    s = messages.settings(parse(["--modes", "metro", "--no-fetch-severity"]), env)
    assert (s.modes, s.bootstrap, s.fetch_severity, s.timeout_s) == ("metro", "b:1", False, 15.0)
    for missing in ({}, env | {"STATUS_APP_KEY": " "}, env | {"KAFKA_BOOTSTRAP": ""}):
        with pytest.raises(ValueError):
            messages.settings(parse([]), missing)
    sent = []
    get = lambda url, params, timeout: ([{"id": "a"}], 200, 3, {})
    got = messages.produce(messages.settings(parse([]), env), lambda t, k, v: sent.append((t, k, json.loads(v))), lambda s_: 0, get)
    assert got["sent_messages"] == 2 and sent[0][1] == "line_status|tram" and sent[0][2]["payload_hash"] == messages.canonical_hash([{"id": "a"}])
    with pytest.raises(RuntimeError):
        messages.produce(messages.settings(parse([]), env), lambda *a: None, lambda s_: 1, get)
    assert messages.canonical_hash({"b": 1, "a": 2}) == messages.canonical_hash({"a": 2, "b": 1})


def test_commands(spark, tmp_path, capsys):
    assert commands.main(["parse"]) == 0 and "mart_line_day <- mart_line_hour" in capsys.readouterr().out
    config = Config(warehouse=str(tmp_path / "lake"))
    at = datetime.now()
    row = ("1", at, at, "a", "A", "metro", 10, "Good", None, None, None, False, "h", "t", 0, 1, at, "k", at, "r", 1)
    Table(spark, config.silver, events.SILVER).overwrite(spark.createDataFrame([row], events.SILVER))
    base = ["--warehouse", config.warehouse]
    assert commands.main([*base, "freshness"]) == 0 and capsys.readouterr().out.startswith("pass")
    assert commands.main([*base, "build"]) == 0
    assert commands.main([*base, "sql", "select line_id from gold_current_line_status"]) == 0 and "|a" in capsys.readouterr().out
    Table(spark, config.silver, events.SILVER).overwrite(spark.createDataFrame([row[:2] + (at - timedelta(hours=3),) + row[3:6] + (99,) + row[7:]], events.SILVER))
    assert commands.main([*base, "freshness"]) == 1
    assert commands.main([*base, "full-build"]) == 1 and "accepted_values_dim_status_status_severity: 1" in capsys.readouterr().out


def test_the_gate_stops_at_the_first_step_that_fails(spark, tmp_path, capsys, monkeypatch):
    told = []
    monkeypatch.setattr(commands, "notify", lambda url, context, step, code: told.append((step, code)))
    base = ["--warehouse", str(tmp_path / "none"), "--webhook-url", "http://h"]
    assert commands.main([*base, "lint"]) == 0
    assert commands.main([*base, "ci"]) == 1 and told == [("freshness", 1)] and "freshness failed" in capsys.readouterr().err


def test_submitting(tmp_path):
    """The script packs the engine and hands its arguments on."""
    fake = tmp_path / "bin/spark-submit"
    fake.parent.mkdir()
    fake.write_text('#!/bin/sh\nprintf "%s\\n" "$@"\n')
    fake.chmod(0o755)
    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([root / "scripts/submit.sh", "stream", "silver", "--once"], env=os.environ | {"SPARK_HOME": str(tmp_path), "SPARK_MASTER": "yarn"}, capture_output=True, text=True, check=True).stdout.splitlines()
    assert said[-4:] == [str(root / "scripts/run.py"), "stream", "silver", "--once"] and said[:2] == ["--master", "yarn"]
    assert "tidewatch/__main__.py" in zipfile.ZipFile(said[said.index("--py-files") + 1]).namelist()


def test_schema_names():
    assert Config(gold_schema="g").schema_for(None) == "g" and Config().schema_for(" own ") == "own"
    model = incremental.models()["dim_line"]
    assert incremental.Gold(None, Config(warehouse="w", gold_schema="g")).models["dim_line"] == model or model.schema is None


def test_notify():
    got = []
    commands.notify("http://h", "ctx", "build", 3, lambda request, timeout: got.append(json.loads(request.data)))
    assert got[0]["step"] == "build" and got[0]["exit_code"] == 3
