"""python -m tidewatch COMMAND: see --help."""

from __future__ import annotations

import argparse
import json
import sys
import urllib.request

from pyspark.sql import functions as F

from .operators.incremental import Gold
from .operators.quality import counts, freshness, suite
from .operators.store import Table
from .plans.registry import ordered
from .session import Config, session
from .sources import delimited, messages, views
from .sources.events import SILVER
from .streaming import jobs


def notify(url: str, context: str, step: str, code: int, opener=urllib.request.urlopen) -> None:
    """Posts a failed step as JSON."""
    body = json.dumps({"text": f"{context}: {step} failed with {code}", "context": context, "step": step, "exit_code": code}).encode()
    opener(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=10)


def checked(spark, config: Config, today) -> int:
    """Prints the checks with violating rows; how many there are."""
    gold, silver = Gold(spark, config), Table(spark, config.silver, SILVER).read()
    failed = counts(suite(today), lambda n: gold.read(n, silver)).filter("failures > 0").collect()
    for r in failed:
        print(f"{r['check']}: {r['failures']}")
    return len(failed)


#: The steps of the gate, in order.
STEPS = ("parse", "lint", "freshness", "build", "test")


def gate(args: argparse.Namespace) -> int:
    """Runs STEPS until one fails; tells which, also to the webhook, and returns its code."""
    for step in STEPS:
        try:
            code = run(argparse.Namespace(**vars(args) | {"command": step}))
        except Exception as e:
            print(f"{step}: {e}", file=sys.stderr)
            code = 1
        if code:
            print(f"{step} failed with {code}", file=sys.stderr)
            if args.webhook_url:
                notify(args.webhook_url, "tidewatch ci", step, code)
            return code
    return 0


def run(args: argparse.Namespace) -> int:
    config = Config(warehouse=args.warehouse) if args.warehouse else Config()
    if args.command == "parse":
        for m in ordered():
            print(m.name, "<-", ", ".join(m.needs))
        return 0
    if args.command == "produce":
        s = messages.settings(args)
        try:
            from confluent_kafka import Producer
        except ImportError:
            print("produce needs a broker client that isn't installed", file=sys.stderr)
            return 2
        client = Producer({"bootstrap.servers": s.bootstrap, **messages.PRODUCER})
        print(json.dumps(messages.produce(s, lambda t, k, v: client.produce(t, key=k, value=v), client.flush)))
        return 0
    spark = session(master=args.master)
    if args.command == "load-csv":
        print(delimited.load(spark, args.filepath, config.warehouse, args.schema).path)
        return 0
    if args.command == "stream":
        records = jobs.streams.files(spark, args.input, most_files=args.max_files) if args.input else jobs.streams.topic(spark, args.bootstrap, args.topic, args.max_offsets) if args.job != "silver" else None
        trigger = {"availableNow": True} if args.once else None
        at = f"{config.warehouse}/_checkpoints/{args.job}"
        if args.job == "raw":
            query = jobs.land_raw(records, config.path("raw", "line_status"), at, trigger)
        elif args.job == "bronze" and args.bronze_table:
            query = jobs.append_bronze_table(records, args.bronze_table, at, trigger)
        elif args.job == "bronze":
            query = jobs.append_bronze(records, config.path("bronze", "line_status"), at, trigger)
        else:
            bronze = jobs.streams.table(spark, args.bronze_table, args.max_files) if args.bronze_table else jobs.bronze_stream(spark, config.path("bronze", "line_status"), args.max_files)
            query = jobs.Silver(spark, config, args.strict).start(bronze, at, trigger)
        query.awaitTermination()
        return 0
    if args.command == "lint":
        for m in ordered():
            Gold(spark, config).schema(m.name)
        return 0
    if args.command == "ci":
        return gate(args)
    silver = Table(spark, config.silver, SILVER).read()
    if args.command == "freshness":
        found = freshness(silver, "ingest_ts", F.current_timestamp(), config.warn_minutes, config.error_minutes).first()
        print(found["status"], found["newest"])
        return int(found["status"] == "error")
    if args.command in ("build", "full-build"):
        gold = Gold(spark, config)
        gold.full(silver) if args.command == "full-build" else gold.refresh(silver)
    if args.command == "sql":
        views.register(spark, config)
        spark.sql(args.query).show(args.limit, False)
        return 0
    return int(checked(spark, config, F.current_date()) > 0)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser("tidewatch")
    top.add_argument("--warehouse")
    top.add_argument("--master")
    top.add_argument("--webhook-url")
    commands = top.add_subparsers(dest="command", required=True)
    for name, does in (("parse", "print the models in order"), ("freshness", "how old the newest silver event is"), ("build", "refresh the gold tables and check them"), ("full-build", "rebuild the gold tables and check them"), ("test", "check the gold tables"), ("lint", "analyse every model over empty inputs"), ("ci", "parse, lint, freshness, build and test, up to the first that fails")):
        commands.add_parser(name, help=does)
    load = commands.add_parser("load-csv")
    load.add_argument("filepath")
    load.add_argument("--schema", default="public")
    ask = commands.add_parser("sql")
    ask.add_argument("query")
    ask.add_argument("--limit", type=int, default=20)
    stream = commands.add_parser("stream")
    stream.add_argument("job", choices=["raw", "bronze", "silver"])
    stream.add_argument("--input", help="a folder of record files instead of a broker")
    stream.add_argument("--bootstrap", default="localhost:9092")
    stream.add_argument("--topic", default="line_status_raw")
    stream.add_argument("--bronze-table", help="a catalog table instead of a folder of the warehouse")
    stream.add_argument("--max-offsets", type=int, help="most records of a topic in a batch")
    stream.add_argument("--max-files", type=int, help="most new files in a batch")
    stream.add_argument("--once", action="store_true")
    stream.add_argument("--strict", action="store_true")
    commands.add_parser("produce", parents=[messages.arguments()], add_help=False, conflict_handler="resolve")
    args = top.parse_args(argv)
    try:
        code = run(args)
    except Exception:
        if args.webhook_url:
            notify(args.webhook_url, "tidewatch", args.command, 1)
        raise
    if code and args.webhook_url and args.command != "ci":
        notify(args.webhook_url, "tidewatch", args.command, code)
    return code


if __name__ == "__main__":
    sys.exit(main())
