"""URL filters by a sort-merge range join.

A rule (host, path) fits a url whose host is the rule's or below it and whose path begins with the rule's. With the host's
labels reversed, a rule is a prefix of ``key(host, path)`` and so an interval of keys; intervals nest or are disjoint. A url
has one key for each domain above its host. Keys and rules are sorted together in ranges; a sweep over a range keeps the
active rules, nested, on a stack whose top is the longest that fits. A rule that reaches into several ranges is sent to each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys looked at for each range when the ranges are laid out.
LOOKED_AT = 100
KEYED = pa.schema([("range", pa.int32()), ("key", pa.string()), ("kind", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
DDL = "range int, key string, kind int, host string, path string, rule string, verdict string"
FITTED = pa.schema([("host", pa.string()), ("path", pa.string()), ("size", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())])


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def key(host: Column, path: Column) -> Column:
    """Reversed labels, a NUL, the path. A NUL in a host counts as another character, as no rule has one."""
    return F.concat(F.array_join(F.reverse(F.split(F.translate(host, "\0", "\1"), r"\.", -1)), ","), F.lit("\0"), path)


def above(host: Column) -> Column:
    """The host and each domain above it."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def lay_out(keys: DataFrame, ranges: int) -> list[bytes]:
    """The first keys of all ranges but the first. Only keys for these are looked at: they decide where rows go, not which."""
    share = min(1.0, LOOKED_AT * ranges / max(1, keys.count()))
    found = sorted({r[0].encode() for r in keys.select("key").sample(share, 11).limit(4 * LOOKED_AT * ranges).collect()})
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def dealt(firsts: list[bytes]):
    """Sends a key to its range, and a rule to each range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kinds = [x.encode() for x in batch["key"].to_pylist()], batch["kind"].to_pylist()
            rows, ranges = [], []
            for i, (k, kind) in enumerate(zip(keys, kinds, strict=True)):
                first = bisect_right(firsts, k)
                last = bisect_right(firsts, k + b"\xff") if kind == 0 else first
                rows += [i] * (last - first + 1)
                ranges += range(first, last + 1)
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *[out[f.name] for f in KEYED if f.name != "range"]], schema=KEYED)

    return run


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by range, key and kind (rules first): the longest rule that fits each key."""
    stack: list[tuple[str, str, str]] = []
    at = None
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for r, k, kind, host, path, rule, verdict in zip(*[batch[f.name].to_pylist() for f in KEYED], strict=True):
            if r != at:
                stack, at = [], r
            while stack and not k.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((k, rule, verdict))
            elif stack:
                for column, x in zip(out, (host, path, len(stack[-1][1]), *stack[-1][1:]), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, FITTED, strict=True)], schema=FITTED)


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path, or null) and verdict of each row of pages.

    rules: host, path, verdict; of equal rules the first verdict in the alphabet holds. The longest rule that fits wins; with
    none, the verdict is ``otherwise``. A null url, or one without ``://``, has an empty host and path and no rule. Repeated
    rows each get their row; of the columns only page_id and url are read.
    """
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    urls = common.own_columns(pages, ["page_id", "url"]).select("page_id", host.alias("host"), path.alias("path"))
    ranges = common.partitions(spark)
    # one key, however often a url is there; few bytes that become many keys, so not to be coalesced
    apart = urls.filter(F.col("host") != "").select("host", "path").distinct().repartition(ranges, F.xxhash64("host", "path"))
    none = F.lit(None).cast("string")
    keys = apart.withColumn("domain", F.explode(above(F.col("host")))).select(key(F.col("domain"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "host", "path", none.alias("rule"), none.alias("verdict"))
    rules = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    starts = rules.select(key(F.col("host"), F.col("path")).alias("key"), F.lit(0).alias("kind"), none.alias("host"), none.alias("path"), F.concat("host", "path").alias("rule"), "verdict")
    firsts = lay_out(keys, ranges)
    both = keys.unionByName(starts).mapInArrow(dealt(firsts), DDL)
    fitted = both.repartition(ranges, "range").sortWithinPartitions("range", "key", "kind").mapInArrow(sweep, "host string, path string, size int, rule string, verdict string")
    best = fitted.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
