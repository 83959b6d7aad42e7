"""Keyed tables on plain parquet: a manifest names the folders that make up the current version, as a log of entries.

A table is cut into parts by an expression over its columns (or is a single part). An entry has folders of rows by part, and
may have marks: keys of which no row of an earlier entry counts any more. So inserts, updates and replaced keys all write what
is new and nothing else, and what they write doesn't grow with the table; readers leave out marked rows by a join with the
marks. When marks or folders get many, the rows that count are written anew.

A change publishes its manifest last; readers of the old version are not disturbed, and a job that dies before changes nothing.
One writer at a time: publishing a version that exists already fails, on file systems whose rename fails then (HDFS, local); an
object store needs a single writer or a committer that gives the same.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALL = "__all__"
#: Entries with marks, and folders of a part, before the rows that count are written anew; versions that are kept.
MOST_MARKS, MOST_FOLDERS, KEPT = 16, 64, 20


class Conflict(RuntimeError):
    """Another writer published the version first."""


class Table:
    """A keyed parquet table at a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, parts_by: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema])
        self.parts_by = parts_by  # an SQL expression
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, and entries in order: parts (part value -> folders), gone (a folder of marks or None), on (their columns)."""
        found = self.versions()
        if not found:
            return {"version": 0, "entries": []}
        version = found[-1] if version is None else version
        stream = self._fs.open(self._path(f"{self.path}/_manifests/v{version:010d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, old: dict, entries: list[dict]) -> None:
        new = old["version"] + 1
        temporary, final = self._path(f"{self.path}/_manifests/.{uuid.uuid4().hex}"), self._path(f"{self.path}/_manifests/v{new:010d}.json")
        there = self.versions()
        if new in there:
            raise Conflict(f"{self.path}: version {new} is there")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps({"version": new, "entries": entries}).encode()))
        stream.close()
        if not self._fs.rename(temporary, final):
            raise Conflict(f"{self.path}: version {new} is there")
        if len(there) >= 2 * KEPT:
            self.vacuum(KEPT)

    def _add(self, old: dict, parts: dict[str, str], gone: str | None = None, on: list[str] | None = None, drop: Iterable[str] = ()) -> None:
        """Publishes old with rows added, after earlier rows were dropped by part or marked. Rows without marks join the last entry."""
        drop = set(drop)
        entries = [e | {"parts": {k: v for k, v in e["parts"].items() if k not in drop}} for e in old["entries"]]
        if gone or not entries:
            entries.append({"parts": {}, "gone": gone, "on": on})
        last = dict(entries[-1]["parts"])
        for k, folder in parts.items():
            last[k] = [*last.get(k, []), folder]
        entries[-1] = entries[-1] | {"parts": last}
        self._publish(old, entries)
        if sum(e["gone"] is not None for e in entries) > MOST_MARKS:
            self.compact()
        elif many := [k for k, v in last.items() if len(v) > MOST_FOLDERS]:
            self.compact(many)

    # reading

    def read(self, version: int | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """The current rows (or those of an earlier version, or of some parts)."""
        entries, wanted = self.manifest(version)["entries"], None if parts is None else set(parts)
        folders = [[f for k, v in e["parts"].items() if wanted is None or k in wanted for f in v] for e in entries]
        if not any(folders):
            return self.spark.createDataFrame([], self.schema)
        if not any(e["gone"] for e in entries[1:]):
            return self._rows([f for each in folders for f in each])
        rows = reduce(DataFrame.unionAll, [self._rows(each).withColumn("_entry", F.lit(i)) for i, each in enumerate(folders) if each])
        for on in {tuple(e["on"]) for e in entries if e["gone"]}:
            schema = T.StructType([T.StructField(f"_on_{c}", self.schema[c].dataType) for c in on])
            marks = [self.spark.read.schema(schema).parquet(f"{self.path}/{e['gone']}").withColumn("_since", F.lit(i)) for i, e in enumerate(entries) if e["gone"] and tuple(e["on"]) == on]
            last = reduce(DataFrame.unionAll, marks).groupBy(*schema.names).agg(F.max("_since").alias("_since"))
            same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
            rows = rows.join(last, same, "left").filter(F.col("_since").isNull() | (F.col("_entry") >= F.col("_since"))).drop("_since", *schema.names)
        return rows.drop("_entry")

    def _rows(self, folders: Iterable[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def exists(self) -> bool:
        return bool(self.versions())

    # writing

    def _part(self) -> Column:
        return F.coalesce(F.expr(self.parts_by).cast("string"), F.lit("__null__"))

    def _write(self, df: DataFrame) -> dict[str, str]:
        """New folders for df's parts: part value -> folder; none for no rows. A large part is written by several tasks."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        if self.parts_by is None:
            rows.write.parquet(f"{self.path}/{folder}")
            return {} if self._rows([folder]).isEmpty() else {ALL: folder}
        tagged = rows.withColumn("_part", F.hex(self._part().cast("binary")))
        tagged.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        listed = self._fs.listStatus(self._path(f"{self.path}/{folder}"))
        names = [s.getPath().getName() for s in listed if s.isDirectory() and s.getPath().getName().startswith("_part=")]
        return {bytes.fromhex(n[6:]).decode(): f"{folder}/{n}" for n in names}

    def _mark(self, keys: DataFrame, on: list[str]) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        keys.select(*[F.col(c).cast(self.schema[c].dataType).alias(f"_on_{c}") for c in on]).distinct().write.parquet(f"{self.path}/{folder}")
        return folder

    def _delete(self, parts: dict[str, str]) -> None:
        for folder in {"/".join(p.split("/")[:2]) for p in parts.values()}:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def overwrite(self, df: DataFrame) -> None:
        """df is the table."""
        parts = self._write(df)
        self._publish(self.manifest(), [{"parts": {k: [v] for k, v in parts.items()}, "gone": None, "on": None}])

    def append(self, df: DataFrame) -> None:
        if parts := self._write(df):
            self._add(self.manifest(), parts)

    def replace_parts(self, df: DataFrame) -> None:
        """The parts that df has rows of are replaced; the others stay."""
        parts = self._write(df)
        self._add(self.manifest(), parts, drop=parts)

    def upsert(self, df: DataFrame, key: list[str], update: list[str] | None = None, order: list[Column] | None = None, unique: bool = False) -> None:
        """Rows of new keys are inserted. Of known keys, the columns in update are set; without it they stay as they are.

        Keys match null-safely. Of several rows with one key the first by order (or by all columns) counts; unique says that
        there are none. df is computed once. Of the table only the keys in the parts that df touches are read (and the rows for a partial update), so where
        it has parts, a key must determine its part; nothing that is there is written again.
        """
        rows = df.select(*self.schema.names)
        offered = self._write(rows if unique else first_of(rows, key, order))
        manifest = self.manifest()
        known = {k for e in manifest["entries"] for k in e["parts"]} & set(offered)
        if not offered:
            return
        new = self._rows(offered.values())
        if not known:
            self._add(manifest, offered)
            return
        old = self.read(manifest["version"], known)
        if not update:
            fresh = self._write(new.join(old.select(*key), _same(new, old, key), "left_anti"))
            if fresh:
                self._add(manifest, fresh)
            self._delete(offered)
            return
        gone = self._mark(new, key)
        if set(update) | set(key) >= set(self.schema.names):
            self._add(manifest, offered, gone, key)
            return
        was = old.select(*key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_old_{c}") for c in self.schema.names if c not in key])
        whole = new.alias("n").join(was.alias("o"), _same(new, was, key), "left").select(*[(F.when(F.col("o._hit"), F.col(f"o._old_{c}")).otherwise(F.col(f"n.{c}")) if c not in update and c not in key else F.col(f"n.{c}")).alias(c) for c in self.schema.names])
        self._add(manifest, self._write(whole), gone, key)
        self._delete(offered)

    def replace_keys(self, df: DataFrame, keys: DataFrame, by: str) -> None:
        """All rows of the keys go, and df's rows come: nothing stale of a key is left."""
        manifest = self.manifest()
        if self.parts_by == by:  # whole parts go
            gone = {r[0] for r in keys.select(F.coalesce(F.col(by).cast("string"), F.lit("__null__"))).distinct().collect()}
            parts = self._write(df)
            self._add(manifest, parts, drop=gone | set(parts))
        else:
            self._add(manifest, self._write(df), self._mark(keys, [by]), [by])

    def compact(self, parts: Iterable[str] | None = None) -> None:
        """Writes the rows that count anew, without marks; or those of some parts of a table without marks."""
        manifest = self.manifest()
        if parts is None:
            self.overwrite(self.read(manifest["version"]))
        else:
            self._add(manifest, self._write(self.read(manifest["version"], parts)), drop=parts)

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions before the last ones, and folders that none of those names."""
        found = self.versions()
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.path}/_manifests/v{v:010d}.json"), False)
        used = {p.split("/")[1] for v in found[-keep:] for e in self.manifest(v)["entries"] for p in (*[f for fs in e["parts"].values() for f in fs], e["gone"]) if p}
        at = self._path(f"{self.path}/data")
        for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & a[k].eqNullSafe(b[k])
    return out


def first_of(df: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key: the first by order, ties by the other columns, so the choice doesn't depend on the layout."""
    rest = [F.col(c) for c, t in df.dtypes if c not in key and not t.startswith("map")]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*(order or []), *rest, F.lit(1))))
    return ranked.filter("_n = 1").drop("_n")


def create_table_sql(name: str, schema: str, using: str = "parquet", partitioned_by: str | None = None, properties: dict[str, str] | None = None) -> str:
    """DDL for a catalog table, for stores that have one."""
    parts = f" PARTITIONED BY ({partitioned_by})" if partitioned_by else ""
    props = ", ".join(f"'{k}' = '{v}'" for k, v in (properties or {}).items())
    return f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING {using}{parts}" + (f" TBLPROPERTIES ({props})" if props else "")


def ensure_table(spark: SparkSession, name: str, schema: str, using: str = "parquet", partitioned_by: str | None = None, properties: dict[str, str] | None = None) -> None:
    """Creates a catalog table, and the namespace that it is in, where they aren't there."""
    if "." in name:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {name.rpartition('.')[0]}")
    spark.sql(create_table_sql(name, schema, using, partitioned_by, properties))


def drop_columns(spark: SparkSession, name: str, columns: list[str]) -> list[str]:
    """Schema clean-up: drops the columns that a catalog table has of those named (its store must be able to), and tells which."""
    found = [c for c in columns if c in spark.table(name).columns]
    if found:
        spark.sql(f"ALTER TABLE {name} DROP COLUMNS ({', '.join(found)})")
    return found
