"""What the operators share: reading tables, cutting lineage in the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A word, wherever an operator speaks of words (bytes of the UTF-8 text; no byte of a longer code point matches).
WORD = rb"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set and all is on one machine (tests), one of our own."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return at or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder: later reads neither recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the columns of exactly these names: extra columns, whatever their names, never reach an operator's own."""
    at = list(df.columns)
    apart = numbered_columns(df)
    return apart.select(*[apart[f"c{at.index(n)}"].alias(n) for n in names])


#: Bytes of a batch that the JVM hands to Python at once.
BATCH = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches of BATCH bytes at most, so that the buffers on both sides stay small whatever the rows' sizes.

    It is a setting of the session, and stays: plans are run later than they are made. A smaller one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH:
        spark.conf.set(key, str(BATCH))


def numbered_columns(df: DataFrame) -> DataFrame:
    """The columns under names by place, c0 and so on, which clash with none of an operator's own."""
    bound_batches(df.sparkSession)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def rows_of(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most_bytes at most (a single row may be larger)."""
    n = max(1, batch.num_rows)
    step = max(1, min(n, int(most_bytes * n / max(1, batch.nbytes))))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def giving_back(run: Callable) -> Callable:
    """For mapInArrow: run, after which the worker, which stays for later tasks, hands memory that it has freed back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can't
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def per_batch(schema: pa.Schema, make: Callable[[pa.RecordBatch], dict], most_bytes: int = 8 << 20) -> Callable:
    """For mapInArrow: make gives the columns of the output for each input batch, in slices of about most_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, most_bytes):
                if part.num_rows:
                    columns = make(part)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    return giving_back(run)
