"""Loads delimited text whose columns all become text, under names made from the header."""

from __future__ import annotations

import re
import unicodedata
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import Table


def slug(name: str) -> str:
    """Lower-case ASCII letters and digits, anything else a single underscore between them."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def column_names(header: list[str]) -> list[str]:
    """Slugs, made unique: the second of a name ends in _2, the third in _3; an empty name becomes column."""
    used: set[str] = set()
    out = []
    for name in header:
        base = name = slug(name) or "column"
        n = 1
        while name in used:
            n += 1
            name = f"{base}_{n}"
        used.add(name)
        out.append(name)
    return out


def read(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """The file's rows, all columns strings; quotes may hold delimiters and line breaks, and empty fields are null."""
    raw = spark.read.option("header", False).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")
    header = raw.csv(path).first()
    if header is None:
        return spark.createDataFrame([], "column string")
    names = column_names([x or "" for x in header])
    return raw.option("header", True).option("enforceSchema", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)


def load(spark: SparkSession, path: str, warehouse: str, schema: str = "public", delimiter: str = ",") -> Table:
    """Replaces the table that is named after the file; readers see the old rows or the new ones, never a part."""
    rows = read(spark, path, delimiter)
    table = Table(spark, f"{warehouse.rstrip('/')}/{schema}/{PurePosixPath(path).stem}", rows.schema)
    table.overwrite(rows)
    return table


def to_database(rows: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Replaces a database's table by way of JDBC; the driver's jar must be on the class path."""
    rows.write.mode("overwrite").jdbc(url, table, properties=properties)
