"""Next, previous and running values along time within a key, without a task per key.

A key (a line, say) may hold a third of all rows, so its rows are cut into slices of time: windows run within (key, slice),
and one row per slice carries on from slice to slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliced(df: DataFrame, ts: str, unit: str = "day") -> DataFrame:
    return df.withColumn("slice", F.date_trunc(unit, F.col(ts)))


def following(df: DataFrame, key: str, order: list[str], into: dict[str, str]) -> DataFrame:
    """df (with slice) plus, for each item of into (new column: column), its value in the next row of the key by order."""
    return _beside(df, key, order, into, F.lead, F.min)


def preceding(df: DataFrame, key: str, order: list[str], into: dict[str, str]) -> DataFrame:
    """The same of the row before."""
    return _beside(df, key, order, into, F.lag, F.max)


def _beside(df, key, order, into, step, edge) -> DataFrame:
    here = Window.partitionBy(key, "slice").orderBy(*order)
    row = F.struct(*order, *[F.col(c).alias(f"_{new}") for new, c in into.items()])
    edges = df.groupBy(key, "slice").agg(edge(row).alias("edge"))
    along = Window.partitionBy(key).orderBy("slice")
    carried = edges.select(F.col(key).alias("_key"), F.col("slice").alias("_slice"), step("edge").over(along).alias("_carried"))
    out = df.withColumn("_beside", step(row).over(here))
    out = out.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("slice").eqNullSafe(F.col("_slice")), "left").withColumn("_beside", F.coalesce("_beside", "_carried"))
    return out.select(*df.columns, *[F.col(f"_beside._{new}").alias(new) for new in into])


def islands(df: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """df (with slice) plus run, the row that the state has lasted since, and before, the same of the run before.

    Both are structs of the first column of order (which must tell rows of a key apart) and of state; before is set on a run's
    first row, and null on the key's first. A new run begins where the first of state differs or was null, or another differs
    null-safely. Rows are windowed in their slices; one row per slice tells the next ones which run they begin in.
    """
    here = Window.partitionBy(key, "slice").orderBy(*order)
    row = F.struct(order[0], *state)

    def differs(new: Column, old: Column) -> Column:
        first = old.isNull() | old[state[0]].isNull() | F.coalesce(new[state[0]] != old[state[0]], F.lit(False))
        return reduce(lambda out, c: out | ~new[c].eqNullSafe(old[c]), state[1:], first)

    rows = df.withColumn("_row", row).withColumn("_was", F.lag("_row").over(here))
    turn = F.when(F.col("_was").isNotNull() & differs(F.col("_row"), F.col("_was")), F.col("_row"))
    edges = rows.groupBy(F.col(key).alias("_key"), F.col("slice").alias("_slice")).agg(F.min("_row").alias("_first"), F.max("_row").alias("_end"), F.max(turn).alias("_turn"))
    along = Window.partitionBy("_key").orderBy("_slice")
    told = edges.withColumn("_came", F.lag("_end").over(along))
    told = told.withColumn("_open", F.coalesce("_turn", F.when(differs(F.col("_first"), F.col("_came")), F.col("_first"))))
    told = told.withColumn("_run", F.last("_open", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))).select("_key", "_slice", "_came", "_run")
    both = rows.join(told, F.col(key).eqNullSafe(F.col("_key")) & F.col("slice").eqNullSafe(F.col("_slice")), "left")
    both = both.withColumn("_new", differs(F.col("_row"), F.coalesce("_was", "_came")))
    both = both.withColumn("run", F.coalesce(F.last(F.when(F.col("_new"), F.col("_row")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_run")))
    both = both.withColumn("before", F.when(F.col("_new"), F.coalesce(F.lag("run").over(here), F.col("_run"))))
    return both.select(*df.columns, "run", "before")
