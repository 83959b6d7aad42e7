"""Connected components of links between ids, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of each id that links (columns a, b: long) name.

    Large-star and small-star turns (each node's larger neighbours, then its smaller ones and itself, are linked to the
    smallest) until nothing moves; the rows never become more than the links. Each turn is written to the shared folder. Links
    of an id to itself and repeated links change nothing; no links give no rows.
    """
    spark = links.sparkSession
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    links, path = common.written(links, "links")
    checked = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # every link now goes from a node to a smaller one
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).filter("a != b").distinct()
        new, at = common.written(small, "links")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        common.drop_path(spark, path)
        links, path = new, at
        if state == checked:
            break
        checked = state
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
