"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

A source of weight w = share / frame may use block i (from 1) from its release time floor((i - 1) / w) on and must by its
deadline ceil(i / w); earliest-deadline-first among the released blocks meets all deadlines, so at each time a source has had
less than one block more or less than its weight asks for. As shares are whole numbers, the schedule repeats after one frame
(the sum of the shares): it is worked out once per set of active sources, by an SQL aggregate over the frame's slots, and each
block finds its slot by an equi-join. When a source has no further whole frame of blocks, it leaves after one last frame in
which its unused slots are closed up, and the others go on with the shares they have, in a schedule of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Slots of a frame, or so, and most that a frame may have (it is the state of one SQL aggregate): more is an error.
FRAME, MOST = 1000, 10_000


def tempered(counts: DataFrame, alpha: float = 0.5, frame: int = FRAME) -> DataFrame:
    """source, share: whole shares in proportion to rows ** alpha, of about frame in all and at least 1 each."""
    whole = F.sum(F.pow("n", F.lit(alpha))).over(Window.partitionBy())
    return counts.select("source", F.greatest(F.lit(1), F.round(frame * F.pow("n", F.lit(alpha)) / whole)).cast("long").alias("share"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, code, tie) with k: the number from 1 among its source's rows, by MD5 of doc_id, doc_id and tie.

    A large source is numbered in parts, cut by the hash: each part's rows are counted, and a part's numbers begin where the
    counts before it end.
    """
    parts = 4 * common.partitions(rows.sparkSession)
    h = F.md5(F.col("doc_id").cast("string").cast("binary"))
    part = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    rows = rows.withColumn("h", h).withColumn("part", F.coalesce(part, F.lit(-1)))
    sizes = rows.groupBy("code", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("code").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("code", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("code", "part").orderBy("h", "doc_id", "tie")
    own = rows.withColumn("rank", F.row_number().over(inside))
    return own.join(before, ["code", "part"]).withColumn("k", F.col("before") + F.col("rank")).drop("before", "rank", "h", "part")


def schedule(shares: Column, frame: Column) -> Column:
    """The source of each slot of a frame: earliest deadline first among released blocks. shares: array of (source, share)."""
    state = F.struct(F.transform(shares, lambda s: F.struct(s["source"].alias("source"), s["share"].alias("share"), F.lit(0).cast("long").alias("used"))).alias("all"), F.array().cast("array<struct<source:string,j:bigint>>").alias("slots"))

    def step(acc: Column, t: Column) -> Column:
        # of block i = used + 1: released if used * frame < (t + 1) * share rounded as floor(used * frame / share) <= t
        open_ = F.filter(acc["all"], lambda s: (s["used"] < s["share"]) & (F.floor(s["used"] * frame / s["share"]) <= t))
        first = F.array_min(F.transform(open_, lambda s: F.struct(F.ceil((s["used"] + 1) * frame / s["share"]).alias("deadline"), s["source"].alias("source"), s["used"].alias("used"))))
        taken = F.transform(acc["all"], lambda s: F.struct(s["source"].alias("source"), s["share"].alias("share"), (s["used"] + F.when(s["source"].eqNullSafe(first["source"]), 1).otherwise(0).cast("long")).alias("used")))
        return F.struct(taken.alias("all"), F.concat(acc["slots"], F.array(F.struct(first["source"].alias("source"), (first["used"] + 1).alias("j")))).alias("slots"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), frame - 1), state, step, lambda acc: acc["slots"])


def code(source: Column) -> Column:
    """A name for each source, null included."""
    return F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source, F.lit("")))


def planned(narrow: DataFrame, shares: DataFrame, block_rows: int) -> DataFrame:
    """Per source: code, share, frames (that it is active in), missing (rows of its last frame), untils (ends of phases).

    A phase is a run of frames with the same active sources; a source is active in its frames 0 to frames - 1.
    """
    rows = narrow.groupBy("code").agg(F.count("*").alias("rows"))
    weights = shares.select(code(F.col("source")).alias("code"), "share").groupBy("code").agg(F.max("share").alias("share"))
    supply = rows.join(weights, "code", "left").withColumn("share", F.coalesce("share", F.lit(1)).cast("long"))
    supply = supply.withColumn("frames", F.ceil(F.col("rows") / (F.col("share") * block_rows)).cast("long"))
    supply = supply.withColumn("missing", F.col("frames") * F.col("share") * block_rows - F.col("rows"))
    return supply.withColumn("untils", F.array_sort(F.collect_set("frames").over(Window.partitionBy())))  # a row per source


def timetable(supply: DataFrame, block_rows: int) -> DataFrame:
    """Per phase and slot of its frame: phase, code and j of the block (the source's j-th in a frame), and when the phase begins
    in slots and in rows."""
    active = supply.withColumn("until", F.explode(F.filter("untils", lambda u: u <= F.col("frames"))))
    active = active.withColumn("phase", F.array_position("untils", F.col("until")) - 1).withColumn("since", F.when(F.col("phase") > 0, F.get("untils", F.col("phase").cast("int") - 1)).otherwise(0))
    phases = active.groupBy("phase", "since", "until").agg(F.array_sort(F.collect_list(F.struct(F.col("code").alias("source"), "share"))).alias("shares"), F.sum("share").alias("frame"), F.sum(F.when(F.col("frames") == F.col("until"), F.col("missing")).otherwise(0)).alias("missing"))
    before = Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)  # a row per phase
    length = (F.col("until") - F.col("since")) * F.col("frame")
    phases = phases.withColumn("frame", F.when(F.col("frame") <= MOST, F.col("frame")).otherwise(F.raise_error(F.lit(f"the shares add up to more than {MOST} slots")).cast("long")))
    phases = phases.withColumn("slots_before", F.coalesce(F.sum(length).over(before), F.lit(0))).withColumn("rows_before", F.coalesce(F.sum(length * block_rows - F.col("missing")).over(before), F.lit(0)))
    return phases.withColumn("slots", schedule(F.col("shares"), F.col("frame"))).select("phase", "since", "frame", "slots_before", "rows_before", F.posexplode("slots").alias("slot", "at")).select("phase", "since", "frame", "slots_before", "rows_before", "slot", F.col("at.source").alias("code"), F.col("at.j").alias("j"))


def mixed(docs: DataFrame, shares: DataFrame, block_rows: int = 1) -> DataFrame:
    """doc_id, source, tie, slot_time (of its block, from 0) and position (from 1, without gaps) of each row of docs.

    shares: source and share (whole, at least 1; of repeated ones the largest). Blocks are block_rows rows of a source, in the
    order of a hash of doc_id; the last of a source may be shorter. A null source is a source of its own; a source that shares
    doesn't name has share 1. Shares that add up to more than MOST are an error, as is a source too many for that: none is left
    out. Repeated rows each get their place; no row is dropped, and no rows give no rows. tie holds two
    hashes of all columns.
    """
    names, apart = docs.columns, common.numbered_columns(docs)
    doc_id, source = (apart[f"c{names.index(n)}"] for n in ("doc_id", "source"))
    narrow = apart.select(doc_id.alias("doc_id"), source.alias("source"), tie(apart).alias("tie")).withColumn("code", code(F.col("source")))
    supply = planned(narrow, shares, block_rows)
    slots = timetable(supply, block_rows)
    rows = numbered(narrow).join(supply.select("code", "share", "untils"), "code").withColumn("block", F.ceil(F.col("k") / block_rows).cast("long"))
    rows = rows.withColumn("in_frame", F.floor((F.col("block") - 1) / F.col("share"))).withColumn("j", F.col("block") - F.col("in_frame") * F.col("share"))
    rows = rows.withColumn("phase", F.size(F.filter("untils", lambda u: u <= F.col("in_frame"))).cast("long")).drop("untils", "share")
    placed = rows.join(slots, ["phase", "code", "j"])
    nth = F.row_number().over(Window.partitionBy("in_frame").orderBy("slot", "k"))  # a frame's rows
    full = F.col("in_frame") - F.col("since")
    return placed.select("doc_id", "source", "tie", (F.col("slots_before") + full * F.col("frame") + F.col("slot")).alias("slot_time"), (F.col("rows_before") + full * F.col("frame") * block_rows + nth).alias("position"))


def tie(apart: DataFrame) -> Column:
    """Two hashes of all columns; never null, so rows that are dealt out by it can be joined where they are."""
    return F.struct(F.xxhash64(*apart.columns).alias("x"), F.xxhash64(F.lit(1), *apart.columns).alias("y"))


def arranged(docs: DataFrame, shares: DataFrame, block_rows: int = 1) -> DataFrame:
    """docs in the mixture's order: partitions are ranges of position, sorted. Same defined cases as mixed."""
    names, apart = docs.columns, common.numbered_columns(docs)
    order = mixed(docs, shares, block_rows).select("tie", "position")
    known = apart.withColumn("tie", tie(apart)).dropDuplicates(["tie"])  # order has each repeat's row
    n = common.partitions(docs.sparkSession)
    ordered = known.join(order, "tie").repartitionByRange(n, "position").sortWithinPartitions("position")
    return ordered.select(*apart.columns).toDF(*names)
