"""Retention: which ranges of history may be pruned, and what a read below the watermark means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chain import day_of


def range_complete(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(lo, hi, stored, complete) of history ranges(lo, hi, size); all ranges in one pass over the blocks' buckets.

    Ranges have one width and lie on its grid, so a block's range is arithmetic and no range join is needed.
    """
    counts = blocks.join(F.broadcast(ranges.agg(F.max(F.col("hi") - F.col("lo")).alias("size_"))), F.lit(True))
    counts = counts.groupBy((F.floor(F.col("number") / F.col("size_")) * F.col("size_")).cast("long").alias("lo"))
    counts = counts.agg(F.count_distinct("number").alias("stored"), F.max(F.col("number") == 0).alias("zero"))
    joined = ranges.join(counts, "lo", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    need = F.col("hi") - F.col("lo") - F.when((F.col("lo") == 0) & ~F.coalesce("zero", F.lit(False)), 1).otherwise(0)
    return joined.select("lo", "hi", "stored", (F.col("stored") >= need).alias("complete"))


def prune_day_floor(blocks: DataFrame, head: int, floor_gap: int) -> DataFrame:
    """The first block of the day that a reorg may still change: nothing from there on is pruned."""
    safe = blocks.where(F.col("number") <= head - floor_gap)
    day = safe.agg(F.max(day_of(F.col("timestamp"))).alias("day"))
    own = blocks.select("number", day_of(F.col("timestamp")).alias("day")).join(F.broadcast(day), "day")
    return own.agg(F.min("number").alias("floor_block"))


def prunable_ranges(ranges: DataFrame, blocks: DataFrame, spans: DataFrame, head: int, retain: int, floor_gap: int) -> DataFrame:
    """(lo, hi, prunable, reason) of each range, oldest first; the first rule that fails is the reason.

    Rules: no longer retained, below the reorg floor, below the reorg day, all blocks stored, all its spans closed. A
    range above one that isn't prunable isn't either, as history is cut from the oldest on.
    """
    complete = range_complete(blocks, ranges)
    floor = prune_day_floor(blocks, head, floor_gap)
    closed = spans.where("state = 'ok'").select(F.col("lo").alias("s_lo"), F.col("hi").alias("s_hi"))
    covered = ranges.join(closed, (F.col("s_lo") < F.col("hi")) & (F.col("s_hi") > F.col("lo")), "left").groupBy("lo").agg(
        F.coalesce(F.sum(F.least("s_hi", "hi") - F.greatest("s_lo", "lo")), F.lit(0)).alias("covered")
    )  # ranges and spans, not blocks
    joined = complete.join(covered, "lo").crossJoin(F.broadcast(floor))
    reason = (
        F.when(F.col("hi") > head - retain, "retained")
        .when(F.col("hi") > head - floor_gap, "above the reorg floor")
        .when(F.col("hi") > F.coalesce("floor_block", F.lit(0)), "reaches the reorg day")
        .when(~F.col("complete"), "incomplete")
        .when(F.col("covered") < F.col("hi") - F.col("lo"), "spans not closed")
    )
    rows = joined.select("lo", "hi", reason.alias("own"))
    first = rows.where("own is not null").agg(F.min("lo").alias("stop"))
    full = rows.crossJoin(F.broadcast(first))
    why = F.when(F.col("own").isNull() & (F.col("lo") > F.col("stop")), "an older range is kept").otherwise(F.col("own"))
    return full.select("lo", "hi", why.isNull().alias("prunable"), why.alias("reason")).orderBy("lo")


def retention_classify(targets: DataFrame, blocks: DataFrame, watermark: int) -> DataFrame:
    """(number, state): live, pruned (below the watermark), or not found."""
    known = blocks.select("number", F.lit(True).alias("known"))
    state = F.when(F.col("number") < watermark, "pruned").when(F.col("known").isNotNull(), "live").otherwise("not found")
    return targets.join(known, "number", "left").select("number", state.alias("state"))
