"""Missing blocks: gap scans without a global window, range algebra, links and reorg depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Blocks per window partition of the gap scan.
SCAN_BUCKET = 100_000


def missing_ranges(blocks: DataFrame, lo: int | None = None, hi: int | None = None, bucket: int = SCAN_BUCKET) -> DataFrame:
    """(from_block, to_block) of all runs of numbers that aren't stored, newest first; bounds are inclusive.

    Numbers are grouped into buckets; the next number is looked up within a bucket, and a bucket's last one meets the
    first of the next bucket over a table with one row per bucket. So no window holds all blocks. With lo and hi the
    range's own ends count as borders; without, the least and greatest stored numbers do.
    """
    numbers = blocks.select(F.col("number").cast("long").alias("n"))
    if lo is not None:
        numbers = numbers.where(F.col("n") >= lo).unionByName(blocks.sparkSession.range(1).select(F.lit(lo - 1).cast("long").alias("n")))
    if hi is not None:
        numbers = numbers.where(F.col("n") <= hi).unionByName(blocks.sparkSession.range(1).select(F.lit(hi + 1).cast("long").alias("n")))
    # a number stored twice is followed by itself, and its last row by the next number: no need to make them distinct
    numbers = numbers.withColumn("b", F.floor(F.col("n") / bucket))
    inner = numbers.withColumn("next", F.lead("n").over(Window.partitionBy("b").orderBy("n"))).select("n", "next")
    ends = numbers.groupBy("b").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    # one row per bucket of a hundred thousand blocks
    edges = ends.select(F.col("last").alias("n"), F.lead("first").over(Window.orderBy("b")).alias("next"))
    holes = inner.unionByName(edges).where(F.col("next") > F.col("n") + 1)
    return holes.select((F.col("n") + 1).alias("from_block"), (F.col("next") - 1).alias("to_block")).orderBy(F.desc("from_block"))


def coverage(blocks: DataFrame, ranges: DataFrame, lo: int, hi: int) -> DataFrame:
    """Stored blocks of a range, the ends they reach, open gaps and the blocks in them."""
    own = blocks.where(F.col("number").between(lo, hi)).agg(
        F.count("*").alias("stored"), F.min("number").alias("first_block"), F.max("number").alias("last_block")
    )
    gaps = ranges.agg(F.count("*").alias("gaps"), F.coalesce(F.sum(F.col("to_block") - F.col("from_block") + 1), F.lit(0)).alias("missing"))
    return own.crossJoin(F.broadcast(gaps))


def first_block_at(blocks: DataFrame, ts: int) -> DataFrame:
    return blocks.where(F.col("timestamp") >= ts).agg(F.min("number").alias("number"))


def progress(blocks: DataFrame, ranges: DataFrame, lo: int, head: int) -> DataFrame:
    """Blocks processed and remaining between a first block and the head, and the share in per cent."""
    total = max(0, head - lo + 1)
    stored = blocks.where(F.col("number").between(lo, head)).agg(F.count("*").alias("processed"))
    gaps = ranges.where(F.col("from_block") <= head).agg(
        F.coalesce(F.sum(F.least("to_block", F.lit(head)) - F.greatest("from_block", F.lit(lo)) + 1), F.lit(0)).alias("in_gaps")
    )
    share = F.when(F.lit(total) > 0, F.col("processed") * 100.0 / total).otherwise(100.0)
    return stored.crossJoin(F.broadcast(gaps)).select(
        "processed", (F.lit(total) - F.col("processed")).cast("long").alias("remaining"), "in_gaps", share.alias("percent")
    )


def contiguous_through(blocks: DataFrame, watermark: int, limit: int | None = None) -> DataFrame:
    """The last block of the unbroken run above a watermark; the watermark itself if its successor is missing.

    It is one less than the least number above it that isn't stored but whose predecessor is (or is the watermark).
    """
    top = watermark + limit if limit is not None else None
    above = blocks.where(F.col("number") > watermark).select(F.col("number").cast("long").alias("n"))
    above = above if top is None else above.where(F.col("n") <= top)
    starts = above.unionByName(blocks.sparkSession.range(1).select(F.lit(watermark).cast("long").alias("n")))
    ends = starts.select((F.col("n") + 1).alias("n")).join(above, "n", "left_anti")
    return ends.agg((F.min("n") - 1).alias("contiguous_through"))


# --- range algebra -------------------------------------------------------------------------------------------------


def _pieces(ranges: DataFrame, bucket: int, *keys: str) -> DataFrame:
    """(keys, b, lo, hi): ranges cut at the borders of buckets of blocks."""
    number = lambda c: F.floor(F.col(c) / bucket)
    rows = ranges.select(*keys, "from_block", "to_block", F.explode(F.sequence(number("from_block"), number("to_block"))).alias("b"))
    start = F.col("b") * bucket
    return rows.select(*keys, "b", F.greatest("from_block", start).alias("lo"), F.least("to_block", start + bucket - 1).alias("hi"))


def _stitched(pieces: DataFrame, bucket: int, *keys: str) -> DataFrame:
    """(keys, from_block, to_block): pieces(keys, b, lo, hi), disjoint in a bucket, those that meet at a bucket's border made one.

    Only pieces at a border are looked at together, two rows per bucket at most (of the same keys).
    """
    rows = pieces.withColumns({"head": F.col("lo") == F.col("b") * bucket, "tail": F.col("hi") == (F.col("b") + 1) * bucket - 1})
    whole = rows.where("not head and not tail").select(*keys, F.col("lo").alias("from_block"), F.col("hi").alias("to_block"))
    order = Window.partitionBy(*keys).orderBy("lo")
    before = F.lag("hi").over(order)
    edge = rows.where("head or tail").withColumn("new", F.when(F.col("lo") == before + 1, 0).otherwise(1))
    edge = edge.withColumn("run", F.sum("new").over(order))
    joined = edge.groupBy(*keys, "run").agg(F.min("lo").alias("from_block"), F.max("hi").alias("to_block")).drop("run")
    return whole.unionByName(joined)


def range_split(ranges: DataFrame, stored: DataFrame, bucket: int = SCAN_BUCKET) -> DataFrame:
    """Ranges without the stored numbers: each hit shrinks a range or splits it; a range of stored numbers only goes.

    Ranges and stored numbers meet by equality on buckets of blocks, and the holes between hits are found within a bucket,
    so neither all stored numbers nor all hits of a range come together anywhere. Equal ranges are one.
    """
    keyed = ranges.select(F.col("from_block").cast("long").alias("from_block"), F.col("to_block").cast("long").alias("to_block")).distinct()
    keyed = keyed.select("*", F.col("from_block").alias("f"), F.col("to_block").alias("t"))
    pieces = _pieces(keyed, bucket, "f", "t")
    numbers = stored.select(F.col("number").cast("long").alias("hit"), F.floor(F.col("number") / bucket).alias("b")).distinct()
    hits = pieces.join(numbers, "b").where(F.col("hit").between(F.col("lo"), F.col("hi"))).select("f", "t", "b", "lo", "hit")
    ends = pieces.select("f", "t", "b", "lo", (F.col("hi") + 1).alias("hit"))
    before = F.lag("hit").over(Window.partitionBy("f", "t", "b").orderBy("hit"))
    holes = hits.unionByName(ends).select("f", "t", "b", F.coalesce(before + 1, F.col("lo")).alias("lo"), (F.col("hit") - 1).alias("hi"))
    return _stitched(holes.where(F.col("lo") <= F.col("hi")), bucket, "f", "t").select("from_block", "to_block")


def range_drop(ranges: DataFrame, numbers: DataFrame, bucket: int = SCAN_BUCKET) -> DataFrame:
    """Ranges but for those that contain one of the numbers; they meet by equality on buckets of blocks."""
    keyed = ranges.select(F.col("from_block").alias("f"), F.col("to_block").alias("t"), "from_block", "to_block")
    wanted = numbers.select(F.col("number").cast("long").alias("hit"), F.floor(F.col("number") / bucket).alias("b")).distinct()
    met = _pieces(keyed, bucket, "f", "t").join(wanted, "b").where(F.col("hit").between(F.col("lo"), F.col("hi")))
    gone = met.select(F.col("f").alias("from_block"), F.col("t").alias("to_block")).distinct()
    return ranges.join(gone, ["from_block", "to_block"], "left_anti")


def range_merge(ranges: DataFrame, bucket: int = SCAN_BUCKET) -> DataFrame:
    """Overlapping and adjoining ranges made one: within buckets of blocks, then over the pieces at their borders."""
    pieces = _pieces(ranges, bucket)
    order = Window.partitionBy("b").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col("lo") <= reach + 1, 0).otherwise(1)
    island = pieces.withColumn("start", start).withColumn("island", F.sum("start").over(order))
    merged = island.groupBy("b", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return _stitched(merged, bucket)


def range_queue(ranges: DataFrame, floor: int, n: int, skip: DataFrame | None = None, newest_first: bool = True) -> DataFrame:
    """The next n ranges to work on, clipped to what is retained; skip(from_block) are left out for now."""
    clipped = ranges.where(F.col("to_block") >= floor).select(F.greatest("from_block", F.lit(floor)).cast("long").alias("from_block"), "to_block")
    if skip is not None:
        clipped = clipped.join(skip.select("from_block"), "from_block", "left_anti")
    return clipped.orderBy(F.desc("to_block") if newest_first else F.asc("from_block")).limit(n)


def jump_range(blocks: DataFrame, safe: int, limit: int) -> DataFrame:
    """The interval to hand to catch-up when the stored head is more than limit behind; no row otherwise."""
    head = blocks.agg(F.coalesce(F.max("number"), F.lit(-1)).cast("long").alias("head"))
    return head.where(F.lit(safe) - F.col("head") > limit).select((F.col("head") + 1).alias("from_block"), F.lit(safe - 1).cast("long").alias("to_block"))


# --- links and reorgs ----------------------------------------------------------------------------------------------


def broken_links(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent hash isn't the hash of the stored block before."""
    previous = blocks.select((F.col("number") + 1).alias("number"), F.col("hash").alias("expected"))
    joined = blocks.select("number", "hash", "parent_hash").join(previous, "number")
    return joined.where(~F.col("parent_hash").eqNullSafe(F.col("expected")))


def mismatches(stored: DataFrame, chain: DataFrame) -> DataFrame:
    """Numbers for which the chain has another hash than is stored."""
    other = chain.select("number", F.col("hash").alias("chain_hash"))
    return stored.select("number", "hash").join(other, "number").where(F.col("hash") != F.col("chain_hash"))


def reorg_depth(stored: DataFrame, chain: DataFrame, window: int = 10) -> DataFrame:
    """How many blocks to revert: from the stored head down to the deepest mismatch of the window, not the first."""
    head = stored.agg(F.max("number").alias("head"))
    recent = stored.crossJoin(F.broadcast(head)).where(F.col("number") > F.col("head") - window)
    deepest = mismatches(recent, chain).agg(F.min("number").alias("deepest"))
    return head.crossJoin(F.broadcast(deepest)).select(
        "head", "deepest", F.coalesce(F.col("head") - F.col("deepest") + 1, F.lit(0)).cast("long").alias("depth")
    )


def stale_head(stored: DataFrame, chain: DataFrame, window: int = 10, limit: int = 128) -> DataFrame:
    """At start: the deepest mismatch within limit, and a verdict.

    ok: none; revert: it ends above a run of window matching blocks within the limit; refuse: mismatches reach the limit.
    """
    head = stored.agg(F.max("number").alias("head"))
    recent = stored.crossJoin(F.broadcast(head)).where(F.col("number") > F.col("head") - limit)
    deepest = mismatches(recent, chain).agg(F.min("number").alias("deepest"))
    depth = F.coalesce(F.col("head") - F.col("deepest") + 1, F.lit(0)).cast("long")
    verdict = F.when(F.col("deepest").isNull(), "ok").when(depth + window <= limit, "revert").otherwise("refuse")
    return head.crossJoin(F.broadcast(deepest)).select("head", "deepest", depth.alias("depth"), verdict.alias("verdict"))


def chain_reset(stored: DataFrame, head: int, limit: int = 128) -> DataFrame:
    """Whether a chain's head lies so far below the stored one that it must be another chain."""
    return stored.agg(F.max("number").alias("stored_head")).select("stored_head", (F.lit(head) + limit < F.col("stored_head")).alias("is_reset"))


def safe_blocks(batch: DataFrame, confirmations: int, head: int | None = None) -> DataFrame:
    """The blocks of a batch that lie at least so many below the head (the batch's own greatest, if none is given)."""
    if head is not None:
        return batch.where(F.col("number") <= head - confirmations)
    top = batch.agg(F.max("number").alias("head_"))
    return batch.crossJoin(F.broadcast(top)).where(F.col("number") <= F.col("head_") - confirmations).drop("head_")
