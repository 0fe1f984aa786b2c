"""Daily statistics: additive parts by day, finishing, cumulative columns, spans of days, and recounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chain import day_of, epoch_of

#: Additive columns of a day, from blocks, transactions and transfers.
BLOCK_PARTS = ("blocks", "gas_used", "size_sum", "size_n", "gap_sum", "gap_n")
TX_PARTS = ("tx_count", "price_sum", "success", "failed")


def block_time_pairs(blocks: DataFrame) -> DataFrame:
    """(number, timestamp, gap): seconds since the block with the number before, null if that isn't stored."""
    return _with_gap(blocks.select("number", "timestamp"), blocks)


def _with_gap(blocks: DataFrame, before: DataFrame) -> DataFrame:
    previous = before.select((F.col("number") + 1).alias("number"), F.col("timestamp").alias("before"))
    joined = blocks.join(previous, "number", "left")
    return joined.withColumn("gap", F.col("timestamp") - F.col("before")).drop("before")


def daily_blocks(blocks: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Blocks, gas, sizes (null ones not counted) and gaps of each day, with its first block.

    before has the blocks whose successors' gaps are wanted, if those aren't among blocks.
    """
    rows = _with_gap(blocks, blocks if before is None else before).withColumn("day", day_of(F.col("timestamp")))
    return rows.groupBy("day").agg(
        F.count("*").alias("blocks"),
        F.sum("gas_used").cast("long").alias("gas_used"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size_sum"),
        F.count("size").alias("size_n"),
        F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("gap_sum"),
        F.count("gap").alias("gap_n"),
        F.min("number").alias("first_block"),
    )


def daily_txs(txs: DataFrame) -> DataFrame:
    """Transactions, gas price sum, successes and failures of each day; the block's time is a column of the row."""
    return txs.groupBy(day_of(F.col("block_timestamp")).alias("day")).agg(
        F.count("*").alias("tx_count"),
        F.sum(F.col("gas_price").cast("decimal(38,0)")).cast("decimal(38,0)").alias("price_sum"),
        F.count_if(F.col("status") == 1).alias("success"),
        F.count_if(F.col("status") == 0).alias("failed"),
    )


def sides(txs: DataFrame) -> DataFrame:
    """(day, address) of senders and recipients, a row for each."""
    both = txs.select(day_of(F.col("block_timestamp")).alias("day"), F.explode(F.array("from_address", "to_address")).alias("address"))
    return both.where(F.col("address").isNotNull())


def daily_active(txs: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct senders and recipients of each day, exact by two groupings, or a sketch's estimate."""
    if approx:
        return daily_sketches(txs).select("day", F.hll_sketch_estimate("sketch").alias("active_addresses"))
    return sides(txs).distinct().groupBy("day").agg(F.count("*").alias("active_addresses"))


def daily_sketches(txs: DataFrame, registers: int = 12) -> DataFrame:
    """(day, sketch): a mergeable sketch of each day's addresses, of at most 2^registers bytes."""
    return sides(txs).groupBy("day").agg(F.hll_sketch_agg("address", F.lit(registers)).alias("sketch"))


def daily_transfers(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy(day_of(F.col("timestamp")).alias("day")).agg(F.count("*").alias("transfer_count"))


def day_spans(blocks: DataFrame) -> DataFrame:
    """(day, lo, hi): blocks [lo, hi) of each stored day; the last ends above the head. One row per day is windowed."""
    firsts = blocks.groupBy(day_of(F.col("timestamp")).alias("day")).agg(F.min("number").alias("lo"), F.max("number").alias("top"))
    end = F.lead("lo").over(Window.orderBy("day"))
    return firsts.select("day", "lo", F.coalesce(end, F.col("top") + 1).alias("hi"))


def address_day_asof(stats: DataFrame, spans: DataFrame) -> DataFrame:
    """(address, day): the first span that ends above the address's first block. Spans are one row per day."""
    return _placed(stats.select("address", F.col("first_seen").alias("at")), spans, forward=True).select("address", "day")


def address_day_asof_back(stats: DataFrame, spans: DataFrame) -> DataFrame:
    """(address, day): the span with the greatest start at or below the address's first block."""
    return _placed(stats.select("address", F.col("first_seen").alias("at")), spans, forward=False).select("address", "day")


#: Blocks of a bucket in which a row looks for its day; a bucket meets few days.
DAY_BUCKET = 1_000


def _placed(rows: DataFrame, spans: DataFrame, forward: bool) -> DataFrame:
    """rows(at, ...) with the day of the nearest span after or before each block; null where there is none.

    The days' borders cut all numbers into disjoint intervals, a row per day; these are listed by the buckets they meet, and
    rows find theirs by equality on the bucket. The list has a row per bucket and day, far fewer than rows, so that the
    rows need no exchange where it is broadcast.
    """
    ordered = Window.orderBy("edge")  # a row per day
    if forward:  # a day takes the blocks from the end of the one before to its own end
        edges = spans.select((F.col("hi") - 1).alias("edge"), "day")
        cuts = edges.select("day", (F.lag("edge").over(ordered) + 1).alias("lo"), F.col("edge").alias("hi"))
    else:  # from its own start to the start of the next
        edges = spans.select(F.col("lo").alias("edge"), "day")
        cuts = edges.select("day", F.col("edge").alias("lo"), (F.lead("edge").over(ordered) - 1).alias("hi"))
    # the first or last interval is open; blocks beyond the outermost border count as lying on it
    cuts = cuts.select("day", F.coalesce("lo", "hi").alias("lo"), F.coalesce("hi", "lo").alias("hi")).where("lo <= hi")
    border = edges.agg(F.min("edge").alias("least"), F.max("edge").alias("most"))
    within = F.greatest("at", "least") if forward else F.least("at", "most")
    keyed = rows.crossJoin(F.broadcast(border)).withColumn("within", F.when(F.col("at").isNotNull(), within)).drop("least", "most")
    keyed = keyed.withColumn("b", F.floor(F.col("within") / DAY_BUCKET))
    number = lambda c: F.floor(F.col(c) / DAY_BUCKET)
    listed = cuts.select("day", "lo", "hi", F.explode(F.sequence(number("lo"), number("hi"))).alias("b"))
    fits = (keyed["b"] == listed["b"]) & keyed["within"].between(listed["lo"], listed["hi"])
    return keyed.join(listed, fits, "left").drop("b", "within", "lo", "hi")


def daily_address_columns(stats: DataFrame, spans: DataFrame) -> DataFrame:
    """New and cumulative addresses and contracts of each day: addresses are first counted by first block, then placed."""
    per_block = stats.groupBy(F.col("first_seen").alias("at")).agg(F.count("*").alias("n"), F.count_if("is_contract").alias("c"))
    placed = _placed(per_block, spans, forward=True).groupBy("day").agg(F.sum("n").alias("new_addresses"), F.sum("c").alias("new_contracts"))
    days = spans.select("day").join(placed, "day", "left").select(
        "day", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("new_addresses", "new_contracts"))
    )
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row per day
    return days.select("*", F.sum("new_addresses").over(upto).alias("total_addresses"), F.sum("new_contracts").over(upto).alias("total_contracts"))


def finish(parts: DataFrame) -> DataFrame:
    """The finished columns of a day's sums: averages rounded half up, 0 where nothing was counted."""

    def mean(total: str, n: str) -> Column:
        exact = F.col(total).cast("decimal(38,0)") / F.nullif(F.col(n), F.lit(0)).cast("decimal(20,0)")
        return F.coalesce(F.round(exact, 0).cast("long"), F.lit(0))

    return parts.withColumns({"avg_block_size": mean("size_sum", "size_n"), "avg_block_time": mean("gap_sum", "gap_n"), "avg_gas_price": mean("price_sum", "tx_count")})


def block_parts(rows: DataFrame, before: DataFrame, *keys: str) -> DataFrame:
    """All additive columns but the active addresses, in one grouping, from a row per block with its own sums.

    before has (number, timestamp) of the blocks whose successors' gaps count.
    """
    paired = _with_gap(rows, before.select("number", "timestamp"))
    sums = {"gas_used": "gas_used", "size_sum": "size", "gap_sum": "gap", "tx_count": "tx_count", "success": "success", "failed": "failed", "transfer_count": "transfer_count"}
    return paired.groupBy(*keys).agg(
        F.count("*").alias("blocks"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in sums.items()), F.count("size").alias("size_n"),
        F.count("gap").alias("gap_n"), F.coalesce(F.sum("price_sum"), F.lit(0)).cast("decimal(38,0)").alias("price_sum"), F.min("number").alias("first_block"),
    )


def daily_parts(blocks: DataFrame, txs: DataFrame, transfers: DataFrame) -> DataFrame:
    """All additive columns of each day that has blocks; days without transactions or transfers count 0."""
    joined = daily_blocks(blocks).join(daily_txs(txs), "day", "left").join(daily_active(txs), "day", "left").join(daily_transfers(transfers), "day", "left")
    zero = ("tx_count", "success", "failed", "active_addresses", "transfer_count")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {"price_sum": F.coalesce("price_sum", F.lit(0).cast("decimal(38,0)"))})


def daily_cumulative(daily: DataFrame, offset: int = 0) -> DataFrame:
    """(day, tx_count, before, cumulative): transactions up to each day; a row per day is windowed."""
    past = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    prior = (F.coalesce(F.sum("tx_count").over(past), F.lit(0)) + offset).alias("before")
    return daily.select("day", "tx_count", prior).withColumn("cumulative", F.col("before") + F.col("tx_count"))


def daily_stats(blocks: DataFrame, txs: DataFrame, transfers: DataFrame, stats: DataFrame) -> DataFrame:
    """The finished row of each day."""
    parts = finish(daily_parts(blocks, txs, transfers))
    running = daily_cumulative(parts).select("day", F.col("cumulative").alias("total_txs"))
    addresses = daily_address_columns(stats, day_spans(blocks))
    return parts.join(running, "day").join(addresses, "day", "left").select(
        "day", "blocks", "gas_used", "avg_block_size", "avg_block_time", "first_block", "tx_count", "avg_gas_price", "success", "failed",
        "active_addresses", "transfer_count", "total_txs", "new_addresses", "new_contracts", "total_addresses", "total_contracts",
    )


def daily_recompute(blocks: DataFrame, txs: DataFrame, transfers: DataFrame, stats: DataFrame, day: str) -> DataFrame:
    """One day straight from the rows, by other means than daily_stats: filters on the day and one-row aggregates."""
    wanted = F.lit(day).cast("date")
    own = blocks.where(day_of(F.col("timestamp")) == wanted)
    previous = blocks.select((F.col("number") + 1).alias("number"), F.col("timestamp").alias("before"))
    b = own.join(previous, "number", "left").agg(
        F.count("*").alias("blocks"), F.coalesce(F.sum("gas_used"), F.lit(0)).cast("long").alias("gas_used"),
        F.coalesce(F.round(F.avg(F.col("size").cast("decimal(20,0)")), 0), F.lit(0)).cast("long").alias("avg_block_size"),
        F.coalesce(F.round(F.avg((F.col("timestamp") - F.col("before")).cast("decimal(20,0)")), 0), F.lit(0)).cast("long").alias("avg_block_time"),
        F.min("number").alias("first_block"), F.max("number").alias("last_block"),
    )
    rows = txs.where(day_of(F.col("block_timestamp")) == wanted)
    t = rows.agg(F.count("*").alias("tx_count"), F.count_if(F.col("status") == 1).alias("success"), F.count_if(F.col("status") == 0).alias("failed"))
    active = rows.select(F.col("from_address").alias("a")).union(rows.where("to_address is not null").select("to_address")).distinct()
    a = active.agg(F.count("*").alias("active_addresses"))
    moved = transfers.where(day_of(F.col("timestamp")) == wanted).agg(F.count("*").alias("transfer_count"))
    upto = txs.where(day_of(F.col("block_timestamp")) <= wanted).agg(F.count("*").alias("total_txs"))
    known = stats.crossJoin(F.broadcast(b.select("last_block"))).where(F.col("first_seen") <= F.col("last_block"))
    n = known.agg(F.count("*").alias("total_addresses"), F.count_if("is_contract").alias("total_contracts"))
    one = b.drop("last_block").select(wanted.alias("day"), "*")
    for part in (t, a, moved, upto, n):  # one row each
        one = one.crossJoin(F.broadcast(part))
    return one


def daily_refill(raw: DataFrame, stored: DataFrame, optional: tuple[str, ...]) -> DataFrame:
    """Days counted anew from raw blocks; optional columns that the raw input couldn't give (null) keep what is stored."""
    kept = stored.select("day", *(F.col(c).alias(f"stored_{c}") for c in optional))
    joined = raw.join(kept, "day", "left")
    return joined.withColumns({c: F.coalesce(c, f"stored_{c}") for c in optional}).drop(*(f"stored_{c}" for c in optional))


def cumulative_backwards(daily: DataFrame, known_day: str, known_total: int) -> DataFrame:
    """(day, tx_count, cumulative) of the consecutive days up to one whose cumulative total is known, going back.

    A day before a gap has no row: its total can't be known. A row per day is windowed.
    """
    wanted = F.lit(known_day).cast("date")
    past = daily.where(F.col("day") <= wanted).select("day", "tx_count")
    newest = Window.orderBy(F.desc("day"))
    rows = past.withColumn("rank", F.row_number().over(newest) - 1).where(F.datediff(wanted, F.col("day")) == F.col("rank"))
    later = newest.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(known_total) - F.coalesce(F.sum("tx_count").over(later), F.lit(0))
    return rows.select("day", "tx_count", total.cast("long").alias("cumulative"))


def day_spans_inferred(days: DataFrame, top: int) -> DataFrame:
    """(day, lo, inferred) from days(day, blocks, first_block): unknown starts filled from the counts before.

    Days are cut into islands that begin with a known start. In an island each start is the one before plus its
    blocks. Its unknown starts are accepted only if dates don't skip and the island's end is the next known start (or,
    in the last one, the block above top); otherwise they are left out.
    """
    order = Window.orderBy("day")  # a row per day
    marked = days.withColumn("island", F.count("first_block").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("island").orderBy("day")
    whole = Window.partitionBy("island")
    run = marked.where("island > 0").select(
        "day", "blocks", "first_block", "island",
        (F.first("first_block").over(own) + F.coalesce(F.sum("blocks").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("lo"),
        (F.datediff(F.max("day").over(whole), F.min("day").over(whole)) + 1 == F.count("*").over(whole)).alias("dense"),
        (F.first("first_block").over(own) + F.sum("blocks").over(whole)).alias("end"),
        F.max("day").over(whole).alias("last_day"),
    )
    heads = marked.where("first_block is not null").select((F.col("island") - 1).alias("island"), F.col("first_block").alias("next"), F.col("day").alias("next_day"))
    joined = run.join(heads, "island", "left")
    lands = (F.col("end") == F.coalesce("next", F.lit(top + 1))) & (F.col("next_day").isNull() | (F.datediff("next_day", "last_day") == 1))
    return joined.where(F.col("first_block").isNotNull() | (F.col("dense") & lands)).select(
        "day", "lo", F.col("first_block").isNull().alias("inferred")
    )


def stale_days(blocks: DataFrame, acc: DataFrame, watermark: int) -> DataFrame:
    """Days whose stored counts of blocks or gaps differ from a recount below the watermark."""
    below = blocks.where(F.col("number") <= watermark)
    fresh = daily_blocks(below).select("day", F.col("blocks").alias("now_blocks"), F.col("gap_n").alias("now_gaps"))
    joined = fresh.join(acc.select("day", "blocks", "gap_n"), "day", "full_outer")
    differs = ~F.coalesce("blocks", F.lit(0)).eqNullSafe(F.coalesce("now_blocks", F.lit(0))) | ~F.coalesce("gap_n", F.lit(0)).eqNullSafe(F.coalesce("now_gaps", F.lit(0)))
    return joined.where(differs).select("day")


def recount_days(blocks: DataFrame, txs: DataFrame, transfers: DataFrame, days: DataFrame, watermark: int) -> DataFrame:
    """Additive columns of the listed days from rows at or below the watermark; the block before a day still pairs."""
    wanted = F.broadcast(days.select("day").distinct())  # a row per stale day
    # the days' ends, and then their blocks', as constants that reach the scans
    first, last = days.select(epoch_of(F.col("day")).alias("e")).agg(F.min("e"), F.max("e")).first()
    within = lambda time: F.lit(False) if first is None else F.col(time).between(first, last + 86_399)
    below = blocks.where((F.col("number") <= watermark) & within("timestamp"))
    own = below.join(wanted, day_of(F.col("timestamp")) == wanted["day"], "left_semi")
    # the blocks before those of other days are needed for their times only
    low, high = own.agg(F.min("number") - 1, F.max("number")).first()
    near = blocks.where(F.lit(False) if low is None else F.col("number").between(low, high))
    ahead = near.join(own.select((F.col("number") - 1).alias("number")), "number", "left_semi").select("number", "timestamp")
    b = daily_blocks(own, ahead)
    t = txs.where((F.col("block_number") <= watermark) & within("block_timestamp")).join(wanted, day_of(F.col("block_timestamp")) == wanted["day"], "left_semi")
    m = transfers.where((F.col("block_number") <= watermark) & within("timestamp")).join(wanted, day_of(F.col("timestamp")) == wanted["day"], "left_semi")
    joined = b.join(daily_txs(t), "day", "left").join(daily_active(t), "day", "left").join(daily_transfers(m), "day", "left")
    zero = ("tx_count", "success", "failed", "active_addresses", "transfer_count")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero} | {"price_sum": F.coalesce("price_sum", F.lit(0).cast("decimal(38,0)"))})


ADDITIVE = ("blocks", "gas_used", "size_sum", "size_n", "gap_sum", "gap_n", "tx_count", "price_sum", "success", "failed", "transfer_count")


def daily_parts_merge(base: DataFrame, retained: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Parts of two block ranges added; boundary(day, gap_sum, gap_n) is the pair of blocks across their border."""
    columns = ["day", *ADDITIVE, "first_block"]
    whole = base.select(columns).unionByName(retained.select(columns))
    if boundary is not None:
        whole = whole.unionByName(boundary.select("day", "gap_sum", "gap_n"), allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast(base.schema[c].dataType).alias(c) for c in ADDITIVE]
    return whole.groupBy("day").agg(*sums, F.min("first_block").alias("first_block"))


def active_set_diff(stored: DataFrame, recount: DataFrame) -> DataFrame:
    """(day, address, change) of two sets of active addresses: gone or added."""
    keys = ["day", "address"]
    gone = stored.select(keys).join(recount.select(keys), keys, "left_anti").withColumn("change", F.lit("gone"))
    added = recount.select(keys).join(stored.select(keys), keys, "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(added)


def invalidate_days(acc: DataFrame, blocks: DataFrame, watermark: int, block: int, pruned_below: int = 0) -> DataFrame:
    """After a revert of block: (day, action, new_watermark) of the stored days.

    Days from the block's on go; the watermark falls to the block before the first one that goes, but stays on a stored
    block. A day that reaches below what is pruned is refused: it couldn't be counted again.
    """
    cut = acc.where(F.col("first_block") <= block).agg(F.max("day").alias("from_day"))
    marked = acc.crossJoin(F.broadcast(cut))
    going = F.col("day") >= F.col("from_day")
    first = marked.where(going).agg(F.min("first_block").alias("first_gone"))
    under = blocks.crossJoin(F.broadcast(first)).where(F.col("number") < F.least("first_gone", F.lit(watermark + 1)))
    mark = under.agg(F.coalesce(F.max("number"), F.lit(-1)).cast("long").alias("new_watermark"))
    action = F.when(~going, "keep").when(F.col("first_block") < pruned_below, "refuse").otherwise("drop")
    return marked.crossJoin(F.broadcast(mark)).select("day", action.alias("action"), "new_watermark")


def watermark_start(blocks: DataFrame) -> DataFrame:
    """Where a fold may begin: the first block of the newest day, if the one before is stored or nothing lies below."""
    spans = blocks.groupBy(day_of(F.col("timestamp")).alias("day")).agg(F.min("number").alias("first_block"))
    newest = spans.agg(F.max_by("first_block", "day").alias("first_block"))
    below = blocks.crossJoin(F.broadcast(newest)).where(F.col("number") < F.col("first_block"))
    facts = below.agg(F.count("*").alias("below"), F.max("number").alias("last_below"))
    good = (F.col("below") == 0) | (F.col("last_below") == F.col("first_block") - 1)
    return newest.crossJoin(F.broadcast(facts)).where(good).select((F.col("first_block") - 1).alias("watermark"))


def watermark_lag(blocks: DataFrame, watermark: int) -> DataFrame:
    """Blocks between a watermark and the head, and the missing block that holds it, if one does."""
    head = blocks.agg(F.max("number").alias("head"))
    after = blocks.where(F.col("number") == watermark + 1).agg((F.count("*") > 0).alias("next_stored"))
    held = F.when((F.col("head") > watermark) & ~F.col("next_stored"), F.lit(watermark + 1).cast("long"))
    return head.crossJoin(F.broadcast(after)).select(F.greatest(F.col("head") - watermark, F.lit(0)).alias("lag"), held.alias("held_at"))
