"""The change feed as a stream: each new block's events, numbered without gaps, from any number on.

A block's events are one row's: the block, its transactions in order, and the addresses that take part. So their place within
the block needs no exchange; the blocks of a batch are put in order within ranges to number them on from the last batch. A
batch is one commit with its number and the next sequence number; a batch that runs again after a failure finds it and adds
nothing, so numbers never change once they can be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions
from ..sources.versions import Change

BUNDLE = (
    "number long, hash string, timestamp long, "
    "txs array<struct<hash:string,tx_index:int,from_address:string,to_address:string>>, transfers array<struct<token_address:string,from_address:string,to_address:string>>"
)
#: Events, and blocks, of a folder.
EVENTS = 1_000_000
BLOCKS = 10_000
_EVENTS = "sequence long, event string, block_number long, block_hash string, place int, payload string"
_SEEN = "number long, hash string"


def _txs() -> Column:
    return F.coalesce("txs", F.array().cast("array<struct<hash:string,tx_index:int,from_address:string,to_address:string>>"))


def _active() -> Column:
    """The addresses that take part in a block, in order."""
    moves = F.coalesce("transfers", F.array().cast("array<struct<token_address:string,from_address:string,to_address:string>>"))
    sides = lambda rows: F.flatten(F.transform(rows, lambda x: F.array(x["from_address"], x["to_address"])))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(sides(_txs()), sides(moves)))))


def _events() -> Column:
    """A block's events in order, as (event, payload)."""
    txs, active = _txs(), _active()
    event = lambda kind, *fields: F.struct(F.lit(kind).alias("event"), F.to_json(F.struct(*fields)).alias("payload"))
    head = event("new_block", "number", "hash", "timestamp", F.size(txs).alias("transaction_count"))
    ordered = F.array_sort(txs, lambda a, b: F.when(a["tx_index"] < b["tx_index"], -1).when(a["tx_index"] > b["tx_index"], 1).otherwise(0))
    each = F.transform(ordered, lambda t: event("new_transaction", *(t[c].alias(c) for c in ("hash", "tx_index", "from_address", "to_address")), F.col("number").alias("block_number")))
    touched = F.transform(active, lambda a: event("address_activity", a.alias("address"), F.col("number").alias("block_number")))
    return F.concat(F.array(head), each, touched)


def numbered(blocks: DataFrame, next_sequence: int) -> DataFrame:
    """The events of blocks, in order of number and hash, numbered on from next_sequence.

    Numbers run within ranges of BLOCKS first; the sums of the ranges, a row each, tell where each range begins.
    """
    keys = ["number", "hash"]
    sizes = blocks.select(*keys, F.floor(F.col("number") / BLOCKS).alias("range"), (1 + F.size(_txs()) + F.size(_active())).cast("long").alias("n"))
    within = Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range of blocks
    upto = lambda order: F.coalesce(F.sum("n").over(order), F.lit(0))
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("n")).select("range", upto(below).alias("below"))
    first = sizes.select(*keys, "range", upto(within).alias("within")).join(F.broadcast(ranges), "range")
    first = first.select(*keys, (F.col("below") + F.col("within") + next_sequence).alias("first"))
    spread = blocks.join(first, keys).select(*keys, "first", F.posexplode(_events()).alias("place", "e"))
    return spread.select((F.col("first") + F.col("place")).cast("long").alias("sequence"), "e.event", F.col("number").alias("block_number"), F.col("hash").alias("block_hash"), "place", "e.payload")


def change_feed_stream(blocks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Events of blocks of BUNDLE at out; events_from reads them. A block is one number and hash: that one comes again is no
    event, that a number comes with another hash is. Runs over what has come, and stops."""
    spark = blocks.sparkSession

    def absorb(batch: DataFrame, number: int) -> None:
        now = versions.current(spark, out)
        if now.token is None or number > now.token:
            publish(now, batch, number)

    return blocks.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish(now: versions.Snapshot, blocks: DataFrame, number: int) -> versions.Snapshot:
    """The version after now with the events of the blocks that it hasn't seen, as batch number."""
    once = blocks.where("number is not null and hash is not null").dropDuplicates(["number", "hash"])
    once = once.withColumn("bucket", F.floor(F.col("number") / BLOCKS).cast("long")).persist()
    ranges = [r[0] for r in once.select("bucket").distinct().collect()]  # of a batch
    fresh = once.join(now.read("seen", ranges, _SEEN), ["number", "hash"], "left_anti").persist()
    at = now.facts.get("next", 0)
    events = numbered(fresh, at).withColumn("bucket", F.floor(F.col("sequence") / EVENTS).cast("long")).persist()
    added = events.count()
    changes = [Change("events", events, order=("sequence",)), Change("seen", fresh.select("number", "hash", "bucket"))] if added else []
    after = versions.commit(now, changes, {"next": at + added}, number)
    for df in (events, fresh, once):
        df.unpersist()
    return after


def events_from(spark: SparkSession, out: str, sequence: int = 0, n: int | None = None) -> DataFrame:
    """Events from a sequence number on, n of them or all, in order: what a consumer reads that has those below it."""
    now = versions.current(spark, out)
    first, last = sequence // EVENTS, None if n is None else (sequence + n - 1) // EVENTS
    wanted = [b for b in now.buckets("events") if int(b) >= first and (last is None or int(b) <= last)]
    rows = now.read("events", wanted, _EVENTS).where(F.col("sequence") >= sequence)
    return (rows if n is None else rows.where(F.col("sequence") < sequence + n)).orderBy("sequence")
