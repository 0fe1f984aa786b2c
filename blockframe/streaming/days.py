"""The daily fold as a stream: sums of new blocks are added to stored days, whole days are recounted for late blocks only.

Blocks arrive with their transactions, in any order and again. What is contiguous above the watermark is folded: its sums
are added to its days'. What lies above a gap waits. A block below the place where the fold began is late: its day, and the
day of the block that comes next, are counted anew from a row per block. A batch ends in one commit of all tables with its
number and the new watermark; a batch that runs again finds it and does nothing. A batch reads itself, what waits, and of the
days that it touches the sums and the set of addresses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import daily, gaps
from ..sources import versions
from ..sources.versions import Change

BUNDLE = (
    "number long, timestamp long, gas_used long, size long, "
    "txs array<struct<from_address:string,to_address:string,gas_price:decimal(38,0),status:int>>, transfer_count long"
)
DAY_SECONDS = 86_400
#: Registers of a day's sketch of addresses, as a power of two.
SKETCH = 12
ROW = "number long, timestamp long, gas_used long, size long, tx_count long, price_sum decimal(38,0), success long, failed long, transfer_count long"
WAITING = f"{ROW}, addresses array<string>"
ACTIVE = "address string"


def block_rows(bundles: DataFrame) -> DataFrame:
    """A row per block with the sums of its transactions and the distinct addresses that take part."""
    txs = F.coalesce("txs", F.array().cast("array<struct<from_address:string,to_address:string,gas_price:decimal(38,0),status:int>>"))
    price = F.aggregate(txs, F.lit(0).cast("decimal(38,0)"), lambda a, t: (a + F.coalesce(t["gas_price"], F.lit(0))).cast("decimal(38,0)"))
    having = lambda status: F.size(F.filter(txs, lambda t: t["status"] == status)).cast("long")
    sides = F.array_distinct(F.array_compact(F.flatten(F.transform(txs, lambda t: F.array(t["from_address"], t["to_address"])))))
    return bundles.select(
        "number", "timestamp", "gas_used", "size", F.size(txs).cast("long").alias("tx_count"), price.alias("price_sum"), having(1).alias("success"),
        having(0).alias("failed"), F.coalesce("transfer_count", F.lit(0)).cast("long").alias("transfer_count"), sides.alias("addresses"),
    )


def _day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.floor(F.col("timestamp") / DAY_SECONDS).cast("long"))


def _days(rows: DataFrame) -> list[int]:
    """Days of a batch: a few, or a few thousand in a backfill of years."""
    return sorted(r[0] for r in _day(rows).select("bucket").distinct().collect())


def daily_fold_stream(bundles: DataFrame, out: str, checkpoint: str, start: int | None = None) -> StreamingQuery:
    """Folds bundles of BUNDLE into days at out; folded_days reads them. Runs over what has come, and stops.

    The fold begins above start; without one, at the first block of the newest day of the first batch. Of blocks that share
    a number the first one counts.
    """
    spark = bundles.sparkSession

    def absorb(batch: DataFrame, number: int) -> None:
        now = versions.current(spark, out)
        if now.token is not None and number <= now.token:
            return
        rows = block_rows(batch.where("number is not null and timestamp is not null").dropDuplicates(["number"])).persist()
        try:
            if not rows.isEmpty():
                fold(now, rows, number, start)
        finally:
            rows.unpersist()

    return bundles.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold(now: versions.Snapshot, rows: DataFrame, number: int, start: int | None = None) -> versions.Snapshot:
    """The version after now with the rows of block_rows folded in, as batch number."""
    spark, facts = rows.sparkSession, now.facts
    if "watermark" not in facts:
        if start is None:
            newest = rows.groupBy(F.floor(F.col("timestamp") / DAY_SECONDS).alias("day")).agg(F.min("number").alias("lo")).agg(F.max_by("lo", "day"))
            start = newest.first()[0] - 1
        facts = {"watermark": start, "start": start, "time": None}
    mark, begun = facts["watermark"], facts["start"]
    fresh = rows.where(F.col("number") > mark).unionByName(now.read("waiting", schema=WAITING)).dropDuplicates(["number"]).persist()
    reach = gaps.contiguous_through(fresh, mark).first()[0]
    ready, waiting = fresh.where(F.col("number") <= reach), fresh.where(F.col("number") > reach)
    late = rows.where(F.col("number") <= begun)
    late_days = _days(late)
    if late_days:
        late = late.join(now.read("blocks", late_days, ROW).select("number"), "number", "left_anti")
        late_days = _days(late)
    taken = _day(ready.unionByName(late)).persist()
    ready_days = _days(ready)
    held = sorted({int(b) for b in now.buckets("blocks")} | set(ready_days) | set(late_days))
    place = {day: i for i, day in enumerate(held)}
    anew = sorted({d for day in late_days for d in held[place[day] : place[day] + 2]})
    before = sorted({d for day in anew for d in held[max(place[day] - 1, 0) : place[day] + 1]})
    parts = _added(spark, facts, ready, anew)
    if anew:
        stored = _day(now.read("blocks", before, ROW)).unionByName(taken.drop("addresses").where(F.col("bucket").isin(before)))
        parts = parts.unionByName(daily.block_parts(stored.where(F.col("bucket").isin(anew)), stored, "bucket"))
    touched = sorted({*ready_days, *late_days, *anew})
    sides = taken.select("bucket", F.explode("addresses").alias("address")).distinct().persist()
    known = _with_bucket(now, "active", touched, ACTIVE)
    unseen = sides.join(known, ["bucket", "address"], "left_anti")
    days = _merged(now, touched, anew, parts, unseen, sides)
    changes = [
        Change("blocks", taken.drop("addresses")),
        Change("active", unseen),
        Change("days", days, tuple(touched)),
        Change("waiting", waiting.withColumn("bucket", F.lit(0)), (0,)),
    ]
    last = ready.agg(F.max_by("timestamp", "number")).first()[0]
    mark_facts = {"watermark": reach, "start": begun, "time": facts["time"] if last is None else last}
    after = versions.commit(now, changes, mark_facts, number)
    for df in (fresh, taken, sides):
        df.unpersist()
    return after


def _added(spark: SparkSession, facts: dict, ready: DataFrame, anew: list[int]) -> DataFrame:
    """The sums of what is folded, by day, but for the days that are counted anew; the watermark's block still pairs."""
    pairs = ready.select("number", "timestamp")
    if facts["time"] is not None:
        edge = spark.range(1).select(F.lit(facts["watermark"]).cast("long").alias("number"), F.lit(facts["time"]).cast("long").alias("timestamp"))
        pairs = pairs.unionByName(edge)
    return daily.block_parts(_day(ready).where(~F.col("bucket").isin(anew)), pairs, "bucket")


def _with_bucket(now: versions.Snapshot, table: str, buckets: list[int], schema: T.StructType | str) -> DataFrame:
    """Rows of some days with their day, which is in the folders' names only."""
    day = F.regexp_extract(F.col("_metadata.file_path"), r"bucket=(-?[0-9]+)", 1).cast("long")
    if not now.parts(table, buckets):
        return now.read(table, buckets, schema).withColumn("bucket", F.lit(0).cast("long"))
    return now.read(table, buckets, schema).select("*", day.alias("bucket"))


def _merged(now: versions.Snapshot, touched: list[int], anew: list[int], parts: DataFrame, unseen: DataFrame, sides: DataFrame) -> DataFrame:
    """The days' rows: stored sums, but for days counted anew, and what the batch adds; sets and sketches only grow."""
    sums = [*daily.ADDITIVE, "first_block"]
    schema = T.StructType([f for f in parts.schema.fields if f.name != "bucket"]).add("active_addresses", "long").add("sketch", "binary")
    stored = _with_bucket(now, "days", touched, schema)
    gone = F.col("bucket").isin(anew)
    stored = stored.select("bucket", *(F.when(~gone, F.col(c)).alias(c) for c in sums), "active_addresses", "sketch")
    counts = unseen.groupBy("bucket").agg(F.count("*").alias("active_addresses"))
    sketches = sides.groupBy("bucket").agg(F.hll_sketch_agg("address", F.lit(SKETCH)).alias("sketch"))
    whole = stored
    for part in (parts, counts, sketches):
        whole = whole.unionByName(part, allowMissingColumns=True)
    added = [F.coalesce(F.sum(c), F.lit(0)).cast(schema[c].dataType).alias(c) for c in (*daily.ADDITIVE, "active_addresses")]
    return whole.groupBy("bucket").agg(*added, F.min("first_block").alias("first_block"), F.hll_union_agg("sketch").alias("sketch"))


def folded_days(spark: SparkSession, out: str) -> DataFrame:
    """The days at out: (day, additive columns, first_block, active_addresses, sketch)."""
    now = versions.current(spark, out)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("bucket").cast("int"))
    return _with_bucket(now, "days", now.buckets("days"), WAITING).select(day.alias("day"), *daily.ADDITIVE, "first_block", "active_addresses", "sketch")


def active_estimate(days: DataFrame, *keys: str) -> DataFrame:
    """(keys, estimate): distinct addresses of days together, from their sketches alone; a sketch has no more than
    2^SKETCH registers, whatever it counted, so months and years are merged from a row per day."""
    return days.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def estimate_bound(registers: int = SKETCH, deviations: int = 3) -> float:
    """The relative error that an estimate stays within, at so many standard deviations."""
    return deviations * 1.04 / 2 ** (registers / 2)
