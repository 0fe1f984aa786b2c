"""Structured Streaming jobs that keep derived tables in step with arriving files.

State lives in Parquet folders bucket=.../batch=...: a batch reads, of the buckets that its own rows fall into, what batches
below its number wrote, and writes its own folders with overwrite. So its work grows with the batch and its buckets and not
with all that was ever stored, and a batch that is run again after a failure gives the same state. Snapshots that a later
one replaced are removed. Blocks arrive in any order and again; nothing is dropped for being late.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import daily, gaps, rollups

#: Blocks of a bucket of stored history.
BLOCKS = 10_000


def _files(spark: SparkSession, path: str):
    """A path and its file system."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(bucket, batch, folder) of what lies at path/bucket=.../batch=...; the bucket may be a pattern."""
    fs, root = _files(spark, f"{path}/batch=*")
    found = [str(s.getPath().toString()) for s in fs.globStatus(root) or []]
    return sorted((f.split("/")[-2], int(f.rsplit("=", 1)[1]), f) for f in found)


def _newest(spark: SparkSession, path: str, buckets: list[int] | None = None, below: int | None = None) -> list[str]:
    """The newest snapshot of each bucket, or of some, and below a batch."""
    names = ["*"] if buckets is None else buckets
    best: dict[str, str] = {}
    for name in names:
        for bucket, batch, folder in _folders(spark, f"{path}/bucket={name}"):
            if below is None or batch < below:
                best[bucket] = folder
    return list(best.values())


def latest(spark: SparkSession, path: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The newest snapshots under a path, or the newest below a batch, of all buckets or some; None if there are none."""
    kept = _newest(spark, path, buckets, below)
    return spark.read.parquet(*kept) if kept else None


def _store(df: DataFrame, path: str, batch: int) -> None:
    """Write df, by its column bucket, as the snapshot of a batch; a batch that runs again replaces its own folders."""
    rows = df.withColumn("batch", F.lit(batch)).repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def _tidy(spark: SparkSession, path: str, batch: int, buckets: list[int]) -> None:
    """Remove the buckets' snapshots that neither the batch nor a repetition of it would read."""
    for bucket in buckets:
        older = [folder for _, n, folder in _folders(spark, f"{path}/bucket={bucket}") if n < batch]
        for folder in older[:-1]:
            fs, root = _files(spark, folder)
            fs.delete(root, True)


def _buckets(df: DataFrame) -> list[int]:
    return [r[0] for r in df.select("bucket").distinct().collect()]


def ingest_blocks(spark: SparkSession, landing: str, out: str, checkpoint: str, confirmations: int = 0, files_per_batch: int = 10) -> StreamingQuery:
    """Blocks from files in a landing folder, each number once, those far enough below the head seen so far.

    out/history gets new blocks, by ranges of BLOCKS numbers (append only); out/waiting is the snapshot of what is still
    above the confirmed height, out/head that of the greatest number seen. Runs over what has landed, and stops.
    """
    arriving = spark.readStream.schema(schemas.BLOCK_LANDING).option("maxFilesPerTrigger", files_per_batch).parquet(landing)

    def absorb(batch: DataFrame, number: int) -> None:
        waiting = latest(spark, f"{out}/waiting", number)
        pending = batch if waiting is None else batch.unionByName(waiting.select(batch.columns))
        pending = pending.dropDuplicates(["number"]).withColumn("bucket", F.floor(F.col("number") / BLOCKS).cast("long")).persist()
        before = latest(spark, f"{out}/head", number)
        heads = [df.agg(F.max("number")).first()[0] for df in (pending, before) if df is not None]
        head = max((h for h in heads if h is not None), default=0)
        done = [f for b in _buckets(pending) for _, n, f in _folders(spark, f"{out}/history/bucket={b}") if n < number]
        stored = spark.read.schema(schemas.BLOCK_LANDING).parquet(*done) if done else pending.limit(0)
        fresh = pending.join(stored.select("number"), "number", "left_anti").select(*batch.columns, "bucket").persist()
        safe = F.col("number") <= head - confirmations
        _store(fresh.where(safe), f"{out}/history", number)
        # a row each time, so that a snapshot that holds nothing is one too
        none = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in batch.schema), F.lit(0).alias("bucket"))
        _store(fresh.where(~safe).withColumn("bucket", F.lit(0)).unionByName(none), f"{out}/waiting", number)
        _store(spark.range(1).select(F.lit(head).cast("long").alias("number"), F.lit(0).alias("bucket")), f"{out}/head", number)
        for name in ("waiting", "head"):
            _tidy(spark, f"{out}/{name}", number, [0])
        fresh.unpersist()
        pending.unpersist()

    return arriving.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, out: str) -> DataFrame:
    """All blocks that ingest_blocks has written."""
    rows = spark.read.schema(f"{schemas.BLOCK_LANDING}, bucket long, batch long").parquet(f"{out}/history")
    return rows.drop("bucket", "batch")


def waiting(spark: SparkSession, out: str) -> DataFrame:
    """Blocks that ingest_blocks holds back."""
    return latest(spark, f"{out}/waiting").where("number is not null")


#: Spark's keyed state store on disk; a batch commits a log of its own changes.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in STATE_STORE; the session's settings are as before afterwards."""
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    try:
        for key, value in STATE_STORE.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def current_balances_stream(reads: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Highest block wins per (token_address, address) over reads(token_address, address, balance, block_number, arrival).

    Of equal blocks the later arrival stays, and of equal arrivals the greater balance. The winners are keyed state in
    Spark's state store: a batch reads and writes the keys that it holds, whatever the number of keys stored.
    current_balances_of reads the state; out/batch=N has what batch N changed, for those who follow.
    """
    order = F.struct("block_number", "arrival", "balance")
    best = reads.groupBy("token_address", "address").agg(F.max(order).alias("best"))
    changed = best.select("token_address", "address", "best.balance", "best.block_number", "best.arrival")

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with keyed_state(reads.sparkSession):
        return changed.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_balances_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The winners that current_balances_stream holds: a scan of its state, a row per key."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    best = state.schema["value"].dataType.fields[0].name
    return state.select("key.*", F.col("value")[best].alias("best")).select("token_address", "address", "best.balance", "best.block_number", "best.arrival")


def blocks_once(arriving: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of blocks in which a redelivered (number, hash) is dropped, if it comes within the delay of the newest
    block; the state holds no more than that. Later redeliveries are for the exact path of ingest_blocks."""
    timed = arriving.withColumn("event_time_", F.timestamp_seconds("timestamp")).withWatermark("event_time_", delay)
    return timed.dropDuplicatesWithinWatermark(["number", "hash"]).drop("event_time_")


def daily_fold_step(blocks: DataFrame, txs: DataFrame, transfers: DataFrame, acc: DataFrame | None, watermark: int) -> tuple[DataFrame, int]:
    """Folds what is contiguous above the watermark: (daily parts after it, the new watermark).

    Days that the new blocks touch are counted anew up to the new watermark and replace the stored ones, so late blocks,
    repeated batches and a day that is met twice all give the same sums.
    """
    reach = gaps.contiguous_through(blocks, watermark).first()[0]
    if reach is None or reach <= watermark:
        return acc, watermark
    fresh = blocks.where((F.col("number") > watermark) & (F.col("number") <= reach))
    touched = fresh.select(daily.day_of(F.col("timestamp")).alias("day")).distinct()
    recounted = daily.recount_days(blocks, txs, transfers, touched, reach)
    kept = recounted if acc is None else acc.join(touched, "day", "left_anti").unionByName(recounted)
    return kept, reach


def batch_twin(reads: DataFrame) -> DataFrame:
    """What current_balances_stream must agree with."""
    return rollups.current_balances(reads)
