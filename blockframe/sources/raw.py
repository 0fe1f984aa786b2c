"""Readers of raw chain dumps, and layouts and exports of history."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def raw_block_scan(spark: SparkSession, path: str) -> DataFrame:
    """Raw blocks from JSON lines: quantities stay hex text but for what is missing or malformed.

    A missing difficulty is "0x0"; a nonce that isn't eight bytes is zero.
    """
    return tidy_blocks(spark.read.schema(schemas.RAW_BLOCK).json(path))


def tidy_blocks(raw: DataFrame) -> DataFrame:
    """Raw blocks with the defaults of raw_block_scan."""
    zero = "0x" + "0" * 16
    return raw.withColumns(
        {
            "difficulty": F.coalesce("difficulty", F.lit("0x0")),
            "totalDifficulty": F.coalesce("totalDifficulty", F.lit("0x0")),
            "nonce": F.when(F.col("nonce").rlike("^0x[0-9a-fA-F]{16}$"), F.col("nonce")).otherwise(zero),
        }
    )


def bundle_scan(spark: SparkSession, path: str) -> DataFrame:
    """Raw blocks with their receipts and traces, from JSON lines."""
    return spark.read.schema(schemas.RAW_BUNDLE).json(path)


def bundle_rows(text: DataFrame) -> DataFrame:
    """The same from lines that are there as rows, in the column value: they are parsed where they lie."""
    return text.select(F.from_json("value", schemas.RAW_BUNDLE).alias("b")).select("b.*")


def receipts_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW_RECEIPT).json(path)


def trace_scan(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Call traces, a row per transaction, the result as a variant.

    An entry with an error, without a result or without a call type is left out; with strict it fails the read.
    """
    return tidy_traces(spark.read.schema(schemas.TRACE).json(path), strict)


def tidy_traces(raw: DataFrame, strict: bool = False) -> DataFrame:
    """(tx_hash, block_number, timestamp, frame) of raw traces, by the rules of trace_scan."""
    raw = raw.withColumn("frame", F.try_parse_json("result"))
    kind = F.try_variant_get("frame", "$.type", "string")
    good = F.col("error").isNull() & F.col("frame").isNotNull() & F.coalesce(kind != "", F.lit(False))
    if strict:
        message = F.concat(F.lit("no trace for transaction "), F.col("txHash"))
        raw = raw.withColumn("frame", F.when(good, F.col("frame")).otherwise(F.raise_error(message).cast("variant")))
    else:
        raw = raw.where(good)
    return raw.select(F.lower("txHash").alias("tx_hash"), F.col("blockNumber").alias("block_number"), "timestamp", "frame")


def creations_csv(spark: SparkSession, path: str) -> DataFrame:
    """(address, creation_tx, block_number, creator) from CSV with or without a header; a bad row fails the read."""
    return tidy_creations(spark.read.schema(schemas.CREATIONS).option("mode", "PERMISSIVE").csv(path))


def tidy_creations(rows: DataFrame) -> DataFrame:
    """Checked rows of creations, by the rules of creations_csv."""
    rows = rows.where(~F.lower(F.coalesce("address", F.lit(""))).isin("address", "contract_address"))
    good = F.lower("address").rlike("^0x[0-9a-f]{40}$") & F.lower("creation_tx").rlike("^0x[0-9a-f]{64}$") & F.col("block_number").rlike("^[0-9]+$")
    good = good & (F.col("creator").isNull() | F.lower("creator").rlike("^0x[0-9a-f]{40}$"))
    message = F.concat(F.lit("bad creation row: "), F.coalesce("address", F.lit("(none)")))
    checked = F.when(F.coalesce(good, F.lit(False)), F.lower("address")).otherwise(F.raise_error(message))
    return rows.select(checked.alias("address"), F.lower("creation_tx").alias("creation_tx"), F.col("block_number").cast("long").alias("block_number"), F.lower("creator").alias("creator"))


def bucketed_history(df: DataFrame, block_col: str, size: int) -> DataFrame:
    """df with block_bucket, the first block of its range; written with partitionBy("block_bucket") a range is a folder."""
    return df.withColumn("block_bucket", (F.floor(F.col(block_col) / size) * size).cast("long"))


def write_history(df: DataFrame, path: str, block_col: str, size: int) -> None:
    """History as Parquet, a folder per range of blocks; rows are dealt by range first, so a range has few files."""
    bucketed_history(df, block_col, size).repartition("block_bucket").sortWithinPartitions(block_col).write.mode("append").partitionBy(
        "block_bucket"
    ).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; on one machine (tests) a temporary one may do."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-landing-")
    return folder.rstrip("/")


#: Rows of an archive's file: the manifest digests a file as one value, which must fit a task's memory.
ARCHIVE_ROWS = 500_000


def archive_export(df: DataFrame, path: str, rows: int = ARCHIVE_ROWS) -> None:
    """A range as gzipped CSV with a header, in files of at most so many rows."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", rows).option("compression", "gzip").option("header", True).csv(path)


def archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, digest, rows) of an archive's files; rows are the CSV's, without headers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv.gz").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    digests = files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
    rows = spark.read.option("header", True).csv(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    counts = rows.groupBy("file").agg(F.count("*").alias("rows"))
    return digests.join(counts, "file", "left").select("file", "bytes", "digest", F.coalesce("rows", F.lit(0)).alias("rows"))


def change_feed(blocks: DataFrame, txs: DataFrame, transfers: DataFrame) -> DataFrame:
    """(event, block_number, payload): a JSON event for each new block, transaction, and address active in a block."""
    def event(df, kind, block):
        return df.select(F.lit(kind).alias("event"), F.col(block).cast("long").alias("block_number"), F.to_json(F.struct("*")).alias("payload"))

    sides = txs.select("block_number", F.explode(F.array("from_address", "to_address")).alias("address"))
    sides = sides.unionByName(transfers.select("block_number", F.explode(F.array("from_address", "to_address")).alias("address")))
    active = sides.where("address is not null").distinct()
    return event(blocks, "new_block", "number").unionByName(event(txs, "new_transaction", "block_number")).unionByName(event(active, "address_activity", "block_number"))


def deposit_logs(l1_logs: DataFrame, portal: str, topic0: str, head: int, confirmations: int, after: int | None = None) -> DataFrame:
    """Deposit events of a bridge's portal from above a resume point up to head - confirmations."""
    rows = l1_logs.where((F.lower("address") == portal.lower()) & (F.col("topic0") == topic0) & (F.col("block_number") <= head - confirmations))
    return rows if after is None else rows.where(F.col("block_number") > after)


