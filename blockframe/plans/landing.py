"""Registered queries of raw input and of streams.

Raw input is encoded from the fixture views by Spark, as text, and decoded again; streams read files that Spark writes
from the views below the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import u256
from ..operators import backfill, daily, decode
from ..sources import fixtures, history, raw, versions
from ..streaming import days, feed, ingest
from .chain import SPAN, Chain
from .maintenance import D_ALL, DENSE, L_CHAIN, LATE, L_TOKEN, TX_DAY, dense
from .queries import ADDRESS, BLOCK_SQL, FRAME_COLUMNS, LOG_SQL, MOVE_COLUMNS, MOVE_SQL, TX, TX_COLUMNS, TX_SQL, query


def _hex(column):
    return F.concat(F.lit("0x"), F.lower(F.hex((F.col(column) if isinstance(column, str) else column).cast("long"))))


def _heads(c: Chain) -> DataFrame:
    """Blocks with their transactions as a dump has them; n is the number, by which they are dealt, states each transaction's status.

    Transactions are dealt by block before they are texts.
    """
    tx = F.struct(
        F.col("hash"), F.col("from_address").alias("from"), F.col("to_address").alias("to"), _hex("value").alias("value"), _hex("gas_used").alias("gas"),
        _hex("gas_price").alias("gasPrice"), F.col("input_data").alias("input"), _hex("tx_type").alias("type"), _hex("tx_index").alias("transactionIndex"),
    )
    bodies = c.dealt_txs.groupBy(F.col("block_number").alias("n")).agg(F.collect_list(tx).alias("transactions"), F.collect_list(F.struct("hash", "status")).alias("states"))  # a block's own
    heads = c.blocks.select(
        F.col("number").alias("n"), _hex("number").alias("number"), "hash", F.col("parent_hash").alias("parentHash"), _hex("timestamp").alias("timestamp"),
        _hex("gas_used").alias("gasUsed"), _hex("size").alias("size"), _hex("base_fee_per_gas").alias("baseFeePerGas"), F.lit("0x7").alias("nonce"),
    )
    return heads.join(bodies, "n")


def _raw_blocks(c: Chain) -> DataFrame:
    """Blocks as JSON text, parsed with the schema of a dump."""
    text = _heads(c).select(F.to_json(F.struct("number", "hash", "parentHash", "timestamp", "gasUsed", "size", "baseFeePerGas", "nonce", "transactions")).alias("value"))
    return raw.tidy_blocks(text.select(F.from_json("value", schemas.RAW_BLOCK).alias("b")).select("b.*"))


query("raw_block_scan", "SELECT number, CAST(count(*) AS BIGINT) AS transactions, '0x0' AS difficulty, '0x0000000000000000' AS nonce FROM f_blocks JOIN f_tx ON block_number = number GROUP BY number")(
    lambda c: _raw_blocks(c).select(F.conv(F.expr("substr(number, 3)"), 16, 10).cast("long").alias("number"), F.size("transactions").alias("transactions"), "difficulty", "nonce")
)
query("blocks_from_raw", f"SELECT {BLOCK_SQL} FROM f_blocks")(
    lambda c: decode.blocks_from_raw(_raw_blocks(c)).select("number", "timestamp", "gas_used", "transaction_count", "size", "base_fee_per_gas")
)
query("txs_from_raw", "SELECT hash, block_number, block_timestamp, CAST(tx_index AS BIGINT) AS tx_index, from_address, to_address, CAST(CAST(value AS BIGINT) AS VARCHAR) AS value, gas_used AS gas_limit, gas_price, 0 AS nonce, CAST(tx_type AS BIGINT) AS tx_type, input_data FROM f_tx")(
    lambda c: decode.txs_from_raw(_raw_blocks(c)).withColumn("value", u256.to_decimal(F.col("value"))).drop("max_fee_per_gas", "max_priority_fee_per_gas")
)


def _raw_receipts(c: Chain) -> DataFrame:
    topics = F.array_compact(F.array("topic0", "topic1", "topic2", "topic3"))
    item = F.struct("address", topics.alias("topics"), "data", _hex("log_index").alias("logIndex"))
    logs = c.logs.groupBy(F.col("tx_hash").alias("transactionHash"), _hex("block_number").alias("blockNumber")).agg(F.collect_list(item).alias("logs"))
    return logs.select(F.from_json(F.to_json(F.struct("*")), schemas.RAW_RECEIPT).alias("r")).select("r.*")


query("logs_from_receipts", "SELECT tx_hash, block_number, CAST(log_index AS BIGINT) AS log_index, token_address AS address, token_type = 'ERC721' AS has_topic3, false AS removed FROM f_transfers")(
    lambda c: decode.logs_from_receipts(_raw_receipts(c)).select("tx_hash", "block_number", "log_index", "address", F.col("topic3").isNotNull().alias("has_topic3"), "removed")
)


def _call(frame: str = "") -> Column:
    """A frame as JSON text, of the columns with that prefix."""
    col = lambda name: F.col(f"{frame}{name}")
    return F.to_json(F.struct(col("call_type").alias("type"), col("from_address").alias("from"), col("to_address").alias("to"), col("output").alias("output"), col("error").alias("error")))


#: The frames of a call tree by their paths.
_PATHS = {"r": "", "a": "0", "b": "0,0", "d": "1", "e": "1,0", "f": "1,0,0"}


def _tree() -> Column:
    """A call tree as JSON text, of the frames in the columns of `_PATHS`: a call with a creation in it, and a call around two nested creations."""

    def nest(parent, *children):
        inner = F.concat_ws(",", *children)
        return F.when(parent.isNotNull(), F.concat(F.regexp_replace(parent, r"\}$", ""), F.lit(',"calls":['), inner, F.lit("]}")))

    return nest(F.col("r"), nest(F.col("a"), F.col("b")), nest(F.col("d"), nest(F.col("e"), F.col("f"))))


def _traces(c: Chain) -> DataFrame:
    """A call tree per transaction."""
    at = lambda path: F.max(F.when(F.col("trace_address") == path, F.col("j")))
    rows = c.frames.select("tx_hash", "block_number", "timestamp", "trace_address", _call().alias("j"))
    wide = rows.groupBy("tx_hash", "block_number", "timestamp").agg(*(at(p).alias(n) for n, p in _PATHS.items()))
    return wide.select(F.col("tx_hash").alias("txHash"), F.col("block_number").alias("blockNumber"), "timestamp", _tree().alias("result"), F.lit(None).cast("string").alias("error"))


query("trace_scan", "SELECT tx_hash, block_number FROM f_frames WHERE trace_address = '' AND block_number % 10 <> 0")(
    lambda c: raw.tidy_traces(_traces(c).withColumn("error", F.when(F.col("blockNumber") % 10 == 0, "lost"))).select("tx_hash", "block_number")
)
query("flatten_frames", "SELECT tx_hash, block_number, trace_address, from_address, to_address, call_type, output, error FROM f_frames WHERE trace_address IN ('0', '0,0', '1', '1,0', '1,0,0')")(
    lambda c: decode.flatten_frames(raw.tidy_traces(_traces(c))).select("tx_hash", "block_number", "trace_address", "from_address", "to_address", "call_type", "output", "error")
)
query("creations_csv", "SELECT address, concat('0x', lpad(substr(creation_tx, 60), 64, '0')) AS creation_tx, block_number, creator FROM contracts")(
    lambda c: raw.tidy_creations(
        c.contracts.select(
            F.from_csv(
                F.concat_ws(",", F.upper(F.expr("substr(address, 3)")), F.expr("concat('0x', lpad(substr(creation_tx, 60), 64, '0'))"), "block_number", "creator"), schemas.CREATIONS
            ).alias("r")
        ).select("r.*").withColumn("address", F.concat(F.lit("0x"), "address"))
    )
)


def _deposit_logs(c: Chain) -> DataFrame:
    """Portal events whose data holds a transaction's value and gas."""
    word = lambda col: F.lpad(F.hex(F.col(col).cast("long")), 64, "0")
    body = F.concat(word("value"), word("value"), F.lpad(F.hex(F.col("gas_used")), 16, "0"), F.when(F.col("to_address").isNull(), "01").otherwise("00"), F.lit("AB"))
    head = F.lpad(F.hex(F.lit(32)), 64, "0"), F.lpad(F.hex((F.length(body) / 2).cast("long")), 64, "0")
    topic = lambda col: F.concat(F.lit("0x"), F.lpad(F.substring(F.coalesce(col, F.lit("0x")), 3, 40), 64, "0"))
    return c.txs.select(
        F.col("hash").alias("tx_hash"), "block_number", F.col("tx_index").alias("log_index"), F.lit("0xPortal").alias("address"), F.lit("0xdep").alias("topic0"),
        topic(F.col("from_address")).alias("topic1"), topic(F.col("to_address")).alias("topic2"), F.concat(F.lit("0x"), *head, body).alias("data"),
    )


query("deposit_logs", f"SELECT hash AS tx_hash, block_number FROM f_tx WHERE block_number > 20 AND block_number <= {LATE} - 10")(
    lambda c: raw.deposit_logs(_deposit_logs(c), "0xportal", "0xdep", c.late, 10, after=20).select("tx_hash", "block_number")
)
query("deposit_decode", "SELECT hash AS tx_hash, from_address, to_address, CAST(CAST(value AS BIGINT) AS VARCHAR) AS mint, CAST(CAST(value AS BIGINT) AS VARCHAR) AS value, gas_used AS gas_limit, to_address IS NULL AS is_creation, '0xAB' AS payload FROM f_tx")(
    lambda c: decode.deposit_decode(_deposit_logs(c)).withColumns({"mint": u256.to_decimal(F.col("mint")), "value": u256.to_decimal(F.col("value"))}).drop("block_number", "log_index")
)
query("abi_string", "SELECT address, symbol FROM tokens")(
    lambda c: c.tokens.select(
        "address", F.concat(F.lit("0x"), F.lpad(F.hex(F.lit(32)), 64, "0"), F.lpad(F.hex(F.length("symbol").cast("long")), 64, "0"), F.rpad(F.hex("symbol"), 64, "0")).alias("data")
    ).select("address", decode.abi_string(F.col("data")).alias("symbol"))
)


def _folder(c: Chain) -> str:
    return f"{raw.shared_folder(c.spark)}/stream-{uuid.uuid4().hex}"


def _land(rows: DataFrame, folder: str) -> None:
    """Files that a stream finds in its folder, written and read by as many tasks as the rows need."""
    rows.write.mode("append").parquet(folder)


def _per_batch(c: Chain, folder: str, batches: int = 3) -> int:
    """Files of a batch, so that what has landed comes in so many batches whatever its size."""
    return max(2, -(-len(c.spark.read.parquet(folder).inputFiles()) // batches))


def _archived(c: Chain) -> DataFrame:
    folder = _folder(c)
    raw.archive_export(c.txs, folder)
    return raw.archive_manifest(c.spark, folder).agg(F.sum("rows").alias("rows"), F.min(F.length("digest")).alias("digest_chars"))


query("archive_manifest", "SELECT count(*) AS rows, 64 AS digest_chars FROM f_tx")(_archived)


def _ingested(c: Chain) -> DataFrame:
    folder = _folder(c)
    rows = c.blocks.selectExpr("number", "hash", "parent_hash", "timestamp", "gas_used", "transaction_count", "cast(size as long) size", "cast(base_fee_per_gas as long) base_fee_per_gas")
    for part in (2, 0, 1, 2):  # files out of order, a third of them twice
        rows.where(F.col("number") % 3 == part).coalesce(2).write.mode("append").parquet(f"{folder}/landing")
    ingest.ingest_blocks(c.spark, f"{folder}/landing", f"{folder}/out", f"{folder}/ckpt", confirmations=12, files_per_batch=3).awaitTermination()
    return ingest.history(c.spark, f"{folder}/out")


query("ingest_blocks", f"SELECT {BLOCK_SQL}, hash, parent_hash FROM f_b WHERE number <= (SELECT max(number) FROM f_b) - 12")(_ingested)


def _once(c: Chain) -> DataFrame:
    """Blocks of a stream in which each file comes twice, those of the same height one after the other."""
    folder = _folder(c)
    rows = c.blocks.selectExpr("number", "hash", "parent_hash", "timestamp", "gas_used", "transaction_count", "cast(size as long) size", "cast(base_fee_per_gas as long) base_fee_per_gas")
    for low, high in ((0, 0.5), (0, 0.5), (0.4, 1)):
        rows.where(F.col("number").between(int(low * c.head), int(high * c.head))).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    stream = c.spark.readStream.schema(schemas.BLOCK_LANDING).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landing")
    once = ingest.blocks_once(stream, "3650 days")
    once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return c.spark.read.parquet(f"{folder}/out").select("number", "hash")


query("blocks_once", "SELECT number, hash FROM f_b")(_once)


def _balances_streamed(c: Chain) -> DataFrame:
    folder = _folder(c)
    reads = c.history.withColumn("arrival", F.lit(1))
    for part in (1, 0):
        _land(reads.where(F.col("block_number") % 2 == part), f"{folder}/reads")
    stream = c.spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", _per_batch(c, f"{folder}/reads")).parquet(f"{folder}/reads")
    ingest.current_balances_stream(stream, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    return ingest.current_balances_of(c.spark, f"{folder}/ckpt").select("token_address", "address", "balance", "block_number")


query("current_balances_stream", "SELECT token_address, address, balance, block_number FROM balances")(_balances_streamed)


def _bundles(c: Chain) -> DataFrame:
    """Blocks with their transactions and number of transfers, renumbered without gaps."""
    tx = F.struct("from_address", "to_address", F.col("gas_price").cast("decimal(38,0)").alias("gas_price"), "status")
    txs = dense(c.txs, "block_number").groupBy(F.col("block_number").alias("number")).agg(F.collect_list(tx).alias("txs"))  # a block's own
    moved = dense(c.transfers, "block_number").groupBy(F.col("block_number").alias("number")).agg(F.count("*").alias("transfer_count"))
    heads = dense(c.blocks, "number").select("number", "timestamp", "gas_used", F.col("size").cast("long").alias("size"))
    return heads.join(txs, "number", "left").join(moved, "number", "left")


def _fold(c: Chain) -> DataFrame:
    """The days of a stream that began amid the chain: a block comes late, files come twice, then all that lay before."""
    folder, bundles = _folder(c), _bundles(c).persist()
    top = bundles.agg(F.max("number")).first()[0]
    low, hole = top // 3, top // 2  # of the table, so that all parts grow with it
    n = F.col("number")
    for part in ((n > low) & (n < hole), (n > hole + 1), n == hole, (n > hole) & (n < hole + 9), n <= low):
        bundles.where(part).coalesce(2).write.mode("append").parquet(f"{folder}/landing")
    stream = c.spark.readStream.schema(days.BUNDLE).option("maxFilesPerTrigger", 2).parquet(f"{folder}/landing")
    days.daily_fold_stream(stream, f"{folder}/out", f"{folder}/ckpt", start=low).awaitTermination()
    bundles.unpersist()
    return days.folded_days(c.spark, f"{folder}/out")


query(
    "daily_fold",
    f", even AS (SELECT {DENSE} AS number, timestamp, gas_used, size, day FROM days), {D_ALL.replace('FROM days b LEFT JOIN f_blocks p', 'FROM even b LEFT JOIN even p')} "
    "SELECT day, blocks, gas_used, size_sum, size_n, gap_sum, gap_n, tx_count, price_sum, success, failed, transfer_count, first_block, active_addresses FROM parts",
)(lambda c: _fold(c).drop("sketch"))


def _sketched(c: Chain) -> DataFrame:
    """Distinct addresses of each week, exact from the transactions, and whether the merged sketches of days come near."""
    week = F.date_trunc("week", "day").cast("date").cast("string").alias("week")
    exact = daily.sides(c.txs).select(week, "address").distinct().groupBy("week").agg(F.count("*").alias("active"))
    merged = days.active_estimate(daily.daily_sketches(c.txs).withColumn("week", week), "week")
    near = F.abs(F.col("estimate") - F.col("active")) <= F.ceil(F.col("active") * days.estimate_bound())
    return exact.join(merged, "week").select("week", "active", near.alias("near"))


query("active_sketches", f"SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week, count(DISTINCT a) AS active, count(DISTINCT a) > 0 AS near FROM (SELECT {TX_DAY} AS day, from_address AS a FROM f_tx UNION ALL SELECT {TX_DAY}, to_address FROM f_tx) WHERE a IS NOT NULL GROUP BY 1")(_sketched)


# --- history with index and postings ----------------------------------------------------------------------------------

_STORED: dict[tuple[str, str], str] = {}
#: Blocks of an append when history is written, and appends at most: what is exchanged at once is a share of the whole.
APPEND_BLOCKS, APPENDS = 100_000, 8


def _stored(c: Chain) -> versions.Snapshot:
    """The chain's tables as history, written once for a session and a folder of tables: older blocks, then newer ones.

    What is made of lines is dealt by ranges, as it will be written, while lines are numbers: not exchanged again as text.
    """
    key = c.spark.sparkContext.applicationId, c.sf_dir
    if key not in _STORED:
        folder = _folder(c)
        now = versions.current(c.spark, folder)
        transfers, frames = (fixtures.view(c.spark, c.sf_dir, n, deal=history.dealt_by(SPAN)) for n in ("f_transfers", "f_frames"))
        whole = {"blocks": c.blocks, "txs": c.txs, "logs": decode.transfer_logs(transfers), "transfers": transfers, "frames": frames}
        parts = max(2, min(APPENDS, c.head // APPEND_BLOCKS))
        for i in range(parts):
            low, high = c.head * i // parts, c.head * (i + 1) // parts  # the last one has the head
            within = lambda n: (n > low) & (n <= high) if i else n <= high  # noqa: B023, E731
            now = history.append(now, {n: df.where(within(F.col(history.TABLES[n][0]))) for n, df in whole.items()}, SPAN)
        _STORED[key] = folder
    return versions.current(c.spark, _STORED[key])


query("tx_lookup_stored", f"SELECT {TX_SQL}, CAST(NULL AS VARCHAR) AS created_contract FROM f_tx WHERE hash = '{TX}'")(
    lambda c: history.tx_lookup(_stored(c), c.contracts.where("false"), TX).select(*TX_COLUMNS, "created_contract")
)
query("logs_by_tx_stored", f"SELECT {LOG_SQL} FROM f_transfers WHERE tx_hash = '{TX}'")(lambda c: history.logs_by_tx(_stored(c), TX).select("tx_hash", "block_number", "log_index", "address"))
query("transfers_by_tx_stored", f"SELECT {MOVE_SQL} FROM f_transfers WHERE tx_hash = '{TX}'")(lambda c: history.transfers_by_tx(_stored(c), TX).select(MOVE_COLUMNS))
query("frames_by_tx_stored", f"SELECT {', '.join(FRAME_COLUMNS)} FROM f_frames WHERE tx_hash = '{TX}'")(lambda c: history.frames_by_tx(_stored(c), TX).select(FRAME_COLUMNS))
query(
    "txs_by_address_stored",
    f"""SELECT {TX_SQL} FROM f_tx t WHERE block_number < 340 AND (from_address = '{ADDRESS}' OR to_address = '{ADDRESS}' OR EXISTS (
        SELECT 1 FROM f_transfers m WHERE m.tx_hash = t.hash AND (m.from_address = '{ADDRESS}' OR m.to_address = '{ADDRESS}'))) ORDER BY block_number DESC, tx_index DESC LIMIT 25""",
)(lambda c: history.txs_by_address(_stored(c), ADDRESS, (340, 0), 25).select(TX_COLUMNS))
query("transfers_by_address_stored", f"SELECT {MOVE_SQL}, (SELECT count(*) FROM f_transfers WHERE from_address = '{ADDRESS}' OR to_address = '{ADDRESS}') AS total FROM f_transfers WHERE (from_address = '{ADDRESS}' OR to_address = '{ADDRESS}') ORDER BY block_number DESC, log_index DESC LIMIT 25")(
    lambda c: history.transfers_by_address(_stored(c), ADDRESS, None, 25).select(MOVE_COLUMNS).crossJoin(F.broadcast(history.postings_total(_stored(c), "transfer", ADDRESS)))
)
query("frames_by_address_stored", f"SELECT {', '.join(FRAME_COLUMNS)} FROM f_frames WHERE from_address = '{ADDRESS}' OR to_address = '{ADDRESS}' ORDER BY block_number DESC, tx_hash, trace_address LIMIT 25")(
    lambda c: history.frames_by_address(_stored(c), ADDRESS, 25).select(FRAME_COLUMNS)
)
query("append_unstored", "SELECT concat(hash, 'n') AS hash, block_number FROM f_tx WHERE block_number % 7 = 0 UNION ALL SELECT hash, block_number + (SELECT max(block_number) FROM f_tx) FROM f_tx WHERE block_number % 11 = 0")(
    lambda c: history.unstored(_stored(c), "txs", _offered(c), SPAN).select("hash", "block_number")
)


def _offered(c: Chain) -> DataFrame:
    """Stored transactions, others in the same blocks, and some beyond the head, twice each."""
    same = c.txs.where("block_number % 7 = 0")
    top = c.txs.agg(F.max("block_number").alias("top"))
    beyond = c.txs.where("block_number % 11 = 0").crossJoin(F.broadcast(top)).withColumn("block_number", F.col("block_number") + F.col("top")).drop("top")
    offered = c.txs.unionByName(same.withColumn("hash", F.concat("hash", F.lit("n")))).unionByName(beyond)
    return offered.unionByName(offered)


def _reverted(c: Chain) -> DataFrame:
    """Rows of each table after the newest half of the blocks is reverted, twice; and who is left in the feed of an address."""
    now = _stored(c)
    half = c.blocks.agg((F.max("number") / 2).cast("long")).first()[0]
    after = history.revert(history.revert(now, half, 10**9), half, 10**9)
    counts = [after.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("blocks", "txs", "transfers", "frames")]
    counts.append(history.postings_total(after, "transfer", ADDRESS).select(F.lit("feed").alias("name"), F.col("total").alias("n")))
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    _STORED.pop((c.spark.sparkContext.applicationId, c.sf_dir))  # the other queries write their own again
    return whole


HALF = "(SELECT max(number) // 2 FROM f_blocks)"
query("revert_stored", f"""SELECT 'blocks' AS name, count(*) AS n FROM f_blocks WHERE number < {HALF} UNION ALL SELECT 'txs', count(*) FROM f_tx WHERE block_number < {HALF} UNION ALL SELECT 'transfers', count(*) FROM f_transfers WHERE block_number < {HALF}
    UNION ALL SELECT 'frames', count(*) FROM f_frames WHERE block_number < {HALF} UNION ALL SELECT 'feed', count(*) FROM f_transfers WHERE block_number < {HALF} AND (from_address = '{ADDRESS}' OR to_address = '{ADDRESS}')""")(_reverted)


# --- a raw range in one pass -------------------------------------------------------------------------------------------


#: Blocks of a file of the dump.
DUMP_BLOCKS = 20_000


def bundles(c: Chain) -> DataFrame:
    """The chain as a dump: JSON lines of blocks with transactions, receipts with logs, and traces.

    Logs and frames come from one exchange of the lines, and are grouped within their blocks, by which the lines are dealt
    already, as transactions are; all joins are on the block: so nothing is exchanged again as text.
    """
    topics = F.array_compact(F.array("topic0", "topic1", "topic2", "topic3"))
    item = F.struct("address", topics.alias("topics"), "data", _hex("log_index").alias("logIndex"))
    rows = decode.transfer_logs(c.lines, "frame")
    at = lambda path: F.max(F.when(F.col("frame.trace_address") == path, _call("frame.")))
    rows = rows.groupBy("block_number", "tx_hash").agg(F.collect_list(item).alias("logs"), *(at(p).alias(n) for n, p in _PATHS.items()))  # a transaction's own
    none = F.array().cast(rows.schema["logs"].dataType)
    trace = F.struct(F.col("tx_hash").alias("txHash"), _tree().alias("result"), F.lit(None).cast("string").alias("error"))
    rows = rows.groupBy(F.col("block_number").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("tx_hash", "logs"))).alias("of"), F.collect_list(trace).alias("traces"))  # a block's own
    receipt = lambda t: F.struct(t["hash"].alias("transactionHash"), _hex(t["status"]).alias("status"), F.coalesce(F.try_element_at("of", t["hash"]), none).alias("logs"))
    whole = _heads(c).join(rows, "n", "left").withColumn("receipts", F.transform("states", receipt)).drop("n", "states", "of")
    return whole.select(F.to_json(F.struct("*")).alias("value"))


def write_bundles(c: Chain, folder: str) -> None:
    """bundles packed with gzip, in files of a bounded number of blocks, as each is read by one task."""
    bundles(c).write.option("maxRecordsPerFile", DUMP_BLOCKS).option("compression", "gzip").text(folder)


def _sums(c: Chain, *families: str) -> DataFrame:
    """The totals of a dump, of the families that a query reads; its lines are parsed by the tasks that make them, not landed first."""
    folder = _folder(c)
    backfill.write_totals(raw.bundle_rows(bundles(c)), f"{folder}/totals", SPAN, families)
    return c.spark.read.parquet(f"{folder}/totals")


#: Frames that the encoded traces hold below their roots, and address stats over them.
_BELOW = "('0', '0,0', '1', '1,0', '1,0,0')"
query("backfill_spans", f", {L_CHAIN} SELECT span_lo, sum(CASE WHEN name = 'blocks' THEN count END)::BIGINT AS blocks, sum(CASE WHEN name = 'txs' THEN count END)::BIGINT AS txs, sum(CASE WHEN name = 'transfers' THEN count END)::BIGINT AS transfers FROM l_chain GROUP BY span_lo")(
    lambda c: backfill.spans(_sums(c, "span"))
)
query("backfill_span_tokens", f", {L_TOKEN} SELECT span_lo, token_address, transfer_count, coalesce(CAST(supply AS VARCHAR), '') AS supply FROM l_token")(
    lambda c: backfill.span_tokens(_sums(c, "span_token")).withColumn("supply", u256.to_decimal(F.col("supply")))
)
query("backfill_addresses", f""", part AS (SELECT * FROM contrib WHERE internal = 0 UNION ALL SELECT from_address, tx_hash, block_number, 0, 1, 0, false FROM f_frames WHERE trace_address IN {_BELOW}
    UNION ALL SELECT to_address, tx_hash, block_number, 0, 1, 0, false FROM f_frames WHERE trace_address IN {_BELOW} AND to_address IS NOT NULL AND to_address <> from_address),
    lasting AS (SELECT to_address AS address, min(block_number) AS lo, max(block_number) AS hi FROM made WHERE output IS NOT NULL AND length(output) > 2 AND trace_address IN {_BELOW} GROUP BY 1),
    s AS (SELECT address, count(DISTINCT tx) AS tx_count, CAST(sum(internal) AS BIGINT) AS internal_tx_count, CAST(sum(moved) AS BIGINT) AS token_transfer_count, CAST(sum(sent) AS BIGINT) AS sent_count,
        min(block_number) AS first_seen, max(block_number) AS last_seen FROM part WHERE NOT is_contract GROUP BY address)
    SELECT s.*, lasting.address IS NOT NULL AS is_contract FROM s LEFT JOIN lasting USING (address)""")(lambda c: backfill.address_deltas(_sums(c, "address")))
query("backfill_tokens", "SELECT address, token_type, block_number, creation_tx FROM tokens")(lambda c: backfill.tokens_seen(_sums(c, "token")))
query("backfill_days", f", {D_ALL} SELECT CAST(day AS VARCHAR) AS day, blocks, gas_used, size_sum, size_n, gap_sum, gap_n, tx_count, price_sum, success, failed, transfer_count, first_block, active_addresses FROM parts")(
    lambda c: backfill.day_parts(_sums(c, *backfill.DAY_FAMILIES)).withColumn("day", F.col("day").cast("string"))
)
query("backfill_balance_keys", "SELECT token_address, a AS address, max(block_number) AS block_number FROM (SELECT token_address, from_address AS a, block_number FROM f_transfers UNION ALL SELECT token_address, to_address, block_number FROM f_transfers), zero WHERE a <> z GROUP BY 1, 2")(
    lambda c: backfill.balance_keys(_sums(c, "balance"))
)


def _refilled(c: Chain) -> DataFrame:
    """Days counted anew from a dump without receipts: what only receipts tell stays as it is stored."""
    dump = _raw_blocks(c)
    blocks, txs = decode.blocks_from_raw(dump), decode.txs_from_raw(dump)
    unknown = {k: F.lit(None).cast("long") for k in ("success", "failed", "transfer_count")}
    counted = daily.daily_blocks(blocks).join(daily.daily_txs(txs.withColumn("status", F.lit(None).cast("int"))).drop("success", "failed"), "day").withColumns(unknown)
    stored = c.daily.select("day", *unknown)
    return daily.daily_refill(counted, stored, tuple(unknown))


query("daily_refill_raw", f", {D_ALL} SELECT CAST(day AS VARCHAR) AS day, blocks, gas_used, size_sum, size_n, gap_sum, gap_n, tx_count, price_sum, success, failed, transfer_count, first_block FROM parts")(
    lambda c: _refilled(c).withColumn("day", F.col("day").cast("string"))
)


# --- the change feed as a stream ---------------------------------------------------------------------------------------


def feed_bundles(c: Chain) -> DataFrame:
    """Blocks with their transactions and transfers, as a follower of the head hands them on."""
    tx, move = F.struct("hash", "tx_index", "from_address", "to_address"), F.struct("token_address", "from_address", "to_address")
    txs = c.txs.groupBy(F.col("block_number").alias("number")).agg(F.collect_list(tx).alias("txs"))  # a block's own
    moves = c.transfers.groupBy(F.col("block_number").alias("number")).agg(F.collect_list(move).alias("transfers"))
    return c.blocks.select("number", "hash", "timestamp").join(txs, "number", "left").join(moves, "number", "left")


def _published(c: Chain) -> DataFrame:
    """Events of a stream whose files come twice, one after the other, and how many numbers were given."""
    folder, whole = _folder(c), feed_bundles(c).persist()
    for part in (1, 0, 1):
        _land(whole.where(F.col("number") % 2 == part), f"{folder}/landing")
    stream = c.spark.readStream.schema(feed.BUNDLE).option("maxFilesPerTrigger", _per_batch(c, f"{folder}/landing")).parquet(f"{folder}/landing")
    feed.change_feed_stream(stream, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    whole.unpersist()
    events = feed.events_from(c.spark, f"{folder}/out")
    numbers = events.agg(F.count_distinct("sequence").alias("numbers"), (F.max("sequence") + 1).alias("next"))
    per = events.groupBy("event", "block_number").agg(F.count("payload").alias("n"), (F.max("place") - F.min("place") + 1).alias("places"))
    return per.crossJoin(F.broadcast(numbers))


query("change_feed_stream", """, ev AS (SELECT 'new_block' AS event, number AS block_number FROM f_blocks UNION ALL SELECT 'new_transaction', block_number FROM f_tx
    UNION ALL SELECT 'address_activity', block_number FROM (SELECT DISTINCT block_number, a FROM (SELECT block_number, from_address AS a FROM f_tx UNION ALL SELECT block_number, to_address FROM f_tx
    UNION ALL SELECT block_number, from_address FROM f_transfers UNION ALL SELECT block_number, to_address FROM f_transfers) WHERE a IS NOT NULL))
    SELECT event, block_number, count(*) AS n, count(*) AS places, (SELECT count(*) FROM ev) AS numbers, (SELECT count(*) FROM ev) AS next FROM ev GROUP BY event, block_number""")(_published)
