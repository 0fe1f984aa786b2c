"""The registered chain queries and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chain as fn
from ..functions import u256
from ..operators import checks, daily, decode, feeds, gaps, ledger, reorg, retention, rollups
from ..sources import fixtures, raw
from .chain import CTES, FLOOR_GAP, SPAN, Chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Keys that all sizes of the tables hold.
ADDRESS = "0x" + "1".rjust(40, "0")
HOLDER = "0x" + "120".rjust(40, "0")
ADDRESS2 = "0x" + "2".rjust(40, "0")
UNKNOWN = "0x" + "f" * 40
TOKEN = "0x70c" + "7".rjust(37, "0")
NFT = "0x70c" + "5".rjust(37, "0")
TX = "0xtx" + "200".rjust(62, "0")
BLOCK = 201
AS_OF = 1704067200 + 300 * 600
DAY = "2024-01-02"


#: Queries with a date column, and its name; dates are compared as text, which both engines write alike.
DATED = {"tx_history_day": "bucket", "tx_history_week": "bucket"} | dict.fromkeys(
    "daily_blocks daily_txs daily_active daily_transfers daily_stats daily_cumulative day_spans address_day_asof address_day_asof_back "
    "daily_address_columns daily_recompute daily_refill cumulative_backwards day_spans_inferred stale_days late_days recount_days "
    "daily_parts_merge active_set_diff invalidate_days daily_fold".split(),
    "day",
)


def plain(df: DataFrame) -> DataFrame:
    """Amounts as longs, small integers too, and dates as text, so that a comparison of values doesn't hang on their type."""
    wide = (T.DecimalType, T.ShortType, T.IntegerType)
    df = df.select(*(F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name) for f in df.schema.fields))
    return df.select(*(F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, wide) and not getattr(f.dataType, "scale", 0) else F.col(f.name) for f in df.schema.fields))


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Chain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(f(Chain(spark, sf_dir)))
        if sql is not None:
            body = sql if sql.lstrip().startswith("--bare") else f"WITH {CTES}\n{sql}"
            day = DATED.get(name)
            ORACLE_SQL[name] = f"SELECT * REPLACE (CAST({day} AS VARCHAR) AS {day}) FROM ({body})" if day else body
        return f

    return register


TX_COLUMNS = ["hash", "block_number", "tx_index", "from_address", "to_address", "value", "status"]
TX_SQL = "hash, block_number, CAST(tx_index AS BIGINT) AS tx_index, from_address, to_address, CAST(value AS BIGINT) AS value, CAST(status AS BIGINT) AS status"
MOVE_COLUMNS = ["tx_hash", "log_index", "block_number", "token_address", "from_address", "to_address", "value", "token_type", "token_id"]
MOVE_SQL = "tx_hash, CAST(log_index AS BIGINT) AS log_index, block_number, token_address, from_address, to_address, CAST(value AS BIGINT) AS value, token_type, token_id"
FRAME_COLUMNS = ["tx_hash", "block_number", "trace_address", "from_address", "to_address", "call_type", "error"]
STAT_SQL = "address, tx_count, internal_tx_count, token_transfer_count, sent_count, first_seen, last_seen, is_contract"
BLOCK_SQL = "number, timestamp, gas_used, CAST(transaction_count AS BIGINT) AS transaction_count, CAST(size AS BIGINT) AS size, CAST(base_fee_per_gas AS BIGINT) AS base_fee_per_gas"
BLOCK_COLUMNS = ["number", "timestamp", "gas_used", "transaction_count", "size", "base_fee_per_gas"]

# --- lookups and feeds ---------------------------------------------------------------------------------------------

query("block_lookup", f"SELECT {BLOCK_SQL} FROM f_blocks WHERE number = {BLOCK}")(lambda c: feeds.block_lookup(c.blocks, number=BLOCK).select(BLOCK_COLUMNS))
query("block_lookup_hash", f"SELECT {BLOCK_SQL} FROM f_b WHERE hash = concat('0xb', lpad('{BLOCK}', 63, '0'))")(
    lambda c: feeds.block_lookup(c.blocks, hash="0xb" + str(BLOCK).rjust(63, "0")).select(BLOCK_COLUMNS)
)
query("block_feed", f"SELECT {BLOCK_SQL} FROM f_blocks WHERE number < 300 ORDER BY number DESC LIMIT 25")(lambda c: feeds.block_feed(c.blocks, 300, 25).select(BLOCK_COLUMNS))
query("latest_block", "SELECT max(number) AS number FROM f_blocks WHERE number <= 291")(lambda c: feeds.latest_block(c.blocks, 291))
query(
    "block_tx_counts",
    "SELECT n AS number, (SELECT count(*) FROM f_tx WHERE block_number = n) AS tx_count FROM (VALUES (5), (97), (200), (999999)) v(n)",
)(lambda c: feeds.block_tx_counts(c.txs, c.rows("number long", (5,), (97,), (200,), (999999,), (5,))))
query(
    "tx_lookup",
    f"SELECT {TX_SQL}, c.address AS created_contract FROM (SELECT hash AS h, * FROM f_tx) t LEFT JOIN contracts c ON c.creation_tx = t.h AND t.to_address IS NULL".replace("hash, block_number", "t.h AS hash, t.block_number").replace("from_address, to_address", "t.from_address, t.to_address"),
)(lambda c: feeds.tx_lookup(c.txs, c.contracts).select(*TX_COLUMNS, "created_contract"))
query("tx_feed", f"SELECT {TX_SQL}, CAST(categories AS BIGINT) AS categories FROM cats WHERE (block_number, tx_index) < (300, 2) AND tx_type <> 126 ORDER BY block_number DESC, tx_index DESC LIMIT 50")(
    lambda c: feeds.tx_feed(c.categorised, (300, 2), 50, hidden=(126,)).select(*TX_COLUMNS, "categories")
)
query("tx_page", f"SELECT {TX_SQL}, (SELECT count(*) FROM f_tx) AS total FROM f_tx ORDER BY block_number DESC, tx_index DESC LIMIT 25 OFFSET 50")(
    lambda c: feeds.tx_page(c.txs, None, 3, 25).select(*TX_COLUMNS, "total")
)
query("txs_by_block", f"SELECT {TX_SQL} FROM f_tx WHERE block_number = {BLOCK}")(
    lambda c: feeds.txs_by_block(c.txs, c.blocks, hash="0xb" + str(BLOCK).rjust(63, "0")).select(TX_COLUMNS)
)
query(
    "txs_by_address",
    f"""SELECT {TX_SQL} FROM f_tx t WHERE block_number < 340 AND (from_address = '{ADDRESS}' OR to_address = '{ADDRESS}' OR EXISTS (
        SELECT 1 FROM f_transfers m WHERE m.tx_hash = t.hash AND (m.from_address = '{ADDRESS}' OR m.to_address = '{ADDRESS}'))) ORDER BY block_number DESC, tx_index DESC LIMIT 25""",
)(lambda c: feeds.txs_by_address(c.txs, c.transfers, ADDRESS, (340, 0), 25).select(TX_COLUMNS))
query("txs_by_direction", f"SELECT {TX_SQL} FROM f_tx WHERE to_address = '{ADDRESS}' ORDER BY block_number DESC, tx_index DESC LIMIT 25")(
    lambda c: feeds.txs_by_direction(c.txs, ADDRESS, "TO", None, 25).select(TX_COLUMNS)
)
query("tx_filter", f"SELECT {TX_SQL} FROM cats WHERE (categories & 6) <> 0 AND status = 1 AND block_number >= 50 AND block_number < 250 AND block_timestamp >= {AS_OF - 120000}")(
    lambda c: feeds.tx_filter(c.categorised, ("contract_creation", "contract_call"), 1, (50, 250), (AS_OF - 120000, None)).select(TX_COLUMNS)
)
query("address_tx_counts", f"SELECT a AS address, coalesce((SELECT tx_count FROM stats s WHERE s.address = a), 0) AS tx_count FROM (VALUES ('{ADDRESS}'), ('{ADDRESS2}'), ('{UNKNOWN}')) v(a)")(
    lambda c: feeds.address_tx_counts(c.stats_of(c.rows("address string", (ADDRESS,), (ADDRESS2,), (UNKNOWN,))), c.rows("address string", (ADDRESS,), (ADDRESS2,), (UNKNOWN.upper().replace("0X", "0x"),)))
)
LOG_SQL = "tx_hash, block_number, CAST(log_index AS BIGINT) AS log_index, token_address AS address"
query("logs_by_tx", f"SELECT {LOG_SQL} FROM f_transfers WHERE tx_hash = '{TX}'")(lambda c: feeds.logs_by_tx(c.logs, c.txs, TX).select("tx_hash", "block_number", "log_index", "address"))
query("logs_by_address", f"SELECT {LOG_SQL}, (SELECT count(*) FROM f_transfers WHERE token_address = '{TOKEN}') AS total FROM f_transfers WHERE token_address = '{TOKEN}' ORDER BY block_number DESC, log_index DESC LIMIT 20")(
    lambda c: feeds.logs_filter(c.logs, address=TOKEN, n=20).select("tx_hash", "block_number", "log_index", "address", "total")
)
query("logs_by_topic", f"SELECT {LOG_SQL}, (SELECT count(*) FROM f_transfers) AS total FROM f_transfers ORDER BY block_number DESC, log_index DESC LIMIT 20")(
    lambda c: feeds.logs_filter(c.logs, topic0=fn.TRANSFER_TOPIC, n=20).select("tx_hash", "block_number", "log_index", "address", "total")
)
query("logs_filter", f"SELECT {LOG_SQL}, (SELECT count(*) FROM f_transfers WHERE token_address = '{TOKEN}' AND block_number BETWEEN 10 AND 300) AS total FROM f_transfers WHERE token_address = '{TOKEN}' AND block_number BETWEEN 10 AND 300 ORDER BY block_number DESC, log_index DESC LIMIT 20")(
    lambda c: feeds.logs_filter(c.logs, TOKEN, fn.TRANSFER_TOPIC, 10, 300, 20).select("tx_hash", "block_number", "log_index", "address", "total")
)
query("transfers_by_tx", f"SELECT {MOVE_SQL} FROM f_transfers WHERE tx_hash = '{TX}'")(lambda c: feeds.transfers_by_tx(c.transfers, TX).select(MOVE_COLUMNS))
query("transfers_by_address", f"SELECT {MOVE_SQL}, (SELECT count(*) FROM f_transfers WHERE from_address = '{ADDRESS}' OR to_address = '{ADDRESS}') AS total FROM f_transfers WHERE (from_address = '{ADDRESS}' OR to_address = '{ADDRESS}') AND (block_number, log_index) < (350, 5) ORDER BY block_number DESC, log_index DESC LIMIT 25")(
    lambda c: feeds.transfers_by_address(c.transfers, ADDRESS, (350, 5), 25).select(*MOVE_COLUMNS, "total")
)
query("transfers_by_token", f"SELECT {MOVE_SQL}, (SELECT count(*) FROM f_transfers WHERE token_address = '{TOKEN}') AS total FROM f_transfers WHERE token_address = '{TOKEN}' ORDER BY block_number DESC, log_index DESC LIMIT 10 OFFSET 10")(
    lambda c: feeds.transfers_by_token(c.transfers, c.tokens, TOKEN, 10, 2).select(*MOVE_COLUMNS, "total")
)
query("transfer_feed", f"SELECT {MOVE_SQL}, (SELECT count(*) FROM f_transfers WHERE token_type = 'ERC721') AS total FROM f_transfers WHERE token_type = 'ERC721' ORDER BY block_number DESC, log_index DESC LIMIT 25")(
    lambda c: feeds.transfer_feed(c.transfers, "ERC721", 1, 25).select(*MOVE_COLUMNS, "total")
)
TOKEN_COLUMNS = ["address", "token_type", "symbol", "name", "holder_count", "transfer_count", "supply"]
query("token_lookup", f"SELECT {', '.join(TOKEN_COLUMNS)} FROM tokens WHERE address = '{TOKEN}'")(lambda c: feeds.token_lookup(c.tokens, TOKEN).select(TOKEN_COLUMNS))
query("token_browse", f"SELECT {', '.join(TOKEN_COLUMNS)}, (SELECT count(*) FROM tokens WHERE token_type = 'ERC20' AND contains(lower(symbol), 'k1')) AS total FROM tokens WHERE token_type = 'ERC20' AND contains(lower(symbol), 'k1') ORDER BY holder_count DESC, address LIMIT 5")(
    lambda c: feeds.token_browse(c.tokens, "ERC20", "K1", 1, 5).select(*TOKEN_COLUMNS, "total")
)
query("token_holders", f"""SELECT address, balance, CAST((balance * 2000000 + h) // (h * 2) AS DOUBLE) / 10000 AS percentage,
    EXISTS (SELECT 1 FROM contracts c WHERE c.address = b.address) AS is_contract, (SELECT count(*) FROM balances WHERE token_address = '{TOKEN}' AND balance > 0) AS total
    FROM balances b, (SELECT CAST(sum(balance) AS BIGINT) AS h FROM balances WHERE token_address = '{TOKEN}' AND balance > 0) WHERE token_address = '{TOKEN}' AND balance > 0 ORDER BY balance DESC, address LIMIT 50""")(
    lambda c: feeds.token_holders(c.balances, c.contracts, TOKEN, 50).withColumn("percentage", F.col("percentage").cast("double"))
)
query("token_holders_wide", f"""SELECT address, concat(CAST(balance AS VARCHAR), repeat('0', 20)) AS balance, CAST((balance * 2000000 + h) // (h * 2) AS DOUBLE) / 10000 AS percentage
    FROM balances b, (SELECT CAST(sum(balance) AS BIGINT) AS h FROM balances WHERE token_address = '{TOKEN}' AND balance > 0) WHERE token_address = '{TOKEN}' AND balance > 0 ORDER BY b.balance DESC, address LIMIT 50""")(
    lambda c: _shown(feeds.token_holders(rollups.balances_from_transfers(_widened(c, 20)), c.contracts, TOKEN, 50), "balance").select("address", "balance", F.col("percentage").cast("double").alias("percentage"))
)
query("nft_inventory", f"SELECT token_address, token_id, owner, block_number, (SELECT count(*) FROM nfts, zero WHERE token_address = '{NFT}' AND owner <> z) AS total FROM nfts, zero WHERE token_address = '{NFT}' AND owner <> z ORDER BY token_id LIMIT 25")(
    lambda c: feeds.nft_inventory(c.nfts, NFT, None, 25)
)
query("holder_balances", f"SELECT token_address, address, balance, block_number FROM balances WHERE address = '{HOLDER}' AND balance > 0")(lambda c: feeds.holder_balances(c.balances, HOLDER))
query("balance_history", f"SELECT token_address, address, block_number, balance FROM history WHERE address = '{ADDRESS}' AND token_address = '{TOKEN}' ORDER BY block_number DESC LIMIT 20")(
    lambda c: feeds.balance_history(c.history, ADDRESS, TOKEN, 20)
)
query("batch_balances", f"SELECT a AS address, coalesce((SELECT string_agg(concat(token_address, ':', CAST(balance AS VARCHAR)), ',' ORDER BY token_address) FROM balances WHERE address = a AND balance > 0), '') AS balances FROM (VALUES ('{ADDRESS}'), ('{ADDRESS2}'), ('{UNKNOWN}')) v(a)")(
    lambda c: feeds.batch_balances(c.balances, c.rows("address string", (ADDRESS,), (ADDRESS2,), (UNKNOWN,))).select(
        "address", F.array_join(F.transform("balances", lambda x: F.concat_ws(":", x["token_address"], x["balance"])), ",").alias("balances")
    )
)
query("address_lookup", f"SELECT a AS address, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('tx_count', 'internal_tx_count', 'token_transfer_count', 'sent_count', 'first_seen', 'last_seen'))}, coalesce(is_contract, false) AS is_contract FROM (VALUES ('{ADDRESS}'), ('{UNKNOWN}')) v(a) LEFT JOIN stats s ON s.address = a")(
    lambda c: feeds.address_lookup(c.stats_of(c.rows("address string", (ADDRESS,), (UNKNOWN,))), c.rows("address string", (ADDRESS,), (UNKNOWN,)))
)
query("address_browse", f"SELECT {STAT_SQL}, (SELECT count(*) FROM stats) AS total FROM stats ORDER BY tx_count DESC, address LIMIT 20 OFFSET 20")(lambda c: feeds.address_browse(c.stored(c.stats), 2, 20))
query("contract_lookup", "SELECT * FROM contracts WHERE address = (SELECT min(address) FROM contracts)")(
    lambda c: c.contracts.join(c.contracts.agg(F.min("address").alias("address")), "address", "left_semi")
)
query("existing_contracts", f"SELECT a AS address FROM (SELECT DISTINCT to_address AS a FROM f_tx WHERE to_address IS NOT NULL) WHERE a IN (SELECT address FROM contracts)")(
    lambda c: feeds.existing_contracts(c.contracts, c.txs.where("to_address is not null").select(F.col("to_address").alias("address")))
)
query("verified_contracts", "SELECT address, block_number, (SELECT count(*) FROM contracts WHERE block_number % 3 = 0) AS total FROM contracts WHERE block_number % 3 = 0 ORDER BY block_number DESC, address LIMIT 10")(
    lambda c: feeds.verified_contracts(c.contracts.withColumns({"verified": F.col("block_number") % 3 == 0, "verified_at": F.col("block_number")}), 1, 10).select("address", "block_number", "total")
)
query("frames_by_tx", f"SELECT {', '.join(FRAME_COLUMNS)} FROM f_frames WHERE tx_hash = '{TX}'")(lambda c: feeds.frames_by_tx(c.frames, TX).select(FRAME_COLUMNS))
query("frames_by_block", f"SELECT {', '.join(FRAME_COLUMNS)} FROM f_frames WHERE block_number = {BLOCK}")(lambda c: feeds.frames_by_block(c.frames, BLOCK).select(FRAME_COLUMNS))
query("frames_by_address", f"SELECT {', '.join(FRAME_COLUMNS)}, (SELECT count(*) FROM f_frames WHERE from_address = '{ADDRESS}' OR to_address = '{ADDRESS}') AS total FROM f_frames WHERE from_address = '{ADDRESS}' OR to_address = '{ADDRESS}' ORDER BY block_number DESC, tx_hash, trace_address LIMIT 25")(
    lambda c: feeds.frames_by_address(c.frames, ADDRESS, 25).select(*FRAME_COLUMNS, "total")
)
query("search_block", "SELECT 'block' AS kind, CAST(number AS VARCHAR) AS value, concat('Block ', CAST(number AS VARCHAR)) AS label FROM f_blocks WHERE starts_with(CAST(number AS VARCHAR), '12') ORDER BY number LIMIT 5")(
    lambda c: feeds.search(c.blocks, c.txs, c.stats, c.tokens, "12", 5)
)
query("search_hex", """(SELECT 'transaction' AS kind, hash AS value, concat(left(hash, 10), '...', right(hash, 6)) AS label FROM f_tx WHERE starts_with(hash, '0x00000') ORDER BY hash LIMIT 5)
    UNION ALL (SELECT 'address', address, concat(left(address, 10), '...', right(address, 6)) FROM stats WHERE starts_with(address, '0x00000') ORDER BY address LIMIT 5)""")(
    lambda c: feeds.search(c.blocks, c.txs, c.stats, c.tokens, "0x00000", 5)
)
query("search", """(SELECT 'address' AS kind, address AS value, concat(left(address, 10), '...', right(address, 6)) AS label FROM stats WHERE starts_with(address, '0x') ORDER BY address LIMIT 3)
    UNION ALL (SELECT 'transaction', hash, concat(left(hash, 10), '...', right(hash, 6)) FROM f_tx WHERE starts_with(hash, '0x') ORDER BY hash LIMIT 3)""")(
    lambda c: feeds.search(c.blocks, c.txs, c.stats, c.tokens, "0x", 3)
)
query("search_text", "SELECT 'token' AS kind, address AS value, concat(symbol, ' (', name, ')') AS label FROM tokens WHERE starts_with(lower(symbol), 'tk1') OR contains(lower(name), 'tk1') ORDER BY holder_count DESC, address LIMIT 5")(
    lambda c: feeds.search(c.blocks, c.txs, c.stats, c.tokens, "TK1", 5)
)
DEPOSIT_SQL = "SELECT hash AS l2_tx_hash, concat('0xd', substr(hash, 5)) AS l1_tx_hash, block_number AS l1_block, from_address AS origin FROM f_tx WHERE tx_type = 126"


def _deposits(c: Chain) -> DataFrame:
    return c.txs.where("tx_type = 126").select(
        F.col("hash").alias("l2_tx_hash"), F.concat(F.lit("0xd"), F.expr("substr(hash, 5)")).alias("l1_tx_hash"), F.col("block_number").alias("l1_block"), F.col("from_address").alias("origin")
    )


query("deposit_lookup", f"SELECT * FROM ({DEPOSIT_SQL}) WHERE l2_tx_hash = '{TX}'")(lambda c: feeds.deposit_lookup(_deposits(c), l2_hash=TX))
query("deposit_list", f"SELECT * FROM ({DEPOSIT_SQL}) WHERE l1_block >= 20 AND l1_block < 330 ORDER BY l1_block DESC, l2_tx_hash DESC LIMIT 20")(lambda c: feeds.deposit_list(_deposits(c), None, (20, 330), None, 20))
query("sync_status", "SELECT (SELECT max(number) FROM f_blocks) AS indexed_head, (SELECT count(*) FROM (SELECT number, lead(number) OVER (ORDER BY number) AS nx FROM f_blocks) WHERE nx > number + 1) AS gaps, true AS is_syncing")(
    lambda c: feeds.sync_status(c.blocks, gaps.missing_ranges(c.blocks), 10**9)
)
query("feed_page", f"SELECT number, timestamp, true AS has_more FROM f_blocks ORDER BY number DESC LIMIT 10")(
    lambda c: feeds.feed_page(c.blocks, [F.desc("number")], ["number"], 10).select("number", "timestamp", "has_more")
)

# --- projections and decoding --------------------------------------------------------------------------------------

query("tx_categories", "SELECT hash, CAST(categories AS BIGINT) AS categories FROM cats")(lambda c: c.categorised.select("hash", "categories"))
query("tx_category_labels", """SELECT hash, CASE WHEN tx_type = 126 THEN 'system_transaction' ELSE concat_ws(',', CASE WHEN categories & 1 <> 0 THEN 'coin_transfer' END, CASE WHEN categories & 2 <> 0 THEN 'contract_creation' END,
    CASE WHEN categories & 4 <> 0 THEN 'contract_call' END, CASE WHEN categories & 8 <> 0 THEN 'token_transfer' END) END AS labels FROM cats""".replace("categories & ", "CAST(categories AS BIGINT) & "))(
    lambda c: c.categorised.select("hash", F.array_join(fn.category_labels(F.col("tx_type"), F.col("categories")), ",").alias("labels"))
)
query("method_id", "SELECT hash, CASE WHEN length(input_data) >= 10 THEN left(input_data, 10) END AS method_id FROM f_tx")(lambda c: c.txs.select("hash", fn.method_id(F.col("input_data")).alias("method_id")))
query("transfer_decode", "SELECT tx_hash, block_number, CAST(log_index AS BIGINT) AS log_index, token_address, from_address, to_address, CAST(CAST(value AS BIGINT) AS VARCHAR) AS value, CASE WHEN token_type = 'ERC721' THEN CAST(token_id AS VARCHAR) ELSE '' END AS token_id, token_type FROM f_transfers")(
    lambda c: _decoded(decode.transfer_decode(c.logs))
)


def _decoded(df: DataFrame) -> DataFrame:
    return df.withColumns({"value": u256.to_decimal(F.col("value")), "token_id": u256.to_decimal(F.col("token_id"))}).drop("transfer_type")


query("receipt_attach", "SELECT hash, gas_used AS gas_used, CASE WHEN tx_type = 126 THEN 1 ELSE CAST(status AS BIGINT) END AS status, CASE WHEN tx_type <> 126 AND status = 0 THEN 'transaction failed' END AS error FROM (SELECT hash, tx_type, status, CASE WHEN tx_type = 126 OR block_number % 7 = 0 THEN 30000 ELSE gas_used END AS gas_used FROM (SELECT hash, tx_type, block_number, gas_used, CASE WHEN block_number % 7 = 0 THEN 1 ELSE status END AS status FROM f_tx))")(
    lambda c: decode.receipt_attach(
        c.txs.select("hash", "tx_type", F.lit(30000).cast("long").alias("gas_limit")), c.txs.where("block_number % 7 <> 0").select("hash", "gas_used", "status"), (126,)
    ).select("hash", "gas_used", "status", "error")
)
query("receipt_incomplete", "SELECT block_number, count(*) AS missing FROM f_tx WHERE CAST(substr(hash, 5) AS BIGINT) % 11 = 0 GROUP BY block_number")(
    lambda c: decode.receipt_incomplete(c.txs, c.txs.where("cast(substr(hash, 5) as bigint) % 11 <> 0"))
)
query("logs_as_receipts", "SELECT tx_hash, 1 AS status, string_agg(CAST(log_index AS VARCHAR), ',' ORDER BY log_index) AS logs FROM f_transfers GROUP BY tx_hash")(
    lambda c: decode.logs_as_receipts(c.logs).select("tx_hash", "status", F.array_join(F.col("logs.log_index").cast("array<string>"), ",").alias("logs"))
)
query("append_new", "SELECT hash, block_number FROM f_tx WHERE block_number >= 100")(
    lambda c: decode.append_new(c.txs.unionByName(c.txs), c.txs.where("block_number < 100"), ["hash"]).select("hash", "block_number")
)
query("log_key_conflicts", "SELECT block_number, CAST(log_index AS BIGINT) AS log_index, concat(tx_hash, 'x') AS tx_hash, tx_hash AS stored_tx FROM f_transfers WHERE log_index = 3")(
    lambda c: decode.log_key_conflicts(c.logs.withColumn("tx_hash", F.when(F.col("log_index") == 3, F.concat("tx_hash", F.lit("x"))).otherwise(F.col("tx_hash"))), c.logs)
)
query("block_conflicts", "SELECT number, concat(hash, 'x') AS hash, hash AS stored_hash FROM f_b WHERE number % 50 = 0")(
    lambda c: decode.block_conflicts(c.blocks.withColumn("hash", F.when(F.col("number") % 50 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash"))), c.blocks)
)
query("lowercase_addresses", "SELECT token_address, address, balance FROM balances")(
    lambda c: decode.lowercase_addresses(
        c.balances.unionByName(c.balances.withColumns({"address": F.upper("address"), "balance": F.lit(-1).cast("decimal(38,0)"), "block_number": F.lit(-1).cast("long")})),
        ["token_address", "address"], ["token_address", "address"], [F.desc("block_number")],
    ).select("token_address", "address", "balance")
)
query("internal_creations", "SELECT tx_hash, trace_address, to_address, call_type FROM made")(lambda c: decode.internal_creations(c.frames).select("tx_hash", "trace_address", "to_address", "call_type"))
query("contracts_from_frames", "SELECT * FROM contracts")(lambda c: c.contracts)
query("contracts_from_receipts", "SELECT concat('0xc', substr(hash, 5, 39)) AS address, '6001' AS bytecode, lpad('6001', 64, '0') AS bytecode_hash, from_address AS creator, hash AS creation_tx, block_number FROM f_tx WHERE to_address IS NULL AND status <> 0")(
    lambda c: decode.contracts_from_receipts(
        c.txs, c.txs.select("hash", "status", F.expr("concat('0xC', substr(hash, 5, 39))").alias("contract_address")), c.txs.select(F.expr("concat('0xc', substr(hash, 5, 39))").alias("address"), F.lit("0x6001").alias("code")).distinct()
    )
)
query("creations_report", "SELECT coalesce(l.a, f.address) AS address, CASE WHEN l.a IS NULL THEN 'found but not listed' WHEN f.address IS NULL THEN 'listed but not created' ELSE 'written' END AS status FROM (SELECT DISTINCT to_address AS a FROM f_frames WHERE call_type = 'create' AND to_address IS NOT NULL) l FULL JOIN contracts f ON f.address = l.a")(
    lambda c: decode.creations_report(c.frames.where("call_type = 'create' and to_address is not null").select(F.col("to_address").alias("address")), c.contracts)
)
query("token_discovery", f"SELECT address, token_type, CAST(decimals AS BIGINT) AS decimals, block_number, creation_tx FROM tokens WHERE address <> '{TOKEN}'")(
    lambda c: decode.token_discovery(c.transfers, c.rows("address string", (TOKEN,)))
)
query("token_merge", f"SELECT address, CASE WHEN address = '{TOKEN}' THEN 'ERC721' ELSE token_type END AS token_type, CASE WHEN address = '{TOKEN}' THEN 'NEW' ELSE symbol END AS symbol, name, CASE WHEN address = '{TOKEN}' THEN 0 ELSE block_number END AS block_number, CASE WHEN address = '{TOKEN}' THEN '0xnew' ELSE creation_tx END AS creation_tx FROM tokens")(
    lambda c: decode.token_merge(
        c.tokens.select("address", "token_type", "symbol", "name", "decimals", "block_number", "creation_tx"),
        c.rows("address string, token_type string, symbol string, name string, decimals int, block_number long, creation_tx string", (TOKEN, "ERC721", "NEW", None, None, 0, "0xnew"), (NFT, "ERC20", None, None, None, 10**9, "0xlate")),
    ).drop("decimals")
)
query("address_view", "SELECT address, tx_count, sent_count, greatest(tx_count - sent_count, 0) AS received_count, is_contract, a.timestamp AS first_at, z.timestamp AS last_at FROM stats JOIN f_blocks a ON a.number = first_seen JOIN f_blocks z ON z.number = last_seen")(
    lambda c: decode.address_view(c.stats, c.blocks).withColumns({"first_at": F.unix_seconds("first_seen_at"), "last_at": F.unix_seconds("last_seen_at")}).drop("first_seen_at", "last_seen_at")
)
query("log_view", "SELECT tx_hash, block_number, CAST(log_index AS BIGINT) AS log_index, CASE WHEN token_type = 'ERC721' THEN 4 ELSE 3 END AS topics, timestamp AS at FROM f_transfers")(
    lambda c: decode.log_view(c.logs).select("tx_hash", "block_number", "log_index", F.size("topics").alias("topics"), F.unix_seconds("at").alias("at"))
)
query("retention_classify", "SELECT n AS number, CASE WHEN n < 50 THEN 'pruned' WHEN n IN (SELECT number FROM f_blocks) THEN 'live' ELSE 'not found' END AS state FROM (VALUES (10), (60), (97), (999999)) v(n)")(
    lambda c: retention.retention_classify(c.rows("number long", (10,), (60,), (97,), (999999,)), c.blocks, 50)
)
query("bucketed_history", f"SELECT CAST(floor(block_number / {SPAN}.0) * {SPAN} AS BIGINT) AS block_bucket, count(*) AS n FROM f_tx GROUP BY 1")(
    lambda c: raw.bucketed_history(c.txs, "block_number", SPAN).groupBy("block_bucket").agg(F.count("*").alias("n"))
)
query("change_feed", """SELECT event, block_number, count(*) AS n FROM (SELECT 'new_block' AS event, number AS block_number FROM f_blocks UNION ALL SELECT 'new_transaction', block_number FROM f_tx
    UNION ALL SELECT 'address_activity', block_number FROM (SELECT DISTINCT block_number, a FROM (SELECT block_number, from_address AS a FROM f_tx UNION ALL SELECT block_number, to_address FROM f_tx
    UNION ALL SELECT block_number, from_address FROM f_transfers UNION ALL SELECT block_number, to_address FROM f_transfers) WHERE a IS NOT NULL)) GROUP BY event, block_number""")(
    lambda c: raw.change_feed(c.blocks, c.txs, c.transfers).groupBy("event", "block_number").agg(F.count("payload").alias("n"))
)

# --- totals --------------------------------------------------------------------------------------------------------

query("chain_counters", "SELECT 'blocks' AS name, count(*) AS count FROM f_blocks UNION ALL SELECT 'txs', count(*) FROM f_tx UNION ALL SELECT 'transfers', count(*) FROM f_transfers UNION ALL SELECT 'addresses', count(*) FROM stats UNION ALL SELECT 'tokens', count(*) FROM totals")(
    lambda c: c.counters
)
query("token_totals", "SELECT * FROM totals")(lambda c: c.token_totals)


def _widened(c: Chain, zeros: int) -> DataFrame:
    """The transfers with 256-bit amounts: as many zeros more than the fixture's."""
    return c.transfers.withColumn("value", u256.from_decimal(F.concat(F.col("value").cast("string"), F.lit("0" * zeros))))


def _shown(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, u256.to_decimal(F.col(column)))


def _wide_sql(column: str, zeros: int) -> str:
    """Digits of an amount with so many zeros more; of those that need more than 78 digits, 78 nines."""
    most = 10 ** (78 - zeros)
    return f"""CASE WHEN {column} IS NULL THEN '' WHEN {column} = 0 THEN '0' WHEN abs({column}) >= {most} THEN concat(CASE WHEN {column} < 0 THEN '-' ELSE '' END, repeat('9', 78))
        ELSE concat(CAST({column} AS VARCHAR), repeat('0', {zeros})) END AS {column}"""


query("token_totals_wide", f"SELECT token_address, transfer_count, {_wide_sql('supply', 60)} FROM totals")(lambda c: _shown(rollups.token_totals(_widened(c, 60)), "supply"))
query("token_totals_saturated", f"SELECT token_address, transfer_count, {_wide_sql('supply', 72)} FROM totals")(lambda c: _shown(rollups.token_totals(_widened(c, 72)), "supply"))
query("token_totals_decoded", "SELECT token_address, transfer_count, coalesce(CAST(supply AS VARCHAR), '') AS supply FROM totals")(
    lambda c: _shown(rollups.token_totals(decode.transfer_decode(c.logs)), "supply")
)
query("balances_wide", f"SELECT token_address, address, {_wide_sql('balance', 60)}, block_number FROM balances")(lambda c: _shown(rollups.balances_from_transfers(_widened(c, 60)), "balance"))
query("balance_history_wide", f"SELECT token_address, address, block_number, {_wide_sql('balance', 60)} FROM history")(
    lambda c: _shown(rollups.balances_from_transfers(_widened(c, 60), history=True), "balance")
)
query("holder_count_wide", "SELECT address, holder_count FROM tokens")(lambda c: rollups.holder_count(c.token_totals.select(F.col("token_address").alias("address")), rollups.balances_from_transfers(_widened(c, 60))))
query("address_contributions", "SELECT address, count(*) AS n, count(tx) AS with_tx, CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(internal) AS BIGINT) AS internal, CAST(sum(moved) AS BIGINT) AS moved FROM contrib GROUP BY address")(
    lambda c: c.contributions.groupBy("address").agg(F.count("*").alias("n"), F.count("tx").alias("with_tx"), *(F.sum(x).alias(x) for x in ("sent", "internal", "moved")))
)
query("address_stats", f"SELECT {STAT_SQL} FROM stats")(lambda c: c.stats)
query("address_stats_merge", "SELECT address, tx_count * 2 AS tx_count, internal_tx_count * 2 AS internal_tx_count, token_transfer_count * 2 AS token_transfer_count, sent_count * 2 AS sent_count, first_seen, last_seen, is_contract FROM stats")(
    lambda c: rollups.address_stats_merge(c.stats, c.stats)
)
query("span_address_totals", f"SELECT CAST(floor(block_number / {SPAN}.0) * {SPAN} AS BIGINT) AS span_lo, address, count(DISTINCT tx) AS tx_count, CAST(sum(moved) AS BIGINT) AS token_transfer_count FROM contrib GROUP BY 1, 2")(
    lambda c: c.span_addresses.select("span_lo", "address", "tx_count", "token_transfer_count")
)
query("holder_count", "SELECT address, holder_count FROM tokens")(lambda c: c.tokens.select("address", "holder_count"))
query("holder_delta", "SELECT token_address, CAST(sum(CASE WHEN balance > 0 THEN 1 ELSE 0 END - CASE WHEN b > 0 THEN 1 ELSE 0 END) AS BIGINT) AS delta FROM (SELECT n.token_address, n.balance, coalesce((SELECT arg_max(h.balance, h.block_number) FROM history h WHERE h.block_number <= 150 AND h.token_address = n.token_address AND h.address = n.address), 0) AS b FROM balances n) GROUP BY token_address")(
    lambda c: rollups.holder_delta(rollups.current_balances(c.history.where("block_number <= 150")), c.balances)
)
query("nft_owners", "SELECT * FROM nfts")(lambda c: c.nfts)
query("nft_supply", "SELECT token_address, count(CASE WHEN owner <> z THEN 1 END) AS live_ids FROM nfts, zero GROUP BY token_address")(lambda c: rollups.nft_supply(c.nfts))
query("current_balances", "SELECT token_address, address, balance, block_number FROM balances")(lambda c: rollups.current_balances(c.history))
query("balances_from_transfers", "SELECT token_address, address, block_number, balance FROM history")(lambda c: c.history)
query("balance_keys", "SELECT token_address, a AS address, max(block_number) AS block_number FROM (SELECT token_address, from_address AS a, block_number FROM f_transfers UNION ALL SELECT token_address, to_address, block_number FROM f_transfers), zero WHERE a <> z GROUP BY token_address, a")(
    lambda c: rollups.balance_keys(c.transfers)
)
query("counters", "SELECT address, type, CAST(sum(n) AS BIGINT) AS count FROM (SELECT from_address AS address, 'transactions' AS type, 1 AS n FROM f_tx UNION ALL SELECT from_address, 'transfers', 1 FROM f_transfers) GROUP BY address, type")(
    lambda c: rollups.counter_merge(
        c.txs.select(F.col("from_address").alias("address"), F.lit("transactions").alias("type"), F.lit(1).cast("long").alias("count")),
        c.transfers.select(F.col("from_address").alias("address"), F.lit("transfers").alias("type"), F.lit(1).cast("long").alias("count")),
    )
)
query("counter_merge", "SELECT from_address AS address, 'transactions' AS type, count(*) + 1 AS count FROM f_tx GROUP BY from_address")(
    lambda c: rollups.counter_merge(
        c.txs.groupBy(F.col("from_address").alias("address")).agg(F.count("*").alias("count")).select("address", F.lit("transactions").alias("type"), "count"),
        c.txs.select(F.col("from_address").alias("address"), F.lit("transactions").alias("type"), F.lit(1).cast("long").alias("count")).distinct(),
    )
)
query("chain_stats", "SELECT (SELECT count(*) FROM f_blocks) AS total_blocks, (SELECT count(*) FROM f_tx) AS total_txs, (SELECT count(*) FROM f_transfers) AS total_transfers, (SELECT count(*) FROM stats) AS total_addresses, (SELECT count(*) FROM totals) AS total_tokens, (max(timestamp) - min(timestamp)) / (count(*) - 1) AS avg_block_time, max(number) AS latest_block FROM (SELECT * FROM f_blocks ORDER BY number DESC LIMIT 100)")(
    lambda c: rollups.chain_stats(c.counters, c.blocks)
)
query("tx_history_hour", f"SELECT CAST(floor(timestamp / 3600.0) * 3600 AS BIGINT) AS bucket, CAST(sum((SELECT count(*) FROM f_tx t WHERE t.block_number = b.number)) AS BIGINT) AS tx_count FROM f_blocks b WHERE timestamp >= {AS_OF // 3600 * 3600 - 23 * 3600} AND timestamp <= {AS_OF} GROUP BY 1")(
    lambda c: rollups.tx_history(c.blocks, c.txs, AS_OF, 3600, 24)
)
query("tx_history_day", "SELECT CAST(to_timestamp(block_timestamp) AT TIME ZONE 'UTC' AS DATE) AS bucket, count(*) AS tx_count FROM f_tx WHERE block_timestamp < 1704240000 GROUP BY 1")(lambda c: rollups.tx_history_day(c.daily, DAY, 7))
query("tx_history_week", "SELECT CAST(date_trunc('week', CAST(to_timestamp(block_timestamp) AT TIME ZONE 'UTC' AS DATE)) AS DATE) AS bucket, count(*) AS tx_count FROM f_tx WHERE block_timestamp < 1706140800 GROUP BY 1")(
    lambda c: rollups.tx_history_week(c.daily, "2024-01-24", 6)
)
query("gas_percentiles", "SELECT CAST(round_even(quantile_cont(CAST(gas_price AS DOUBLE), 0.35), 0) AS BIGINT) AS slow, CAST(round_even(quantile_cont(CAST(gas_price AS DOUBLE), 0.6), 0) AS BIGINT) AS average, CAST(round_even(quantile_cont(CAST(gas_price AS DOUBLE), 0.9), 0) AS BIGINT) AS fast, (SELECT CAST(arg_max(base_fee_per_gas, number) AS BIGINT) FROM f_blocks WHERE base_fee_per_gas IS NOT NULL) AS base_fee, count(*) AS sampled FROM (SELECT * FROM f_tx WHERE gas_price > 0 ORDER BY block_number DESC, tx_index DESC LIMIT 10000)")(
    lambda c: rollups.gas_percentiles(c.txs, c.blocks)
)
query("gas_tiers", "SELECT t AS tier, round(p / 1e9, 6) AS gas_price, round(greatest(p - b, 0) / 1e9, 6) AS priority_fee FROM (SELECT unnest(['slow', 'average', 'fast']) AS t, unnest([quantile_cont(CAST(gas_price AS DOUBLE), 0.35), quantile_cont(CAST(gas_price AS DOUBLE), 0.6), quantile_cont(CAST(gas_price AS DOUBLE), 0.9)]) AS p, (SELECT arg_max(base_fee_per_gas, number) FROM f_blocks WHERE base_fee_per_gas IS NOT NULL) AS b FROM (SELECT * FROM f_tx WHERE gas_price > 0 ORDER BY block_number DESC, tx_index DESC LIMIT 10000))")(
    lambda c: rollups.gas_tiers(rollups.gas_percentiles(c.txs, c.blocks)).select("tier", F.round("gas_price", 6).alias("gas_price"), F.round("priority_fee", 6).alias("priority_fee"))
)
query("ingest_rate", "--bare\nSELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) / 3600.0 AS rows_per_second, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")(
    lambda c: rollups.ingest_rate(fixtures.read(c.spark, c.sf_dir, "events"), "ts", {}).join(
        fixtures.read(c.spark, c.sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_distinct("event_type").alias("kinds")), "hour"
    ).withColumns({"hour": F.unix_timestamp(F.col("hour").cast("timestamp")), "rows_per_second": F.col("rows_per_second").cast("double")})
)

# --- scalar functions, each over a whole table ----------------------------------------------------------------------

query("hex_quantity", "SELECT hash, gas_price AS quantity, CAST(gas_price AS VARCHAR) AS wide FROM f_tx")(
    lambda c: c.txs.select("hash", F.concat(F.lit("0X"), F.hex("gas_price")).alias("h")).select(
        "hash", fn.hex_to_long(F.col("h")).alias("quantity"), u256.to_decimal(u256.from_hex(F.col("h"))).alias("wide"))
)
query("topic_address", "SELECT tx_hash, CAST(log_index AS BIGINT) AS log_index, from_address, to_address FROM f_transfers")(
    lambda c: c.logs.select("tx_hash", F.col("log_index").cast("long").alias("log_index"), fn.topic_address(F.upper("topic1")).alias("from_address"), fn.topic_address(F.col("topic2")).alias("to_address"))
)
query("epoch_and_day", "SELECT number, day, CAST(epoch(CAST(day AS TIMESTAMP)) AS BIGINT) AS midnight FROM days")(
    lambda c: c.blocks.select("number", fn.day_of(F.col("timestamp")).alias("day"), fn.epoch_of(fn.day_of(F.col("timestamp"))).alias("midnight"))
)
query("address_buckets", "SELECT token_address, CAST(12 AS INTEGER) AS bucket, count(*) AS n FROM f_transfers GROUP BY token_address")(
    # tokens begin with 0x70c; from its third digit on, after a zero, the first byte is 12
    lambda c: c.transfers.select("token_address", F.concat(F.lit("0x0"), F.substring("token_address", 5, 36)).alias("a"))
    .where((F.col("a") >= fn.bucket_bounds(12)[0]) & (F.col("a") < fn.bucket_bounds(12)[1])).groupBy("token_address", fn.address_bucket(F.col("a")).alias("bucket")).agg(F.count("*").alias("n"))
)
query("labels", "SELECT hash, concat(left(hash, 10), '...', right(hash, 6)) AS short, right(from_address, 9) AS same, split_part(concat('tx', tx_type, ' of ', block_number), ' ', 1) AS symbol FROM f_tx")(
    lambda c: c.txs.select("hash", fn.short_label(F.col("hash")).alias("short"), fn.short_label(F.right("from_address", F.lit(9))).alias("same"), fn.symbol_of(F.concat(F.lit("tx"), "tx_type", F.lit(" of "), "block_number")).alias("symbol"))
)
query("numeric_words", "SELECT hash, regexp_full_match(right(to_address, 3), '[0-9]+') AS digits, regexp_full_match(hash, '[0-9]+') AS words FROM f_tx WHERE to_address IS NOT NULL")(
    lambda c: c.txs.where("to_address is not null").select("hash", fn.is_numeric(F.right("to_address", F.lit(3))).alias("digits"), fn.is_numeric(F.col("hash")).alias("words"))
)
query("gas_in_gwei", "SELECT hash, gas_price / 1e9 AS gwei, greatest(gas_used - 21500, 0) AS above FROM f_tx")(
    lambda c: c.txs.select("hash", fn.gwei(F.col("gas_price")).alias("gwei"), fn.floor_zero(F.col("gas_used") - 21500).alias("above"))
)
query("bytecode_hash", "SELECT tx_hash, trace_address, lpad(right(substr(output, 3), 64), 64, '0') AS hash FROM f_frames WHERE output IS NOT NULL")(
    lambda c: c.frames.where("output is not null").select("tx_hash", "trace_address", fn.bytecode_hash(F.col("output")).alias("hash"))
)
query("enclosing_paths", "SELECT f.tx_hash, f.trace_address, g.p AS around FROM f_frames f JOIN (VALUES (''), ('0'), ('1'), ('1,0'), ('2')) g(p) ON (g.p = '' AND f.trace_address <> '') OR (g.p <> '' AND starts_with(f.trace_address, concat(g.p, ',')))")(
    lambda c: c.frames.select("tx_hash", "trace_address", F.explode(fn.enclosing_paths(F.col("trace_address"))).alias("around"))
)
