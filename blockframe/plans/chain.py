"""A chain over the star-schema tables: the fixture views and what the operators derive from them.

Each property is a lazy DataFrame. The SQL of the same tables, for DuckDB, is in `CTES`, written independently of the
operators, so that an oracle doesn't repeat their logic.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chain import TRANSFER_TOPIC
from ..operators import daily, decode, ledger, rollups
from ..sources import fixtures, raw

SPAN = 500
#: Spans below this block are closed.
CLOSED = 1 * SPAN
FLOOR_GAP = 200
HASH = "concat('0xb', lpad(CAST({n} AS STRING), 63, '0'))"


class Chain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    def rows(self, schema: str, *rows: tuple) -> DataFrame:
        """A few parameter rows (requested keys); not data."""
        return self.spark.createDataFrame(list(rows), schema)

    def stored(self, df: DataFrame) -> DataFrame:
        """df written once to the folder that driver and executors share, for a query that reads it at several places."""
        folder = f"{raw.shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    @cached_property
    def head(self) -> int:
        """The greatest block number; what queries take as bounds are shares of it."""
        return self.blocks.agg(F.max("number")).first()[0]

    @property
    def late(self) -> int:
        return self.head * 4 // 5

    @cached_property
    def txs(self) -> DataFrame:
        return self.view("f_tx")

    @cached_property
    def dealt_txs(self) -> DataFrame:
        """The transactions dealt by block."""
        return fixtures.view(self.spark, self.sf_dir, "f_tx", by_block=True)

    @cached_property
    def lines(self) -> DataFrame:
        """Transfers and frames, a row for both."""
        return fixtures.lines(self.spark, self.sf_dir)

    @cached_property
    def blocks(self) -> DataFrame:
        rows = self.view("f_blocks")
        return rows.select("*", F.expr(HASH.format(n="number")).alias("hash"), F.expr(HASH.format(n="(number - 1)")).alias("parent_hash"))

    @cached_property
    def transfers(self) -> DataFrame:
        return self.view("f_transfers")

    @cached_property
    def frames(self) -> DataFrame:
        return self.view("f_frames")

    @cached_property
    def categorised(self) -> DataFrame:
        return rollups.tx_categories(self.txs, self.transfers)

    @cached_property
    def logs(self) -> DataFrame:
        return decode.transfer_logs(self.transfers)

    @cached_property
    def no_contracts(self) -> DataFrame:
        return self.txs.select(F.col("hash").alias("address")).limit(0)

    @cached_property
    def contracts(self) -> DataFrame:
        return decode.contracts_from_frames(self.frames, self.no_contracts)

    @cached_property
    def contributions(self) -> DataFrame:
        return rollups.address_contributions(self.txs, self.transfers, self.frames, self.contracts)

    @cached_property
    def dealt(self) -> DataFrame:
        """The contributions dealt by block, for what groups them by transactions."""
        txs = fixtures.view(self.spark, self.sf_dir, "f_tx", by_block=True)
        return rollups.address_contributions(txs, self.transfers, self.frames, self.contracts, by_block=True)

    @cached_property
    def stats(self) -> DataFrame:
        return rollups.address_stats(self.dealt)

    def stats_of(self, addresses: DataFrame) -> DataFrame:
        """The stats of some addresses: only their contributions are grouped."""
        return rollups.address_stats(self.contributions.join(addresses.select("address"), "address", "left_semi"))

    @cached_property
    def split(self) -> DataFrame:
        """The address ledger of closed spans, and the stats of the open rows above: one aggregate by address and side."""
        return self.stored(rollups.address_stats(self.dealt.withColumn("closed", F.col("block_number") < CLOSED), "closed"))

    @cached_property
    def split_stats(self) -> DataFrame:
        """The stats as both sides of the split add up to them: what a query compares with the split needs no pass of its own."""
        return ledger.address_truth(self.split)

    @cached_property
    def history(self) -> DataFrame:
        return rollups.balances_from_transfers(self.transfers, history=True)

    @cached_property
    def balances(self) -> DataFrame:
        return rollups.balances_from_transfers(self.transfers)

    @cached_property
    def token_totals(self) -> DataFrame:
        return rollups.token_totals(self.transfers)

    @cached_property
    def tokens(self) -> DataFrame:
        """Discovered tokens with their totals and holders; symbols are made of the address."""
        found = decode.token_discovery(self.transfers, self.no_contracts)
        counts = rollups.holder_count(found.select("address"), self.balances)
        totals = self.token_totals.withColumnRenamed("token_address", "address")
        symbol = F.concat(F.lit("TK"), F.right("address", F.lit(2)))
        name = F.concat(F.lit("Token "), F.right("address", F.lit(2)))
        return found.join(counts, "address").join(totals, "address").withColumns({"symbol": symbol, "name": name})

    @cached_property
    def nfts(self) -> DataFrame:
        return rollups.nft_owners(self.transfers)

    @cached_property
    def counters(self) -> DataFrame:
        addresses = rollups.addresses(self.txs, self.transfers, self.frames)  # a row each, as the stats have; nothing else of them is counted
        return rollups.chain_counters(self.blocks, self.txs, self.transfers, addresses, self.token_totals)

    @cached_property
    def daily(self) -> DataFrame:
        return daily.daily_parts(self.blocks, self.txs, self.transfers)

    @cached_property
    def span_addresses(self) -> DataFrame:
        return ledger.address_stats_by_span(self.dealt, SPAN)


_PATHS = """
f_b AS (SELECT *, concat('0xb', lpad(CAST(number AS STRING), 63, '0')) AS hash,
               concat('0xb', lpad(CAST(number - 1 AS STRING), 63, '0')) AS parent_hash FROM f_blocks)
""".strip()

#: Derived tables in SQL: creations that lasted, contributions, stats, balances, totals, tokens, owners, categories.
CTES = ",\n".join(
    [
        fixtures.CTES,
        _PATHS,
        """made AS (SELECT * FROM f_frames f WHERE call_type IN ('create', 'create2') AND trace_address <> '' AND error IS NULL AND to_address IS NOT NULL
           AND NOT EXISTS (SELECT 1 FROM f_frames g WHERE g.tx_hash = f.tx_hash AND g.error IS NOT NULL AND g.trace_address <> f.trace_address
                           AND (g.trace_address = '' OR starts_with(f.trace_address, concat(g.trace_address, ',')))))""",
        """contracts AS (SELECT address, bytecode, lpad(right(bytecode, 64), 64, '0') AS bytecode_hash, creator, creation_tx, block_number FROM (
           SELECT to_address AS address, substr(output, 3) AS bytecode, from_address AS creator, tx_hash AS creation_tx, block_number,
                  row_number() OVER (PARTITION BY to_address ORDER BY block_number, tx_hash, trace_address) AS n
           FROM made WHERE output IS NOT NULL AND length(output) > 2) WHERE n = 1)""",
        """zero AS (SELECT concat('0x', lpad('0', 40, '0')) AS z)""",
        """contrib AS (
           SELECT from_address AS address, hash AS tx, block_number, CASE WHEN tx_type IN (0,1,2,3,4) THEN 1 ELSE 0 END AS sent, 0 AS internal, 0 AS moved, false AS is_contract FROM f_tx
           UNION ALL SELECT to_address, hash, block_number, 0, 0, 0, false FROM f_tx WHERE to_address IS NOT NULL AND to_address <> from_address
           UNION ALL SELECT from_address, tx_hash, block_number, 0, 1, 0, false FROM f_frames
           UNION ALL SELECT to_address, tx_hash, block_number, 0, 1, 0, false FROM f_frames WHERE to_address IS NOT NULL AND to_address <> from_address
           UNION ALL SELECT from_address, tx_hash, block_number, 0, 0, 1, false FROM f_transfers, zero WHERE from_address <> z
           UNION ALL SELECT to_address, tx_hash, block_number, 0, 0, 1, false FROM f_transfers, zero WHERE to_address <> z AND to_address <> from_address
           UNION ALL SELECT address, NULL, block_number, 0, 0, 0, true FROM contracts)""",
        """stats AS (SELECT address, count(DISTINCT tx) AS tx_count, CAST(sum(internal) AS BIGINT) AS internal_tx_count, CAST(sum(moved) AS BIGINT) AS token_transfer_count,
           CAST(sum(sent) AS BIGINT) AS sent_count, min(block_number) AS first_seen, max(block_number) AS last_seen, bool_or(is_contract) AS is_contract FROM contrib GROUP BY address)""",
        """totals AS (SELECT token_address, count(*) AS transfer_count, CASE WHEN max(token_type) = 'ERC20' THEN CAST(sum(CASE WHEN from_address = z THEN value ELSE 0 END
           - CASE WHEN to_address = z THEN value ELSE 0 END) AS BIGINT) END AS supply FROM f_transfers, zero GROUP BY token_address)""",
        """changes AS (SELECT token_address, to_address AS address, block_number, CAST(value AS BIGINT) AS change FROM f_transfers, zero WHERE token_type = 'ERC20' AND to_address <> z
           UNION ALL SELECT token_address, from_address, block_number, -CAST(value AS BIGINT) FROM f_transfers, zero WHERE token_type = 'ERC20' AND from_address <> z)""",
        """balances AS (SELECT token_address, address, CAST(sum(change) AS BIGINT) AS balance, max(block_number) AS block_number FROM changes GROUP BY token_address, address)""",
        """history AS (SELECT token_address, address, block_number, CAST(sum(c) OVER (PARTITION BY token_address, address ORDER BY block_number) AS BIGINT) AS balance FROM (
           SELECT token_address, address, block_number, sum(change) AS c FROM changes GROUP BY ALL))""",
        """nfts AS (SELECT token_address, token_id, to_address AS owner, block_number FROM (SELECT *, row_number() OVER (PARTITION BY token_address, token_id
           ORDER BY block_number DESC, log_index DESC) AS n FROM f_transfers WHERE token_type = 'ERC721' AND token_id IS NOT NULL) WHERE n = 1)""",
        """tokens AS (SELECT t.token_address AS address, CASE WHEN bool_or(f.token_type = 'ERC721') THEN 'ERC721' ELSE 'ERC20' END AS token_type,
           CASE WHEN bool_or(f.token_type = 'ERC721') THEN 0 ELSE 18 END AS decimals, min(f.block_number) AS block_number, any_value(t.transfer_count) AS transfer_count,
           any_value(t.supply) AS supply, coalesce((SELECT count(*) FROM balances b WHERE b.token_address = t.token_address AND balance > 0), 0) AS holder_count,
           concat('TK', right(t.token_address, 2)) AS symbol, concat('Token ', right(t.token_address, 2)) AS name,
           arg_min(f.tx_hash, f.block_number * 100000 + f.log_index) AS creation_tx
           FROM totals t JOIN f_transfers f USING (token_address) GROUP BY t.token_address)""",
        """cats AS (SELECT f_tx.*, CASE WHEN value > 0 AND input_data IN ('', '0x') THEN 1 ELSE 0 END + CASE WHEN to_address IS NULL AND status = 1 THEN 2 ELSE 0 END
           + CASE WHEN to_address IS NOT NULL AND length(input_data) >= 10 THEN 4 ELSE 0 END
           + CASE WHEN EXISTS (SELECT 1 FROM f_transfers m WHERE m.tx_hash = f_tx.hash) THEN 8 ELSE 0 END AS categories FROM f_tx)""",
        """days AS (SELECT *, CAST(to_timestamp(timestamp) AT TIME ZONE 'UTC' AS DATE) AS day FROM f_blocks)""",
    ]
)
TOPIC = TRANSFER_TOPIC
