"""Chain-shaped views over the star-schema tables, in SQL that means the same to Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Each view and its SQL; later ones read earlier ones. `orders` and `lineitem` are the tables.
VIEWS = {
    "f_tx": """
SELECT concat('0xtx', lpad(CAST(o_orderkey AS STRING), 62, '0')) AS hash,
       CAST(floor(o_orderkey / 4) AS BIGINT) + 1 AS block_number,
       1704067200 + (CAST(floor(o_orderkey / 4) AS BIGINT) + 1) * 600 + (CAST(floor(o_orderkey / 4) AS BIGINT) + 1) % 7 AS block_timestamp,
       CAST(o_orderkey % 4 AS INT) AS tx_index,
       concat('0x', lpad(CAST(o_custkey + 1 AS STRING), 40, '0')) AS from_address,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL
            WHEN o_orderkey % 29 = 0 THEN concat('0x', lpad(CAST(o_custkey + 1 AS STRING), 40, '0'))
            ELSE concat('0x', lpad(CAST((o_orderkey * 31) % 150 + 1 AS STRING), 40, '0')) END AS to_address,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS DECIMAL(38,0))
            ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DECIMAL(38,0)) END AS value,
       21000 + o_orderkey % 1000 AS gas_used,
       1000000000 + CAST(round(o_totalprice * 100) AS BIGINT) AS gas_price,
       CAST(CASE o_orderkey % 10 WHEN 0 THEN 126 WHEN 1 THEN 0 ELSE 2 END AS INT) AS tx_type,
       CASE WHEN o_orderkey % 2 = 0 THEN '0x' ELSE '0xa9059cbb00' END AS input_data,
       CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS INT) AS status
FROM orders WHERE (CAST(floor(o_orderkey / 4) AS BIGINT) + 1) % 97 <> 0
""",
    "f_blocks": """
SELECT block_number AS number, min(block_timestamp) AS timestamp, CAST(sum(gas_used) AS BIGINT) AS gas_used,
       CAST(count(*) AS INT) AS transaction_count,
       CASE WHEN block_number % 9 = 0 THEN NULL ELSE 400 + block_number * 7 % 1000 END AS size,
       CASE WHEN block_number < 100 THEN NULL ELSE 7 + block_number % 50 END AS base_fee_per_gas
FROM f_tx GROUP BY block_number
""",
    "f_lines": """
SELECT l.*, t.hash AS tx_hash, t.block_number, t.block_timestamp, t.from_address AS tx_from,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
       row_number() OVER (PARTITION BY t.block_number ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS log_index
FROM lineitem l JOIN f_tx t ON t.hash = concat('0xtx', lpad(CAST(l_orderkey AS STRING), 62, '0'))
""",
    "f_transfers": """
SELECT tx_hash, CAST(log_index AS INT) AS log_index, block_number, block_timestamp AS timestamp,
       concat('0x70c', lpad(CAST(l_partkey % 50 AS STRING), 37, '0')) AS token_address,
       CASE WHEN l_partkey % 17 = 0 THEN concat('0x', lpad('0', 40, '0'))
            ELSE concat('0x', lpad(CAST(l_suppkey + 1 AS STRING), 40, '0')) END AS from_address,
       CASE WHEN l_partkey % 19 = 0 THEN concat('0x', lpad('0', 40, '0'))
            WHEN l_linenumber = 7 AND l_partkey % 17 <> 0 THEN concat('0x', lpad(CAST(l_suppkey + 1 AS STRING), 40, '0'))
            ELSE tx_from END AS to_address,
       CASE WHEN (l_partkey % 50) % 5 = 0 THEN CAST(1 AS DECIMAL(38,0)) ELSE CAST(CAST(round(l_quantity * 1000) AS BIGINT) AS DECIMAL(38,0)) END AS value,
       CASE WHEN (l_partkey % 50) % 5 = 0 THEN 'ERC721' ELSE 'ERC20' END AS token_type,
       CASE WHEN (l_partkey % 50) % 5 = 0 THEN l_partkey END AS token_id
FROM f_lines
""",
    "f_frames": """
SELECT tx_hash, block_number, block_timestamp AS timestamp,
       CASE seq WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN '0,0' WHEN 4 THEN '1' WHEN 5 THEN '1,0' WHEN 6 THEN '1,0,0' ELSE concat('2,', CAST(seq AS STRING)) END AS trace_address,
       concat('0x', lpad(CAST(l_suppkey + 1 AS STRING), 40, '0')) AS from_address,
       CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE concat('0x', lpad(CAST(l_partkey % 400 + 1 AS STRING), 40, '0')) END AS to_address,
       CASE WHEN seq IN (3, 6) THEN 'create' WHEN seq = 5 THEN 'create2' ELSE 'call' END AS call_type,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'execution reverted' END AS error,
       CASE WHEN seq IN (3, 5, 6) THEN concat('0x60', CAST(l_partkey AS STRING)) END AS output
FROM f_lines
""",
}

#: The views as common table expressions, for SQL that DuckDB runs.
CTES = ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The block of an order's key, as the view f_tx has it.
_BLOCK = "CAST(floor({key} / 4) AS BIGINT) + 1"

_KEPT: dict[tuple[str, str], DataFrame] = {}


def keep(spark: SparkSession, sf_dir: str) -> None:
    """Persist the views of a folder for this process, so that timings are those of the operators on stored tables."""
    for name in VIEWS:
        if name != "f_lines":
            _KEPT[sf_dir, name] = kept = view(spark, sf_dir, name).persist()
            kept.count()


def _lines(spark: SparkSession, sf_dir: str, deal: Column | None = None) -> DataFrame:
    """The view f_lines with one exchange of each table instead of four: by the block, which the order's key tells.

    A hash stands for its key, so the join is on the keys; what the hash and the block say of a line is made of its own key
    after the exchange. Both windows lie within a block and share one sort. The join's key is the block alone, and a line's
    order a condition on the block's four: with two keys, a join that shuffles deals both sides by both, and the windows
    exchange all lines again.

    With deal, an expression of block_number, tables are dealt by that instead, for what writes ranges of blocks; it is a key of the
    join and the windows then, which don't exchange again if spark.sql.requireAllClusterKeysForCoPartition is off.
    """
    block = lambda key: F.expr(_BLOCK.format(key=key))
    txs = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", block("o_orderkey").alias("block_number")).where("block_number % 97 <> 0")
    lines = read(spark, sf_dir, "lineitem").withColumn("block_number", block("l_orderkey")).where("block_number % 97 <> 0")
    if deal is None:
        on, place = "l.block_number = t.block_number and l_orderkey - o_orderkey = 0", ["block_number"]
        txs, lines = txs.repartition("block_number"), lines.repartition("block_number")
    else:
        on, place = "l.deal_ = t.deal_ and l_orderkey = o_orderkey", ["deal_", "block_number"]
        txs, lines = (df.repartition(deal).withColumn("deal_", deal) for df in (txs, lines))
    both = lines.alias("l").join(txs.alias("t"), F.expr(on)).select("l.*", "o_custkey")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return both.select(
        *(c for c in both.columns if c not in ("o_custkey", "deal_")),
        F.expr("concat('0xtx', lpad(CAST(l_orderkey AS STRING), 62, '0'))").alias("tx_hash"),
        F.expr("1704067200 + block_number * 600 + block_number % 7").alias("block_timestamp"),
        F.expr("concat('0x', lpad(CAST(o_custkey + 1 AS STRING), 40, '0'))").alias("tx_from"),
        F.row_number().over(Window.partitionBy(*place, "l_orderkey").orderBy(*order[1:])).alias("seq"),
        (F.row_number().over(Window.partitionBy(*place).orderBy(*order)) - 1).alias("log_index"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as the transfer that the view makes of it, and as a frame, a struct: dealt by block.

    Each view exchanges the lines with the columns that it reads; what reads both views has them here from one exchange.
    """
    of = lambda name: VIEWS[name].strip().removeprefix("SELECT").removesuffix("FROM f_lines")
    sql = f"SELECT {of('f_transfers')}, struct({of('f_frames')}) AS frame FROM {{f_lines}}"
    return spark.sql(sql, f_lines=view(spark, sf_dir, "f_lines"))


def view(spark: SparkSession, sf_dir: str, name: str, by_block: bool = False, deal: Column | None = None) -> DataFrame:
    """One view over the tables in a folder, as a lazy DataFrame.

    With by_block f_tx is dealt by its block, as the views of lines are: by the orders' keys, before they become texts. With deal,
    an expression of block_number, views of lines are dealt by it.
    """
    if (sf_dir, name) in _KEPT:
        return _KEPT[sf_dir, name]
    if name == "f_lines":
        return _lines(spark, sf_dir, deal)
    # each view is a DataFrame over those that it reads, not a WITH clause: Spark numbers the clauses of a whole query, so that
    # the same view is another plan at its second place there, and what `keep` has persisted wouldn't be found
    named = re.findall(r"\b(?:FROM|JOIN) (\w+)", VIEWS[name])
    inner = {n: view(spark, sf_dir, n, deal=deal) if n in VIEWS else read(spark, sf_dir, n) for n in named}
    if by_block:
        inner = {n: df.repartition(F.expr(_BLOCK.format(key="o_orderkey"))) if n == "orders" else df for n, df in inner.items()}
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", VIEWS[name]), **inner)
