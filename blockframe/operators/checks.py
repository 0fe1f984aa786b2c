"""Checks of stored values against facts from elsewhere, and samples to check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rollups import COUNTED_TYPES


def check_blocks_total(counters: DataFrame, blocks: DataFrame, ranges: DataFrame, first: int) -> DataFrame:
    """The blocks counter against head + 1 - first, less what is known to be missing."""
    head = blocks.agg(F.max("number").alias("head"))
    gaps = ranges.agg(F.coalesce(F.sum(F.col("to_block") - F.col("from_block") + 1), F.lit(0)).alias("missing"))
    stored = counters.where("name = 'blocks'").agg(F.max("count").alias("stored"))
    whole = head.crossJoin(F.broadcast(gaps)).crossJoin(F.broadcast(stored))
    expected = F.col("head") + 1 - first - F.col("missing")
    return whole.select("stored", expected.alias("expected"), F.col("stored").eqNullSafe(expected).alias("ok"))


def check_against(stored: DataFrame, facts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, stored, fact, ok) for every fact; a key that isn't stored is null and not ok."""
    mine = stored.select(*keys, F.col(column).alias("stored"))
    joined = facts.select(*keys, F.col("fact")).join(mine, keys, "left")
    return joined.withColumn("ok", F.col("stored").eqNullSafe(F.col("fact")))


def check_supply(tokens: DataFrame, facts: DataFrame) -> DataFrame:
    return check_against(tokens, facts, ["token_address"], "supply")


def check_nonces(stats: DataFrame, facts: DataFrame) -> DataFrame:
    return check_against(stats, facts, ["address"], "sent_count")


def check_span_txs(ledger_chain: DataFrame, facts: DataFrame) -> DataFrame:
    return check_against(ledger_chain.where("name = 'txs'"), facts, ["span_lo"], "count")


def check_balances(balances: DataFrame, facts: DataFrame, suspects: DataFrame) -> DataFrame:
    """(token_address, address, stored, fact, verdict): a difference counts only when it is seen twice with the same fact."""
    keys = ["token_address", "address"]
    seen = check_against(balances, facts, keys, "balance").join(suspects.select(*keys, F.col("fact").alias("before")), keys, "left")
    verdict = F.when(F.col("ok"), "ok").when(F.col("before").eqNullSafe(F.col("fact")), "wrong").otherwise("suspect")
    return seen.select(*keys, "stored", "fact", verdict.alias("verdict"))


def settled_balances(balances: DataFrame, transfers: DataFrame, n: int | None, seed: int = 1) -> DataFrame:
    """Balances that no later transfer of their key has touched: all of them, or about n drawn at random.

    The last transfer of each (token, address) is found first, so that "no later transfer" is an equi-join.
    """
    side = F.explode(F.array("from_address", "to_address")).alias("address")
    last = transfers.select("token_address", side, "block_number").groupBy("token_address", "address").agg(F.max("block_number").alias("last_transfer"))
    drawn = balances if n is None else balances.orderBy(F.xxhash64(F.lit(seed), "token_address", "address")).limit(4 * n)
    joined = drawn.join(last, ["token_address", "address"], "left")
    rows = joined.where(F.col("last_transfer").isNull() | (F.col("last_transfer") <= F.col("block_number"))).drop("last_transfer")
    return rows if n is None else rows.orderBy(F.xxhash64(F.lit(seed), "token_address", "address")).limit(n)


def sender_sample(stats: DataFrame, txs: DataFrame, n: int | None, most_txs: int, seed: int = 1) -> DataFrame:
    """Senders whose count can be checked: no contract, few enough transactions, and none of a type that isn't counted."""
    fit = stats.where(~F.col("is_contract") & (F.col("sent_count") > 0) & (F.col("tx_count") <= most_txs))
    other = txs.where(~F.col("tx_type").isin(*COUNTED_TYPES)).select(F.col("from_address").alias("address")).distinct()
    rows = fit.join(other, "address", "left_anti").select("address", "sent_count")
    return rows if n is None else rows.orderBy(F.xxhash64(F.lit(seed), "address")).limit(n)
