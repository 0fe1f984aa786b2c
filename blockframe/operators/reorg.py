"""Reverting blocks: what to remove, what to subtract, and what to restore from the rows that remain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import u256
from ..functions.chain import ZERO_ADDRESS, floor_zero
from . import rollups

BLOCK_COLUMN = {"blocks": "number"}


def _doomed(df: DataFrame, lo: int, hi: int, column: str) -> Column:
    return F.col(column).between(lo, hi)


def revert_tables(tables: dict[str, DataFrame], lo: int, hi: int) -> dict[str, DataFrame]:
    """The history tables without the rows of blocks lo to hi: a filter on the block column, no join."""
    return {name: df.where(~_doomed(df, lo, hi, BLOCK_COLUMN.get(name, "block_number"))) for name, df in tables.items()}


def revert_deltas(tables: dict[str, DataFrame], lo: int, hi: int) -> dict[str, DataFrame]:
    """What the removed rows take from the counters: chain(name, delta) and token(token_address, counts, supply)."""
    gone = {name: df.where(_doomed(df, lo, hi, BLOCK_COLUMN.get(name, "block_number"))) for name, df in tables.items()}
    chain = None
    for name in ("blocks", "txs", "transfers"):
        part = gone[name].agg((-F.count("*")).alias("delta")).select(F.lit(name).alias("name"), "delta")
        chain = part if chain is None else chain.unionByName(part)
    token = rollups.token_totals(gone["transfers"])
    supply = u256.minus(F.col("supply"), u256.is_wide(token, "supply")).alias("supply")
    token = token.select("token_address", (-F.col("transfer_count")).alias("transfer_count"), supply)
    return {"chain": chain, "token": token}


def apply_chain_deltas(counters: DataFrame, delta: DataFrame) -> DataFrame:
    joined = counters.join(delta, "name", "left")
    return joined.select("name", floor_zero(F.col("count") + F.coalesce("delta", F.lit(0))).alias("count"))


def apply_token_deltas(tokens: DataFrame, delta: DataFrame) -> DataFrame:
    """tokens(token_address, transfer_count, supply) with deltas added; counts stop at zero."""
    d = delta.select("token_address", F.col("transfer_count").alias("d_count"), F.col("supply").alias("d_supply"))
    joined = tokens.join(d, "token_address", "left")
    wide = u256.is_wide(tokens, "supply")
    return joined.select(
        "token_address", floor_zero(F.col("transfer_count") + F.coalesce("d_count", F.lit(0))).alias("transfer_count"),
        u256.plus(F.col("supply"), F.coalesce(F.col("d_supply"), u256.zero(wide)), wide).alias("supply"),
    )


def revert_nft(nfts: DataFrame, transfers: DataFrame, lo: int, hi: int) -> DataFrame:
    """Owners after a revert. An id that the removed blocks moved goes back to who got it last before; with no earlier
    transfer to the sender of the first removed one; and is dropped if that one minted it."""
    keys = ["token_address", "token_id"]
    ids = transfers.where((F.col("token_type") == "ERC721") & F.col("token_id").isNotNull())
    place = F.struct("block_number", "log_index")
    gone = ids.where(F.col("block_number").between(lo, hi)).groupBy(*keys).agg(F.min_by("from_address", place).alias("sender"))
    before = ids.where(F.col("block_number") < lo).join(gone.select(*keys), keys, "left_semi")
    before = before.groupBy(*keys).agg(F.max_by("to_address", place).alias("was"), F.max("block_number").alias("was_block"))
    joined = nfts.join(gone, keys, "left").join(before, keys, "left")
    touched = F.col("sender").isNotNull()
    drop = touched & F.col("was").isNull() & (F.col("sender") == ZERO_ADDRESS)
    owner = F.when(touched, F.coalesce("was", "sender")).otherwise(F.col("owner"))
    block = F.when(touched, F.coalesce("was_block", F.lit(lo - 1).cast("long"))).otherwise(F.col("block_number"))
    return joined.where(~drop).select(*keys, owner.alias("owner"), block.alias("block_number"))


def revert_address_stats(stats: DataFrame, contributions: DataFrame, lo: int, hi: int) -> DataFrame:
    """Stats after a revert: the removed rows' counts subtracted, first and last block taken from the rows that remain.

    contributions are those of all rows before the revert. Only addresses that the removed blocks touched change; one that
    nothing else mentions goes. Both sides of the cut come from one aggregate, so contributions are read once.
    """
    gone = F.coalesce(F.col("block_number").between(lo, hi), F.lit(False))
    sides = rollups.address_stats(contributions.withColumn("gone_", gone), "gone_")
    mine, rest = F.col("gone_"), ~F.col("gone_")
    cut = sides.groupBy("address").agg(
        *(F.max(F.when(mine, F.col(c))).alias(f"d_{c}") for c in rollups.STAT_SUMS), F.max(F.when(mine, True)).alias("hit_"),
        F.max(F.when(rest, F.col("first_seen"))).alias("lo_"), F.max(F.when(rest, F.col("last_seen"))).alias("hi_"), F.max(F.when(rest, F.col("is_contract"))).alias("c_"),
    )
    joined = stats.join(cut, "address", "left")
    hit = F.col("hit_").isNotNull()
    return joined.where(~hit | F.col("lo_").isNotNull()).select(
        "address",
        *(F.when(hit, floor_zero(F.col(c) - F.col(f"d_{c}"))).otherwise(F.col(c)).alias(c) for c in rollups.STAT_SUMS),
        F.when(hit, F.col("lo_")).otherwise(F.col("first_seen")).alias("first_seen"),
        F.when(hit, F.col("hi_")).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(hit, F.col("c_")).otherwise(F.col("is_contract")).alias("is_contract"),
    )


def revert_balances(history: DataFrame, current: DataFrame, lo: int, hi: int) -> DataFrame:
    """Current balances after a revert: keys whose history was cut go back to the latest row that remains, or go."""
    keys = ["token_address", "address"]
    touched = history.where(F.col("block_number").between(lo, hi)).select(*keys).distinct().withColumn("hit_", F.lit(True))
    left = history.where(~F.col("block_number").between(lo, hi)).join(touched.drop("hit_"), keys, "left_semi")
    restored = rollups.current_balances(left).withColumnsRenamed({"balance": "r_balance", "block_number": "r_block"})
    joined = current.join(touched, keys, "left").join(restored, keys, "left")
    hit = F.col("hit_").isNotNull()
    return joined.where(~hit | F.col("r_block").isNotNull()).select(
        *keys, F.when(hit, F.col("r_balance")).otherwise(F.col("balance")).alias("balance"), F.when(hit, F.col("r_block")).otherwise(F.col("block_number")).alias("block_number")
    )


def reread_keys(transfers: DataFrame, history: DataFrame, lo: int, hi: int) -> DataFrame:
    """(token_address, address): keys to read again after a revert, from removed transfers and balances."""
    moved = rollups.balance_keys(transfers.where(F.col("block_number").between(lo, hi))).select("token_address", "address")
    read = history.where(F.col("block_number").between(lo, hi)).select("token_address", "address")
    return moved.unionByName(read).distinct()


# --- work after a revert -------------------------------------------------------------------------------------------


def epoch_fence(reads: DataFrame, epochs: DataFrame) -> DataFrame:
    """reads(token_address, address, epoch, ...) with accepted: not below the key's latest epoch (0 if it has none).

    A read that isn't is to be made again; an accepted one closes its key's request.
    """
    keys = ["token_address", "address"]
    latest = epochs.groupBy(*keys).agg(F.max("epoch").alias("latest"))
    joined = reads.join(latest, keys, "left")
    return joined.withColumn("accepted", F.col("epoch") >= F.coalesce("latest", F.lit(0))).drop("latest")


def fold_work(items: DataFrame) -> DataFrame:
    """One item per (token_address, address): the higher epoch, then the higher block."""
    order = F.struct("epoch", "block_number")
    return items.groupBy("token_address", "address").agg(F.max(order).alias("m")).select("token_address", "address", "m.epoch", "m.block_number")


def claim_rereads(requests: DataFrame, n: int, max_attempts: int = 20) -> DataFrame:
    """(token_address, address, epoch, attempts, action) of the next n open requests, oldest epoch first.

    A claim counts as an attempt; a request with max_attempts behind it is abandoned.
    """
    rows = requests.where("open").orderBy("epoch", "token_address", "address").limit(n)
    action = F.when(F.col("attempts") >= max_attempts, "abandon").otherwise("claim")
    return rows.select("token_address", "address", "epoch", (F.col("attempts") + F.when(action == "claim", 1).otherwise(0)).alias("attempts"), action.alias("action"))
