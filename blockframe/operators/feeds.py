"""Lookups, feeds and browse pages: filter, order, limit. Each is one pushed-down filter and one top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chain, u256

PARTICIPANTS = ("from_address", "to_address")


# --- helpers -------------------------------------------------------------------------------------------------------


def top_k(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """Page number (from 1) of a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def before(keys: list[str], bound: tuple | None) -> Column:
    """(keys) < bound as row values, in the form that reaches the scan: a <= x and (a < x or b < y)."""
    if bound is None:
        return F.lit(True)
    if len(keys) == 1:
        return F.col(keys[0]) < bound[0]
    a, b = keys
    return (F.col(a) <= bound[0]) & ((F.col(a) < bound[0]) | (F.col(b) < bound[1]))


def between(column: str, low: int | None, high: int | None) -> Column:
    """Half-open range; None is unbounded."""
    kept = F.lit(True)
    if low is not None:
        kept = kept & (F.col(column) >= low)
    if high is not None:
        kept = kept & (F.col(column) < high)
    return kept


def with_total(rows: DataFrame, whole: DataFrame, name: str = "total") -> DataFrame:
    """rows with the number of rows of whole; one row is broadcast."""
    return rows.crossJoin(F.broadcast(whole.agg(F.count("*").alias(name))))


def newest(*keys: str) -> list[Column]:
    return [F.desc(k) for k in keys]


def hide_types(txs: DataFrame, types: tuple[int, ...]) -> DataFrame:
    """Without the listed transaction types; an empty list hides nothing."""
    return txs.where(~F.col("tx_type").isin(*types)) if types else txs


def feed_page(df: DataFrame, order: list[Column], keys: list[str], n: int) -> DataFrame:
    """n rows, whether there are more, and on the last row a token that resumes after it."""
    probe = top_k(df, order, n + 1)
    counted = probe.crossJoin(F.broadcast(probe.agg((F.count("*") > n).alias("has_more"))))
    rows = counted.orderBy(*order).limit(n)
    token = F.base64(F.to_json(F.struct(*keys)).cast("binary"))
    return rows.withColumn("cursor", token)


# --- blocks --------------------------------------------------------------------------------------------------------


def block_lookup(blocks: DataFrame, number: int | None = None, hash: str | None = None) -> DataFrame:
    return blocks.where(F.col("number") == number if number is not None else F.col("hash") == hash)


def block_feed(blocks: DataFrame, before_number: int | None, n: int) -> DataFrame:
    return top_k(blocks.where(before(["number"], (before_number,) if before_number is not None else None)), newest("number"), n)


def latest_block(blocks: DataFrame, at_or_below: int | None = None) -> DataFrame:
    rows = blocks if at_or_below is None else blocks.where(F.col("number") <= at_or_below)
    return rows.agg(F.max("number").alias("number"))


def block_tx_counts(txs: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, tx_count) of each requested number; 0 where there are none."""
    wanted = numbers.select("number").distinct()
    counts = txs.groupBy(F.col("block_number").alias("number")).agg(F.count("*").alias("tx_count"))
    return wanted.join(counts, "number", "left").select("number", F.coalesce("tx_count", F.lit(0)).alias("tx_count"))


# --- transactions --------------------------------------------------------------------------------------------------


def tx_lookup(txs: DataFrame, contracts: DataFrame, hash: str | None = None) -> DataFrame:
    """Transactions with the contract that each created, if it is a creation."""
    rows = txs if hash is None else txs.where(F.col("hash") == hash)
    made = contracts.select(F.col("creation_tx"), F.col("address").alias("created_contract"))
    return rows.join(made, (rows["hash"] == made["creation_tx"]) & rows["to_address"].isNull(), "left").drop("creation_tx")


def tx_feed(txs: DataFrame, bound: tuple[int, int] | None, n: int, hidden: tuple[int, ...] = ()) -> DataFrame:
    rows = hide_types(txs.where(before(["block_number", "tx_index"], bound)), hidden)
    return top_k(rows, newest("block_number", "tx_index"), n)


def tx_page(txs: DataFrame, counters: DataFrame | None, number: int, size: int, hidden: tuple[int, ...] = ()) -> DataFrame:
    """A page with the total: the counter's, where it is known and nothing is hidden, else counted."""
    rows = hide_types(txs, hidden)
    counted = rows.agg(F.count("*").alias("counted"))
    if counters is not None and not hidden:
        stored = counters.where("name = 'txs'").agg(F.max("count").alias("stored"))
        totals = counted.crossJoin(F.broadcast(stored)).select(F.coalesce("stored", "counted").alias("total"))
    else:
        totals = counted.withColumnRenamed("counted", "total")
    return page(rows, newest("block_number", "tx_index"), size, number).crossJoin(F.broadcast(totals))


def txs_by_block(txs: DataFrame, blocks: DataFrame | None = None, number: int | None = None, hash: str | None = None) -> DataFrame:
    if number is not None:
        return txs.where(F.col("block_number") == number)
    wanted = blocks.where(F.col("hash") == hash).select(F.col("number").alias("block_number"))
    return txs.join(wanted, "block_number", "left_semi")


def _involving(df: DataFrame, address: str) -> DataFrame:
    return df.where((F.col("from_address") == address) | (F.col("to_address") == address))


def txs_by_address(txs: DataFrame, transfers: DataFrame, address: str, bound: tuple[int, int] | None, n: int) -> DataFrame:
    """Transactions that an address sent, received, or took part in through a token transfer; each once, newest first.

    The own branch and the transfer branch are one scan each; the transfers of one address are distinct by transaction
    before they meet the transactions.
    """
    rows = txs.where(before(["block_number", "tx_index"], bound))
    moved = _involving(transfers, address).select(F.col("tx_hash").alias("hash")).distinct()
    both = _involving(rows, address).unionByName(rows.join(moved, "hash", "left_semi")).dropDuplicates(["hash"])
    return top_k(both, newest("block_number", "tx_index"), n)


def txs_by_direction(txs: DataFrame, address: str, direction: str, bound: tuple[int, int] | None, n: int) -> DataFrame:
    """direction: FROM, TO or BOTH."""
    rows = txs.where(before(["block_number", "tx_index"], bound))
    kept = {
        "FROM": F.col("from_address") == address,
        "TO": F.col("to_address") == address,
        "BOTH": (F.col("from_address") == address) | (F.col("to_address") == address),
    }
    return top_k(rows.where(kept[direction]), newest("block_number", "tx_index"), n)


def tx_filter(txs: DataFrame, categories: tuple[str, ...] = (), status: int | None = None, blocks: tuple[int | None, int | None] = (None, None), times: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Any of the categories, and the status, and both half-open ranges; what isn't given filters nothing."""
    kept = between("block_number", *blocks) & between("block_timestamp", *times)
    if categories:
        mask = sum(chain.CATEGORY_BITS[c] for c in categories)
        kept = kept & (F.col("categories").bitwiseAND(mask) != 0)
    if status is not None:
        kept = kept & (F.col("status") == status)
    return txs.where(kept)


def address_tx_counts(stats: DataFrame, addresses: DataFrame) -> DataFrame:
    """(address, tx_count) of each requested address; 0 where unknown or negative."""
    wanted = addresses.select(F.lower("address").alias("address")).distinct()
    return wanted.join(stats.select("address", "tx_count"), "address", "left").select(
        "address", chain.floor_zero(F.coalesce("tx_count", F.lit(0))).alias("tx_count")
    )


# --- logs and transfers --------------------------------------------------------------------------------------------


def logs_by_tx(logs: DataFrame, txs: DataFrame, hash: str) -> DataFrame:
    """The logs of a transaction; its block is looked up first, so that a layout by block is pruned."""
    block = txs.where(F.col("hash") == hash).select("block_number")
    return logs.where(F.col("tx_hash") == hash).join(block, "block_number", "left_semi").orderBy("log_index")


def logs_filter(logs: DataFrame, address: str | None = None, topic0: str | None = None, from_block: int | None = None, to_block: int | None = None, n: int = 100) -> DataFrame:
    """Newest logs that match all that is given, both bounds included, with the number of all that match."""
    kept = F.lit(True)
    if address is not None:
        kept = kept & (F.col("address") == address)
    if topic0 is not None:
        kept = kept & (F.col("topic0") == topic0)
    if from_block is not None:
        kept = kept & (F.col("block_number") >= from_block)
    if to_block is not None:
        kept = kept & (F.col("block_number") <= to_block)
    rows = logs.where(kept)
    return with_total(top_k(rows, newest("block_number", "log_index"), n), rows)


def transfers_by_tx(transfers: DataFrame, hash: str) -> DataFrame:
    return transfers.where(F.col("tx_hash") == hash).orderBy("log_index")


def transfers_by_address(transfers: DataFrame, address: str, bound: tuple[int, int] | None, n: int) -> DataFrame:
    """Newest transfers of an address with their number; one with itself counts once."""
    rows = _involving(transfers, address)
    return with_total(top_k(rows.where(before(["block_number", "log_index"], bound)), newest("block_number", "log_index"), n), rows)


def transfers_by_token(transfers: DataFrame, tokens: DataFrame | None, token: str, n: int, number: int = 1) -> DataFrame:
    """A page of a token's transfers with the total: the token's counter, else counted."""
    rows = transfers.where(F.col("token_address") == token)
    totals = rows.agg(F.count("*").alias("total"))
    if tokens is not None:
        stored = tokens.where(F.col("address") == token).agg(F.max("transfer_count").alias("stored"))
        totals = totals.crossJoin(F.broadcast(stored)).select(F.coalesce("stored", "total").alias("total"))
    return page(rows, newest("block_number", "log_index"), n, number).crossJoin(F.broadcast(totals))


def transfer_feed(transfers: DataFrame, token_type: str | None, number: int, size: int) -> DataFrame:
    rows = transfers if token_type is None else transfers.where(F.col("token_type") == token_type)
    return with_total(page(rows, newest("block_number", "log_index"), size, number), rows)


# --- tokens, holders, addresses ------------------------------------------------------------------------------------


def token_lookup(tokens: DataFrame, address: str | None = None) -> DataFrame:
    return tokens.where(F.col("address") == address) if address is not None else tokens.select("address", "token_type")


def token_browse(tokens: DataFrame, token_type: str | None, text: str | None, number: int, size: int) -> DataFrame:
    """Tokens by holders; text is looked for in name, symbol and address, without case, % and _ being ordinary."""
    rows = tokens if token_type is None else tokens.where(F.col("token_type") == token_type)
    if text:
        wanted = text.lower()
        rows = rows.where(F.greatest(*(F.coalesce(F.lower(c).contains(wanted), F.lit(False)) for c in ("name", "symbol", "address"))))
    return with_total(page(rows, [F.desc("holder_count"), F.asc("address")], size, number), rows)


def _percentage(part: Column, whole: Column, wide: bool) -> Column:
    """part of whole in per cent, four digits; exact where the whole is below 10^32, beyond it from doubles."""

    def rough() -> Column:
        a, b = (u256.as_double(x) if wide else x.cast("double") for x in (part, whole))
        return F.round(a / b * 100, 4).cast("decimal(10,4)")

    # rounded once, from the exact remainder: a decimal quotient would be cut to six digits before
    small = F.expr("cast('1' || repeat('0', 32) as decimal(38,0))")
    if wide:
        fits = (whole["hi"] == 0) & (whole["mid"] < 1_000_000)
        a, b = ((x["mid"] * F.expr(f"cast('1' || repeat('0', {u256.BASE_DIGITS}) as decimal(27,0))") + x["lo"]).cast("decimal(38,0)") for x in (part, whole))
    else:
        fits, a, b = whole < small, part, whole
    a, b = (F.when(fits, x).cast("decimal(38,0)") for x in (a, b))
    scaled = (a * 1_000_000).cast("decimal(38,0)")
    rest = F.pmod(scaled, b)
    exact = ((scaled - rest) / b).cast("decimal(38,0)") + F.when(rest >= b - rest, 1).otherwise(0)
    return F.when(fits, (exact.cast("decimal(12,0)") / 10_000).cast("decimal(10,4)")).otherwise(rough())


def token_holders(balances: DataFrame, contracts: DataFrame, token: str, n: int, number: int = 1) -> DataFrame:
    """Positive balances of a token, largest first, with their share of all in per cent and a contract flag."""
    wide = u256.is_wide(balances, "balance")
    rows = balances.where((F.col("token_address") == token) & (F.col("balance") > u256.zero(wide)))
    totals = rows.agg(u256.sum_of(F.col("balance"), wide).alias("held"), F.count("*").alias("total"))
    share = F.when(F.col("held") > u256.zero(wide), _percentage(F.col("balance"), F.col("held"), wide))
    top = page(rows, [F.desc("balance"), F.asc("address")], n, number)
    flagged = top.join(contracts.select("address", F.lit(True).alias("known")).distinct(), "address", "left")
    return flagged.crossJoin(F.broadcast(totals)).select(
        "address", "balance", share.alias("percentage"), F.coalesce("known", F.lit(False)).alias("is_contract"), "total"
    )


def nft_inventory(nfts: DataFrame, token: str, token_id: int | None, n: int, number: int = 1) -> DataFrame:
    """Live ids of a collection in numeric order with their number; the zero address owns what is burned."""
    rows = nfts.where((F.col("token_address") == token) & (F.col("owner") != chain.ZERO_ADDRESS))
    if token_id is not None:
        rows = rows.where(F.col("token_id") == token_id)
    return with_total(page(rows, [F.asc("token_id")], n, number), rows)


def holder_balances(balances: DataFrame, address: str) -> DataFrame:
    rows = balances.where((F.col("address") == address) & (F.col("balance") > 0))
    return rows.orderBy(F.desc("balance"), F.asc("token_address"))


def balance_history(history: DataFrame, address: str, token: str, n: int) -> DataFrame:
    rows = history.where((F.col("address") == address) & (F.col("token_address") == token))
    return top_k(rows, newest("block_number"), n)


def batch_balances(balances: DataFrame, addresses: DataFrame) -> DataFrame:
    """(address, balances) of each requested address: positive balances by token; an empty list where there are none."""
    wanted = addresses.select("address").distinct()
    item = F.struct("token_address", "balance")
    held = balances.where("balance > 0").join(wanted, "address", "left_semi")
    grouped = held.groupBy("address").agg(F.sort_array(F.collect_list(item)).alias("balances"))
    empty = F.array().cast(grouped.schema["balances"].dataType)
    return wanted.join(grouped, "address", "left").select("address", F.coalesce("balances", empty).alias("balances"))


def address_lookup(stats: DataFrame, addresses: DataFrame) -> DataFrame:
    """Stats of each requested address, zeros where unknown."""
    counts = ("tx_count", "internal_tx_count", "token_transfer_count", "sent_count", "first_seen", "last_seen")
    joined = addresses.select("address").distinct().join(stats, "address", "left")
    return joined.select(
        "address", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("is_contract", F.lit(False)).alias("is_contract")
    )


def address_browse(stats: DataFrame, number: int, size: int) -> DataFrame:
    return with_total(page(stats, [F.desc("tx_count"), F.asc("address")], size, number), stats)


def contract_lookup(contracts: DataFrame, address: str) -> DataFrame:
    return contracts.where(F.col("address") == address)


def existing_contracts(contracts: DataFrame, addresses: DataFrame) -> DataFrame:
    return addresses.select("address").distinct().join(contracts, "address", "left_semi")


def verified_contracts(contracts: DataFrame, number: int, size: int) -> DataFrame:
    """Verified contracts, latest verification first, with their number."""
    rows = contracts.where("verified")
    return with_total(page(rows, [F.desc_nulls_first("verified_at"), F.asc("address")], size, number), rows)


def frames_by_tx(frames: DataFrame, hash: str) -> DataFrame:
    return frames.where(F.col("tx_hash") == hash).orderBy("trace_address")


def frames_by_block(frames: DataFrame, number: int) -> DataFrame:
    return frames.where(F.col("block_number") == number).orderBy("tx_hash", "trace_address")


def frames_by_address(frames: DataFrame, address: str, n: int) -> DataFrame:
    """Newest frames of an address with their number; a call to itself counts once."""
    rows = _involving(frames, address)
    return with_total(top_k(rows, [*newest("block_number"), F.asc("tx_hash"), F.asc("trace_address")], n), rows)


def search(blocks: DataFrame, txs: DataFrame, stats: DataFrame, tokens: DataFrame, text: str, k: int) -> DataFrame:
    """(kind, value, label): up to k suggestions of each kind for a text typed by a user.

    Digits are a prefix of a block number; 0x begins a transaction hash and an address; all else is a prefix of a token's
    symbol or part of its name. % and _ are ordinary characters.
    """
    wanted = text.strip().lower()
    none = blocks.select(F.lit("").alias("kind"), F.lit("").alias("value"), F.lit("").alias("label")).limit(0)
    found = none
    if wanted.isdigit():
        number = F.col("number").cast("string")
        rows = top_k(blocks.where(number.startswith(wanted)), [F.asc("number")], k)
        found = found.unionByName(rows.select(F.lit("block").alias("kind"), number.alias("value"), F.concat(F.lit("Block "), number).alias("label")))
    elif wanted.startswith("0x"):
        for kind, df, column in (("transaction", txs, "hash"), ("address", stats, "address")):
            rows = top_k(df.where(F.col(column).startswith(wanted)).select(column), [F.asc(column)], k)
            found = found.unionByName(rows.select(F.lit(kind).alias("kind"), F.col(column).alias("value"), chain.short_label(F.col(column)).alias("label")))
    elif wanted:
        hit = F.lower("symbol").startswith(wanted) | F.coalesce(F.lower("name").contains(wanted), F.lit(False))
        rows = top_k(tokens.where(hit), [F.desc("holder_count"), F.asc("address")], k)
        label = F.concat_ws(" ", F.col("symbol"), F.concat(F.lit("("), F.col("name"), F.lit(")")))
        found = found.unionByName(rows.select(F.lit("token").alias("kind"), F.col("address").alias("value"), label.alias("label")))
    return found


def deposit_lookup(deposits: DataFrame, l1_hash: str | None = None, l2_hash: str | None = None) -> DataFrame:
    return deposits.where(F.col("l1_tx_hash") == l1_hash if l1_hash is not None else F.col("l2_tx_hash") == l2_hash)


def deposit_list(deposits: DataFrame, origin: str | None, l1_range: tuple[int | None, int | None], bound: tuple[int, str] | None, n: int) -> DataFrame:
    rows = deposits.where(between("l1_block", *l1_range) & before(["l1_block", "l2_tx_hash"], bound))
    rows = rows if origin is None else rows.where(F.col("origin") == origin)
    return top_k(rows, newest("l1_block", "l2_tx_hash"), n)


def counters_of(counters: DataFrame, addresses: DataFrame) -> DataFrame:
    return counters.join(addresses.select("address").distinct(), "address", "left_semi")


def sync_status(blocks: DataFrame, ranges: DataFrame, head: int) -> DataFrame:
    """Indexed head, open gaps, and whether the indexer is behind a chain's head."""
    one = blocks.agg(F.coalesce(F.max("number"), F.lit(0)).alias("indexed_head"))
    gaps = ranges.agg(F.count("*").alias("gaps"))
    return one.crossJoin(F.broadcast(gaps)).select(
        "indexed_head", "gaps", ((F.col("gaps") > 0) | (F.col("indexed_head") < head)).alias("is_syncing")
    )
