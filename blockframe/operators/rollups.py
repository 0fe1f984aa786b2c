"""Totals per chain, token and address; balances and ownership; rates and gas prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chain, u256
from ..functions.chain import ZERO_ADDRESS

#: Transaction types that count as sent by their sender (a fixed value of the chain's format).
COUNTED_TYPES = (0, 1, 2, 3, 4)


def tx_categories(txs: DataFrame, transfers: DataFrame) -> DataFrame:
    """txs with their category bits; whether a transaction moved a token is a join with distinct hashes."""
    moved = transfers.select(F.col("tx_hash").alias("hash")).distinct().withColumn("moved_", F.lit(True))
    joined = txs.join(moved, "hash", "left")
    bits = chain.category_bits(F.col("value"), F.col("to_address"), F.col("status"), F.col("input_data"), F.col("moved_").isNotNull())
    return joined.withColumn("categories", bits).drop("moved_")


def chain_counters(blocks: DataFrame, txs: DataFrame, transfers: DataFrame, stats: DataFrame, tokens: DataFrame) -> DataFrame:
    """(name, count) of the five tables; each count is a partial aggregate."""
    parts = {"blocks": blocks, "txs": txs, "transfers": transfers, "addresses": stats, "tokens": tokens}
    counts = [df.agg(F.count("*").alias("count")).select(F.lit(name).alias("name"), "count") for name, df in parts.items()]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole


def supply_of(value: Column, wide: bool) -> Column:
    """Minted less burned; from zero to zero nets nothing. Wide sums are cut off at 78 digits."""
    none = F.lit(None)
    minted = F.when(F.col("from_address") == ZERO_ADDRESS, value).otherwise(none)
    burned = F.when(F.col("to_address") == ZERO_ADDRESS, value).otherwise(none)
    return u256.sum_of(minted, wide, less=burned)


def token_totals(transfers: DataFrame, *keys: str) -> DataFrame:
    """Transfers and, for fungible tokens, supply of each token (and of each further key).

    The supply has the type of the amounts: decimals, or 256-bit integers as decoded transfers have them.
    """
    wide = u256.is_wide(transfers, "value")
    grouped = transfers.groupBy(*keys, "token_address").agg(
        F.count("*").alias("transfer_count"),
        supply_of(F.col("value"), wide).alias("net"),
        F.max((F.col("token_type") != "ERC20").cast("int")).alias("other"),
    )
    supply = F.when(F.col("other") == 0, F.col("net"))
    return grouped.select(*keys, "token_address", "transfer_count", supply.alias("supply"))


def address_contributions(txs: DataFrame, transfers: DataFrame, frames: DataFrame, contracts: DataFrame, *keys: str, by_block: bool = False) -> DataFrame:
    """A row for each way an address takes part: (address, tx, block, sent, internal, transfers, is_contract).

    Senders, recipients other than the sender, frame callers, frame targets other than the caller, transfer sides
    (a side that both ends share once, the zero address never), and created contracts. keys are further columns kept.
    With by_block each table is dealt by its block, unless it is so already, before its rows become two: a union of tables
    that are dealt alike stays so, and `address_stats` groups it by transactions where it lies.
    """
    no, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def side(address, sent=no, internal=no, moved=no, is_contract=False):
        return F.struct(
            address.alias("address"), sent.alias("sent"), internal.alias("internal"), moved.alias("moved"), F.lit(is_contract).alias("is_contract")
        )

    def part(df, tx, *sides):  # one pass over a table gives both of its sides; a side without an address is no row
        df = df.repartition("block_number") if by_block else df
        rows = df.select(*keys, tx.alias("tx"), F.col("block_number").cast("long").alias("block_number"), F.explode(F.array(*sides)).alias("side"))
        rows = rows.where(F.col("side.address").isNotNull())
        return rows.select(*keys, "side.address", "tx", "block_number", "side.sent", "side.internal", "side.moved", "side.is_contract")

    a, b = F.col("from_address"), F.col("to_address")
    other = F.when(~a.eqNullSafe(b), b)
    counted = F.col("tx_type").isin(*COUNTED_TYPES).cast("long")
    parts = [
        part(txs, F.col("hash"), side(a, sent=counted), side(other)),
        part(frames, F.col("tx_hash"), side(a, internal=one), side(other, internal=one)),
        part(transfers, F.col("tx_hash"), side(F.when(a != ZERO_ADDRESS, a), moved=one), side(F.when(b != ZERO_ADDRESS, other), moved=one)),
        part(contracts, F.lit(None).cast("string"), side(F.col("address"), is_contract=True)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def addresses(txs: DataFrame, transfers: DataFrame, frames: DataFrame) -> DataFrame:
    """(address), once, of all that take part, as `address_contributions` has them; what a frame creates is its target."""
    real = lambda c: F.when(F.col(c) != ZERO_ADDRESS, F.col(c))
    sides = [(txs, "from_address", "to_address"), (frames, "from_address", "to_address"), (transfers, real("from_address"), real("to_address"))]
    parts = [df.select(F.explode(F.array(a, b)).alias("address")) for df, a, b in sides]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("address").isNotNull()).distinct()


def address_stats(contributions: DataFrame, *keys: str) -> DataFrame:
    """Stats of each address (and further key) from its contributions.

    Grouped by (block, address, transaction) first, so that the distinct count needs no expanded rows, and a hot address is
    many groups before it is one. A transaction stands in one block; contributions that are dealt by block need no exchange
    for this grouping, and what is exchanged is a row per address of each task.
    """
    per_tx = contributions.groupBy(*keys, "block_number", "address", "tx").agg(
        F.sum("sent").alias("sent"), F.sum("internal").alias("internal"), F.sum("moved").alias("moved"), F.max("is_contract").alias("is_contract")
    )
    return per_tx.groupBy(*keys, "address").agg(
        F.count("tx").alias("tx_count"),
        F.sum("internal").alias("internal_tx_count"),
        F.sum("moved").alias("token_transfer_count"),
        F.sum("sent").alias("sent_count"),
        F.min("block_number").alias("first_seen"),
        F.max("block_number").alias("last_seen"),
        F.max("is_contract").alias("is_contract"),
    )


STAT_SUMS = ("tx_count", "internal_tx_count", "token_transfer_count", "sent_count")


def address_stats_merge(stats: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored stats with a batch's added: sums, least first block, greatest last, contract if either says so."""
    both = stats.unionByName(delta.select(stats.columns))
    return both.groupBy("address").agg(
        *(F.sum(c).alias(c) for c in STAT_SUMS),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.bool_or("is_contract").alias("is_contract"),
    )


def holder_count(tokens: DataFrame, balances: DataFrame) -> DataFrame:
    """(address, holder_count) of every token: addresses with a positive balance."""
    held = balances.where(F.col("balance") > u256.zero(u256.is_wide(balances, "balance"))).groupBy(F.col("token_address").alias("address")).agg(F.count("*").alias("n"))
    return tokens.select("address").join(held, "address", "left").select("address", F.coalesce("n", F.lit(0)).alias("holder_count"))


def holder_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(token_address, delta): by how much a batch of balances changes the holders of each token it touches."""
    keys = ["token_address", "address"]
    joined = new.select(*keys, "balance").join(old.select(*keys, F.col("balance").alias("was")), keys, "left")
    none = u256.zero(u256.is_wide(new, "balance"))
    change = (F.col("balance") > none).cast("long") - F.coalesce((F.col("was") > none).cast("long"), F.lit(0))
    return joined.groupBy("token_address").agg(F.sum(change).alias("delta"))


def nft_owners(transfers: DataFrame, uris: DataFrame | None = None) -> DataFrame:
    """(token_address, token_id, owner, block_number): who got each id last; a URI is kept from wherever it is known."""
    ids = transfers.where((F.col("token_type") == "ERC721") & F.col("token_id").isNotNull())
    place = F.struct("block_number", "log_index")
    owned = ids.groupBy("token_address", "token_id").agg(F.max_by("to_address", place).alias("owner"), F.max("block_number").alias("block_number"))
    return owned if uris is None else owned.join(uris, ["token_address", "token_id"], "left")


def nft_supply(nfts: DataFrame) -> DataFrame:
    live = F.when(F.col("owner") != ZERO_ADDRESS, 1)
    return nfts.groupBy("token_address").agg(F.count(live).alias("live_ids"))


def balance_changes(transfers: DataFrame) -> DataFrame:
    """(token_address, address, block_number, change) of fungible transfers; the zero address holds nothing."""
    wide = u256.is_wide(transfers, "value")
    rows = transfers.where(F.col("token_type") == "ERC20")
    sides = [
        F.struct(F.col("to_address").alias("address"), F.col("value").alias("change")),
        F.struct(F.col("from_address").alias("address"), u256.minus(F.col("value"), wide).alias("change")),
    ]
    both = rows.select("token_address", "block_number", F.explode(F.array(*sides)).alias("side"))
    return both.select("token_address", "side.address", "block_number", "side.change").where(F.col("address") != ZERO_ADDRESS)


def balances_from_transfers(transfers: DataFrame, history: bool = False) -> DataFrame:
    """Balances netted from transfers: the last of each key, or with history one row for each block that touched it.

    Balances have the type of the amounts. Wide ones are cut off at 78 digits. Without history changes are added up in one
    grouping, by task first, so that a hot key is a row of each task.
    """
    wide = u256.is_wide(transfers, "value")
    keys = ["token_address", "address"]
    changes = balance_changes(transfers)
    if not history:
        return changes.groupBy(*keys).agg(u256.sum_of(F.col("change"), wide).alias("balance"), F.max("block_number").alias("block_number"))
    per_block = changes.groupBy(*keys, "block_number").agg(u256.sum_of(F.col("change"), wide).alias("change"))
    upto = Window.partitionBy(*keys).orderBy("block_number").rowsBetween(Window.unboundedPreceding, 0)
    if not wide:
        return per_block.select(*keys, "block_number", F.sum("change").over(upto).cast("decimal(38,0)").alias("balance"))
    limbs = per_block.select(*keys, "block_number", *(F.sum(F.col("change")[f]).over(upto).alias(f) for f in ("hi", "mid", "lo")))
    return limbs.select(*keys, "block_number", u256.normalise(F.col("hi"), F.col("mid"), F.col("lo")).alias("balance"))


def current_balances(history: DataFrame) -> DataFrame:
    """The latest row of each (token, address)."""
    return history.groupBy("token_address", "address").agg(
        F.max_by("balance", "block_number").alias("balance"), F.max("block_number").alias("block_number")
    )


def balance_keys(transfers: DataFrame) -> DataFrame:
    """(token_address, address, block_number): keys touched, with the last block that did."""
    side = F.explode(F.array("from_address", "to_address")).alias("address")
    return (
        transfers.select("token_address", side, "block_number")
        .where(F.col("address") != ZERO_ADDRESS)
        .groupBy("token_address", "address")
        .agg(F.max("block_number").alias("block_number"))
    )


def counter_merge(stored: DataFrame, delta: DataFrame) -> DataFrame:
    return stored.unionByName(delta).groupBy("address", "type").agg(F.sum("count").alias("count"))


# --- rates and prices ----------------------------------------------------------------------------------------------


def chain_stats(counters: DataFrame, blocks: DataFrame, window: int = 100) -> DataFrame:
    """The counters on one row, with the mean gap of the newest blocks: (last - first) / (n - 1) seconds."""
    recent = blocks.select("number", "timestamp").orderBy(F.desc("number")).limit(window)
    gap = recent.agg(
        F.when(F.count("*") > 1, (F.max("timestamp") - F.min("timestamp")) / (F.count("*") - 1)).otherwise(0.0).alias("avg_block_time"),
        F.max("number").alias("latest_block"),
    )
    names = ("blocks", "txs", "transfers", "addresses", "tokens")
    wide = counters.agg(*(F.max(F.when(F.col("name") == n, F.col("count"))).alias(f"total_{n}") for n in names))
    return wide.crossJoin(F.broadcast(gap))


def tx_history(blocks: DataFrame, txs: DataFrame, as_of: int, width: int, n: int) -> DataFrame:
    """(bucket, tx_count): transactions of the n buckets up to as_of that hold blocks; blocks without any count 0."""
    first = as_of // width * width - (n - 1) * width
    recent = blocks.where((F.col("timestamp") >= first) & (F.col("timestamp") <= as_of)).select("number", "timestamp")
    counts = txs.where((F.col("block_timestamp") >= first) & (F.col("block_timestamp") <= as_of))
    counts = counts.groupBy(F.col("block_number").alias("number")).agg(F.count("*").alias("n"))
    bucket = F.floor(F.col("timestamp") / width) * width
    joined = recent.join(counts, "number", "left")
    return joined.groupBy(bucket.cast("long").alias("bucket")).agg(F.sum(F.coalesce("n", F.lit(0))).alias("tx_count")).orderBy("bucket")


def tx_history_day(daily: DataFrame, as_of: str, n: int) -> DataFrame:
    rows = daily.where((F.col("day") <= F.lit(as_of).cast("date")) & (F.col("day") > F.date_sub(F.lit(as_of).cast("date"), n)))
    return rows.select(F.col("day").alias("bucket"), F.col("tx_count")).orderBy("bucket")


def tx_history_week(daily: DataFrame, as_of: str, n: int) -> DataFrame:
    """By ISO weeks, which begin on Monday."""
    this = F.date_trunc("week", F.lit(as_of).cast("date")).cast("date")
    rows = daily.where((F.col("day") <= F.lit(as_of).cast("date")) & (F.col("day") >= F.date_sub(this, 7 * (n - 1))))
    week = F.date_trunc("week", F.col("day")).cast("date")
    return rows.groupBy(week.alias("bucket")).agg(F.sum("tx_count").alias("tx_count")).orderBy("bucket")


def gas_percentiles(txs: DataFrame, blocks: DataFrame, fractions: tuple[float, ...] = (0.35, 0.6, 0.9), sample: int = 10_000) -> DataFrame:
    """Interpolated percentiles of the newest priced transactions' gas price, rounded half to even, and the base fee."""
    priced = txs.where("gas_price > 0").orderBy(F.desc("block_number"), F.desc("tx_index")).limit(sample)
    points = priced.agg(F.percentile(F.col("gas_price").cast("double"), [float(f) for f in fractions]).alias("p"), F.count("*").alias("n"))
    fee = blocks.where("base_fee_per_gas is not null").agg(F.max_by("base_fee_per_gas", "number").alias("base_fee"))
    names = ("slow", "average", "fast")[: len(fractions)]
    return points.crossJoin(F.broadcast(fee)).select(
        *(F.coalesce(F.bround(F.get("p", F.lit(i))).cast("long"), F.lit(0)).alias(name) for i, name in enumerate(names)),
        F.coalesce("base_fee", F.lit(0)).cast("long").alias("base_fee"), F.col("n").alias("sampled"),
    )


def gas_tiers(percentiles: DataFrame) -> DataFrame:
    """(tier, gas_price, priority_fee) in gwei; the priority is what a price has above the base fee."""
    tiers = F.array(*(F.struct(F.lit(t).alias("tier"), F.col(t).alias("wei")) for t in ("slow", "average", "fast")))
    rows = percentiles.select("base_fee", F.explode(tiers).alias("t"))
    over = F.when(F.col("t.wei") > F.col("base_fee"), F.col("t.wei") - F.col("base_fee")).otherwise(0)
    return rows.select("t.tier", chain.gwei(F.col("t.wei")).alias("gas_price"), chain.gwei(over).alias("priority_fee"), chain.gwei(F.col("base_fee")).alias("base_fee"))


def ingest_rate(events: DataFrame, time_col: str, sums: dict[str, str]) -> DataFrame:
    """(hour, rows_per_second, and per second each sum) of a table by a timestamp column."""
    hour = F.date_trunc("hour", F.col(time_col))
    return events.groupBy(hour.alias("hour")).agg(
        (F.count("*") / 3600.0).alias("rows_per_second"), *((F.sum(c) / 3600.0).alias(name) for name, c in sums.items())
    )
