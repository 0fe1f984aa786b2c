"""Totals of a raw range in one pass: what a backfill needs of blocks that aren't stored row by row.

Raw bundles (a block with its transactions, receipts and traces) become tagged rows, (family, key1, key2, measures), within the
scan; one exchange by tag and key gives all sums. Five tables are then read from the result, which is as large as
the keys are many and not as the range is long: totals by span, additions to address stats, tokens first seen, parts of
days, and the balances to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import u256
from ..functions.chain import TRANSFER_TOPIC, ZERO_ADDRESS, hex_to_long, topic_address
from . import decode, rollups

FAMILIES = ("span", "span_token", "address", "token", "day", "pair", "active", "balance")
#: The families that day_parts reads; each other table reads one.
DAY_FAMILIES = ("day", "pair", "active")
COUNTS = tuple(f"c{i}" for i in range(1, 9))
_LIMBS = ("hi", "mid", "lo")
#: The measures and their types, and those that a family has; all others of it are null.
MEASURES = dict.fromkeys(COUNTS, "long") | {
    "price": "decimal(38,0)", "amount": u256.TYPE, "lo": "long", "hi": "long", "flag": "boolean", "first": "struct<block:long,log_index:long,tx:string>",
}
_HAS = {
    "span": ("c1", "c2", "c3"), "span_token": ("c1", "amount", "flag"), "address": ("c1", "c2", "c3", "c4", "lo", "hi", "flag"), "token": ("flag", "first"),
    "day": (*COUNTS, "price", "lo"), "pair": ("lo", "hi"), "active": (), "balance": ("hi",),
}


def _measures(families: tuple[str, ...]) -> list[str]:
    """The measures that some of the families have."""
    return [m for m in MEASURES if any(m in _HAS[f] for f in families)]


def _decoded(raw: DataFrame, size: int, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """A row per block: its fields, transactions, transfers and frames as arrays of what the families need of them."""
    valued = "amount" in _measures(families)
    lower = lambda c: F.lower(c)
    none = lambda kind: F.array().cast(kind)

    def tx(t: Column) -> Column:
        return F.struct(lower(t["hash"]).alias("hash"), lower(t["from"]).alias("a"), lower(t["to"]).alias("b"), F.coalesce(hex_to_long(t["type"]), F.lit(0)).alias("type"), F.coalesce(hex_to_long(t["gasPrice"]), F.lit(0)).alias("price"))

    def transfers(r: Column) -> Column:
        moved = F.filter(r["logs"], lambda g: (F.lower(F.get(g["topics"], F.lit(0))) == TRANSFER_TOPIC) & F.get(g["topics"], F.lit(2)).isNotNull())

        def one(g: Column) -> Column:
            nft = F.get(g["topics"], F.lit(3)).isNotNull()
            data = F.when(F.coalesce(g["data"], F.lit("0x")).isin("", "0x"), F.lit("0x0")).otherwise(F.left(g["data"], F.lit(66)))
            sender, receiver = (topic_address(F.lower(F.get(g["topics"], F.lit(i)))) for i in (1, 2))
            value = [F.when(nft, u256.literal(1)).otherwise(u256.from_hex(data)).alias("value")] if valued else []  # the costliest to read
            return F.struct(lower(r["transactionHash"]).alias("tx"), lower(g["address"]).alias("token"), sender.alias("a"), receiver.alias("b"), hex_to_long(g["logIndex"]).alias("log_index"), nft.alias("nft"), *value)

        return F.transform(F.coalesce(moved, none(raw.schema["receipts"].dataType.elementType["logs"].dataType.simpleString())), one)

    def frames(t: Column) -> Column:
        text = lambda n, path: F.try_variant_get(n["frame"], path, "string")

        def one(n: Column) -> Column:
            made = F.lower(text(n, "$.type")).isin("create", "create2") & (F.length(text(n, "$.output")) > 2)
            return F.struct(lower(t["txHash"]).alias("tx"), n["path"].alias("path"), lower(text(n, "$.from")).alias("a"), lower(text(n, "$.to")).alias("b"), F.coalesce(made, F.lit(False)).alias("made"), text(n, "$.error").isNotNull().alias("failed"))

        return F.transform(decode.frame_nodes(t["frame"], root=True, lists=t["lists"]), one)

    receipts = F.coalesce("receipts", none(raw.schema["receipts"].dataType.simpleString()))
    whole = F.filter(F.coalesce("traces", none(raw.schema["traces"].dataType.simpleString())), lambda t: t["error"].isNull())
    traces = F.transform(whole, lambda t: F.struct(t["txHash"].alias("txHash"), F.try_parse_json(t["result"]).alias("frame"), decode.lists_in(t["result"]).alias("lists")))  # each text is parsed once
    traces = F.filter(traces, lambda t: t["frame"].isNotNull())
    number, time = hex_to_long(F.col("number")), hex_to_long(F.col("timestamp"))
    state = lambda s: F.size(F.filter(receipts, lambda r: hex_to_long(r["status"]) == s)).cast("long")
    return raw.select(
        number.alias("number"), time.alias("time"), F.floor(time / 86_400).cast("string").alias("day"), (F.floor(number / size) * size).cast("string").alias("span"),
        F.coalesce(hex_to_long(F.col("gasUsed")), F.lit(0)).alias("gas_used"), hex_to_long(F.col("size")).alias("size"),
        F.transform(F.coalesce("transactions", none(raw.schema["transactions"].dataType.simpleString())), tx).alias("txs"),
        F.flatten(F.transform(receipts, transfers)).alias("transfers"), F.transform(traces, frames).alias("frames"), state(1).alias("success"), state(0).alias("failed"),
    )


def _tagged(blocks: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """(family, key1, key2, measures that they have) of the families, exploded from each block at once."""
    no, measures = F.lit(None), _measures(families)

    def tag(family: str, key1: Column, key2: Column = no, **has: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), key1.alias("key1"), key2.cast("string").alias("key2"), *(has.get(m, no).cast(MEASURES[m]).alias(m) for m in measures))

    one, number, span, day = F.lit(1).cast("long"), F.col("number"), F.col("span"), F.col("day")
    txs, moves = F.col("txs"), F.col("transfers")
    size = lambda c: F.size(c).cast("long")
    price = F.aggregate(txs, F.lit(0).cast("decimal(38,0)"), lambda a, t: (a + t["price"]).cast("decimal(38,0)"))
    # frames below the root take part; created contracts are those that no failed frame encloses
    below = F.flatten(F.transform("frames", lambda fs: F.filter(fs, lambda f: f["path"] != "")))
    around = lambda f, e: (e["path"] == "") | F.startswith(f["path"], F.concat(e["path"], F.lit(",")))
    lasting = lambda fs: F.filter(fs, lambda f: (f["path"] != "") & f["made"] & ~f["failed"] & f["b"].isNotNull() & ~F.exists(F.filter(fs, lambda e: e["failed"]), lambda e: around(f, e)))
    made = F.flatten(F.transform("frames", lasting))
    both = lambda x: F.filter(F.array_distinct(F.array(x["a"], x["b"])), lambda v: v.isNotNull())
    each = lambda rows, f: F.flatten(F.transform(rows, lambda x: F.transform(both(x), lambda v: f(x, v))))
    pair = lambda tx: lambda x, v: F.concat_ws(" ", v, x[tx])
    held = lambda x: F.filter(both(x), lambda v: v != ZERO_ADDRESS)
    moved = F.flatten(F.transform(moves, lambda x: F.transform(held(x), lambda v: F.concat_ws(" ", v, x["tx"]))))
    pairs = F.array_distinct(F.concat(each(txs, pair("hash")), each(below, pair("tx")), moved))
    at = {"lo": number, "hi": number}
    mint = lambda x: F.when(x["a"] == ZERO_ADDRESS, F.when(x["b"] != ZERO_ADDRESS, x["value"])).when(x["b"] == ZERO_ADDRESS, u256.negate(x["value"]))
    place = lambda x: F.struct(number.alias("block"), x["log_index"].alias("log_index"), x["tx"].alias("tx"))
    rows = {  # each made only if it is wanted
        "span": lambda: [F.array(tag("span", span, c1=one, c2=size(txs), c3=size(moves)))],
        "day": lambda: [
            F.array(tag("day", day, c1=one, c2=F.col("gas_used"), c3=F.col("size"), c4=F.col("size").isNotNull().cast("long"), c5=size(txs), c6=F.col("success"), c7=F.col("failed"), c8=size(moves), price=price, lo=number))
        ],
        "pair": lambda: [F.array(tag("pair", number.cast("string"), lo=F.col("time")), tag("pair", (number + 1).cast("string"), hi=F.col("time")))],
        "span_token": lambda: [F.transform(moves, lambda x: tag("span_token", span, x["token"], c1=one, amount=mint(x), flag=x["nft"]))],
        "token": lambda: [F.transform(moves, lambda x: tag("token", x["token"], flag=x["nft"], first=place(x)))],
        "balance": lambda: [F.flatten(F.transform(moves, lambda x: F.transform(held(x), lambda v: tag("balance", x["token"], v, hi=number))))],
        "address": lambda: [
            F.transform(pairs, lambda p: tag("address", F.substring_index(p, " ", 1), c1=one, **at)),
            F.transform(F.filter(txs, lambda t: t["type"].isin(*rollups.COUNTED_TYPES)), lambda t: tag("address", t["a"], c4=one, **at)),
            each(below, lambda _, v: tag("address", v, c2=one, **at)),
            F.flatten(F.transform(moves, lambda x: F.transform(held(x), lambda v: tag("address", v, c3=one, **at)))),
            F.transform(made, lambda f: tag("address", f["b"], flag=F.lit(True), **at)),
        ],
        "active": lambda: [F.transform(F.array_distinct(F.flatten(F.transform(txs, both))), lambda v: tag("active", day, v))],
    }
    wanted = [part for family in FAMILIES if family in families for part in rows[family]()]
    return blocks.select(F.explode(F.concat(*wanted)).alias("r")).select("r.*")


def totals(raw: DataFrame, size: int, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(family, key1, key2, sums) of raw bundles: one scan, one exchange. Each block is to be there once.

    families are those that are wanted: of the others nothing is decoded, exchanged or kept.
    """
    tagged, held = _tagged(_decoded(raw, size, families), families), _measures(families)
    added = {c: F.sum(c) for c in COUNTS} | {
        "price": F.sum("price").cast("decimal(38,0)"), "amount": F.struct(*(F.sum(F.col("amount")[f]).alias(f) for f in _LIMBS)),
        "lo": F.min("lo"), "hi": F.max("hi"), "flag": F.bool_or("flag"), "first": F.min("first"),
    }
    unknown = F.lit(None)
    none = {"amount": F.struct(*(unknown.cast("decimal(36,0)").alias(f) for f in _LIMBS))}  # the type of a sum
    sums = tagged.groupBy("family", "key1", "key2").agg(*(added[m].alias(m) for m in held)) if held else tagged.select("family", "key1", "key2").distinct()
    return sums.select("family", "key1", "key2", *(F.col(m) if m in held else none.get(m, unknown.cast(MEASURES[m])).alias(m) for m in MEASURES))


def _of(sums: DataFrame, family: str) -> DataFrame:
    return sums.where(F.col("family") == family)


def spans(sums: DataFrame) -> DataFrame:
    """(span_lo, blocks, txs, transfers)."""
    return _of(sums, "span").select(F.col("key1").cast("long").alias("span_lo"), F.col("c1").alias("blocks"), F.col("c2").alias("txs"), F.col("c3").alias("transfers"))


def span_tokens(sums: DataFrame) -> DataFrame:
    """(span_lo, token_address, transfer_count, supply); the supply, a 256-bit integer, of fungible tokens only."""
    zero = F.lit(0)
    net = u256.normalise(*(F.coalesce(F.col("amount")[f], zero.cast("decimal(38,0)")) for f in ("hi", "mid", "lo")))
    return _of(sums, "span_token").select(F.col("key1").cast("long").alias("span_lo"), F.col("key2").alias("token_address"), F.col("c1").alias("transfer_count"), F.when(~F.col("flag"), net).alias("supply"))


def address_deltas(sums: DataFrame) -> DataFrame:
    """What the range adds to address stats, for address_stats_merge."""
    count = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return _of(sums, "address").select(
        F.col("key1").alias("address"), count("c1", "tx_count"), count("c2", "internal_tx_count"), count("c3", "token_transfer_count"), count("c4", "sent_count"),
        F.col("lo").alias("first_seen"), F.col("hi").alias("last_seen"), F.coalesce("flag", F.lit(False)).alias("is_contract"),
    )


def tokens_seen(sums: DataFrame) -> DataFrame:
    """(address, token_type, block_number, creation_tx) of each token's first transfer in the range."""
    return _of(sums, "token").select(F.col("key1").alias("address"), F.when(F.col("flag"), "ERC721").otherwise("ERC20").alias("token_type"), F.col("first.block").alias("block_number"), F.col("first.tx").alias("creation_tx"))


def day_parts(sums: DataFrame) -> DataFrame:
    """The additive columns of each day and its distinct addresses; gaps within the range only."""
    days = _of(sums, "day").select(
        F.col("key1").alias("d"), F.col("c1").alias("blocks"), F.col("c2").alias("gas_used"), F.coalesce("c3", F.lit(0)).alias("size_sum"), F.col("c4").alias("size_n"), F.col("c5").alias("tx_count"),
        F.col("price").alias("price_sum"), F.col("c6").alias("success"), F.col("c7").alias("failed"), F.col("c8").alias("transfer_count"), F.col("lo").alias("first_block"),
    )
    # a row per block, of what was summed; and one per day and address
    gap = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.col("lo") - F.col("hi"))
    gaps = _of(sums, "pair").select(F.floor(F.col("lo") / 86_400).cast("string").alias("d"), gap.alias("gap")).where("gap is not null")
    gaps = gaps.groupBy("d").agg(F.sum("gap").alias("gap_sum"), F.count("*").alias("gap_n"))
    active = _of(sums, "active").groupBy(F.col("key1").alias("d")).agg(F.count("*").alias("active_addresses"))
    joined = days.join(gaps, "d", "left").join(active, "d", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gap_sum", "gap_n", "active_addresses")}
    return joined.withColumns(zero).withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int"))).drop("d")


def balance_keys(sums: DataFrame) -> DataFrame:
    """(token_address, address, block_number): balances to read, at the last block that touched them."""
    return _of(sums, "balance").select(F.col("key1").alias("token_address"), F.col("key2").alias("address"), F.col("hi").alias("block_number"))


def write_totals(raw: DataFrame, path: str, size: int, families: tuple[str, ...] = FAMILIES) -> None:
    """totals as Parquet, a folder per family, so that each table reads its own: written by the tasks that add them up."""
    totals(raw, size, families).write.partitionBy("family").parquet(path)
