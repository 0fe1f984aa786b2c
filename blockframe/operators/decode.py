"""Raw blocks, receipts and traces decoded into tables; new rows appended once; contracts and tokens discovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chain, u256
from ..functions.chain import TRANSFER_TOPIC, ZERO_ADDRESS, hex_to_long, topic_address

CALL_TYPES = ("call", "delegatecall", "staticcall", "callcode", "create", "create2", "selfdestruct", "suicide")


# --- projections of raw input --------------------------------------------------------------------------------------


def blocks_from_raw(raw: DataFrame) -> DataFrame:
    q = lambda c: hex_to_long(F.col(c))
    return raw.select(
        q("number").alias("number"), F.lower("hash").alias("hash"), F.lower("parentHash").alias("parent_hash"), q("timestamp").alias("timestamp"),
        q("gasUsed").alias("gas_used"), q("gasLimit").alias("gas_limit"), q("baseFeePerGas").alias("base_fee_per_gas"),
        F.size(F.coalesce("transactions", F.array().cast(raw.schema["transactions"].dataType))).alias("transaction_count"), q("size").alias("size"),
        u256.to_decimal(u256.from_hex(F.col("difficulty"))).alias("difficulty"), u256.to_decimal(u256.from_hex(F.col("totalDifficulty"))).alias("total_difficulty"),
        F.col("nonce"), F.lower("miner").alias("miner"), F.col("extraData").alias("extra_data"),
    )


def txs_from_raw(raw: DataFrame) -> DataFrame:
    """A row per transaction; a missing value, nonce or gas price is 0, a missing type too."""
    rows = raw.select(hex_to_long(F.col("number")).alias("block_number"), hex_to_long(F.col("timestamp")).alias("block_timestamp"), F.posexplode("transactions").alias("i", "t"))
    q = lambda c: hex_to_long(F.col(f"t.{c}"))
    return rows.select(
        F.lower("t.hash").alias("hash"), "block_number", "block_timestamp", F.coalesce(q("transactionIndex").cast("int"), F.col("i")).alias("tx_index"),
        F.lower("t.from").alias("from_address"), F.lower("t.to").alias("to_address"), u256.from_hex(F.coalesce("t.value", F.lit("0x0"))).alias("value"),
        F.coalesce(q("gas"), F.lit(0)).alias("gas_limit"), F.coalesce(q("gasPrice"), F.lit(0)).alias("gas_price"), q("maxFeePerGas").alias("max_fee_per_gas"),
        q("maxPriorityFeePerGas").alias("max_priority_fee_per_gas"), F.coalesce(q("nonce"), F.lit(0)).alias("nonce"),
        F.coalesce(q("type"), F.lit(0)).cast("int").alias("tx_type"), F.col("t.input").alias("input_data"),
    )


def logs_from_receipts(receipts: DataFrame) -> DataFrame:
    """A row per log with up to four topics; what a log has fewer of is null."""
    rows = receipts.select(F.lower("transactionHash").alias("tx_hash"), hex_to_long(F.col("blockNumber")).alias("block_number"), F.explode("logs").alias("l"))
    return rows.select(
        "tx_hash", "block_number", hex_to_long(F.col("l.logIndex")).cast("int").alias("log_index"), F.lower("l.address").alias("address"),
        *(F.lower(F.get("l.topics", F.lit(i))).alias(f"topic{i}") for i in range(4)), F.col("l.data").alias("data"), F.coalesce("l.removed", F.lit(False)).alias("removed"),
    )


def receipt_attach(txs: DataFrame, receipts: DataFrame, skip_types: tuple[int, ...] = ()) -> DataFrame:
    """txs(hash, gas_limit, tx_type) with gas_used, status and error of their receipts(hash, gas_used, status).

    No receipt, or a type that is skipped: the gas limit was used and it succeeded.
    """
    got = receipts.select("hash", F.col("gas_used").alias("r_gas"), F.col("status").alias("r_status"))
    joined = txs.join(got, "hash", "left")
    known = F.col("r_status").isNotNull() if not skip_types else F.col("r_status").isNotNull() & ~F.col("tx_type").isin(*skip_types)
    status = F.when(known, F.col("r_status")).otherwise(1)
    return joined.withColumns(
        {"gas_used": F.when(known, F.col("r_gas")).otherwise(F.col("gas_limit")), "status": status, "error": F.when(status == 0, F.lit("transaction failed"))}
    ).drop("r_gas", "r_status")


def receipt_incomplete(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """(block_number, missing): blocks of which some transaction has no receipt."""
    return txs.join(receipts.select("hash"), "hash", "left_anti").groupBy("block_number").agg(F.count("*").alias("missing"))


def logs_as_receipts(logs: DataFrame) -> DataFrame:
    """(tx_hash, status, logs): a receipt of logs only for each transaction that has any, in log order."""
    item = F.struct("log_index", "address", "topic0", "data")
    return logs.groupBy("tx_hash").agg(F.lit(1).alias("status"), F.sort_array(F.collect_list(item)).alias("logs"))


# --- transfers -----------------------------------------------------------------------------------------------------


def transfer_decode(logs: DataFrame) -> DataFrame:
    """Token transfers of Transfer logs with three topics (an amount in the data) or four (an id in the last)."""
    rows = logs.where((F.col("topic0") == TRANSFER_TOPIC) & F.col("topic2").isNotNull())
    nft = F.col("topic3").isNotNull()
    amount = u256.from_hex(F.when(F.coalesce(F.col("data"), F.lit("0x")).isin("", "0x"), F.lit("0x0")).otherwise(F.left(F.col("data"), F.lit(66))))
    sender, receiver = topic_address(F.col("topic1")), topic_address(F.col("topic2"))
    kind = F.when(sender == ZERO_ADDRESS, "mint").when(receiver == ZERO_ADDRESS, "burn").otherwise("transfer")
    return rows.select(
        "tx_hash", "block_number", "log_index", F.col("address").alias("token_address"), sender.alias("from_address"), receiver.alias("to_address"),
        F.when(nft, u256.literal(1)).otherwise(amount).alias("value"), F.when(nft, u256.from_hex(F.col("topic3"))).alias("token_id"),
        F.when(nft, "ERC721").otherwise("ERC20").alias("token_type"), kind.alias("transfer_type"),
    )


def transfer_logs(transfers: DataFrame, *keys: str) -> DataFrame:
    """The Transfer log of each transfer: decoding it gives the transfer again. Values are decimal(38,0) or longs.

    keys are further columns kept.
    """

    def word(value: Column) -> Column:  # 32 bytes of hex, from two halves below 2^63 each
        whole = value.cast("decimal(38,0)")
        low = F.pmod(whole, F.expr("cast('1000000000000' as decimal(38,0))"))
        return F.lpad(F.hex((whole - low).cast("decimal(38,0)").cast("long") + low.cast("long")), 64, "0")

    padded = lambda c: F.concat(F.lit("0x"), F.lpad(F.substring(c, 3, 40), 64, "0"))
    nft = F.col("token_type") == "ERC721"
    return transfers.select(
        "tx_hash", "block_number", "log_index", F.col("token_address").alias("address"), F.lit(TRANSFER_TOPIC).alias("topic0"),
        padded("from_address").alias("topic1"), padded("to_address").alias("topic2"),
        F.when(nft, F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("token_id").cast("long"))), 64, "0"))).alias("topic3"),
        F.when(nft, F.lit("0x")).otherwise(F.concat(F.lit("0x"), F.lower(word(F.col("value"))))).alias("data"), "timestamp", *keys,
    )


# --- appending -----------------------------------------------------------------------------------------------------


def append_new(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: each key once, and none that is stored. Running it again on the result appends nothing."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def log_key_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(block_number, log_index, tx_hash, stored_tx): the same place held by another transaction's log."""
    held = stored.select("block_number", "log_index", F.col("tx_hash").alias("stored_tx"))
    joined = new.select("block_number", "log_index", "tx_hash").join(held, ["block_number", "log_index"])
    return joined.where(F.col("tx_hash") != F.col("stored_tx"))


def block_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(number, hash, stored_hash): the same number with another hash is a fork."""
    held = stored.select("number", F.col("hash").alias("stored_hash"))
    return new.select("number", "hash").join(held, "number").where(F.col("hash") != F.col("stored_hash"))


def lowercase_addresses(df: DataFrame, columns: list[str], keys: list[str], order: list[Column]) -> DataFrame:
    """df with the columns lower-cased, and of rows that then share their keys the first of an order."""
    lowered = df.withColumns({c: F.lower(c) for c in columns})
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return lowered.withColumn("first_", first).where("first_ = 1").drop("first_")


# --- call frames and contracts -------------------------------------------------------------------------------------


def lists_in(json: Column) -> Column:
    """A bound on how deep lists are nested in a JSON text, found in one pass: how many begin, those in texts too."""
    return F.length(json) - F.length(F.replace(json, F.lit("["), F.lit("")))


def frame_nodes(frame: Column, root: bool = False, lists: Column | None = None) -> Column:
    """The frames of a trace (a variant) with their paths, level by level, the root first if it is wanted.

    lists is a bound on how deep its lists are nested, if the caller has one.

    The tree is walked down in one expression, as often as its lists are nested, or a little more; once a level is empty a
    step only passes on what was found.
    """
    nodes = "array<struct<path:string,frame:variant>>"

    def children(node: Column) -> Column:
        calls = F.coalesce(F.try_variant_get(node["frame"], "$.calls", "array<variant>"), F.array().cast("array<variant>"))
        path = lambda i: F.when(node["path"] == "", i.cast("string")).otherwise(F.concat_ws(",", node["path"], i.cast("string")))
        return F.transform(calls, lambda frame, i: F.struct(path(i).alias("path"), frame.alias("frame")))

    def down(state: Column, _: Column) -> Column:
        level = F.flatten(F.transform(state["level"], children)).cast(nodes)
        below = F.transform(F.array(level), lambda one: F.struct(one.alias("level"), F.concat(state["found"], one).cast(nodes).alias("found")))[0]
        return F.when(F.size(state["level"]) == 0, state).otherwise(below)

    top = F.array(F.struct(F.lit("").alias("path"), frame.alias("frame"))).cast(nodes)
    start = F.struct(top.alias("level"), (top if root else F.array().cast(nodes)).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), (_nested(F.to_json(frame)) if lists is None else lists) + 1), start, down)["found"]


#: Levels of lists that are peeled off a text before those that are left are counted.
_PEELED = 12


def _nested(json: Column) -> Column:
    """A bound on how deep lists are nested in a JSON text: each step takes the innermost ones away, all others count one."""
    lists = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]]+", "")
    for _ in range(_PEELED):
        lists = F.replace(lists, F.lit("[]"), F.lit(""))
    return F.length(F.replace(lists, F.lit("]"), F.lit(""))) + _PEELED


def flatten_frames(traces: DataFrame) -> DataFrame:
    """A row for each frame below a trace's root: (tx_hash, block_number, timestamp, trace_address, ...).

    Frames are variants. Empty input and output, and zero gas, are null; an unknown call type is `call`. A call tree of any
    depth and width is read in one pass without an exchange.
    """
    text = lambda path: F.try_variant_get("frame", path, "string")
    blank = lambda c: F.when(c.isin("", "0x"), None).otherwise(c)
    gas = lambda path: F.nullif(hex_to_long(text(path)), F.lit(0).cast("long"))
    found = frame_nodes(F.col("frame"))
    found = traces.select("tx_hash", "block_number", "timestamp", F.explode(found).alias("n"))
    found = found.select("tx_hash", "block_number", "timestamp", F.col("n.path").alias("trace_address"), F.col("n.frame").alias("frame"))
    kind = F.lower(text("$.type"))
    return found.select(
        "tx_hash", "block_number", "timestamp", "trace_address", F.lower(text("$.from")).alias("from_address"), F.lower(text("$.to")).alias("to_address"),
        F.coalesce(text("$.value"), F.lit("0x0")).alias("value"), gas("$.gas").alias("gas"), gas("$.gasUsed").alias("gas_used"),
        blank(text("$.input")).alias("input"), blank(text("$.output")).alias("output"),
        F.when(kind.isin(*CALL_TYPES), kind).otherwise("call").alias("call_type"), text("$.error").alias("error"),
    )


def internal_creations(frames: DataFrame) -> DataFrame:
    """Creations below the root that lasted: no error of their own, a target, and no frame around them that failed.

    "Around" is a prefix of the path; each creation's enclosing paths are listed beside the failed frames, and meet them by
    equality. Frames are read once, and exchanged once: by their block if they have one, in which their transaction stands, so
    that frames which are dealt by block stay where they lie, else by their transaction.
    """
    tx = ["block_number", "tx_hash"] if "block_number" in frames.columns else ["tx_hash"]
    failed = F.col("error").isNotNull()
    made = F.col("call_type").isin("create", "create2") & (F.col("trace_address") != "") & ~failed & F.col("to_address").isNotNull()
    paths = F.when(failed, F.array("trace_address")).otherwise(chain.enclosing_paths(F.col("trace_address")))
    listed = frames.where(failed | made).repartition(tx[0]).select(*frames.columns, F.posexplode(paths).alias("place_", "around_"))
    met = listed.withColumn("undone_", F.bool_or(failed & F.col("tx_hash").isNotNull()).over(Window.partitionBy(*tx, "around_"))).where(~failed)
    met = met.withColumn("undone_", F.bool_or("undone_").over(Window.partitionBy(*tx, "trace_address")))
    return met.where(~F.col("undone_") & (F.col("place_") == 0)).select(*frames.columns)


def contracts_from_frames(frames: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts that lasting creations made and that aren't stored; the earliest of each address."""
    rows = internal_creations(frames).where(F.col("output").isNotNull() & (F.length("output") > 2))
    place = Window.partitionBy("address").orderBy("block_number", "tx_hash", "trace_address")
    made = rows.select(
        F.col("to_address").alias("address"), F.regexp_replace("output", "^0[xX]", "").alias("bytecode"), chain.bytecode_hash(F.col("output")).alias("bytecode_hash"),
        F.col("from_address").alias("creator"), F.col("tx_hash").alias("creation_tx"), "block_number", "trace_address", "tx_hash",
    )
    first = made.withColumn("n", F.row_number().over(place)).where("n = 1").drop("n", "trace_address", "tx_hash")
    return first.join(contracts.select("address"), "address", "left_anti")


def contracts_from_receipts(txs: DataFrame, receipts: DataFrame, codes: DataFrame) -> DataFrame:
    """Contracts of creating transactions: no recipient, an address in the receipt, not failed, and code there."""
    made = txs.where(F.col("to_address").isNull()).select("hash", "from_address", "block_number")
    got = receipts.where(F.col("contract_address").isNotNull() & (F.col("status") != 0)).select("hash", F.lower("contract_address").alias("address"))
    joined = made.join(got, "hash").join(codes, "address").where(F.col("code").isNotNull() & ~F.col("code").isin("", "0x"))
    return joined.select(
        "address", F.regexp_replace("code", "^0[xX]", "").alias("bytecode"), chain.bytecode_hash(F.col("code")).alias("bytecode_hash"),
        F.col("from_address").alias("creator"), F.col("hash").alias("creation_tx"), "block_number",
    )


def creations_report(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(address, status): of contracts listed elsewhere and those found in frames."""
    a = listed.select("address", F.lit(True).alias("is_listed")).distinct()
    b = found.select("address", F.lit(True).alias("is_found")).distinct()
    status = F.when(F.col("is_listed") & F.col("is_found"), "written").when(F.col("is_listed"), "listed but not created").otherwise("found but not listed")
    return a.join(b, "address", "full_outer").select("address", status.alias("status"))


# --- deposits and call results -------------------------------------------------------------------------------------


def deposit_decode(l1_logs: DataFrame) -> DataFrame:
    """Deposits of portal events: data is (offset, length, mint 32, value 32, gas 8, creation 1, payload).

    What is too short for its stated length, or for the fixed fields, is dropped; a creation has no recipient.
    """
    digits = F.regexp_replace("data", "^0[xX]", "")
    length = F.conv(F.substring(digits, 65 + 48, 16), 16, 10).cast("long")  # the low eight bytes of the length word
    rows = l1_logs.withColumn("d_", digits).withColumn("n_", length)
    rows = rows.where((F.length("d_") >= 128) & (F.col("n_") >= 73) & (F.length("d_") >= 128 + 2 * F.col("n_")) & F.col("topic2").isNotNull())
    at = lambda start, size: F.substring(F.col("d_"), 129 + 2 * start, 2 * size)
    creation = at(72, 1) != "00"
    payload = F.expr("substring(d_, 129 + 146, 2 * (n_ - 73))")
    return rows.select(
        "tx_hash", "block_number", "log_index", topic_address(F.col("topic1")).alias("from_address"),
        F.when(~creation, topic_address(F.col("topic2"))).alias("to_address"), u256.from_hex(at(0, 32)).alias("mint"), u256.from_hex(at(32, 32)).alias("value"),
        hex_to_long(at(64, 8)).alias("gas_limit"), creation.alias("is_creation"), F.concat(F.lit("0x"), payload).alias("payload"),
    )


def abi_string(result: Column) -> Column:
    """The string of a call result in hex: (offset 32, length 32, bytes), or short data read as it is; ends at a NUL."""
    digits = F.regexp_replace(result, "^0[xX]", "")
    length = F.least(F.conv(F.substring(digits, 65 + 48, 16), 16, 10).cast("long"), (F.length(digits) - 128) / 2)
    long_form = F.substr(digits, F.lit(129), (2 * F.greatest(length, F.lit(0))).cast("int"))
    raw = F.when(F.length(digits) >= 128, long_form).otherwise(digits)
    return F.when(digits == "", "").otherwise(F.substring_index(F.unhex(raw).cast("string"), "\0", 1))


# --- tokens --------------------------------------------------------------------------------------------------------


def token_discovery(transfers: DataFrame, tokens: DataFrame) -> DataFrame:
    """(address, token_type, decimals, block_number, creation_tx) of tokens seen first; any id makes one non-fungible."""
    unseen = transfers.join(tokens.select(F.col("address").alias("token_address")), "token_address", "left_anti")
    place = F.struct("block_number", "log_index")
    rows = unseen.groupBy("token_address").agg(
        F.bool_or(F.col("token_type") == "ERC721").alias("nft"), F.min("block_number").alias("block_number"), F.min_by("tx_hash", place).alias("creation_tx")
    )
    return rows.select(
        F.col("token_address").alias("address"), F.when(F.col("nft"), "ERC721").otherwise("ERC20").alias("token_type"),
        F.when(F.col("nft"), 0).otherwise(18).alias("decimals"), "block_number", "creation_tx",
    )


def token_merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Tokens after an upsert: new metadata where there is some, a type promoted from ERC20 but never back, and the
    earlier creation."""
    s, n = (df.select("address", F.struct(*(c for c in df.columns if c != "address")).alias(a)) for df, a in ((stored, "s"), (new, "n")))
    joined = s.join(n, "address", "full_outer")
    newer = lambda c: F.coalesce(f"n.{c}", f"s.{c}").alias(c)
    both = F.col("s.token_type").isNotNull() & F.col("n.token_type").isNotNull()
    kind = F.when(both & (F.col("s.token_type") != "ERC20"), F.col("s.token_type")).otherwise(F.coalesce("n.token_type", "s.token_type"))
    earlier = F.col("s.block_number").isNull() | (F.col("n.block_number") < F.col("s.block_number"))
    return joined.select(
        "address", kind.alias("token_type"), newer("symbol"), newer("name"), newer("decimals"),
        F.when(earlier, F.col("n.block_number")).otherwise(F.col("s.block_number")).alias("block_number"),
        F.when(earlier, F.col("n.creation_tx")).otherwise(F.col("s.creation_tx")).alias("creation_tx"),
    )


# --- views at the edge ---------------------------------------------------------------------------------------------


def address_view(stats: DataFrame, blocks: DataFrame) -> DataFrame:
    """Stats as a reader sees them: blocks become times, and received is what isn't sent, never below zero."""
    times = blocks.select("number", F.timestamp_seconds("timestamp").alias("at"))
    first = times.select(F.col("number").alias("first_seen"), F.col("at").alias("first_seen_at"))
    last = times.select(F.col("number").alias("last_seen"), F.col("at").alias("last_seen_at"))
    received = chain.floor_zero(F.col("tx_count") - F.col("sent_count"))
    return stats.join(first, "first_seen", "left").join(last, "last_seen", "left").select(
        "address", "tx_count", "sent_count", received.alias("received_count"), "first_seen_at", "last_seen_at", "is_contract"
    )


def log_view(logs: DataFrame) -> DataFrame:
    """Logs with their topics as one array without nulls, and no time where it is unset."""
    topics = F.array_compact(F.array("topic0", "topic1", "topic2", "topic3"))
    return logs.select("tx_hash", "block_number", "log_index", "address", topics.alias("topics"), "data", F.timestamp_seconds(F.nullif("timestamp", F.lit(0).cast("long"))).alias("at"))
