"""Scalar functions over chain columns; all are Column to Column and stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the chain: the zero address, and topic 0 of a token transfer.
ZERO_ADDRESS = "0x" + "0" * 40
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
#: Bits of a transaction's categories, and their labels in order.
CATEGORY_BITS = {"coin_transfer": 1, "contract_creation": 2, "contract_call": 4, "token_transfer": 8}
#: The transaction type of a layer-2 system transaction.
SYSTEM_TYPE = 126


def hex_to_long(text: Column) -> Column:
    """A hex quantity below 2^63; null stays null."""
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("long")


def topic_address(topic: Column) -> Column:
    """The address in the last 20 bytes of a topic."""
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


def day_of(ts: Column) -> Column:
    """The UTC day of epoch seconds."""
    return F.date_from_unix_date(F.floor(ts / 86400).cast("int"))


def epoch_of(day: Column) -> Column:
    """The epoch second at which a UTC day begins."""
    return F.unix_date(day).cast("long") * 86400


def address_bucket(address: Column) -> Column:
    """0 to 255: the first byte of an address."""
    return F.conv(F.substring(address, 3, 2), 16, 10).cast("int")


def bucket_bounds(bucket: int) -> tuple[str, str]:
    """The half-open string range that holds a bucket's addresses."""
    if not 0 <= bucket <= 255:
        raise ValueError("a bucket is 0 to 255")
    return f"0x{bucket:02x}", f"0x{bucket + 1:02x}" if bucket < 255 else "0y"


def short_label(text: Column) -> Column:
    """The first 10 and last 6 characters of a text of more than 16."""
    return F.when(F.length(text) > 16, F.concat(F.left(text, F.lit(10)), F.lit("..."), F.right(text, F.lit(6)))).otherwise(text)


def is_numeric(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def symbol_of(label: Column) -> Column:
    """The part of a label before its first space."""
    return F.substring_index(label, " ", 1)


def gwei(wei: Column) -> Column:
    return wei.cast("double") / 1e9


def floor_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0).cast("long"))


def bytecode_hash(code: Column) -> Column:
    """The last 64 hex digits of a code without 0x, padded with zeros on the left."""
    return F.lpad(F.right(F.regexp_replace(code, "^0[xX]", ""), F.lit(64)), 64, "0")


def enclosing_paths(path: Column) -> Column:
    """The trace addresses of all frames around one, the root '' first; none for the root."""
    steps = F.split(path, ",")
    inner = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), ","))
    nothing = F.array().cast("array<string>")
    return F.when(path == "", nothing).otherwise(
        F.concat(F.array(F.lit("")), F.when(F.size(steps) > 1, inner).otherwise(nothing))
    )


def category_bits(value: Column, to: Column, status: Column, input_data: Column, has_transfer: Column) -> Column:
    """Coin moved, contract created, contract called, token moved."""
    empty = input_data.isNull() | input_data.isin("", "0x")
    coin = F.when((value > 0) & empty, CATEGORY_BITS["coin_transfer"]).otherwise(0)
    creation = F.when(to.isNull() & (status == 1), CATEGORY_BITS["contract_creation"]).otherwise(0)
    call = F.when(to.isNotNull() & (F.length(input_data) >= 10), CATEGORY_BITS["contract_call"]).otherwise(0)
    token = F.when(has_transfer, CATEGORY_BITS["token_transfer"]).otherwise(0)
    return coin.bitwiseOR(creation).bitwiseOR(call).bitwiseOR(token).cast("short")


def category_labels(tx_type: Column, bits: Column) -> Column:
    """Labels of the bits that are set; a system transaction has its own label only."""
    labels = F.array_compact(F.array(*(F.when(bits.bitwiseAND(b) != 0, name) for name, b in CATEGORY_BITS.items())))
    return F.when(tx_type == SYSTEM_TYPE, F.array(F.lit("system_transaction"))).otherwise(labels)


def method_id(input_data: Column) -> Column:
    return F.when(F.length(input_data) >= 10, F.left(input_data, F.lit(10)))
