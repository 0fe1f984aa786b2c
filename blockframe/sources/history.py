"""A chain's history as versions of tables, laid out so that lookups and feeds read few files.

Tables lie in ranges of blocks. Beside them: tx_index, from a transaction's hash to its block, by a checksum of the hash;
postings, from an address to the places where it takes part, by a checksum of the address and wide ranges of blocks; and a
sketch of each range's keys, by which an append tells what it certainly has not stored. Index and postings are
hints: what is returned is always read from the tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chain import ZERO_ADDRESS
from ..operators import feeds
from . import versions
from .versions import Change, Snapshot

#: Blocks of a range of history, and of a range of postings.
BLOCKS = 10_000
FEED_BLOCKS = 1_000_000
#: Parts by checksum of the index and of the postings.
INDEX_PARTS = 256
ADDRESS_PARTS = 64
#: Blocks of a range that are one task's at most when rows are dealt.
PIECE = 1_000
#: Ranges whose sketches share a file.
GROUP = 16
#: Tasks that write the files of an index, which are many and small.
TASKS = 32
#: Tables of an append that are written at once: each has its exchange on disk meanwhile.
AT_ONCE = 3
#: The block column, the key and the hash column of each table.
TABLES = {
    "blocks": ("number", ("number",), None),
    "txs": ("block_number", ("block_number", "hash"), "hash"),
    "logs": ("block_number", ("block_number", "log_index"), "tx_hash"),
    "transfers": ("block_number", ("block_number", "log_index"), "tx_hash"),
    "frames": ("block_number", ("block_number", "tx_hash", "trace_address"), "tx_hash"),
}
#: Keys that are whole numbers.
NUMBERS = ("number", "block_number", "log_index")


def _range(column: str, size: int) -> Column:
    return (F.floor(F.col(column) / size) * size).cast("long")


def _part(column: str | Column, parts: int) -> Column:
    return F.crc32(F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary")) % parts


def _part_of(text: str, parts: int) -> int:
    return zlib.crc32(text.encode()) % parts


# --- appending -----------------------------------------------------------------------------------------------------


def _piece(column: str, size: int) -> Column:
    """What rows are dealt by: a range, or some blocks of a wide one, so that it is no single task's."""
    return F.floor(F.col(column) / min(size, PIECE)).cast("long")


def dealt_by(size: int) -> Column:
    """The expression of block_number by which append deals rows; those that are dealt by it already aren't exchanged."""
    return _piece("block_number", size)


def _mark(keys: tuple[str, ...]) -> Column:
    """A 32-bit fingerprint of a key, the same for numbers of any type."""
    return F.hash(*(F.col(k).cast("long") if k in NUMBERS else F.col(k) for k in keys))


def _sketch(rows: DataFrame, keys: tuple[str, ...], size: int) -> DataFrame:
    """(bucket, range, mark): a fingerprint of each key, so that a sketch is as large as its keys are many; some ranges share a bucket."""
    return rows.select(_group(F.col("bucket"), size).alias("bucket"), F.col("bucket").alias("range"), _mark(keys).alias("mark"))


def _group(bucket: Column, size: int) -> Column:
    return F.concat(F.lit("g"), F.floor(bucket / (size * GROUP)).cast("string"))


def _keyed(table: str, rows: DataFrame, size: int) -> DataFrame:
    """rows with their bucket, each key once."""
    column, keys, _ = TABLES[table]
    return rows.dropDuplicates(list(keys)).withColumn("bucket", _range(column, size))


def _dealt(table: str, rows: DataFrame, size: int) -> DataFrame:
    """The same, dealt by ranges and sorted in one exchange: rows of the same key follow each other, and the first one stays."""
    column, keys, _ = TABLES[table]
    placed = rows.withColumns({"bucket": _range(column, size), "piece_": _piece(column, size)}).repartition("piece_")
    key = F.struct(*keys)
    again = F.lag(key).over(Window.partitionBy("bucket", "piece_").orderBy(*keys)).eqNullSafe(key)
    return placed.withColumn("again_", again).where("not again_").drop("again_", "piece_")


def unstored(now: Snapshot, table: str, rows: DataFrame, size: int = BLOCKS) -> DataFrame:
    """rows with their bucket, each key once, without those that are stored.

    A key holds its block, so only ranges that the rows fall into matter. Their sketches pick the ranges in which some row may
    be stored; only of these are stored keys read. If there are none, stored rows are in no part of the plan.
    """
    column, keys, _ = TABLES[table]
    fresh = _keyed(table, rows, size)
    placed = rows.withColumn("bucket", _range(column, size))
    ranges = [str(r[0]) for r in placed.select("bucket").distinct().collect()] if now.buckets(table) else []  # a batch's ranges
    met = _met(now, table, placed, ranges, size)
    return _unheld(now, table, fresh, met) if met else fresh


def _met(now: Snapshot, table: str, placed: DataFrame, ranges: list[str], size: int) -> list[str]:
    """Those of the ranges in which some of the placed rows may be stored."""
    ranges = [r for r in ranges if now.parts(table, [r])]
    if not ranges:
        return []
    stored_size = now.facts.get("size", size)
    groups = {f"g{int(r) // (stored_size * GROUP)}" for r in ranges}
    sketch = now.read(f"{table}_sketch", sorted({*groups, *ranges}))
    old = F.regexp_extract(F.col("_metadata.file_path"), r"bucket=([0-9]+)/", 1)
    held = {c: F.col(c) if c in sketch.columns else F.lit(None) for c in ("range", "mark")}
    sketch = sketch.select(F.coalesce(held["range"].cast("long"), F.nullif(old, F.lit("")).cast("long")).alias("bucket"), held["mark"].cast("int").alias("mark"))
    placed = placed.select("bucket", _mark(TABLES[table][1]).alias("mark"))
    met = placed.join(sketch, ["bucket", "mark"], "left_semi").select("bucket")
    # histories written before have other sketches: in their ranges any row may be stored
    met = met.union(sketch.where("mark is null").select("bucket"))
    found = {str(r[0]) for r in met.distinct().collect()}  # ranges
    return [r for r in ranges if r in found]


def _unheld(now: Snapshot, table: str, rows: DataFrame, ranges: list[str]) -> DataFrame:
    """rows without those that the ranges hold."""
    keys = list(TABLES[table][1])
    return rows.join(now.read(table, ranges).select(*keys), keys, "left_anti").select(*rows.columns)


def _postings(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(bucket, kind, address, block_number, position, ref): where addresses take part, each place once.

    The rows of tables, each key once, hold each place of transfers and frames once; only those of transactions, in which an
    address may take part in several ways, are looked through for the same one. A frame's place is its ref, others have none.
    """
    sides = F.array("from_address", "to_address")
    none = F.lit(None).cast("string")

    def posted(df: DataFrame, kind: str, position: Column, addresses: Column, ref: Column = none) -> DataFrame:
        rows = df.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(addresses)).alias("address"), F.col("block_number").cast("long"), position.cast("long").alias("position"), ref.alias("ref"))
        return rows.where("address is not null")

    parts = []
    if "txs" in tables and "transfers" in tables:  # also who takes part through a transfer
        block = F.col("block_number").cast("long").alias("block_number")
        sent = tables["txs"].select(block, "hash", F.col("tx_index").cast("long").alias("position"), sides.alias("sides"))
        moved = tables["transfers"].select(block, F.col("tx_hash").alias("hash"), F.lit(None).cast("long").alias("position"), sides.alias("sides"))
        of = sent.unionByName(moved).groupBy("block_number", "hash").agg(F.max("position").alias("position"), F.flatten(F.collect_list("sides")).alias("sides"))  # a transaction's own
        parts.append(posted(of.where("position is not null"), "tx", F.col("position"), F.col("sides")))
    elif "txs" in tables:
        parts.append(posted(tables["txs"], "tx", F.col("tx_index"), sides))
    if "transfers" in tables:
        parts.append(posted(tables["transfers"], "transfer", F.col("log_index"), sides))
    if "frames" in tables:
        parts.append(posted(tables["frames"], "frame", F.lit(0), sides, F.concat_ws(" ", "tx_hash", "trace_address")))
    if not parts:
        return None
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    place = F.concat_ws("-", _part("address", ADDRESS_PARTS), F.floor(F.col("block_number") / FEED_BLOCKS))
    return whole.where(F.col("address") != ZERO_ADDRESS).withColumn("bucket", place)


def append(now: Snapshot, tables: dict[str, DataFrame], size: int = BLOCKS, token: int | None = None) -> Snapshot:
    """The version after now with the rows that it lacks, in one commit; the same rows again change nothing.

    tables are some of TABLES. Transfers of a block come with its transactions, so that the feed of an address has both.
    What comes in is computed once, and written where it will stay; only ranges in which some rows are stored already are
    written anew without these. Sketches, index and postings are made of what was written.
    """
    if token is not None and now.token is not None and token <= now.token:
        return now

    def new(name: str) -> list[versions.Written]:
        column, keys, hashed = TABLES[name]
        kept = (hashed,) if hashed else ()
        first = versions.write(now, Change(name, _dealt(name, tables[name], size), keys=kept, dealt=True))
        held = [b for b in first.buckets if now.parts(name, [b])]
        met = _met(now, name, first.rows(held), held, size) if held else []
        if not met:
            return [first]
        second = versions.write(now, Change(name, _unheld(now, name, first.rows(met), met), keys=kept, order=(column,)))
        return [first.without(met), second]

    def rows(parts: list[versions.Written]) -> DataFrame:
        whole = parts[0].rows()
        return whole.unionByName(parts[1].rows()) if parts[1:] else whole

    with versions.writing(now.spark):
        written = dict(zip(tables, versions.each(now.spark, new, tables, AT_ONCE), strict=True))
        fresh = {name: rows(parts) for name, parts in written.items()}
        changes, posted = [], _postings(fresh)
        if posted is not None:  # the longest first
            changes.append(Change("postings", posted, keys=("address",), order=("address", "block_number")))
        if "txs" in fresh:
            index = fresh["txs"].select("hash", "block_number", _part("hash", INDEX_PARTS).alias("bucket"))
            changes.append(Change("tx_index", index, keys=("hash",), order=("hash",), tasks=TASKS))
        changes += [Change(f"{name}_sketch", _sketch(df, TABLES[name][1], size), order=("range",)) for name, df in fresh.items()]
        hints = versions.each(now.spark, lambda change: versions.write(now, change), changes, AT_ONCE)
    return versions.publish(now, [*(p for parts in written.values() for p in parts), *hints], {"size": size}, token)


def compact(now: Snapshot, most: int = 8) -> Snapshot:
    """now with the index, postings and sketches in few files for each part; those that are in few already aren't touched."""
    for table, keys, order in (("tx_index", ("hash",), ("hash",)), ("postings", ("address",), ("address", "block_number"))):
        now = versions.merge_parts(now, table, most, keys, order)
    for table in now.folders:
        if table.endswith("_sketch"):
            now = versions.merge_parts(now, table, most)
    return now


def revert(now: Snapshot, lo: int, hi: int, token: int | None = None) -> Snapshot:
    """The version after now without blocks lo to hi: only ranges that keep some of their blocks are read and written anew.

    Run again it leaves the same rows. The index keeps its entries, which then lead to no row.
    """
    size, changes = now.facts["size"], []
    for table in [t for t in TABLES if now.buckets(t)]:
        column = TABLES[table][0]
        touched = [b for b in now.buckets(table) if int(b) <= hi and int(b) + size > lo]
        if touched:
            edges = [b for b in touched if int(b) < lo or int(b) + size - 1 > hi]  # the others lose all that they hold
            left = now.read(table, edges).where(~F.col(column).between(lo, hi)).withColumn("bucket", _range(column, size))
            hashed = TABLES[table][2]
            changes.append(Change(table, left, tuple(touched), (hashed,) if hashed else (), (column,)))
    first = {b: int(b.split("-")[1]) * FEED_BLOCKS for b in now.buckets("postings")}
    posted = [b for b, n in first.items() if n <= hi and n + FEED_BLOCKS > lo]
    if posted:
        edges = [b for b in posted if first[b] < lo or first[b] + FEED_BLOCKS - 1 > hi]
        left = now.read("postings", edges).where(~F.col("block_number").between(lo, hi))
        place = F.concat_ws("-", _part("address", ADDRESS_PARTS), F.floor(F.col("block_number") / FEED_BLOCKS))
        changes.append(Change("postings", left.withColumn("bucket", place), tuple(posted), ("address",), ("address", "block_number")))
    return versions.commit(now, changes, token=token)


# --- lookups -------------------------------------------------------------------------------------------------------


def blocks_of(now: Snapshot, hash: str) -> list[int]:
    """The blocks that the index has for a transaction: one, or more if it was reverted and came again; none if unknown."""
    found = now.read("tx_index", [_part_of(hash, INDEX_PARTS)], "hash string, block_number long").where(F.col("hash") == hash)
    return sorted({r.block_number for r in found.select("block_number").collect()})


def by_hash(now: Snapshot, table: str, hash: str) -> DataFrame:
    """The rows of a transaction: its block comes from the index, then the one range that holds it is read."""
    size, column = now.facts["size"], TABLES[table][2]
    blocks = blocks_of(now, hash)
    rows = now.read(table, sorted({b // size * size for b in blocks}))
    return rows.where(F.col("block_number").isin(blocks) & (F.col(column) == hash))


def tx_lookup(now: Snapshot, contracts: DataFrame, hash: str) -> DataFrame:
    return feeds.tx_lookup(by_hash(now, "txs", hash), contracts, hash)


def logs_by_tx(now: Snapshot, hash: str) -> DataFrame:
    return by_hash(now, "logs", hash).orderBy("log_index")


def transfers_by_tx(now: Snapshot, hash: str) -> DataFrame:
    return feeds.transfers_by_tx(by_hash(now, "transfers", hash), hash)


def frames_by_tx(now: Snapshot, hash: str) -> DataFrame:
    return feeds.frames_by_tx(by_hash(now, "frames", hash), hash)


# --- feeds of an address -------------------------------------------------------------------------------------------


def _newest(now: Snapshot, kind: str, address: str, kept: Column, order: list[Column], n: int, from_block: int | None) -> list:
    """The first n postings of an address: the newest range of blocks first, then twice as many, until n are found."""
    part = _part_of(address, ADDRESS_PARTS)
    ranges = sorted((int(b.split("-")[1]) for b in now.buckets("postings") if b.split("-")[0] == str(part)), reverse=True)
    ranges = [r for r in ranges if from_block is None or r * FEED_BLOCKS <= from_block]
    found, at, step = [], 0, 1
    while at < len(ranges) and len(found) < n:
        rows = now.read("postings", [f"{part}-{r}" for r in ranges[at : at + step]])
        rows = rows.where((F.col("kind") == kind) & (F.col("address") == address) & kept)
        ref = F.col("ref") if kind == "frame" else F.lit(None).cast("string")  # other places are what they are without it
        found += rows.select("block_number", "position", ref.alias("ref")).distinct().orderBy(*order).limit(n - len(found)).collect()  # a page
        at, step = at + step, step * 2
    return found


def _rows_at(now: Snapshot, table: str, found: list, on: Callable[[DataFrame], dict[str, Column]]) -> DataFrame:
    """The rows of a page of postings: ranges and blocks are constants that reach the scan."""
    size = now.facts["size"]
    blocks = sorted({r.block_number for r in found})
    rows = now.read(table, sorted({b // size * size for b in blocks})).where(F.col("block_number").isin(blocks))
    wanted = now.spark.createDataFrame([(r.block_number, r.position, r.ref) for r in found], "block_number long, position long, ref string")
    keyed = rows.withColumns({f"{k}_": v for k, v in on(rows).items()})
    wanted = wanted.select(F.col("block_number").alias("block_"), *(F.col(k).alias(f"{k}_") for k in on(rows)))
    joined = keyed.withColumn("block_", F.col("block_number")).join(F.broadcast(wanted), ["block_", *(f"{k}_" for k in on(rows))], "left_semi")
    return joined.select(*rows.columns)


def txs_by_address(now: Snapshot, address: str, bound: tuple[int, int] | None, n: int) -> DataFrame:
    """What feeds.txs_by_address gives, from postings: transactions sent, received, or taken part in, newest first."""
    kept = feeds.before(["block_number", "position"], bound)
    found = _newest(now, "tx", address, kept, feeds.newest("block_number", "position"), n, bound and bound[0])
    return _rows_at(now, "txs", found, lambda df: {"position": df["tx_index"].cast("long")}).orderBy(*feeds.newest("block_number", "tx_index"))


def transfers_by_address(now: Snapshot, address: str, bound: tuple[int, int] | None, n: int) -> DataFrame:
    """The newest transfers of an address; one with itself counts once."""
    kept = feeds.before(["block_number", "position"], bound)
    found = _newest(now, "transfer", address, kept, feeds.newest("block_number", "position"), n, bound and bound[0])
    return _rows_at(now, "transfers", found, lambda df: {"position": df["log_index"].cast("long")}).orderBy(*feeds.newest("block_number", "log_index"))


def frames_by_address(now: Snapshot, address: str, n: int) -> DataFrame:
    """The newest frames of an address; a call to itself counts once."""
    order = [F.desc("block_number"), F.asc(F.substring_index("ref", " ", 1)), F.asc(F.substring_index("ref", " ", -1))]
    found = _newest(now, "frame", address, F.lit(True), order, n, None)
    rows = _rows_at(now, "frames", found, lambda df: {"ref": F.concat_ws(" ", df["tx_hash"], df["trace_address"])})
    return rows.orderBy(F.desc("block_number"), "tx_hash", "trace_address")


def postings_total(now: Snapshot, kind: str, address: str) -> DataFrame:
    """(total): places of an address, from its part of the postings; transfers with itself count once."""
    part = _part_of(address, ADDRESS_PARTS)
    mine = [b for b in now.buckets("postings") if b.split("-")[0] == str(part)]
    rows = now.read("postings", mine, "kind string, address string, block_number long, position long, ref string")
    return rows.where((F.col("kind") == kind) & (F.col("address") == address)).agg(F.count("*").alias("total"))
