"""The ledger: what each closed span of blocks contributes to every counter, and the checks and repairs built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import u256
from ..functions.chain import address_bucket, bucket_bounds
from . import rollups

STAT_COLUMNS = (*rollups.STAT_SUMS, "first_seen", "last_seen", "is_contract")


def span_of(column: str, size: int) -> Column:
    return (F.floor(F.col(column) / size) * size).cast("long")


def with_span(df: DataFrame, size: int, column: str = "block_number") -> DataFrame:
    return df.withColumn("span_lo", span_of(column, size))


def span_grid(blocks: DataFrame, size: int, bounds: DataFrame | None = None) -> DataFrame:
    """(lo, hi) of the spans [lo, hi) of a grid over the stored blocks, cut further at bounds(bound)."""
    ends = blocks.agg(F.min("number").alias("low"), F.max("number").alias("high")).select(span_of("low", size).alias("first"), "high")
    starts = ends.select(F.explode(F.sequence(F.col("first"), F.col("high"), F.lit(size).cast("long"))).alias("lo"), "first", "high")
    last = ends.select((span_of("high", size) + size).alias("end_"))
    points = starts.select("lo")
    if bounds is not None:
        inside = bounds.select(F.col("bound").cast("long").alias("lo")).join(F.broadcast(ends), (F.col("lo") > F.col("first")) & (F.col("lo") <= F.col("high")))
        points = points.unionByName(inside.select("lo")).distinct()
    following = F.lead("lo").over(Window.orderBy("lo"))  # a row per span
    return points.select("lo", following.alias("hi")).crossJoin(F.broadcast(last)).select("lo", F.coalesce("hi", "end_").alias("hi"))


def closable_spans(blocks: DataFrame, ranges: DataFrame, head: int, size: int, floor_gap: int, zero_optional: bool = True) -> DataFrame:
    """(lo, hi, stored) of the spans that may be closed: far enough below the head, whole, and without an open gap.

    Block 0 may be missing.
    """
    counts = blocks.groupBy(span_of("number", size).alias("lo")).agg(F.count_distinct("number").alias("stored"), F.max(F.col("number") == 0).alias("has_zero"))
    rows = counts.withColumn("hi", F.col("lo") + size).where(F.col("hi") <= head - floor_gap)
    need = F.lit(size) - F.when((F.col("lo") == 0) & ~F.col("has_zero") & F.lit(zero_optional), 1).otherwise(0)
    touched = ranges.select(F.explode(F.sequence(span_of("from_block", size), span_of("to_block", size), F.lit(size).cast("long"))).alias("lo"),
                            "from_block", "to_block")
    only_zero = (F.col("from_block") == 0) & (F.col("to_block") == 0) & F.lit(zero_optional)
    touched = touched.where(~only_zero).select("lo").distinct()
    return rows.where(F.col("stored") == need).join(touched, "lo", "left_anti").select("lo", "hi", "stored")


def ledger_chain(blocks: DataFrame, txs: DataFrame, transfers: DataFrame, size: int) -> DataFrame:
    """(span_lo, name, count) for blocks, txs and transfers; all spans in one pass each."""
    parts = [
        df.groupBy(span_of(column, size).alias("span_lo")).agg(F.count("*").alias("count")).select("span_lo", F.lit(name).alias("name"), "count")
        for name, df, column in (("blocks", blocks, "number"), ("txs", txs, "block_number"), ("transfers", transfers, "block_number"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ledger_token(transfers: DataFrame, size: int) -> DataFrame:
    """(span_lo, token_address, transfer_count, supply)."""
    return rollups.token_totals(with_span(transfers, size), "span_lo")


def ledger_address(txs: DataFrame, transfers: DataFrame, frames: DataFrame, contracts: DataFrame, size: int) -> DataFrame:
    """(span_lo, address, stats): a transaction lies in one span, so its distinct count adds up over spans."""
    return address_stats_by_span(rollups.address_contributions(txs, transfers, frames, contracts), size)


def address_stats_by_span(contributions: DataFrame, size: int) -> DataFrame:
    return rollups.address_stats(with_span(contributions, size), "span_lo")


def _supply(df: DataFrame) -> Column:
    """The sum of a column of supplies, decimals or 256-bit integers."""
    return u256.sum_of(F.col("supply"), u256.is_wide(df, "supply")).alias("supply")


def prune_offsets(chain: DataFrame, token: DataFrame, watermark: int, size: int) -> DataFrame:
    """(kind, key, count, supply): what the spans that end at or below the watermark hold of each counter."""
    c = chain.where(F.col("span_lo") + size <= watermark).groupBy(F.col("name").alias("key")).agg(F.sum("count").alias("count"))
    t = token.where(F.col("span_lo") + size <= watermark).groupBy(F.col("token_address").alias("key")).agg(F.sum("transfer_count").alias("count"), _supply(token))
    return c.select(F.lit("chain").alias("kind"), "key", "count", F.lit(None).cast(t.schema["supply"].dataType).alias("supply")).unionByName(
        t.select(F.lit("token").alias("kind"), "key", "count", "supply")
    )


def totals_with_offsets(retained: DataFrame, offsets: DataFrame) -> DataFrame:
    """(token_address, transfer_count, supply): retained rows' totals and those of pruned spans added."""
    rows = retained.select("token_address", "transfer_count", "supply").unionByName(
        offsets.where("kind = 'token'").select(F.col("key").alias("token_address"), F.col("count").alias("transfer_count"), "supply")
    )
    return rows.groupBy("token_address").agg(F.sum("transfer_count").alias("transfer_count"), _supply(retained))


def token_seed(transfers: DataFrame, token: DataFrame, balances: DataFrame, wanted: DataFrame, closed_through: int) -> DataFrame:
    """What a token discovered late starts at: closed spans, the open tail, and its holders."""
    tail = rollups.token_totals(transfers.where(F.col("block_number") >= closed_through).join(wanted, "token_address", "left_semi"))
    closed = token.where(F.col("span_lo") < closed_through).join(wanted, "token_address", "left_semi").select("token_address", "transfer_count", "supply")
    counted = closed.unionByName(tail).groupBy("token_address").agg(F.sum("transfer_count").alias("transfer_count"), _supply(token))
    held = balances.where(F.col("balance") > u256.zero(u256.is_wide(balances, "balance"))).groupBy("token_address").agg(F.count("*").alias("holder_count"))
    return wanted.select("token_address").distinct().join(counted, "token_address", "left").join(held, "token_address", "left").select(
        "token_address", F.coalesce("transfer_count", F.lit(0)).alias("transfer_count"), "supply", F.coalesce("holder_count", F.lit(0)).alias("holder_count")
    )


def diff(stored: DataFrame, truth: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """(keys, counter, stored, truth): one row for each counter that differs, values as text; a missing row is null.

    Null-safe: a null on both sides is no difference.
    """

    def text(df: DataFrame, side: str) -> DataFrame:
        def shown(c: str) -> Column:
            return F.when(F.col(c).isNotNull(), u256.to_decimal(F.col(c))) if u256.is_wide(df, c) else F.col(c).cast("string")

        return df.select(*keys, *(shown(c).alias(f"{side}_{c}") for c in counters))

    joined = text(stored, "s").join(text(truth, "t"), keys, "full_outer")
    items = F.array(*(F.struct(F.lit(c).alias("counter"), F.col(f"s_{c}").alias("stored"), F.col(f"t_{c}").alias("truth")) for c in counters))
    rows = joined.select(*keys, F.explode(F.filter(items, lambda x: ~x["stored"].eqNullSafe(x["truth"]))).alias("d"))
    return rows.select(*keys, "d.counter", "d.stored", "d.truth")


def span_diff(stored: DataFrame, recount: DataFrame, family: str) -> DataFrame:
    keys = {"chain": ["span_lo", "name"], "token": ["span_lo", "token_address"], "address": ["span_lo", "address"]}[family]
    counters = {"chain": ["count"], "token": ["transfer_count", "supply"], "address": list(STAT_COLUMNS)}[family]
    found = diff(stored, recount, keys, counters)
    return found.select("span_lo", F.lit(family).alias("family"), F.col(keys[1]).alias("key"), "counter", "stored", "truth")


def span_settle(spans: DataFrame, diffs: DataFrame, repair: bool) -> DataFrame:
    """(lo, prior, state): a span without a difference is ok; else repaired when asked to, but quarantined if a repair
    had been made before; without repair it is drift. What is quarantined stays so."""
    drifted = diffs.select(F.col("span_lo").alias("lo")).distinct().withColumn("drifted", F.lit(True))
    found = F.col("drifted").isNotNull()
    state = (
        F.when(F.col("state") == "quarantined", "quarantined")
        .when(~found, "ok")
        .when(F.lit(not repair), "drift")
        .when(F.col("state") == "repaired", "quarantined")
        .otherwise("repaired")
    )
    return spans.join(drifted, "lo", "left").select("lo", F.col("state").alias("prior"), state.alias("state"))


def running_diff_chain_token(counters: DataFrame, tokens: DataFrame, chain: DataFrame, token: DataFrame, open_chain: DataFrame, open_token: DataFrame) -> DataFrame:
    """(family, key, counter, stored, truth): running counters against closed spans and open rows."""
    c_truth = chain.select("name", "count").unionByName(open_chain.select("name", "count")).groupBy("name").agg(F.sum("count").alias("count"))
    kept = counters.join(c_truth.select("name"), "name", "left_semi")  # counters that the ledger holds
    c = diff(kept.select("name", "count"), c_truth, ["name"], ["count"])
    columns = ["token_address", "transfer_count", "supply"]
    t_truth = token.select(columns).unionByName(open_token.select(columns)).groupBy("token_address").agg(
        F.sum("transfer_count").alias("transfer_count"), _supply(token)
    )
    t = diff(tokens.select(columns), t_truth, ["token_address"], ["transfer_count", "supply"])
    return c.select(F.lit("chain").alias("family"), F.col("name").alias("key"), "counter", "stored", "truth").unionByName(
        t.select(F.lit("token").alias("family"), F.col("token_address").alias("key"), "counter", "stored", "truth")
    )


def address_truth(*parts: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Stats of addresses (all, or a set) from parts that add up, such as closed spans and open rows."""
    columns = ["address", *STAT_COLUMNS]
    rows = parts[0].select(columns)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(columns))
    if addresses is not None:
        rows = rows.join(addresses.select("address"), "address", "left_semi")
    return rows.groupBy("address").agg(
        *(F.sum(c).alias(c) for c in rollups.STAT_SUMS), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.bool_or("is_contract").alias("is_contract"),
    )


def running_diff_address(stats: DataFrame, *parts: DataFrame, bucket: int | None = None) -> DataFrame:
    """(address, counter, stored, truth) over all addresses, or those of one bucket as a range of strings.

    parts add up to the truth: closed spans and open rows, in one table or several.
    """
    def kept(df):
        if bucket is None:
            return df
        low, high = bucket_bounds(bucket)
        return df.where((F.col("address") >= low) & (F.col("address") < high))

    return diff(kept(stats), address_truth(*map(kept, parts)), ["address"], list(STAT_COLUMNS))


def rebase_targets(span_addresses: DataFrame, reverted: DataFrame) -> DataFrame:
    """Addresses of the spans to rebase that no revert has touched since."""
    return span_addresses.select("address").distinct().join(reverted.select("address"), "address", "left_anti")


def rebase_plan(stats: DataFrame, truth: DataFrame, targets: DataFrame) -> DataFrame:
    """(address, action, columns): create, set or remove for each target whose stored row isn't the truth."""
    mine = lambda df, side: df.join(targets, "address", "left_semi").select("address", F.struct(*STAT_COLUMNS).alias(side))
    joined = mine(stats, "stored").join(mine(truth, "truth"), "address", "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"stored.{c}").eqNullSafe(F.col(f"truth.{c}")), c) for c in STAT_COLUMNS)))
    action = F.when(F.col("stored").isNull(), "create").when(F.col("truth").isNull(), "remove").when(F.size(changed) > 0, "set")
    rows = joined.select("address", action.alias("action"), F.when(action == "set", changed).otherwise(F.array().cast("array<string>")).alias("columns"), "truth")
    return rows.where("action is not null")


def rebase_summary(plan: DataFrame) -> DataFrame:
    """(action, column, n): how many rows each action touches, and for set each column."""
    whole = plan.groupBy("action").agg(F.count("*").alias("n")).select("action", F.lit("*").alias("column"), "n")
    return whole.unionByName(plan.select("action", F.explode("columns").alias("column")).groupBy("action", "column").agg(F.count("*").alias("n")))


def rebase_apply(stats: DataFrame, plan: DataFrame) -> DataFrame:
    """The stats after a plan: created and set rows take the truth, removed ones go, others stay."""
    joined = stats.select("address", F.struct(*STAT_COLUMNS).alias("stored")).join(plan.select("address", "action", "truth"), "address", "full_outer")
    row = F.when(F.col("action").isNull(), F.col("stored")).when(F.col("action") != "remove", F.col("truth"))
    return joined.select("address", row.alias("row")).where("row is not null").select("address", "row.*")


def repair_dry_run(found: DataFrame) -> DataFrame:
    """(bucket, to_correct, to_create, to_remove) of an address diff: rows of the stats are never without a tx_count."""
    per = found.groupBy("address").agg(
        F.max((F.col("counter") == "tx_count") & F.col("stored").isNull()).alias("missing"),
        F.max((F.col("counter") == "tx_count") & F.col("truth").isNull()).alias("extra"),
    )
    return per.groupBy(address_bucket(F.col("address")).alias("bucket")).agg(
        F.count_if(~F.col("missing") & ~F.col("extra")).alias("to_correct"), F.count_if("missing").alias("to_create"), F.count_if("extra").alias("to_remove")
    )


def repairable(found: DataFrame, repairs: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(key, counter, verdict) of drifts(key, counter, truth): skip what is quarantined; quarantine what drifts again
    though the last repair set it to the same truth; repair the rest, also where the truth has moved since."""
    keys = ["key", "counter"]
    last = repairs.groupBy(*keys).agg(F.max_by("value", "at").alias("repaired_to"))
    barred = quarantine.select(*keys).distinct().withColumn("barred", F.lit(True))
    joined = found.join(last, keys, "left").join(barred, keys, "left")
    verdict = F.when(F.col("barred"), "skip").when(F.col("repaired_to").eqNullSafe(F.col("truth")) & F.col("repaired_to").isNotNull(), "quarantine").otherwise("repair")
    return joined.select(*keys, verdict.alias("verdict"))


def compactable_run(spans: DataFrame, n: int, floor: int) -> DataFrame:
    """(lo, hi) of the first run of n adjoining spans that are all ok and pruned, below floor. A row per span is windowed."""
    ahead = Window.orderBy("lo").rowsBetween(0, n - 1)
    step = Window.orderBy("lo")
    end = F.lead("hi", n - 1).over(step) if n > 1 else F.col("hi")
    rows = spans.select(
        "lo", end.alias("end"), F.every((F.col("state") == "ok") & F.col("pruned")).over(ahead).alias("good"),
        F.count("*").over(ahead).alias("n"), F.sum(F.col("hi") - F.col("lo")).over(ahead).alias("width"),
    )
    fits = rows.where(F.col("good") & (F.col("n") == n) & (F.col("end") - F.col("lo") == F.col("width")) & (F.col("end") <= floor))
    return fits.orderBy("lo").limit(1).select("lo", F.col("end").alias("hi"))


def ledger_compact(ledger: DataFrame, run: DataFrame, keys: list[str], sums: list[str], mins: list[str] = (), maxs: list[str] = ()) -> DataFrame:
    """A ledger table with the spans of one run added into its first."""
    lo, hi = F.col("run_lo"), F.col("run_hi")
    joined = ledger.crossJoin(F.broadcast(run.agg(F.max("lo").alias("run_lo"), F.max("hi").alias("run_hi"))))  # one row, nulls without a run
    span = F.when((F.col("span_lo") >= lo) & (F.col("span_lo") < hi), lo).otherwise(F.col("span_lo"))
    kinds = {f.name: f.dataType for f in ledger.schema.fields}
    return joined.withColumn("span_lo", span).groupBy("span_lo", *keys).agg(
        *(F.sum(c).cast(kinds[c]).alias(c) for c in sums), *(F.min(c).alias(c) for c in mins), *(F.max(c).alias(c) for c in maxs)
    )


def next_token(tokens: DataFrame, after: str) -> DataFrame:
    """The token after one in a round trip through all: the least address above it, else the least of all."""
    return tokens.orderBy(F.col("address") <= after, F.asc("address")).limit(1)


def next_span(spans: DataFrame, floor: int) -> DataFrame:
    """The pruned span to verify next: never checked first, then longest ago."""
    return spans.where((F.col("hi") <= floor) & F.col("pruned")).orderBy(F.asc_nulls_first("checked_at"), F.asc("lo")).limit(1)


def token_creation(tokens: DataFrame, transfers: DataFrame) -> DataFrame:
    """Tokens with creation lowered to their earliest transfer; never raised."""
    place = F.struct("block_number", "log_index")
    first = transfers.groupBy(F.col("token_address").alias("address")).agg(F.min("block_number").alias("seen_block"), F.min_by("tx_hash", place).alias("seen_tx"))
    earlier = F.col("seen_block").isNotNull() & (F.col("block_number").isNull() | (F.col("seen_block") < F.col("block_number")))
    joined = tokens.join(first, "address", "left")
    return joined.withColumns(
        {"creation_tx": F.when(earlier, F.col("seen_tx")).otherwise(F.col("creation_tx")), "block_number": F.when(earlier, F.col("seen_block")).otherwise(F.col("block_number"))}
    ).drop("seen_block", "seen_tx")


def balance_drift(current: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of a cache of current balances that aren't the history's latest."""
    return diff(current, rollups.current_balances(history), ["token_address", "address"], ["balance", "block_number"])
