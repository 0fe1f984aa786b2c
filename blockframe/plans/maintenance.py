"""Registered queries of daily statistics, gaps, ledger, checks, retention and reorgs, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chain as fn
from ..operators import checks, daily, gaps, ledger, reorg, retention, rollups
from .chain import CLOSED, FLOOR_GAP, SPAN, Chain
from .queries import ADDRESS, DAY, MOVE_SQL, NFT, STAT_SQL, TOKEN, UNKNOWN, query

# --- days ----------------------------------------------------------------------------------------------------------

PAIRS = "SELECT b.*, b.timestamp - p.timestamp AS gap FROM days b LEFT JOIN f_blocks p ON p.number = b.number - 1"
D_BLOCKS = f"""d_blocks AS (SELECT day, count(*) AS blocks, CAST(sum(gas_used) AS BIGINT) AS gas_used, CAST(coalesce(sum(size), 0) AS BIGINT) AS size_sum, count(size) AS size_n,
    CAST(coalesce(sum(gap), 0) AS BIGINT) AS gap_sum, count(gap) AS gap_n, min(number) AS first_block FROM ({PAIRS}) GROUP BY day)"""
TX_DAY = "CAST(to_timestamp(block_timestamp) AT TIME ZONE 'UTC' AS DATE)"
D_TXS = f"""d_txs AS (SELECT {TX_DAY} AS day, count(*) AS tx_count, CAST(sum(CAST(gas_price AS HUGEINT)) AS BIGINT) AS price_sum, count(CASE WHEN status = 1 THEN 1 END) AS success,
    count(CASE WHEN status = 0 THEN 1 END) AS failed FROM f_tx GROUP BY 1)"""
D_ACTIVE = f"""d_active AS (SELECT day, count(DISTINCT a) AS active_addresses FROM (SELECT {TX_DAY} AS day, from_address AS a FROM f_tx UNION ALL SELECT {TX_DAY}, to_address FROM f_tx)
    WHERE a IS NOT NULL GROUP BY day)"""
D_MOVES = "d_moves AS (SELECT CAST(to_timestamp(timestamp) AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS transfer_count FROM f_transfers GROUP BY 1)"
SPANS = "spans AS (SELECT day, lo, coalesce(lead(lo) OVER (ORDER BY day), top + 1) AS hi FROM (SELECT day, min(number) AS lo, max(number) AS top FROM days GROUP BY day))"
D_ADDR = """d_addr AS (SELECT s.day, count(a.address) AS new_addresses, count(CASE WHEN a.is_contract THEN 1 END) AS new_contracts FROM spans s
    LEFT JOIN stats a ON a.first_seen < s.hi AND a.first_seen >= coalesce((SELECT max(q.hi) FROM spans q WHERE q.hi < s.hi), 0) GROUP BY s.day)"""
D_ALL = f"""{D_BLOCKS}, {D_TXS}, {D_ACTIVE}, {D_MOVES}, parts AS (SELECT b.*, coalesce(tx_count, 0) AS tx_count, coalesce(price_sum, 0) AS price_sum, coalesce(success, 0) AS success,
    coalesce(failed, 0) AS failed, coalesce(active_addresses, 0) AS active_addresses, coalesce(transfer_count, 0) AS transfer_count
    FROM d_blocks b LEFT JOIN d_txs USING (day) LEFT JOIN d_active USING (day) LEFT JOIN d_moves USING (day))"""
MEAN = "CAST(coalesce(floor(({a} * 2 + {n}) // ({n} * 2)), 0) AS BIGINT)"
STATS_SQL = f"""SELECT day, blocks, gas_used, CASE WHEN size_n = 0 THEN 0 ELSE (size_sum * 2 + size_n) // (size_n * 2) END AS avg_block_size,
    CASE WHEN gap_n = 0 THEN 0 ELSE (gap_sum * 2 + gap_n) // (gap_n * 2) END AS avg_block_time, first_block, tx_count,
    CASE WHEN tx_count = 0 THEN 0 ELSE (price_sum * 2 + tx_count) // (tx_count * 2) END AS avg_gas_price, success, failed, active_addresses, transfer_count,
    CAST(sum(tx_count) OVER (ORDER BY day) AS BIGINT) AS total_txs, new_addresses, new_contracts, CAST(sum(new_addresses) OVER (ORDER BY day) AS BIGINT) AS total_addresses,
    CAST(sum(new_contracts) OVER (ORDER BY day) AS BIGINT) AS total_contracts FROM parts JOIN d_addr USING (day)"""

query("block_time_pairs", "SELECT b.number, b.timestamp, b.timestamp - p.timestamp AS gap FROM f_blocks b LEFT JOIN f_blocks p ON p.number = b.number - 1")(lambda c: daily.block_time_pairs(c.blocks))
query("daily_blocks", f", {D_BLOCKS} SELECT * FROM d_blocks")(lambda c: daily.daily_blocks(c.blocks))
query("daily_txs", f", {D_TXS} SELECT * FROM d_txs")(lambda c: daily.daily_txs(c.txs))
query("daily_active", f", {D_ACTIVE} SELECT * FROM d_active")(lambda c: daily.daily_active(c.txs))
query("daily_transfers", f", {D_MOVES} SELECT * FROM d_moves")(lambda c: daily.daily_transfers(c.transfers))
query("daily_stats", f", {D_ALL}, {SPANS}, {D_ADDR} {STATS_SQL}")(lambda c: daily.daily_stats(c.blocks, c.txs, c.transfers, c.stats))
query("daily_cumulative", f", {D_TXS} SELECT day, tx_count, CAST(coalesce(sum(tx_count) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(tx_count) OVER (ORDER BY day) AS BIGINT) AS cumulative FROM d_txs")(
    lambda c: daily.daily_cumulative(daily.daily_txs(c.txs))
)
query("day_spans", f", {SPANS} SELECT * FROM spans")(lambda c: daily.day_spans(c.blocks))
query("address_day_asof", f", {SPANS} SELECT address, (SELECT min(day) FROM spans WHERE hi > first_seen) AS day FROM stats")(lambda c: daily.address_day_asof(c.stats, daily.day_spans(c.blocks)))
query("address_day_asof_back", f", {SPANS} SELECT address, (SELECT max(day) FROM spans WHERE lo <= first_seen) AS day FROM stats")(lambda c: daily.address_day_asof_back(c.stats, daily.day_spans(c.blocks)))
query("daily_address_columns", f", {SPANS}, {D_ADDR} SELECT *, CAST(sum(new_addresses) OVER (ORDER BY day) AS BIGINT) AS total_addresses, CAST(sum(new_contracts) OVER (ORDER BY day) AS BIGINT) AS total_contracts FROM d_addr")(
    lambda c: daily.daily_address_columns(c.stats, daily.day_spans(c.blocks))
)
query("daily_recompute", f", {D_ALL}, {SPANS}, {D_ADDR} SELECT day, blocks, gas_used, avg_block_size, avg_block_time, first_block, tx_count, success, failed, active_addresses, transfer_count, total_txs, total_addresses, total_contracts FROM ({STATS_SQL}) WHERE day = DATE '{DAY}'")(
    lambda c: daily.daily_recompute(c.blocks, c.txs, c.transfers, c.stats, DAY)
)
query("daily_refill", f", {D_TXS}, {D_BLOCKS} SELECT b.day, blocks, tx_count, CASE WHEN dayofmonth(b.day) % 2 = 0 THEN success ELSE -1 END AS success FROM d_blocks b JOIN d_txs USING (day)")(
    lambda c: daily.daily_refill(
        daily.daily_blocks(c.blocks).join(daily.daily_txs(c.txs), "day").select("day", "blocks", "tx_count", F.when(F.dayofmonth("day") % 2 == 0, F.col("success")).alias("success")),
        daily.daily_txs(c.txs).select("day", F.lit(-1).cast("long").alias("success")), ("success",),
    )
)
query("cumulative_backwards", f", {D_TXS} SELECT day, tx_count, CAST(1000000 - coalesce(sum(tx_count) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cumulative FROM d_txs WHERE day <= DATE '{DAY}'")(
    lambda c: daily.cumulative_backwards(daily.daily_txs(c.txs), DAY, 1_000_000)
)
DENSE = "number - number // 97"  # the fixture's chain lacks every 97th block; so renumbered it has none missing
query("day_spans_inferred", f"SELECT day, min({DENSE}) AS lo, dayofmonth(day) % 3 <> 1 AS inferred FROM days WHERE dayofmonth(day) NOT IN (11, 12) GROUP BY day")(lambda c: _inferred(c))


def dense(df: DataFrame, number: str) -> DataFrame:
    return df.withColumn(number, F.col(number) - F.floor(F.col(number) / 97))


def _inferred(c: Chain) -> DataFrame:
    """The days' counts with the start of two in three unknown, and one count wrong: its run of days isn't believed."""
    blocks = dense(c.blocks, "number")
    wrong = F.when(F.dayofmonth("day") == 11, 1).otherwise(0)
    days = daily.daily_blocks(blocks).select("day", (F.col("blocks") + wrong).alias("blocks"), F.when(F.dayofmonth("day") % 3 == 1, F.col("first_block")).alias("first_block"))
    return daily.day_spans_inferred(days, blocks.agg(F.max("number").alias("n")).first()["n"])


#: A place in the last fifth of the chain, and one in the first eighth.
LATE, EARLY = "(SELECT max(number) * 4 // 5 FROM f_blocks)", "(SELECT max(number) // 8 FROM f_blocks)"
query("stale_days", f"SELECT DISTINCT day FROM days WHERE number <= {LATE} AND dayofmonth(day) % 3 = 2")(
    lambda c: daily.stale_days(c.blocks, daily.daily_blocks(c.blocks.where(F.col("number") <= c.late)).withColumn("blocks", F.col("blocks") - (F.dayofmonth("day") % 3 == 2).cast("int")), c.late)
)
query("late_days", "SELECT DISTINCT day FROM days WHERE number IN (40, 200, 201)")(
    lambda c: daily.stale_days(c.blocks, daily.daily_blocks(c.blocks.where("number not in (40, 200)")), 10**9)
)
query("recount_days", f", {D_ALL} SELECT day, blocks, gas_used, size_sum, size_n, gap_sum, gap_n, first_block, tx_count, price_sum, success, failed, active_addresses, transfer_count FROM parts WHERE day = DATE '{DAY}'")(
    lambda c: daily.recount_days(c.blocks, c.txs, c.transfers, c.blocks.where("number = 200").select(fn.day_of(F.col("timestamp")).alias("day")), 10**9)
)
query("daily_parts_merge", f", {D_ALL} SELECT day, blocks, gas_used, size_sum, size_n, gap_sum, gap_n, tx_count, price_sum, success, failed, transfer_count, first_block FROM parts")(
    lambda c: daily.daily_parts_merge(
        daily.daily_parts(c.blocks.where("number < 100"), c.txs.where("block_number < 100"), c.transfers.where("block_number < 100")),
        daily.daily_parts(c.blocks.where("number >= 100"), c.txs.where("block_number >= 100"), c.transfers.where("block_number >= 100")),
        daily.block_time_pairs(c.blocks).where("number = 100").select(fn.day_of(F.col("timestamp")).alias("day"), F.col("gap").alias("gap_sum"), F.lit(1).cast("long").alias("gap_n")),
    )
)
ACTIVE = f"SELECT DISTINCT {TX_DAY} AS day, from_address AS address FROM f_tx"
query("active_set_diff", f"SELECT day, address, 'gone' AS change FROM ({ACTIVE}) WHERE right(address, 1) = '3' AND day <= DATE '{DAY}'")(
    lambda c: daily.active_set_diff(
        *(df.select(fn.day_of(F.col("block_timestamp")).alias("day"), F.col("from_address").alias("address")).distinct().where(w)
          for df, w in ((c.txs, f"day <= date '{DAY}'"), (c.txs, f"day <= date '{DAY}' and right(address, 1) <> '3'")))
    )
)
query("invalidate_days", f"SELECT day, CASE WHEN day < DATE '{DAY}' THEN 'keep' ELSE 'drop' END AS action, (SELECT max(number) FROM days WHERE day < DATE '{DAY}') AS new_watermark FROM days GROUP BY day")(
    lambda c: daily.invalidate_days(daily.daily_blocks(c.blocks), c.blocks, 10**9, 200)
)
query("watermark_start", "SELECT min(number) - 1 AS watermark FROM days WHERE day = (SELECT max(day) FROM days) HAVING count(*) > 0 AND min(number) - 1 IN (SELECT number FROM f_blocks)")(lambda c: daily.watermark_start(c.blocks))
#: The block below a hole near the middle of the chain, which lacks every 97th block.
MARK = "(SELECT max(number) // 194 * 97 - 1 FROM f_blocks)"
query("watermark_lag", f"SELECT max(number) - {MARK} AS lag, CASE WHEN count(CASE WHEN number = {MARK} + 1 THEN 1 END) = 0 THEN {MARK} + 1 END AS held_at FROM f_blocks")(
    lambda c: daily.watermark_lag(c.blocks, c.head // 194 * 97 - 1)
)

# --- gaps and links ------------------------------------------------------------------------------------------------

HOLES = "SELECT number + 1 AS from_block, nx - 1 AS to_block FROM (SELECT number, lead(number) OVER (ORDER BY number) AS nx FROM f_blocks) WHERE nx > number + 1"
query("missing_ranges", HOLES)(lambda c: gaps.missing_ranges(c.blocks))
query("coverage", f"SELECT count(*) AS stored, min(number) AS first_block, max(number) AS last_block, (SELECT count(*) FROM ({HOLES})) AS gaps, (SELECT CAST(sum(to_block - from_block + 1) AS BIGINT) FROM ({HOLES})) AS missing FROM f_blocks WHERE number BETWEEN {EARLY} AND {LATE}")(
    lambda c: gaps.coverage(c.blocks, gaps.missing_ranges(c.blocks), c.head // 8, c.late)
)
query("first_block_at", "SELECT min(number) AS number FROM f_blocks WHERE timestamp >= 1704110400")(lambda c: gaps.first_block_at(c.blocks, 1704110400))
query("progress", f"SELECT count(*) AS processed, {LATE} - count(*) AS remaining, {LATE} - count(*) AS in_gaps, round(count(*) * 100.0 / {LATE}, 6) AS percent FROM f_blocks WHERE number BETWEEN 1 AND {LATE}")(
    lambda c: gaps.progress(c.blocks, gaps.missing_ranges(c.blocks), 1, c.late).withColumn("percent", F.round(F.col("percent").cast("double"), 6))
)
query("contiguous_through", "SELECT min(number) AS contiguous_through FROM f_blocks WHERE number >= 100 AND number + 1 NOT IN (SELECT number FROM f_blocks)")(lambda c: gaps.contiguous_through(c.blocks, 100))
query("range_split", f"SELECT from_block, to_block FROM (SELECT number + 1 AS from_block, lead(number, 1, (SELECT max(number) + 10 FROM f_blocks)) OVER (ORDER BY number) - 1 AS to_block FROM (SELECT number FROM f_blocks WHERE number % 3 <> 0 UNION SELECT 0)) WHERE from_block <= to_block")(
    lambda c: gaps.range_split(c.blocks.agg(F.lit(1).alias("from_block"), (F.max("number") + 9).alias("to_block")), c.blocks.where("number % 3 <> 0"), bucket=64)
)
query("range_merge", f"SELECT number + 1 AS from_block, nx - 1 AS to_block FROM (SELECT number, lead(number) OVER (ORDER BY number) AS nx FROM (SELECT number FROM f_blocks WHERE number % 97 = 1 UNION ALL SELECT max(number) + 1 FROM f_blocks UNION ALL SELECT 0)) WHERE nx > number + 1")(
    lambda c: gaps.range_merge(gaps.missing_ranges(c.blocks).unionByName(c.blocks.where("number % 97 <> 1").select(F.col("number").alias("from_block"), F.col("number").alias("to_block"))), bucket=64)
)
query("range_drop", f"SELECT from_block, to_block FROM ({HOLES}) WHERE from_block % 2 = 0")(
    lambda c: gaps.range_drop(gaps.missing_ranges(c.blocks), c.blocks.where("number % 97 = 96").select((F.col("number") + 1).alias("number")).where("number % 2 = 1"))
)
query("range_queue", f"SELECT greatest(from_block, 100) AS from_block, to_block FROM ({HOLES}) WHERE to_block >= 100 ORDER BY to_block DESC LIMIT 3")(lambda c: gaps.range_queue(gaps.missing_ranges(c.blocks), 100, 3))
query("jump_range", "SELECT max(number) + 1 AS from_block, 9999999 AS to_block FROM f_blocks")(lambda c: gaps.jump_range(c.blocks, 10_000_000, 1000))
query("safe_blocks", "SELECT number FROM f_blocks WHERE number <= (SELECT max(number) FROM f_blocks) - 12")(lambda c: gaps.safe_blocks(c.blocks, 12).select("number"))


def _forked(c: Chain, low: int) -> DataFrame:
    """The chain as it is, with other hashes from so many blocks below the head on."""
    top = c.blocks.agg(F.max("number").alias("top_"))
    changed = F.when(F.col("number") > F.col("top_") - low, F.concat("hash", F.lit("f"))).otherwise(F.col("hash"))
    return c.blocks.crossJoin(F.broadcast(top)).withColumn("hash", changed).drop("top_")


query("broken_links", "SELECT number, hash, parent_hash, concat('0xb', lpad(CAST(number - 1 AS VARCHAR), 63, '0'), 'f') AS expected FROM f_b WHERE number - 1 IN (SELECT number FROM f_b) AND number - 1 > (SELECT max(number) FROM f_b) - 4")(
    lambda c: gaps.broken_links(_forked(c, 4).withColumn("hash", F.col("hash"))).select("number", F.left("hash", F.lit(66)).alias("hash"), "parent_hash", "expected")
)
query("reorg_depth", "SELECT max(number) AS head, min(CASE WHEN number > t - 4 THEN number END) AS deepest, max(number) - min(CASE WHEN number > t - 4 THEN number END) + 1 AS depth FROM (SELECT number, (SELECT max(number) FROM f_b) AS t FROM f_b)")(
    lambda c: gaps.reorg_depth(c.blocks, _forked(c, 4))
)
query("stale_head", "SELECT max(number) AS head, min(CASE WHEN number > t - 30 THEN number END) AS deepest, max(number) - min(CASE WHEN number > t - 30 THEN number END) + 1 AS depth, 'revert' AS verdict FROM (SELECT number, (SELECT max(number) FROM f_b) AS t FROM f_b)")(
    lambda c: gaps.stale_head(c.blocks, _forked(c, 30))
)
query("chain_reset", "SELECT max(number) AS stored_head, 10 + 128 < max(number) AS is_reset FROM f_blocks")(lambda c: gaps.chain_reset(c.blocks, 10))

# --- ledger --------------------------------------------------------------------------------------------------------


def lo(column: str) -> str:
    return f"CAST(floor({column} / {SPAN}.0) * {SPAN} AS BIGINT)"


L_CHAIN = f"""l_chain AS (SELECT {lo('number')} AS span_lo, 'blocks' AS name, count(*) AS count FROM f_blocks GROUP BY 1 UNION ALL SELECT {lo('block_number')}, 'txs', count(*) FROM f_tx GROUP BY 1
    UNION ALL SELECT {lo('block_number')}, 'transfers', count(*) FROM f_transfers GROUP BY 1)"""
L_TOKEN = f"""l_token AS (SELECT {lo('block_number')} AS span_lo, token_address, count(*) AS transfer_count, CASE WHEN max(token_type) = 'ERC20' THEN CAST(sum(CASE WHEN from_address = z THEN value ELSE 0 END
    - CASE WHEN to_address = z THEN value ELSE 0 END) AS BIGINT) END AS supply FROM f_transfers, zero GROUP BY 1, 2)"""
query("span_grid", f"SELECT lo, lead(lo, 1, (SELECT {lo('max(number)')} + {SPAN} FROM f_blocks)) OVER (ORDER BY lo) AS hi FROM (SELECT unnest(generate_series(0, (SELECT {lo('max(number)')} FROM f_blocks), {SPAN})) AS lo UNION SELECT 120)")(
    lambda c: ledger.span_grid(c.blocks, SPAN, c.rows("bound long", (120,), (10**9,)))
)
query("closable_spans", f"SELECT lo, lo + {SPAN} AS hi, n AS stored FROM (SELECT {lo('number')} AS lo, count(*) AS n FROM (SELECT number FROM f_blocks UNION SELECT number + 1 FROM f_blocks WHERE number % 97 = 96 AND number // 97 % 7 <> 3) GROUP BY 1) WHERE n = {SPAN} - CASE WHEN lo = 0 THEN 1 ELSE 0 END AND lo + {SPAN} <= (SELECT max(number) FROM f_blocks) - {FLOOR_GAP}")(
    lambda c: _closable(c)
)


def _closable(c: Chain) -> DataFrame:
    """The stored blocks with most gaps filled, so that some spans are whole and others aren't."""
    filled = c.blocks.where("number % 97 = 96 and floor(number / 97) % 7 <> 3").select((F.col("number") + 1).alias("number"))
    whole = c.blocks.select("number").unionByName(filled)
    top = c.blocks.agg(F.max("number").alias("n")).first()["n"]
    return ledger.closable_spans(whole, gaps.missing_ranges(whole), top, SPAN, FLOOR_GAP)


query("ledger_chain", f", {L_CHAIN} SELECT * FROM l_chain")(lambda c: ledger.ledger_chain(c.blocks, c.txs, c.transfers, SPAN))
query("ledger_token", f", {L_TOKEN} SELECT * FROM l_token")(lambda c: ledger.ledger_token(c.transfers, SPAN))
L_ADDRESS = f"""l_address AS (SELECT {lo('block_number')} AS span_lo, address, count(DISTINCT tx) AS tx_count, CAST(sum(internal) AS BIGINT) AS internal_tx_count, CAST(sum(moved) AS BIGINT) AS token_transfer_count,
    CAST(sum(sent) AS BIGINT) AS sent_count, min(block_number) AS first_seen, max(block_number) AS last_seen, bool_or(is_contract) AS is_contract FROM contrib GROUP BY 1, 2)"""
query("ledger_address", f", {L_ADDRESS} SELECT * FROM l_address")(lambda c: ledger.ledger_address(c.txs, c.transfers, c.frames, c.contracts, SPAN))
query("prune_offsets", f", {L_CHAIN}, {L_TOKEN} SELECT 'chain' AS kind, name AS key, CAST(sum(count) AS BIGINT) AS count, CAST(NULL AS BIGINT) AS supply FROM l_chain WHERE span_lo + {SPAN} <= {CLOSED} GROUP BY name UNION ALL SELECT 'token', token_address, CAST(sum(transfer_count) AS BIGINT), CAST(sum(supply) AS BIGINT) FROM l_token WHERE span_lo + {SPAN} <= {CLOSED} GROUP BY token_address")(
    lambda c: ledger.prune_offsets(ledger.ledger_chain(c.blocks, c.txs, c.transfers, SPAN), ledger.ledger_token(c.transfers, SPAN), CLOSED, SPAN)
)
query("totals_with_offsets", "SELECT * FROM totals")(
    lambda c: ledger.totals_with_offsets(
        rollups.token_totals(c.transfers.where(F.col("block_number") >= CLOSED)),
        ledger.prune_offsets(ledger.ledger_chain(c.blocks, c.txs, c.transfers, SPAN), ledger.ledger_token(c.transfers, SPAN), CLOSED, SPAN),
    )
)
query("token_seed", f"SELECT address AS token_address, transfer_count, supply, holder_count FROM tokens WHERE address IN ('{TOKEN}', '{NFT}')")(
    lambda c: ledger.token_seed(c.transfers, ledger.ledger_token(c.transfers, SPAN), c.balances, c.rows("token_address string", (TOKEN,), (NFT,)), CLOSED)
)
query("span_diff", f", {L_TOKEN} SELECT span_lo, 'token' AS family, token_address AS key, 'transfer_count' AS counter, CAST(transfer_count + 1 AS VARCHAR) AS stored, CAST(transfer_count AS VARCHAR) AS truth FROM l_token WHERE token_address = '{TOKEN}'")(
    lambda c: ledger.span_diff(
        ledger.ledger_token(c.transfers, SPAN).withColumn("transfer_count", F.col("transfer_count") + (F.col("token_address") == TOKEN).cast("int")), ledger.ledger_token(c.transfers, SPAN), "token"
    )
)
query("span_settle", f"SELECT {lo('number')} AS lo, CASE WHEN {lo('number')} = 0 THEN 'repaired' ELSE 'ok' END AS prior, CASE WHEN {lo('number')} = 0 THEN 'quarantined' ELSE 'ok' END AS state FROM f_blocks GROUP BY 1, 2, 3")(
    lambda c: ledger.span_settle(
        c.blocks.select(ledger.span_of("number", SPAN).alias("lo")).distinct().withColumn("state", F.when(F.col("lo") == 0, "repaired").otherwise("ok")), c.rows("span_lo long", (0,), (0,)), True
    )
)
query("running_diff_chain_token", f"SELECT 'chain' AS family, 'txs' AS key, 'count' AS counter, CAST(count(*) + 3 AS VARCHAR) AS stored, CAST(count(*) AS VARCHAR) AS truth FROM f_tx")(
    lambda c: ledger.running_diff_chain_token(
        c.counters.withColumn("count", F.col("count") + F.when(F.col("name") == "txs", 3).otherwise(0)), c.token_totals,
        ledger.ledger_chain(*(df.where(F.col(k) < CLOSED) for df, k in ((c.blocks, "number"), (c.txs, "block_number"), (c.transfers, "block_number"))), SPAN),
        ledger.ledger_token(c.transfers.where(F.col("block_number") < CLOSED), SPAN),
        ledger.ledger_chain(*(df.where(F.col(k) >= CLOSED) for df, k in ((c.blocks, "number"), (c.txs, "block_number"), (c.transfers, "block_number"))), SPAN),
        rollups.token_totals(c.transfers.where(F.col("block_number") >= CLOSED)),
    )
)


def _drifted(c: Chain) -> DataFrame:
    """Stats with one address's counts changed, one missing, and one that nothing mentions."""
    changed = c.split_stats.where(F.col("address") != TOKEN_HOLDER).withColumn("tx_count", F.col("tx_count") + (F.col("address") == ADDRESS).cast("int"))
    extra = c.rows("address string", (UNKNOWN,)).select("address", *(F.lit(1).cast("long").alias(x) for x in (*rollups.STAT_SUMS, "first_seen", "last_seen")), F.lit(False).alias("is_contract"))
    return changed.unionByName(extra)


TOKEN_HOLDER = "0x" + "3".rjust(40, "0")
query("running_diff_address", f"""SELECT * FROM (SELECT '{ADDRESS}' AS address, 'tx_count' AS counter, CAST(tx_count + 1 AS VARCHAR) AS stored, CAST(tx_count AS VARCHAR) AS truth FROM stats WHERE address = '{ADDRESS}'
    UNION ALL SELECT '{UNKNOWN}', c, CASE WHEN c = 'is_contract' THEN 'false' ELSE '1' END, NULL FROM (SELECT unnest(['tx_count', 'internal_tx_count', 'token_transfer_count', 'sent_count', 'first_seen', 'last_seen', 'is_contract']) AS c)
    UNION ALL SELECT address, unnest(['tx_count', 'internal_tx_count', 'token_transfer_count', 'sent_count', 'first_seen', 'last_seen', 'is_contract']), NULL,
       unnest([CAST(tx_count AS VARCHAR), CAST(internal_tx_count AS VARCHAR), CAST(token_transfer_count AS VARCHAR), CAST(sent_count AS VARCHAR), CAST(first_seen AS VARCHAR), CAST(last_seen AS VARCHAR), CAST(is_contract AS VARCHAR)]) FROM stats WHERE address = '{TOKEN_HOLDER}')""")(
    lambda c: ledger.running_diff_address(_drifted(c), c.split)
)
query("address_truth", f"SELECT {STAT_SQL} FROM stats WHERE address IN (SELECT from_address FROM f_tx WHERE block_number < 20)")(
    lambda c: _truth(c)
)


def _truth(c: Chain) -> DataFrame:
    """The truth of the senders of the first blocks: closed spans and open rows, grouped for those addresses only."""
    wanted = c.txs.where("block_number < 20").select(F.col("from_address").alias("address")).distinct()
    mine = c.contributions.join(wanted, "address", "left_semi").withColumn("closed", F.col("block_number") < CLOSED)
    return ledger.address_truth(rollups.address_stats(mine, "closed"), addresses=wanted)


query("rebase_targets", f"SELECT DISTINCT address FROM contrib WHERE block_number < {CLOSED} AND address <> '{ADDRESS}'")(lambda c: ledger.rebase_targets(c.split.where("closed"), c.rows("address string", (ADDRESS,))))


def _moved(address: str) -> str:
    """Another address, of another bucket: the last two digits come first."""
    return f"concat('0x', substr({address}, 41, 2), substr({address}, 5, 38))"


def _wrong(c: Chain) -> DataFrame:
    """Stats of which a fifth counts too much, a fifth is missing, and for a fifth there is a row that nothing mentions."""
    kept = c.split_stats.where("tx_count % 5 <> 1").withColumn("tx_count", F.col("tx_count") + (F.col("tx_count") % 5 == 0).cast("int"))
    return kept.unionByName(c.split_stats.where("tx_count % 5 = 2").withColumn("address", F.concat(F.expr(_moved("address")), F.lit("ff"))))


def _plan(c: Chain) -> DataFrame:
    wrong, truth = _wrong(c), c.split
    targets = wrong.select("address").unionByName(truth.select("address")).distinct()
    return ledger.rebase_plan(wrong, ledger.address_truth(truth, addresses=targets), targets)


PLAN_SQL = f"""plan AS (SELECT address, CASE tx_count % 5 WHEN 0 THEN 'set' ELSE 'create' END AS action FROM stats WHERE tx_count % 5 IN (0, 1)
    UNION ALL SELECT concat({_moved('address')}, 'ff'), 'remove' FROM stats WHERE tx_count % 5 = 2)"""
query("rebase_plan", f", {PLAN_SQL} SELECT address, action FROM plan")(lambda c: _plan(c).select("address", "action"))
query("rebase_summary", f", {PLAN_SQL} SELECT action, '*' AS \"column\", count(*) AS n FROM plan GROUP BY action UNION ALL SELECT action, 'tx_count', count(*) FROM plan WHERE action = 'set' GROUP BY action")(lambda c: ledger.rebase_summary(_plan(c)))
query("rebase_apply", f"SELECT {STAT_SQL} FROM stats")(lambda c: ledger.rebase_apply(_wrong(c), _plan(c)))
query("repair_dry_run", f", {PLAN_SQL} SELECT CAST(concat('0x', substr(address, 3, 2)) AS BIGINT) AS bucket, count(CASE WHEN action = 'set' THEN 1 END) AS to_correct, count(CASE WHEN action = 'create' THEN 1 END) AS to_create, count(CASE WHEN action = 'remove' THEN 1 END) AS to_remove FROM plan GROUP BY 1")(
    lambda c: ledger.repair_dry_run(ledger.running_diff_address(_wrong(c), c.split))
)
query("repairable", f"SELECT address AS key, 'tx_count' AS counter, CASE WHEN tx_count % 3 = 0 THEN 'quarantine' WHEN tx_count % 3 = 1 THEN 'skip' ELSE 'repair' END AS verdict FROM stats")(
    lambda c: ledger.repairable(
        c.stats.select(F.col("address").alias("key"), F.lit("tx_count").alias("counter"), F.col("tx_count").cast("string").alias("truth")),
        # repaired twice, lately to the same truth or to another
        c.stats.select(F.col("address").alias("key"), F.lit("tx_count").alias("counter"), F.explode(F.array(F.struct(F.lit("-1").alias("value"), F.lit(1).alias("at")),
            F.struct(F.when(F.col("tx_count") % 3 == 0, F.col("tx_count")).otherwise(-2).cast("string").alias("value"), F.lit(2).alias("at")))).alias("r")).select("key", "counter", "r.*"),
        c.stats.where("tx_count % 3 = 1").select(F.col("address").alias("key"), F.lit("tx_count").alias("counter")),
    )
)


def _spans(c: Chain) -> DataFrame:
    rows = c.blocks.select(ledger.span_of("number", SPAN).alias("lo")).distinct()
    return rows.select("lo", (F.col("lo") + SPAN).alias("hi"), F.lit("ok").alias("state"), (F.col("lo") > 0).alias("pruned"), F.when(F.col("lo") > 500, F.col("lo")).alias("checked_at"))


#: Spans, with the lower half not pruned yet: the run and the span to find move with the head.
HALF = f"(SELECT {lo('max(number) / 2')} FROM f_blocks)"


def _upper(c: Chain) -> DataFrame:
    half = c.blocks.agg((F.max("number") / 2).cast("long").alias("half")).select(ledger.span_of("half", SPAN).alias("half")).first()["half"]
    return _spans(c).withColumn("pruned", F.col("lo") >= half)


query("compactable_run", f"SELECT {HALF} AS lo, {HALF} + {2 * SPAN} AS hi FROM f_blocks HAVING max(number) >= {HALF} + {SPAN}")(lambda c: ledger.compactable_run(_upper(c), 2, 10**9))
query("ledger_compact", f", {L_CHAIN} SELECT CASE WHEN span_lo >= {SPAN} AND span_lo < {3 * SPAN} AND (SELECT max(number) FROM f_blocks) >= {2 * SPAN} THEN {SPAN} ELSE span_lo END AS span_lo, name, CAST(sum(count) AS BIGINT) AS count FROM l_chain GROUP BY 1, 2")(
    lambda c: ledger.ledger_compact(ledger.ledger_chain(c.blocks, c.txs, c.transfers, SPAN), ledger.compactable_run(_spans(c), 2, 10**9), ["name"], ["count"])
)
query("next_token", f"SELECT min(address) AS address FROM tokens WHERE address > '{TOKEN}'")(lambda c: ledger.next_token(c.tokens, TOKEN).select("address"))
query("next_span", f"SELECT max(lo) AS lo, max(lo) + {SPAN} AS hi FROM (SELECT DISTINCT {lo('number')} AS lo FROM f_blocks) WHERE lo >= {HALF}")(
    # the later a span, the longer ago it was checked
    lambda c: ledger.next_span(_upper(c).withColumn("checked_at", -F.col("lo")), 10**9).select("lo", "hi")
)
query("token_creation", "SELECT address, block_number, creation_tx FROM tokens")(
    lambda c: ledger.token_creation(c.tokens.select("address", (F.col("block_number") + 10).alias("block_number"), F.lit("0xlate").alias("creation_tx")), c.transfers).select("address", "block_number", "creation_tx")
)
query("balance_drift", f"SELECT token_address, address, 'balance' AS counter, CAST(balance + 1 AS VARCHAR) AS stored, CAST(balance AS VARCHAR) AS truth FROM balances WHERE address = '{ADDRESS}'")(
    lambda c: ledger.balance_drift(c.balances.withColumn("balance", (F.col("balance") + (F.col("address") == ADDRESS).cast("int")).cast("decimal(38,0)")), c.history)
)
query("backfill_totals", f"SELECT {STAT_SQL} FROM stats")(
    lambda c: rollups.address_stats_merge(*(rollups.address_stats(c.dealt.where(w)) for w in (F.col("block_number") < 150, F.col("block_number") >= 150)))
)

# --- checks, samples, retention ------------------------------------------------------------------------------------

query("check_blocks_total", f"SELECT count(*) AS stored, max(number) - (SELECT CAST(coalesce(sum(to_block - from_block + 1), 0) AS BIGINT) FROM ({HOLES})) AS expected, count(*) = max(number) - (SELECT coalesce(sum(to_block - from_block + 1), 0) FROM ({HOLES})) AS ok FROM f_blocks")(
    lambda c: checks.check_blocks_total(c.counters, c.blocks, gaps.missing_ranges(c.blocks), 1)
)
query("check_supply", f"SELECT token_address, supply AS fact, supply AS stored, true AS ok FROM totals WHERE supply IS NOT NULL UNION ALL SELECT '{UNKNOWN}', 5, NULL, false")(
    lambda c: _supplies(c, c.stored(c.token_totals))  # a row per token, added up once for both sides
)


def _supplies(c: Chain, totals: DataFrame) -> DataFrame:
    """The stored totals against supplies from elsewhere: their own, and one of a token that isn't stored."""
    unknown = c.rows("token_address string, fact long", (UNKNOWN, 5)).select("token_address", F.col("fact").cast("decimal(38,0)").alias("fact"))
    return checks.check_supply(totals, totals.where("supply is not null").select("token_address", F.col("supply").alias("fact")).unionByName(unknown))


query("check_nonces", "SELECT address, sent_count AS fact, sent_count AS stored, true AS ok FROM stats WHERE sent_count > 0")(
    lambda c: checks.check_nonces(c.stats, c.txs.where(F.col("tx_type").isin(*rollups.COUNTED_TYPES)).groupBy(F.col("from_address").alias("address")).agg(F.count("*").alias("fact")))
)
query("check_span_txs", f", {L_CHAIN} SELECT span_lo, count AS fact, count AS stored, true AS ok FROM l_chain WHERE name = 'txs'")(
    lambda c: checks.check_span_txs(ledger.ledger_chain(c.blocks, c.txs, c.transfers, SPAN), c.txs.groupBy(ledger.span_of("block_number", SPAN).alias("span_lo")).agg(F.count("*").alias("fact")))
)
query("check_balances", f"SELECT token_address, address, balance AS stored, balance + CASE WHEN address = '{ADDRESS}' THEN 1 ELSE 0 END AS fact, CASE WHEN address <> '{ADDRESS}' THEN 'ok' WHEN token_address = '{TOKEN}' THEN 'wrong' ELSE 'suspect' END AS verdict FROM balances")(
    lambda c: _checked(c)
)


def _checked(c: Chain) -> DataFrame:
    facts = c.balances.select("token_address", "address", (F.col("balance") + (F.col("address") == ADDRESS).cast("int")).cast("decimal(38,0)").alias("fact"))
    return checks.check_balances(c.balances, facts, facts.where((F.col("token_address") == TOKEN) & (F.col("address") == ADDRESS)))


query("settled_balances", "SELECT b.token_address, b.address, b.balance, b.block_number FROM (SELECT token_address, address, balance, block_number FROM history) b WHERE NOT EXISTS (SELECT 1 FROM f_transfers m WHERE m.token_address = b.token_address AND m.block_number > b.block_number AND (m.from_address = b.address OR m.to_address = b.address))")(
    lambda c: checks.settled_balances(c.history.select("token_address", "address", "balance", "block_number"), c.transfers, None)
)
query("sender_sample", "SELECT address, sent_count FROM stats WHERE NOT is_contract AND sent_count > 0 AND tx_count <= 1000 AND address NOT IN (SELECT from_address FROM f_tx WHERE tx_type = 126)")(
    lambda c: checks.sender_sample(c.stats, c.txs, None, 1000)
)
RANGES = f"ranges AS (SELECT {lo('number')} AS lo, {lo('number')} + {SPAN} AS hi, count(*) AS stored, count(*) FILTER (WHERE number = 0) AS z FROM f_blocks GROUP BY 1, 2)"


def _ranges(c: Chain) -> DataFrame:
    return c.blocks.select(ledger.span_of("number", SPAN).alias("lo")).distinct().withColumn("hi", F.col("lo") + SPAN)


query("range_complete", f", {RANGES} SELECT lo, hi, stored, stored >= {SPAN} - CASE WHEN lo = 0 THEN 1 ELSE 0 END AS complete FROM ranges")(lambda c: retention.range_complete(c.blocks, _ranges(c)))
query("prune_day_floor", f"SELECT min(number) AS floor_block FROM days WHERE day = (SELECT max(day) FROM days WHERE number <= {LATE} - {FLOOR_GAP})")(lambda c: retention.prune_day_floor(c.blocks, c.late, FLOOR_GAP))
query("prunable_ranges", f", {RANGES} SELECT lo, hi, false AS prunable, CASE WHEN hi > {LATE} - 1000 THEN 'retained' WHEN hi > {LATE} - {FLOOR_GAP} THEN 'above the reorg floor' WHEN hi > (SELECT min(number) FROM days WHERE day = (SELECT max(day) FROM days WHERE number <= {LATE} - {FLOOR_GAP})) THEN 'reaches the reorg day' WHEN stored < {SPAN} - CASE WHEN lo = 0 THEN 1 ELSE 0 END THEN 'incomplete' END AS reason FROM ranges")(
    lambda c: retention.prunable_ranges(_ranges(c), c.blocks, _ranges(c).withColumn("state", F.lit("ok")), c.late, 1000, FLOOR_GAP)
)

# --- reorgs --------------------------------------------------------------------------------------------------------

CUT = 250


def _tables(c: Chain) -> dict[str, DataFrame]:
    return {"blocks": c.blocks, "txs": c.txs, "transfers": c.transfers, "frames": c.frames}


query("revert_tables", f"SELECT 'blocks' AS name, count(*) AS n FROM f_blocks WHERE number < {CUT} UNION ALL SELECT 'txs', count(*) FROM f_tx WHERE block_number < {CUT} UNION ALL SELECT 'transfers', count(*) FROM f_transfers WHERE block_number < {CUT} UNION ALL SELECT 'frames', count(*) FROM f_frames WHERE block_number < {CUT}")(
    lambda c: _union([df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in reorg.revert_tables(_tables(c), CUT, 10**9).items()])
)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


BELOW = f"FROM f_transfers, zero WHERE block_number < {CUT} GROUP BY token_address"
query("revert_deltas", f"SELECT token_address, transfer_count - coalesce(n, 0) AS transfer_count, supply - coalesce(s, 0) AS supply FROM totals LEFT JOIN (SELECT token_address, count(*) AS n, CAST(sum(CASE WHEN from_address = z THEN value ELSE 0 END - CASE WHEN to_address = z THEN value ELSE 0 END) AS BIGINT) AS s FROM f_transfers, zero WHERE block_number >= {CUT} GROUP BY token_address) USING (token_address)")(
    lambda c: reorg.apply_token_deltas(c.token_totals, reorg.revert_deltas(_tables(c), CUT, 10**9)["token"])
)
query("revert_chain", f"SELECT 'blocks' AS name, count(*) AS count FROM f_blocks WHERE number < {CUT} UNION ALL SELECT 'txs', count(*) FROM f_tx WHERE block_number < {CUT} UNION ALL SELECT 'transfers', count(*) FROM f_transfers WHERE block_number < {CUT}")(
    lambda c: reorg.apply_chain_deltas(c.counters.where("name in ('blocks', 'txs', 'transfers')"), reorg.revert_deltas(_tables(c), CUT, 10**9)["chain"])
)
query("revert_nft", f"""SELECT token_address, token_id, coalesce(was, sender, owner) AS owner FROM (SELECT token_address, token_id, owner,
    (SELECT arg_max(to_address, block_number * 100000 + log_index) FROM f_transfers m WHERE m.token_type = 'ERC721' AND m.token_address = n.token_address AND m.token_id = n.token_id AND block_number < {CUT}) AS was,
    (SELECT arg_min(from_address, block_number * 100000 + log_index) FROM f_transfers m WHERE m.token_type = 'ERC721' AND m.token_address = n.token_address AND m.token_id = n.token_id AND block_number >= {CUT}) AS sender FROM nfts n), zero
    WHERE NOT (was IS NULL AND sender IS NOT NULL AND sender = z)""")(lambda c: reorg.revert_nft(c.nfts, c.transfers, CUT, 10**9).select("token_address", "token_id", "owner"))
query("revert_address_stats", f"SELECT address, count(DISTINCT tx) AS tx_count, CAST(sum(internal) AS BIGINT) AS internal_tx_count, CAST(sum(moved) AS BIGINT) AS token_transfer_count, CAST(sum(sent) AS BIGINT) AS sent_count, min(block_number) AS first_seen, max(block_number) AS last_seen, bool_or(is_contract) AS is_contract FROM contrib WHERE block_number < {CUT} GROUP BY address")(
    lambda c: reorg.revert_address_stats(c.stats, c.dealt, CUT, 10**9)
)
query("revert_balances", f"SELECT token_address, address, arg_max(balance, block_number) AS balance, max(block_number) AS block_number FROM history WHERE block_number < {CUT} GROUP BY token_address, address")(
    lambda c: reorg.revert_balances(c.history, c.balances, CUT, 10**9)
)
query("reread_keys", f"SELECT DISTINCT token_address, a AS address FROM (SELECT token_address, from_address AS a FROM f_transfers WHERE block_number >= {CUT} UNION ALL SELECT token_address, to_address FROM f_transfers WHERE block_number >= {CUT}), zero WHERE a <> z")(
    lambda c: reorg.reread_keys(c.transfers, c.history, CUT, 10**9)
)


def _reads(c: Chain) -> DataFrame:
    return c.history.select("token_address", "address", "balance", "block_number", (F.col("block_number") % 5).alias("epoch"))


query("epoch_fence", "SELECT token_address, address, block_number, block_number % 5 AS epoch, block_number % 5 >= (SELECT max(g.block_number % 5) FROM history g WHERE g.token_address = h.token_address AND g.address = h.address) AS accepted FROM history h")(
    lambda c: reorg.epoch_fence(_reads(c), _reads(c).select("token_address", "address", "epoch")).drop("balance")
)
query("fold_work", "SELECT token_address, address, (k // 10000000) AS epoch, k % 10000000 AS block_number FROM (SELECT token_address, address, max((block_number % 5) * 10000000 + block_number) AS k FROM history GROUP BY token_address, address)")(
    lambda c: reorg.fold_work(_reads(c))
)
query("claim_rereads", "SELECT token_address, address, block_number % 5 AS epoch, CASE WHEN block_number % 25 >= 20 THEN block_number % 25 ELSE block_number % 25 + 1 END AS attempts, CASE WHEN block_number % 25 >= 20 THEN 'abandon' ELSE 'claim' END AS action FROM balances WHERE block_number % 2 = 0 ORDER BY block_number % 5, token_address, address LIMIT 100")(
    lambda c: reorg.claim_rereads(c.balances.select("token_address", "address", (F.col("block_number") % 5).alias("epoch"), (F.col("block_number") % 25).alias("attempts"), (F.col("block_number") % 2 == 0).alias("open")), 100)
)
query("current_balances_highest", "SELECT token_address, address, balance, block_number FROM balances")(lambda c: rollups.current_balances(c.history.unionByName(c.history)))
