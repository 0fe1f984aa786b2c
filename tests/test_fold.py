"""The daily fold as a stream against a recount of all blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from blockframe.operators import daily
from blockframe.plans.chain import Chain
from blockframe.plans.landing import _bundles
from blockframe.plans.maintenance import dense
from blockframe.sources import versions
from blockframe.streaming import days


@pytest.fixture(scope="module")
def bundles(spark, sf):
    return _bundles(Chain(spark, sf)).where("number <= 420").persist()


def want(spark, sf, numbers):
    c = Chain(spark, sf)
    own = lambda df, col: dense(df, col).where(F.col(col).isin(numbers))
    parts = daily.daily_parts(own(c.blocks, "number"), own(c.txs, "block_number"), own(c.transfers, "block_number"))
    return {r.day: r.asDict() for r in parts.collect()}


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(days.BUNDLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    days.daily_fold_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), **options).awaitTermination()
    return {r.day: {k: v for k, v in r.asDict().items() if k != "sketch"} for r in days.folded_days(spark, str(tmp_path / "out")).collect()}


def test_any_order_of_arrival_equals_a_recount(spark, sf, bundles, tmp_path):
    rng = random.Random(8)
    numbers = list(range(1, 421))
    cuts = sorted(rng.sample(numbers[1:300], 4))
    pieces = [numbers[a:b] for a, b in zip([0, *cuts], [*cuts, 420])]
    rng.shuffle(pieces)
    for piece in [*pieces, pieces[3]]:
        bundles.where(F.col("number").isin(piece)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, whole = run(spark, tmp_path), want(spark, sf, numbers)
    assert got == {day: {k: row[k] for k in got[day]} for day, row in whole.items()}
    facts = versions.current(spark, str(tmp_path / "out")).facts
    assert facts["watermark"] == bundles.agg(F.max("number")).first()[0] and facts["start"] > 0


def test_only_new_rows_are_read_and_a_batch_again_is_harmless(spark, sf, bundles, tmp_path, monkeypatch):
    read = []
    whole = versions.Snapshot.read

    def spy(self, table, buckets=None, schema=None):
        read.append((table, len(self.parts(table, buckets)), None if buckets is None else set(map(int, buckets))))
        return whole(self, table, buckets, schema)

    monkeypatch.setattr(versions.Snapshot, "read", spy)
    for low in range(1, 401, 100):
        bundles.where(F.col("number").between(low, low + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path, start=0)
    assert got == {day: {k: row[k] for k in got[day]} for day, row in want(spark, sf, list(range(1, 401))).items()}
    # no batch read stored blocks, nor anything of a day that it doesn't touch: 100 blocks meet two days at most
    assert not any(n for table, n, _ in read if table == "blocks")
    assert all(len(buckets) <= 2 for table, _, buckets in read[:-1] if table in ("active", "days"))
    # the last batch once more, as after a failure before its checkpoint
    now = versions.current(spark, str(tmp_path / "out"))
    rows = days.block_rows(bundles.where("number > 350 and number <= 400"))
    again = versions.commit(now, [], {"watermark": 0}, token=now.token)
    assert again is now and days.fold(now, rows, now.token).number == now.number
    assert run(spark, tmp_path, start=0) == got


def test_gap_waits_and_late_block_recounts_its_neighbours(spark, sf, bundles, tmp_path):
    def add(condition):
        bundles.where(condition).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return run(spark, tmp_path, start=200)

    def expect(numbers):
        return {day: {k: v for k, v in row.items()} for day, row in want(spark, sf, numbers).items()}

    got = add("number between 201 and 230 or number between 232 and 260")
    assert sum(r["blocks"] for r in got.values()) == 30  # what lies above the gap waits
    got = add("number = 231")
    assert got == {d: {k: r[k] for k in got[d]} for d, r in expect(list(range(201, 261))).items()}
    got = add("number between 199 and 200")  # late: the pair across the border is counted too
    assert got == {d: {k: r[k] for k in got[d]} for d, r in expect(list(range(199, 261))).items()}
    assert add("number between 199 and 231") == got


def test_sketches_merge_within_their_bound(spark, tmp_path):
    txs = spark.range(60_000).selectExpr("id div 6000 * 86400 + 5 AS block_timestamp", "concat('a', id % 23000) AS from_address", "IF(id % 7 = 0, NULL, concat('a', id % 3000)) AS to_address")
    exact = daily.sides(txs).select("address").distinct().count()
    sketches = daily.daily_sketches(txs).persist()
    merged = days.active_estimate(sketches).first().estimate
    assert abs(merged - exact) <= days.estimate_bound() * exact
    # the days' own estimates can't simply be added
    per = {r.day: r.active_addresses for r in daily.daily_active(txs, approx=True).collect()}
    true = {r.day: r.active_addresses for r in daily.daily_active(txs).collect()}
    assert all(abs(per[d] - true[d]) <= days.estimate_bound() * true[d] for d in true) and sum(per.values()) > 1.5 * exact
