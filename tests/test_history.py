"""History with index and postings: few files are read, and results are those of scans of the whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from blockframe.operators import decode, feeds
from blockframe.plans.chain import Chain
from blockframe.sources import history, versions

SIZE = 50
A = "0x" + "1".rjust(40, "0")
FAR = "0x" + "9".rjust(40, "0")


def scans(df):
    """Files that the scans of an executed query read."""
    df.collect()
    files, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            stack.append(node.plan())
            continue
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            files += metrics.apply("numFiles").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return files


@pytest.fixture(scope="module")
def tables(spark, sf):
    c = Chain(spark, sf)
    whole = {"blocks": c.blocks, "txs": c.txs, "logs": c.logs, "transfers": c.transfers, "frames": c.frames}
    return {n: df.where(F.col(history.TABLES[n][0]) < 350).persist() for n, df in whole.items()}


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    now = versions.current(spark, str(tmp_path_factory.mktemp("history")))
    for lo, hi in ((0, 150), (150, 350)):
        part = {n: df.where(F.col(history.TABLES[n][0]).between(lo, hi - 1)) for n, df in tables.items()}
        now = history.append(now, part, SIZE)
    return now


def same(got, want):
    columns = want.columns
    return sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.collect()))


def test_tables_come_back_whole(stored, tables):
    for name, df in tables.items():
        assert same(stored.read(name), df), name


def test_lookups_read_few_files(stored, tables):
    hashes = [r.hash for r in tables["txs"].select("hash").orderBy(F.xxhash64("hash")).limit(3).collect()]
    for h in hashes:
        for name, column in (("txs", "hash"), ("logs", "tx_hash"), ("transfers", "tx_hash"), ("frames", "tx_hash")):
            got = history.by_hash(stored, name, h)
            assert same(got, tables[name].where(F.col(column) == h)), (name, h)
        assert scans(history.by_hash(stored, "txs", h)) <= 2  # the files of one range, however many there are
        assert len(stored.parts("tx_index", [history._part_of(h, history.INDEX_PARTS)])) <= 2
    assert history.by_hash(stored, "txs", "0xnone").collect() == []
    assert len(stored.parts("txs")) >= 7


def test_feeds_equal_scans(stored, tables, monkeypatch):
    for bound in (None, (340, 2), (160, 0)):
        for n in (1, 7, 25):
            want = feeds.txs_by_address(tables["txs"], tables["transfers"], A, bound, n)
            assert [r.hash for r in history.txs_by_address(stored, A, bound, n).collect()] == [r.hash for r in want.collect()]
            want = feeds.transfers_by_address(tables["transfers"], A, bound, n).drop("total")
            assert history.transfers_by_address(stored, A, bound, n).select(want.columns).collect() == want.collect()
    want = feeds.frames_by_address(tables["frames"], A, 25).drop("total")
    assert history.frames_by_address(stored, A, 25).select(want.columns).collect() == want.collect()
    assert history.txs_by_address(stored, "0xnobody", None, 5).collect() == []
    assert history.postings_total(stored, "transfer", A).first().total == tables["transfers"].where((F.col("from_address") == A) | (F.col("to_address") == A)).count()


def test_a_feed_reads_the_newest_ranges_only(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "FEED_BLOCKS", 25)
    now = history.append(versions.current(spark, str(tmp_path)), {k: tables[k] for k in ("txs", "transfers")}, SIZE)
    read = []
    whole = versions.Snapshot.read

    def spy(self, table, buckets=None, schema=None):
        read.append((table, list(buckets)))
        return whole(self, table, buckets, schema)

    monkeypatch.setattr(versions.Snapshot, "read", spy)
    got = history.txs_by_address(now, A, None, 3).collect()
    postings = [b for t, bs in read if t == "postings" for b in bs]
    assert len(got) == 3 and len(postings) <= 3 < len({b for b in now.buckets("postings") if b.startswith(postings[0].split("-")[0] + "-")})
    assert len([b for t, bs in read if t == "txs" for b in bs]) <= 2  # ranges that the page's rows lie in
    want = feeds.txs_by_address(tables["txs"], tables["transfers"], A, (200, 1), 30)
    assert [r.hash for r in history.txs_by_address(now, A, (200, 1), 30).collect()] == [r.hash for r in want.collect()]


def test_append_is_idempotent_and_new_keys_need_no_stored_ones(spark, stored, tables):
    again = history.append(stored, {k: tables[k] for k in ("txs", "transfers")}, SIZE)
    assert again.read("txs").count() == tables["txs"].count() and again.read("transfers").count() == tables["transfers"].count()
    fresh = tables["txs"].withColumn("hash", F.concat(F.lit("0xnew"), F.substring("hash", 6, 100)))
    got = history.unstored(stored, "txs", fresh, SIZE)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == fresh.count() and "/txs/commit" not in plan and "Anti" not in plan
    mixed = fresh.where("block_number % 2 = 0").unionByName(tables["txs"])
    want = decode.append_new(mixed, stored.read("txs"), ["hash"])
    assert same(history.unstored(stored, "txs", mixed, SIZE).select(want.columns), want)


def test_revert_writes_only_the_ranges_it_touches(spark, stored, tables):
    stored = versions.current(spark, stored.path)
    after = history.revert(stored, 270, 340)
    for name, df in tables.items():
        column = history.TABLES[name][0]
        assert same(after.read(name), df.where(~F.col(column).between(270, 340))), name
        kept = [b for b in stored.buckets(name) if int(b) < 250]
        assert kept and all(after.folders[name][b] == stored.folders[name][b] for b in kept)
    gone = tables["txs"].where("block_number = 300").first().hash
    assert history.by_hash(after, "txs", gone).collect() == []
    left = tables["transfers"].where("block_number < 270 or block_number > 340")
    want = feeds.transfers_by_address(left, A, None, 10).drop("total")
    assert history.transfers_by_address(after, A, None, 10).select(want.columns).collect() == want.collect()
    # what was reverted comes again, in other blocks too
    moved = tables["txs"].where("block_number between 300 and 310").withColumn("block_number", F.col("block_number") + 100)
    last = history.append(after, {"txs": moved}, SIZE)
    assert [r.block_number for r in history.by_hash(last, "txs", gone).collect()] == [400]


def test_compacting_keeps_everything(spark, tables, tmp_path):
    now = versions.current(spark, str(tmp_path))
    for lo in range(0, 40, 10):
        now = history.append(now, {"txs": tables["txs"].where(F.col("block_number").between(lo, lo + 9))}, SIZE)
    small = history.compact(now, most=2)
    assert max(len(p) for p in small.folders["tx_index"].values()) <= 2 and max(len(p) for p in small.folders["txs_sketch"].values()) <= 2
    h = tables["txs"].where("block_number = 25").first().hash
    assert history.by_hash(small, "txs", h).first().hash == h and history.unstored(small, "txs", tables["txs"].where("block_number < 40"), SIZE).isEmpty()
