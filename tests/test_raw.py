"""Raw dumps: decoding what was encoded from the fixtures gives them again."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from blockframe.functions import u256
from blockframe.operators import decode
from blockframe.plans.chain import Chain
from blockframe.sources import raw


def write(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_blocks_and_transactions(spark, tmp_path):
    block = {
        "number": "0x10", "hash": "0xAA", "parentHash": "0xBB", "timestamp": "0x65920080", "gasUsed": "0x5208", "gasLimit": "0xffff", "size": "0x200", "nonce": "0x1",
        "miner": "0xCC", "transactions": [{"hash": "0xT1", "from": "0xF1", "to": None, "value": hex(2**255), "gas": "0x5208", "input": "0x60"}, {"hash": "0xT2", "from": "0xF1", "to": "0xF2", "nonce": "0x5", "type": "0x7e"}],
    }
    scanned = raw.raw_block_scan(spark, write(tmp_path, "b.json", [block, {"number": "0x11", "nonce": "0x0000000000000007", "difficulty": "0x2"}]))
    rows = {r.number: r for r in decode.blocks_from_raw(scanned).collect()}
    assert rows[16].nonce == "0x" + "0" * 16 and rows[17].nonce.endswith("7")
    assert (rows[16].difficulty, rows[17].difficulty, rows[16].transaction_count, rows[17].transaction_count) == ("0", "2", 2, 0)
    txs = {r.hash: r for r in decode.txs_from_raw(scanned).withColumn("value", u256.to_decimal(F.col("value"))).collect()}
    assert txs["0xt1"].value == str(2**255) and txs["0xt1"].to_address is None and txs["0xt1"].tx_type == 0
    assert (txs["0xt2"].value, txs["0xt2"].nonce, txs["0xt2"].tx_type, txs["0xt2"].gas_price, txs["0xt2"].tx_index) == ("0", 5, 126, 0, 1)


def test_receipt_logs(spark, tmp_path):
    receipt = {"transactionHash": "0xT1", "blockNumber": "0x10", "logs": [{"address": "0xAB", "topics": ["0x1", "0x2"], "data": "0x", "logIndex": "0x3"}, {"address": "0xAB", "topics": [], "data": "0x", "logIndex": "0x4"}]}
    rows = decode.logs_from_receipts(raw.receipts_scan(spark, write(tmp_path, "r.json", [receipt]))).orderBy("log_index").collect()
    assert [(r.log_index, r.topic0, r.topic1, r.topic2) for r in rows] == [(3, "0x1", "0x2", None), (4, None, None, None)]


def frame(kind, to, calls=(), **more):
    return {"type": kind, "from": "0xF", "to": to, "calls": list(calls), **more}


def test_traces(spark, tmp_path):
    tree = frame("CALL", "0xa", [frame("CREATE", "0xb", output="0x60"), frame("CALL", "0xc", [frame("CREATE2", "0xd", output="0x61"), frame("WEIRD", "0xe", gas="0x0", input="0x")], error="reverted")])
    rows = [{"txHash": "0x1", "blockNumber": 5, "timestamp": 7, "result": json.dumps(tree)}, {"txHash": "0x2", "error": "no trace"}, {"txHash": "0x3", "result": json.dumps({"from": "0x1"})}]
    path = write(tmp_path, "t.json", rows)
    flat = {r.trace_address: r for r in decode.flatten_frames(raw.trace_scan(spark, path)).collect()}
    assert set(flat) == {"0", "1", "1,0", "1,1"}
    assert flat["1,1"].call_type == "call" and flat["1,1"].gas is None and flat["1,1"].input is None
    made = decode.contracts_from_frames(decode.flatten_frames(raw.trace_scan(spark, path)), spark.createDataFrame([], "address string")).collect()
    assert [(r.address, r.bytecode) for r in made] == [("0xb", "60")]  # the one below a failed frame didn't last
    with pytest.raises(PySparkException):
        raw.trace_scan(spark, path, strict=True).collect()


def test_deep_and_wide_traces(spark, tmp_path):
    deep = frame("CREATE", "0x0")
    for i in range(1, 200):
        deep = frame("CALL", f"0x{i}", [deep])
    wide = frame("CALL", "0xa", [frame("CALL", "0xb", [frame("CALL", f"0x{i}") for i in range(40)]) for _ in range(10)])
    rows = [{"txHash": h, "blockNumber": 5, "timestamp": 7, "result": json.dumps(t)} for h, t in (("0x1", deep), ("0x2", wide), ("0x3", frame("CALL", "0xc")))]
    got = decode.flatten_frames(raw.trace_scan(spark, write(tmp_path, "t.json", rows))).collect()
    paths = {h: {r.trace_address for r in got if r.tx_hash == h} for h in ("0x1", "0x2", "0x3")}
    assert paths["0x1"] == {",".join(["0"] * n) for n in range(1, 200)}
    assert paths["0x2"] == {f"{i}" for i in range(10)} | {f"{i},{j}" for i in range(10) for j in range(40)}
    assert paths["0x3"] == set()


def test_creations_csv(spark, tmp_path):
    a, t = "0x" + "Ab" * 20, "0x" + "1" * 64
    (tmp_path / "good.csv").write_text(f"address,creation_tx,block_number\n{a},{t},5\n{a},{t},6,{a}\n")
    rows = sorted(raw.creations_csv(spark, str(tmp_path / "good.csv")).collect(), key=lambda r: r.block_number)
    assert [(r.address, r.block_number, r.creator) for r in rows] == [(a.lower(), 5, None), (a.lower(), 6, a.lower())]
    (tmp_path / "bad.csv").write_text(f"{a},nothing,5\n")
    with pytest.raises(PySparkException):
        raw.creations_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_transfer_logs_decode_to_the_transfers(spark, sf):
    c = Chain(spark, sf)
    keys = ["tx_hash", "log_index", "token_address", "from_address", "to_address", "token_type"]
    back = decode.transfer_decode(c.logs).withColumn("value", u256.to_decimal(F.col("value")))
    a = c.transfers.select(*keys, F.col("value").cast("string").alias("value"))
    assert a.exceptAll(back.select(*keys, "value")).count() == 0 and back.count() == a.count()


def test_deposits(spark):
    topic = "0x" + "0" * 24 + "ab" * 20
    body = f"{5:064x}{2**200:064x}{21000:016x}00" + "beef"
    data = "0x" + f"{32:064x}{len(body) // 2:064x}" + body
    made = "0x" + f"{32:064x}{73:064x}" + f"{0:064x}{0:064x}{7:016x}01"
    rows = [("0x1", 1, 0, topic, topic, data), ("0x1", 1, 1, topic, topic, made), ("0x1", 1, 2, topic, topic, data[:-4]), ("0x1", 1, 3, topic, topic, "0x")]
    df = spark.createDataFrame(rows, "tx_hash string, block_number long, log_index int, topic1 string, topic2 string, data string")
    got = decode.deposit_decode(df).withColumns({"mint": u256.to_decimal(F.col("mint")), "value": u256.to_decimal(F.col("value"))}).orderBy("log_index").collect()
    assert [(r.log_index, r.to_address, r.mint, r.value, r.gas_limit, r.is_creation, r.payload) for r in got] == [
        (0, "0x" + "ab" * 20, "5", str(2**200), 21000, False, "0xbeef"), (1, None, "0", "0", 7, True, "0x"),
    ]


def test_abi_strings(spark):
    word = "DAI".encode().hex()
    long = "0x" + f"{32:064x}{3:064x}" + word.ljust(64, "0")
    rows = [("long", long), ("raw", "0x" + word.ljust(64, "0")), ("empty", "0x"), ("short", "0x" + f"{32:064x}{99:064x}" + word)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k string, d string").select("k", decode.abi_string(F.col("d")).alias("s")).collect()}
    assert got == {"long": "DAI", "raw": "DAI", "empty": "", "short": "DAI"}


def test_history_layout_and_archive(spark, sf, tmp_path):
    c = Chain(spark, sf)
    out = str(tmp_path / "history")
    raw.write_history(c.txs, out, "block_number", 100)
    assert spark.read.parquet(out).where("block_bucket = 100").count() == c.txs.where("block_number between 100 and 199").count()
    raw.archive_export(c.txs.where("block_number < 50"), str(tmp_path / "archive"))
    manifest = raw.archive_manifest(spark, str(tmp_path / "archive")).collect()
    assert sum(r.rows for r in manifest) == c.txs.where("block_number < 50").count()
    assert all(len(r.digest) == 64 and r.bytes > 0 for r in manifest)


def test_deposit_source(spark):
    rows = [("0xAB", "t", 5), ("0xab", "t", 9), ("0xab", "u", 5), ("0xcd", "t", 5)]
    df = spark.createDataFrame(rows, "address string, topic0 string, block_number long")
    assert [r.block_number for r in raw.deposit_logs(df, "0xAb", "t", 10, 2).collect()] == [5]
    assert raw.deposit_logs(df, "0xAb", "t", 10, 2, after=5).count() == 0
