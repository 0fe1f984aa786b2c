from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from blockframe.functions import chain, u256

EXTREMES = [0, 1, 7, 10**18, 10**26 - 1, 10**26, 10**52 - 1, 10**52, 2**255, 2**256 - 1]


def values():
    r = random.Random(2)
    return EXTREMES + [r.getrandbits(r.choice([60, 90, 130, 200, 256])) for _ in range(40)]


def test_round_trips(spark):
    df = spark.createDataFrame([(hex(v), str(v)) for v in values()], "h string, d string")
    rows = df.select("d", u256.to_decimal(u256.from_hex(F.col("h"))).alias("a"), u256.to_decimal(u256.from_decimal(F.col("d"))).alias("b"), u256.to_decimal(u256.negate(u256.from_decimal(F.col("d")))).alias("n"))
    for r in rows.collect():
        assert r.a == r.b == r.d and r.n == ("-" if r.d != "0" else "") + r.d


def test_amounts_around_two_words(spark):
    known = {"0x0": 0, "0xffffffffffffffff": 2**64 - 1, "0x10000000000000000": 2**64, "0XFF": 255, "0x" + "0" * 63 + "9": 9, "": 0}
    df = spark.createDataFrame([(h, str(v)) for h, v in known.items()] + [(None, "")], "h string, d string")
    number = u256.from_hex(F.col("h"))
    assert df.select(number.alias("n")).schema["n"].dataType.simpleString() == u256.TYPE
    for r in df.select("h", "d", u256.to_decimal(number).alias("n")).collect():
        assert r.n == r.d, r.h


def test_unknown_is_not_zero(spark):
    row = spark.range(1).select(
        u256.to_decimal(u256.from_decimal(F.lit(""))).alias("e"), u256.to_decimal(u256.from_decimal(F.lit(None).cast("string"))).alias("n"),
        u256.to_decimal(u256.from_decimal(F.lit("0"))).alias("z"), u256.to_decimal(u256.from_hex(F.lit("0x"))).alias("x"),
    ).first()
    assert (row.e, row.n, row.z, row.x) == ("", "", "0", "0")


def test_signed_sums_and_order(spark):
    r = random.Random(3)
    signed = [r.choice([1, -1]) * v for v in values() for _ in range(3) if v < 2**250]
    df = spark.createDataFrame([(i % 7, str(abs(v)), v < 0, i) for i, v in enumerate(signed)], "g int, d string, n boolean, i int")
    value = u256.from_decimal(F.col("d"))
    df = df.withColumn("v", F.when(F.col("n"), u256.negate(value)).otherwise(value))
    got = {x.g: x.s for x in df.groupBy("g").agg(u256.to_decimal(u256.total(F.col("v"))).alias("s")).collect()}
    assert got == {g: str(sum(signed[g::7])) for g in range(7)}
    assert [signed[x.i] for x in df.orderBy("v", "i").collect()] == sorted(signed)
    assert df.where("i < 0").agg(u256.total(F.col("v")).alias("s")).first().s is None


def test_saturation(spark):
    limit = 10**78 - 1
    row = spark.range(1).select(u256.to_decimal(u256.saturate(u256.literal(limit))).alias("a"), u256.to_decimal(u256.saturate(u256.literal(-limit))).alias("b")).first()
    assert (row.a, row.b) == (str(limit), str(-limit))


@pytest.mark.parametrize("path, want", [("", []), ("0", [""]), ("0,1", ["", "0"]), ("2,0,11", ["", "2", "2,0"])])
def test_enclosing_paths(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(chain.enclosing_paths(F.col("p")).alias("x")).first().x == want


def test_scalars(spark):
    df = spark.createDataFrame([("0x" + "ab" * 20, 1704067199, "0x" + "00" * 12 + "AB" * 20, "TK7 (Token 7)", "0x60016002")], "a string, ts long, topic string, label string, code string")
    r = df.select(
        chain.address_bucket(F.col("a")).alias("bucket"), chain.short_label(F.col("a")).alias("short"), chain.short_label(F.lit("0x12")).alias("same"),
        chain.day_of(F.col("ts")).alias("day"), chain.epoch_of(chain.day_of(F.col("ts"))).alias("epoch"), chain.topic_address(F.col("topic")).alias("addr"),
        chain.symbol_of(F.col("label")).alias("symbol"), chain.gwei(F.lit(2_500_000_000)).alias("gwei"), chain.bytecode_hash(F.col("code")).alias("hash"),
        chain.is_numeric(F.lit("12")).alias("num"), chain.is_numeric(F.lit("12a")).alias("not_num"), chain.floor_zero(F.lit(-3)).alias("floor"), chain.hex_to_long(F.lit("0xff")).alias("hex"),
    ).first()
    assert (r.bucket, r.short, r.same) == (0xAB, "0xabababab...ababab", "0x12")
    assert (str(r.day), r.epoch, r.addr) == ("2023-12-31", 1703980800, "0x" + "ab" * 20)
    assert (r.symbol, r.gwei, r.hash, r.num, r.not_num, r.floor, r.hex) == ("TK7", 2.5, "60016002".rjust(64, "0"), True, False, 0, 255)
    assert chain.bucket_bounds(0) == ("0x00", "0x01") and chain.bucket_bounds(255) == ("0xff", "0y")
