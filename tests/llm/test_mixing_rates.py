from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from blockframe.llm import mixing


def draw(text, mean):
    u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13
    k, p = 0, math.exp(-mean)
    c = p
    while c <= u and k < mean + 12 * math.sqrt(mean) + 30:
        k += 1
        p = p * mean / k
        c += p
    return k


def test_a_source_of_one_row_with_a_rate_of_thousands(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("big").alias("source"))
    one = spark.createDataFrame([(7_000_000, None)], "doc_id long, source string")
    docs = rows.unionByName(one)
    rate = {r.source: r.rate for r in mixing.rates(docs, weights={"big": 1.0, None: 2.0}).collect()}[None]
    assert 2600 < rate < 2700
    n = math.ceil(rate / 500)
    want = draw("42|7000000", rate / n) + sum(draw(f"42 part|7000000|{j}", rate / n) for j in range(1, n))
    out = mixing.replicate(docs, weights={"big": 1.0, None: 2.0}).where("source is null").collect()
    assert sorted(r.copy for r in out) == list(range(want))
    assert abs(want - rate) < 5 * math.sqrt(rate)


def test_large_rates_have_the_mean_and_spread_of_the_distribution(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    got = Counter(r.doc_id for r in mixing.replicate(docs, epochs=1300.0).select("doc_id").collect())
    times = [got[i] for i in range(300)]
    mean = sum(times) / 300
    assert abs(mean - 1300) < 5 * math.sqrt(1300 / 300)
    assert 0.7 * 1300 < sum((x - mean) ** 2 for x in times) / 299 < 1.4 * 1300


def test_rates_up_to_the_limit_are_one_draw(spark):
    docs = spark.createDataFrame([(i, "a") for i in range(20)], "doc_id long, source string")
    got = Counter(r.doc_id for r in mixing.replicate(docs, epochs=650.0).collect())
    assert all(got[i] == draw(f"42|{i}", 650.0) for i in range(20))
