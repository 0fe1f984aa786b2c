from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import Row

from blockframe.llm import simhash


def naive_fingerprint(text: str) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(rows):
    """Least id reachable, for (id, fingerprint) rows, by comparing all pairs."""
    group = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows[:i]):
                if (a ^ b).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
        # labels settle within as many rounds as rows; small inputs only
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in group]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_its_definition():
    random.seed(4)
    words = ["a", "b", "Éa", "x y", "Zed", "q"]
    for n in (0, 1, 2, 3, 4, 40, 9000):
        text = random.choice([" ", "\t\n"]).join(random.choice(words) for _ in range(n))
        assert simhash.fingerprint(text) == naive_fingerprint(text)
    assert simhash.fingerprint(" \n\t") == 0
    assert simhash.fingerprint("A b C") == simhash.fingerprint("a  B\nc")


def test_golay_keys_are_shared_within_two_bits():
    random.seed(5)
    a = np.array([random.getrandbits(21) for _ in range(300)], dtype=np.int64)
    for flips in (0, 1, 2):
        b = a.copy()
        for i in range(len(b)):
            for bit in random.sample(range(21), flips):
                b[i] ^= 1 << bit
        for x, y in zip(simhash.golay_keys(a, 21), simhash.golay_keys(b, 21)):
            assert set(x) & set(y)
            assert len(x) <= 6


def test_components_match_all_pairs(spark):
    """Includes a crowd of near fingerprints, larger than the pair limit, and chains of links."""
    random.seed(6)
    prints = [random.getrandbits(64) for _ in range(10)]
    crowd = [prints[0] ^ (1 << random.randrange(30)) ^ (1 << random.randrange(30)) for _ in range(40)]
    chain = [prints[1]]
    for i in range(12):
        chain.append(chain[-1] ^ (3 << (2 * i)))
    rows = list(enumerate([*prints, *crowd, *chain, 0, 0], start=100))
    random.shuffle(rows)
    rows.append((None, random.getrandbits(64)))
    df = spark.createDataFrame([(i, signed(p)) for i, p in rows], "id long, simhash long").selectExpr("*", "simhash as content")
    got = {r.simhash: r.component_id for r in simhash.components(df).collect()}
    assert [got[signed(p)] for _, p in rows] == naive_components(rows)


def test_edge_rows(spark):
    rows = [
        Row(doc_id=5, text=None, simhash="x", component_id="y"),
        Row(doc_id=3, text="", simhash="x", component_id="y"),
        Row(doc_id=7, text="one two three four", simhash="x", component_id="y"),
        Row(doc_id=7, text="one two three four", simhash="x", component_id="y"),
        Row(doc_id=None, text="One TWO three four", simhash="x", component_id="y"),
        Row(doc_id=9, text="word " * 50_000, simhash="x", component_id="y"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, simhash string, component_id string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 7), (3, 3), (5, 3), (7, 7), (7, 7), (9, 9)]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    assert simhash.drop_near_duplicates(df.limit(0)).collect() == []


def test_query_against_all_pairs(spark, sf):
    from blockframe.llm.queries import op1_simhash

    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    prints = [(i, naive_fingerprint(t)) for i, t in texts]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, naive_components(prints))]
    assert sorted(map(tuple, op1_simhash(spark, sf).collect())) == want
