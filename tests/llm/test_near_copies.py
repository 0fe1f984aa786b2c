from __future__ import annotations

import random

import corpus_pipeline
from blockframe.llm import simhash


def brute(rows):
    """The ids that stay: the least of each group of (id, text) linked by 5-word Jaccard of 0.8, over all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))})
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if min(len(s), len(t)) >= 0.8 * max(len(s), len(t)) and len(s & t) >= 0.8 * len(s | t):
                group[top(a)] = top(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[top(a)] = min(least.get(top(a), i), i)
    return sorted(least.values())


def test_stage_matches_all_pairs_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert kept.columns == docs.columns
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want


def test_edited_copies_go_and_others_stay(spark):
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows = []
    for g in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randint(100, 300))]
        rows.append((len(rows), " ".join(words)))
        for edits in (0, 1, 2, 3, 8):
            copy = list(words)
            for at in r.sample(range(len(copy)), edits):
                copy[at] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy).upper() if edits == 0 else " ".join(copy)))
    rows += [(10_000, ""), (10_001, None), (10_002, "two words"), (10_003, "Two  words"), (10_003, "Two  words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(x.doc_id for x in simhash.drop_near_copies(df).collect())
    assert kept == brute(rows)
    assert len(kept) < 100
    assert simhash.drop_near_copies(df.limit(0)).collect() == []
