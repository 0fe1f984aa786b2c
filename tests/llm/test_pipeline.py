from __future__ import annotations

from collections import Counter

import corpus_pipeline
from blockframe.llm import langid, mixing, pii
from test_near_copies import brute


def test_stages_and_run(spark, sf):
    """Each stage against plain Python over its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        before = current.collect()
        current = stage(spark, current, sf).persist()
        rows[name] = after = current.collect()
        if name == "language_id":
            kept = {r.doc_id for r in after}
            assert {r.doc_id for r in before if any(c.isalpha() for c in r.text)} - kept == set()
        elif name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in after) == brute([(r.doc_id, r.text) for r in before])
        elif name == "pii":
            assert len(after) == len(before)
            assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in after)
            clean = {r.doc_id: r.text for r in before if not pii.base_spans(r.text)}
            assert sum(clean.get(r.doc_id) == r.text for r in after) == len(clean)
        elif name == "mixing":
            want = mixing.replicate(spark.createDataFrame(before, docs.schema)).collect()
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in want)
        else:
            assert len(after) == len(before) and all(r.exact and r.n_tokens == len(r.ids) for r in after)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert current.columns == columns
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r.doc_id, tuple(r.ids)) for r in rows["byte_bpe"])


def test_rejects_text_without_a_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**9, None, "en", "src0", 0), (10**9 + 1, "12 34 !!", None, "src0", 8)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(extra), sf)
    assert kept.where(f"doc_id >= {10**9}").count() == 0
    assert langid.UNDETERMINED == "und"


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_clashing_columns_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    named = docs.selectExpr("*", "'a' as lang_pred", "0.0d as score", "7 as copy", "'n' as node", "1L as id", "'r' as row")
    odd = named.limit(40).unionByName(named.limit(5))
    odd = odd.unionByName(odd.limit(1).selectExpr("null as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "0L as n_chars", "lang_pred", "score", "copy", "node", "id", "row"))
    current = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, sf)
        assert current.columns == named.columns, name
        rows = current.collect()
        assert rows and all((r.lang_pred, r.score, r["copy"], r.node, r.id, r.row) == ("a", 0.0, 7, "n", 1, "r") for r in rows)
        current = spark.createDataFrame(rows, named.schema)
