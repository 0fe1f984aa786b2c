from __future__ import annotations

from zlib import crc32

from pyspark.sql import functions as F

from blockframe.llm import langid, quality
from blockframe.llm.queries import op6_langid, op9_quality


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_langid(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_edge_rows(spark):
    docs = [(i, t, y) for i, (t, y) in enumerate([("the cat and the dog of this", "en"), ("der hund und die katze im", "de")] * 30)]
    docs += [(None, "no id here", "en"), (900, None, "en"), (901, "no language", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == ("de", "en")
    asked = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the dog and the cat", "x"), (5, "der hund " * 100_000, "x")], "i int, text string, score string")
    got = {r.i: (r.lang_pred, r.score) for r in langid.predict(asked, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[5][0] == "de"
    assert langid.predict(asked.limit(0), model).collect() == []
    empty = langid.train(df.where(F.col("lang") == "none"))
    assert {r.lang_pred for r in langid.predict(asked, empty).collect()} == {"und"}
    single = langid.train(df.where(F.col("lang") == "en"))
    assert langid.predict(asked.where("i = 4"), single).first().lang_pred == "en"


def test_grams_do_not_depend_on_blocks(monkeypatch):
    import numpy as np

    text = "Größe und Maß, 12 x " * 500
    whole = np.bincount(np.concatenate(list(langid.grams(text))), minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "_BLOCK", 97)
    parts = np.bincount(np.concatenate(list(langid.grams(text))), minlength=langid.BUCKETS)
    assert (whole == parts).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op9_quality(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.93 * len(held)


def test_factorisation_is_the_sum_over_pairs():
    import numpy as np

    at, x = quality.features("One two three two!\nFour | five")
    random = np.random.default_rng(3)
    size = quality.WORD_BUCKETS + len(quality.STATISTICS)
    m = quality.Machine(0.25, random.normal(size=size).astype(np.float32), random.normal(size=(size, 4)).astype(np.float32))
    pairs = sum(float(m.factors[at[i]].astype(float) @ m.factors[at[j]].astype(float)) * float(x[i]) * float(x[j]) for i in range(len(at)) for j in range(i))
    assert abs(m.margin(at, x) - (0.25 + float(m.linear[at].astype(float) @ x) + pairs)) < 1e-3


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "Good text here. " * 20, "a"), (None, "BAD!!", "a"), (3, "Good text here.", "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).collect() == []
