from __future__ import annotations

import random

from pyspark.sql import functions as F

from blockframe.llm import langid


def test_a_rare_language_is_learned_at_any_size(spark):
    r = random.Random(3)
    words = {"en": "the cat and dog of this house with that".split(), "de": "der hund und die katze im haus mit das".split(), "fi": "kissa ja koira talossa joka on hyvin vanha".split()}
    text = lambda y: " ".join(r.choice(words[y]) for _ in range(12))
    rows = [(i, text(y), y) for i in range(6000) for y in ["fi" if i % 300 == 7 else "en" if i % 3 else "de"]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    least = df.orderBy(F.xxhash64("doc_id", "text")).limit(60).select("lang").distinct()
    assert "fi" not in {x.lang for x in least.collect()}  # an undivided sample misses it
    model = langid.train(df, sample_rows=60)
    assert model.languages == ("de", "en", "fi")
    got = langid.predict(df, model).groupBy("lang", "lang_pred").count().collect()
    assert sum(x["count"] for x in got if x.lang == x.lang_pred) >= 5990
    assert sum(x["count"] for x in got if x.lang == x.lang_pred == "fi") == 20


def test_quotas():
    assert langid.quotas({"a": 30, "b": 7}, 4000) == {"a": 30, "b": 7}
    assert langid.quotas({"a": 3_000_000, "b": 999_990, "c": 10, "d": 500}, 4000) == {"a": 3000, "b": 1000, "c": 10, "d": 100}


def test_equal_rows_are_bounded_by_the_quota(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the cat").alias("text"), F.lit("en").alias("lang"))
    rows = df.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    assert len(langid._stratified(rows, {"en": 3000}, {"en": 100})) == 100
