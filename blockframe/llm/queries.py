"""The registered queries over the synthetic text tables, and the SQL of those that SQL can express.

Each query applies one operator, with production parameters, to a whole table and derives the digest columns from the
operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embed_dedup, fim, hard_negatives, html, langid, licenses, mixing, paragraphs, pii, quality, simhash

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("simhash")).alias("fingerprint"), "component_id")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    decoded = bpe.decode(encoded, path, pattern)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.learn_patterns(docs))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in pii.KINDS),
        F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.duplicate_passages(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.fold("doc_id", 3)
    model = langid.train(docs.where(fold != 1))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
     t AS (SELECT sum(sqrt(n)) AS all_raw, sum(n) AS all_n FROM n),
     r AS (SELECT source, sqrt(n) / all_raw * all_n / n AS rate FROM n, t),
     c(source, rate, k, p, c) AS (
       SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
       UNION ALL
       SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c
       WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
     d AS (SELECT *, CAST(concat('0x', substr(md5(concat('42|', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13)) AS BIGINT)
                     / 4503599627370496.0 AS u FROM documents)
SELECT doc_id, text, lang, d.source, n_chars, CAST(c.k AS INTEGER) AS copy
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u
"""


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = langid.fold("doc_id", 5)
    machine = quality.train(docs, labels.where(fold != 0))
    found = quality.score(docs, machine)
    return found.select(
        "doc_id",
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


#: Every anchor against every row, by plain products.
OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS own, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
           FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT own AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


#: The cuts by counting lines; a text that is rebuilt exactly has its own digest.
OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', doc_id)) AS h FROM documents),
     l AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS ls FROM d),
     g AS (SELECT *, len(ls) AS n, CAST(concat('0x', h[1:8]) AS BIGINT) % (len(ls) + 1) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) % (len(ls) + 1) AS h2,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                       WHEN CAST(concat('0x', h[25:32]) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
     c AS (SELECT doc_id, t, n, form, coalesce(array_to_string(ls[1:least(h1, h2)], ''), '') AS p,
                  coalesce(array_to_string(ls[least(h1, h2) + 1:greatest(h1, h2)], ''), '') AS m,
                  coalesce(array_to_string(ls[greatest(h1, h2) + 1:], ''), '') AS s FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_embeddings": op2_embeddings,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_paragraphs": op5_paragraphs,
    "op6_langid": op6_langid,
    "op7_mixing": op7_mixing,
    "op8_html": op8_html,
    "op9_quality": op9_quality,
    "op10_ann": op10_ann,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_licenses": op12_licenses,
    "op13_fim": op13_fim,
}
ORACLE_SQL = {"op7_mixing": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_fim": OP13_SQL}
