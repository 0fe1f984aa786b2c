"""A corpus pipeline: language ID, near-dedup, redaction, mixing to target weights, tokenising.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockframe.llm import bpe, langid, mixing, pii, simhash
from blockframe.llm.queries import VOCABULARY
from blockframe.llm.runtime import remove, shared_folder

#: Calibrated probability below which a language isn't taken as identified.
LEAST_SCORE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; those without letters or without a likely language go.

    Null and empty texts have none. Repeated rows are judged alike; texts of any length are judged whole. Columns are those
    of docs, whatever their names. If no row has a language to learn from, none can be told, and no row stays.
    """
    pred, score = _free(docs, "lang_pred"), _free(docs, "score")
    found = langid.predict(docs, langid.train(docs), "text", pred, score)
    return found.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose 5-word shingles have a Jaccard similarity of 0.8: the one with the least id.

    Null and empty texts are one group; ties and repeated rows leave one row. Texts of any length are compared whole.
    Columns are those of docs. An empty table stays empty.
    """
    return simhash.drop_near_copies(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by its kind; n_chars follows the text.

    A null text stays null, with a null n_chars. Repeated rows are redacted alike, texts of any length whole.
    """
    clean = pii.redact(docs, pii.learn_patterns(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources weigh as the root of their size, in a global shuffle.

    A null source is a source of its own; rows that share an id are drawn alike. Texts, null, empty or of any length, are
    passed on as they are. Columns are those of docs. An empty table stays empty.
    """
    return mixing.replicate(docs, copy=_free(docs, "copy")).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its token ids, their number, and whether they decode to its text.

    Null and empty texts have no ids. Texts of any length are encoded whole; repeated rows are each encoded alike. Of the
    other columns only those of documents are passed on. An empty table stays empty.
    """
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    done = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), exact.alias("exact"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: No stage but the mixing can be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages leave of documents. Stages are written below the cluster's shared checkpoint folder, and
    removed once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if number:
            remove(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
