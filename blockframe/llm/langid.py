"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased letters of a whole text (all else is one space), hashed to
`BUCKETS` columns. Document frequencies are counted over all rows to learn from. The weights are trained by
follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty on a bounded sample of each language's rows,
and a temperature fitted on a held-out fifth of the sample calibrates the probabilities. Languages are counted over all
rows; where the sample holds more of a rare one than its share, the biases are corrected to the true shares.

A text's term frequencies are relative to its number of n-grams, so its score is the mean, over its places, of
idf x weight of the n-gram there: linear in the text, without a table per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import add_columns, bound_batches, texts

BUCKETS = 1 << 16
#: Rows of the labelled sample that the weights are fitted on; each language has its share of them, but
#: `LANGUAGE_ROWS` at least (or all it has), so that a rare one is learned at any size of the corpus.
SAMPLE_ROWS = 4000
LANGUAGE_ROWS = 100
UNDETERMINED = "und"
_SCALE = 40.0
_BLOCK = 1 << 19  # characters hashed at a time


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams of a text, in blocks; nothing if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of other characters
    codes = np.concatenate([np.array([32], np.uint32), codes[keep], np.array([32], np.uint32)])
    for i in range(0, len(codes), _BLOCK):
        c = codes[i : i + _BLOCK + 2]
        own = len(codes[i : i + _BLOCK])  # n-grams that begin in this block
        one = c * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        two = (one[:-1] ^ np.uint32(0x5851F42D)) * np.uint32(0x85EBCA6B) + c[1:]
        three = (two[:-1] ^ np.uint32(0x14057B7E)) * np.uint32(0xC2B2AE35) + c[2:]
        for h in (one[:own], two[:own], three[:own]):
            h = h ^ (h >> np.uint32(15))
            yield (h * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


@dataclass(frozen=True)
class Model:
    """What a prediction needs: idf x weight by bucket and language, biases, and the temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for h in grams(text):
            total += self.weights[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        if not n or not self.languages:
            return UNDETERMINED, 0.0
        logits = (total * (_SCALE / n) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts; over all rows."""

    def run(batches):
        count, n = np.zeros(BUCKETS + 1, dtype=np.int64), 0
        for batch in batches:
            for text in texts(batch.column(0)):
                seen = np.zeros(BUCKETS + 1, dtype=bool)
                for h in grams(text):
                    seen[h] = True
                seen[BUCKETS] = True
                count += seen
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["bucket", "n"])

    counted = docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(BUCKETS + 1, dtype=np.int64)
    count[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return count[:BUCKETS], int(count[BUCKETS])


def sample_features(rows: DataFrame, label: str, size: int, make) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(label, indices, values) of at most size rows of rows(h, text, label), the least by h, in their order.

    The threshold is found over the hashes alone, and texts become features in the tasks; the driver gets features of
    a bounded number of rows.
    """
    top = rows.select("h").orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if top is None:
        return []

    def run(batches):
        features = make()
        for batch in batches:
            got = [features(x) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([x[0] for x in got], type=pa.list_(pa.int32())),
                    pa.array([x[1] for x in got], type=pa.list_(pa.float32())),
                ],
                names=["h", label, "at", "x"],
            )

    kind = rows.schema[label].dataType.simpleString()
    chosen = rows.where(F.col("h") <= top).select("h", "text", label)
    table = chosen.mapInArrow(run, f"h long, `{label}` {kind}, at array<int>, x array<float>").limit(size).toArrow()
    got = zip(*(table[c] for c in ("h", label, "at", "x")), strict=True)
    rows_ = [(h.as_py(), y.as_py(), a.values.to_numpy(), x.values.to_numpy()) for h, y, a, x in got]
    return [r[1:] for r in sorted(rows_, key=lambda r: (r[0], str(r[1]), len(r[2])))]


def quotas(counts: dict[str, int], size: int) -> dict[str, int]:
    """How many rows of each language are sampled: its share of size, but `LANGUAGE_ROWS` at least, or all it has."""
    total = max(1, sum(counts.values()))
    return {y: min(n, max(LANGUAGE_ROWS, -(-n * size // total))) for y, n in counts.items()}


def _stratified(rows: DataFrame, counts: dict[str, int], quota: dict[str, int]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, indices, values) of the quota of each language, the least rows(h, text, lang) by h, in their order.

    Hashes are even, so a bound on them leaves some twice the quota; where equal rows make it leave too few, there is none.
    """
    if not counts:
        return []
    spark, place = rows.sparkSession, F.col("h") / 2.0**64 + 0.5

    def bounded(bound: dict[str, float]) -> DataFrame:
        table = spark.createDataFrame([(y, quota[y], float(bound[y])) for y in counts], "lang string, quota int, bound double")
        return rows.join(F.broadcast(table), "lang").where(place <= F.col("bound"))  # a row per language

    bound = {y: min(1.0, (2 * quota[y] + 100) / n) for y, n in counts.items()}
    if min(bound.values()) < 1:
        left = dict(bounded(bound).groupBy("lang").count().collect())
        bound = {y: b if left.get(y, 0) >= quota[y] else 1.0 for y, b in bound.items()}

    def run(batches):
        features = _counts()
        for batch in batches:
            got = [features(x) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    batch.column(3),
                    pa.array([x[0] for x in got], type=pa.list_(pa.int32())),
                    pa.array([x[1] for x in got], type=pa.list_(pa.float32())),
                ],
                names=["h", "lang", "quota", "at", "x"],
            )

    made = bounded(bound).select("h", "text", "lang", "quota").mapInArrow(run, "h long, lang string, quota int, at array<int>, x array<float>")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    table = made.withColumn("nth", nth).where(F.col("nth") <= max(quota.values())).where("nth <= quota").toArrow()
    got = zip(*(table[c] for c in ("h", "lang", "at", "x")), strict=True)
    rows_ = [(h.as_py(), y.as_py(), a.values.to_numpy(), x.values.to_numpy()) for h, y, a, x in got]
    return [r[1:] for r in sorted(rows_, key=lambda r: (r[0], r[1], len(r[2])))]


def _counts():
    def features(text: str) -> tuple[np.ndarray, np.ndarray]:
        count = np.zeros(BUCKETS, dtype=np.int64)
        for h in grams(text):
            count += np.bincount(h, minlength=BUCKETS)
        at = np.flatnonzero(count)
        return at.astype(np.int32), (count[at] / max(1, count.sum())).astype(np.float32)

    return features


def _ftrl(rows, classes: int, alpha=0.3, beta=1.0, l1=0.02, l2=0.02, epochs=3) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for a softmax over sparse rows; the last row of the weights is the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) > l1, w, 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, at, x = rows[i]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, from a fine geometric grid."""

    def loss(t):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean()

    return float(min(np.geomspace(0.05, 20, 241), key=loss)) if len(y) else 1.0


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows whose text and language aren't null.

    Frequencies and languages are counted over all of them; the weights come from the rows of each language with the
    least hash of id and text, sample_rows in all but for the least number of a language. No rows at all give a model that predicts `UNDETERMINED`; one language gives one that always predicts it.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(id_col, text).alias("h"))
    rows = rows.where("text is not null and lang is not null")
    bound_batches(docs.sparkSession)
    frequency, n = _frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + frequency)) + 1.0
    counts = dict(rows.groupBy("lang").count().collect())
    quota = quotas(counts, sample_rows)
    sample = [(y, a, x) for y, a, x in _stratified(rows, counts, quota) if len(a)]
    languages = tuple(sorted({y for y, _, _ in sample}))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    number = {y: i for i, y in enumerate(languages)}
    ready = [
        (number[y], np.append(a, np.int32(BUCKETS)), np.append(x.astype(np.float64) * idf[a] * _SCALE, 1.0)) for y, a, x in sample
    ]
    del sample
    pa.default_memory_pool().release_unused()  # the driver goes on without the rows that it was sent
    held = ready[::5] if len(ready) >= 20 else []
    learned = [r for i, r in enumerate(ready) if i % 5] if held else ready
    w, b = _ftrl(learned, len(languages))
    full = np.vstack([w, b])
    logits = np.array([x @ full[a] for _, a, x in held]).reshape(len(held), len(languages))
    t = _temperature(logits, np.array([y for y, _, _ in held], dtype=int))
    # the sample's shares become the true ones; on the scale of the biases, before the temperature
    drawn = {y: counts[y] / quota[y] for y in languages}
    most = max(drawn.values())
    b = b + t * np.log([drawn[y] / most for y in languages])
    return Model(languages, (w * idf[:, None]).astype(np.float32), b, t)


def predict(df: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of each whole text and its calibrated probability.

    A text that is null, or has no letter, is `UNDETERMINED` with score 0. Texts of any length are read whole, each row by
    itself, so repeated rows get the same; of languages with equal probability the first by name is taken. Other columns pass through; columns named as
    the outputs are replaced. The model's size is buckets x languages, whatever the data's.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def run(column: pa.Array) -> list[pa.Array]:
            got = [m.predict(x) for x in texts(column)]
            return [pa.array([x[0] for x in got], type=pa.string()), pa.array([x[1] for x in got], type=pa.float64())]

        return run

    bound_batches(df.sparkSession)
    return add_columns(df, [text], [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())], make)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of an id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
