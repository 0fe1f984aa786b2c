"""Quality classifier: a second-order factorisation machine (Rendle, 2010).

Inputs of a text are its hashed words (log counts, normalised to length 1) and statistics of its structure: lengths,
shares of character classes, repeated words and lines. The machine scores a bias, a weight per input and all pairwise
interactions, of rank `RANK`; the interactions are scored in linear time as half of (square of the sum minus sum of the
squares) per factor. It is trained by AdaGrad on a bounded sample of labelled rows, so that classes weigh as they are.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import sample_features
from .runtime import add_columns, bound_batches, texts

WORD_BUCKETS = 1 << 17
RANK = 8
#: Labelled rows that the machine is fitted on, and that are joined with their texts.
SAMPLE_ROWS = 4000
STATISTICS = (
    "log_chars", "log_words", "word_chars", "long_words", "upper", "lower", "digit", "space", "other",
    "ascii_symbol", "bars", "shouts", "distinct_words", "log_lines", "repeated_lines", "line_words", "ends_sentence",
)


@cache
def _classes() -> np.ndarray:
    """The class of each code point: 0 other, 1 upper, 2 lower, 3 digit, 4 space, 5 ASCII symbol."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        kinds[i] = 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c.isspace() else 0
    for c in "#$%&*+/<=>@\\^_`{|}~":
        kinds[ord(c)] = 5
    return kinds


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Input numbers and values of a whole text."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    chars = max(1, len(codes))
    share = np.bincount(_classes()[codes], minlength=6) / chars
    words = text.split()
    n = max(1, len(words))
    count = Counter(w.lower() for w in words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    stats = [
        np.log1p(len(codes)) / 10, np.log1p(len(words)) / 10, min(3.0, len(codes) / n / 10), sum(len(w) > 20 for w in words) / n,
        share[1], share[2], share[3], share[4], share[0], share[5] * 4, text.count("|") / n, text.count("!") / n,
        len(count) / n, np.log1p(len(lines)) / 10, 1 - len(set(lines)) / max(1, len(lines)),
        min(3.0, len(words) / max(1, len(lines)) / 50), sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)),
    ]
    mask = WORD_BUCKETS - 1
    at = np.fromiter((crc32(w.encode("utf-8", "replace")) & mask for w in count), dtype=np.int32, count=len(count))
    x = np.log1p(np.fromiter(count.values(), dtype=np.float64, count=len(count)))
    at, place = np.unique(at, return_inverse=True)  # words that share a bucket are one feature
    x = np.bincount(place, weights=x, minlength=len(at)).astype(np.float64)
    x /= max(1e-9, float(np.sqrt(x @ x)))
    own = np.arange(WORD_BUCKETS, WORD_BUCKETS + len(stats), dtype=np.int32)
    return np.concatenate([at, own]), np.concatenate([x, stats]).astype(np.float32)


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        total = v.sum(axis=0, dtype=np.float64)
        return float(self.bias + self.linear[at] @ x + 0.5 * (total @ total - (v * v).sum(dtype=np.float64)))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -60, 60))))


def _fit(rows, epochs: int = 6, rate: float = 0.08, l2: float = 1e-5) -> Machine:
    size = WORD_BUCKETS + len(STATISTICS)
    random = np.random.default_rng(11)
    bias, w, v = 0.0, np.zeros(size), random.normal(0, 0.05, (size, RANK))
    gb, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            y, at, x = rows[i]
            vx = v[at] * x[:, None]
            total = vx.sum(axis=0)
            s = bias + w[at] @ x + 0.5 * (total @ total - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(s, -60, 60))) - y
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            dw = g * x + l2 * w[at]
            gw[at] += dw * dw
            w[at] -= rate * dw / np.sqrt(gw[at])
            dv = g * (x[:, None] * total - vx * x[:, None]) + l2 * v[at]
            gv[at] += dv * dv
            v[at] -= rate * dv / np.sqrt(gv[at])
    return Machine(float(bias), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine from docs joined with labels(id_col, label) by id.

    Labels that are null, or whose id is null, are left out; an id with differing labels counts with each. The rows with
    the least hash of id and label are the sample: at most sample_rows of them, so they may be broadcast to the join.
    With no labelled row every text scores 0.5.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    chosen = known.withColumn("h", F.xxhash64("id", "y")).orderBy("h", "id").limit(sample_rows)
    plain = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    joined = plain.join(F.broadcast(chosen), "id").select(F.xxhash64("id", "y", "text").alias("h"), "text", "y")
    rows = [(y, a, x.astype(np.float64)) for y, a, x in sample_features(joined, "y", sample_rows, lambda: features)]
    if not rows:
        return Machine(0.0, np.zeros(WORD_BUCKETS + len(STATISTICS), np.float32), np.zeros((WORD_BUCKETS + len(STATISTICS), RANK), np.float32))
    return _fit(rows)


def score(df: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score (0 to 1, higher is better) of each whole text; a null text counts as empty.

    Texts of any length are scored whole, each row by itself, so repeated rows score alike. Other columns pass through; one named as the output is replaced. The machine's size doesn't depend on the data.
    """
    sent = df.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = sent.value
        return lambda column: [pa.array([m.score(x) for x in texts(column)], type=pa.float64())]

    bound_batches(df.sparkSession)
    return add_columns(df, [text], [T.StructField(out, T.DoubleType())], make)
