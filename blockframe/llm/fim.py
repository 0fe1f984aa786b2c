"""Fill-in-the-middle: a text cut at two unit boundaries and put together in another order.

The boundaries of a text's lines are a sorted sequence of offsets. A piecewise-linear function learns it: segments
that predict each offset within a bound, grown as long as one slope serves all of their points. A cut is the prediction
at its rank, corrected by the residual that was stored for it, which gives the exact offset.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import add_columns, bound_batches

#: Marks of the three parts; a text that holds one stays as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Characters by which a prediction may be off.
BOUND = 32
#: Texts of a hundred that are transformed, and of those, of a hundred, that begin with the suffix.
RATE, SPM_RATE = 100, 50
SEED = "7"


class RankIndex:
    """Offsets by rank: a few linear segments, and small residuals."""

    def __init__(self, offsets: np.ndarray, bound: int = BOUND):
        self.starts: list[int] = []
        self.bases: list[int] = []
        self.slopes: list[float] = []
        values = offsets.tolist()
        at = 0
        while at < len(values):
            end, slope = _segment(values, at, bound)
            self.starts.append(at)
            self.bases.append(values[at])
            self.slopes.append(slope)
            at = end
        lengths = np.diff([*self.starts, len(values)])
        ranks = np.arange(len(values)) - np.repeat(self.starts, lengths)
        predicted = np.repeat(self.bases, lengths) + np.floor(np.repeat(self.slopes, lengths) * ranks + 0.5).astype(np.int64)
        residuals = offsets - predicted
        self.residuals = residuals.astype(np.int16 if bound < 2**14 else np.int64)

    def predict(self, rank: int) -> int:
        segment = bisect_right(self.starts, rank) - 1
        return self.bases[segment] + int(np.floor(self.slopes[segment] * (rank - self.starts[segment]) + 0.5))

    def offset(self, rank: int) -> int:
        """The exact offset of a rank."""
        return self.predict(rank) + int(self.residuals[rank])


def _segment(values: list[int], start: int, bound: int) -> tuple[int, float]:
    """(end, slope): the longest run from start that one slope predicts within the bound."""
    base, low, high = values[start], 0.0, float("inf")
    rank = start + 1
    while rank < len(values):
        run = rank - start
        least, most = (values[rank] - bound - base) / run, (values[rank] + bound - base) / run
        if max(low, least) > min(high, most):
            break
        low, high = max(low, least), min(high, most)
        rank += 1
    return rank, low if high == float("inf") else (low + high) / 2


def boundaries(text: str) -> np.ndarray:
    """Offsets in code points before, between and after the lines of a text; a line ends after its line feed."""
    if text.isascii():
        ends = np.flatnonzero(np.frombuffer(text.encode("ascii"), np.uint8) == 10) + 1
    else:
        ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    last = [len(text)] if text and not text.endswith("\n") else []
    return np.concatenate([[0], ends, last]).astype(np.int64)


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a digest of the seed and the key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def cut(text: str, key: str, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, bound: int = BOUND) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, characters of the prefix, of the middle, output) of one text."""
    offsets = boundaries(text)
    n = len(offsets) - 1
    a, b, whether, which = draws(seed, key)
    if not text or whether % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    index = RankIndex(offsets, bound)
    first, second = (index.offset(r) for r in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if which % 100 < spm_rate:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of. No part holds a mark, and none can arise where a part meets one."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, rest = output.removeprefix(first).split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return a + middle + b if form == "psm" else b + middle + a


def transform(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
    bound: int = BOUND,
) -> DataFrame:
    """df with n (lines), form, prefix_chars, middle_chars and output of each whole text, of any length.

    The cuts and the form hang on the seed and the decimal id alone; a null id counts as empty, so rows that share an id
    are cut by the same draws, and repeated rows alike. A null text is an empty one: plain, no lines, an empty output. Other
    columns pass through; columns named as the outputs are replaced. An empty table gives none.
    """
    bound_batches(df.sparkSession)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]

    def make():
        def run(ids: pa.Array, whole: pa.Array) -> list[pa.Array]:
            keys = ("" if k is None else str(k) for k in ids.to_pylist())
            rows = [cut(x or "", k, seed, rate, spm_rate, bound) for k, x in zip(keys, whole.to_pylist(), strict=True)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            return [*made[:4], made[4].cast(pa.string())]

        return run

    return add_columns(df, [id_col, text], fields, make)


def restore(df: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """df with the text that each output and form were made of; a null output is an empty text."""
    bound_batches(df.sparkSession)

    def make():
        def run(outputs: pa.Array, forms: pa.Array) -> list[pa.Array]:
            return [pa.array([restored(x or "", f) for x, f in zip(outputs.to_pylist(), forms.to_pylist(), strict=True)], pa.string())]

        return run

    return add_columns(df, [output, form], [T.StructField(to, T.StringType())], make)
