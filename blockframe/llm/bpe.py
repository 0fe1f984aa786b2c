"""Byte-level BPE: exact merges in linear time, encoding and decoding.

A vocabulary is a rank file (base64 of the token's bytes and its rank, a line each); a token's rank is its id. Texts are
cut by the vocabulary's pattern and each match is encoded by itself, as rank-based BPE does: the neighbours whose join
has the lowest rank are merged first, the leftmost of equal ones, until no join is in the vocabulary.

Rather than merging, a match is covered from the left. Its bytes are mapped to Latin-1 characters, and one pass of an
Aho-Corasick automaton of all tokens finds every token at every place. The longest token is taken, kept if it is
compatible with the one before, and shortened, or the one before given up, if not. Two tokens are compatible if merging
their joined bytes gives just these two; that answer is memoised, and so is every place from which no cover exists, so
each place and token is tried once. A sequence whose neighbours are all compatible is the one that merging gives.
"""

from __future__ import annotations

import base64
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import add_columns, bound_batches, texts

#: Matches, and pairs, in one of a memo's two generations. A worker keeps both at most, so its memory is bounded.
MEMO = 80_000
#: Longer matches (in characters) are rare and long; they are encoded but not remembered.
MEMO_CHARS = 48


class Memo:
    """A mapping that forgets: when the young generation is full it becomes the old one, and what is asked for again in
    the old one is young again. What is forgotten is computed anew, so no result depends on it."""

    def __init__(self, size: int = MEMO):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Bpe:
    """A vocabulary, ready to encode and decode."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.tokens = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        size = max(self.tokens) + 1
        self.length = [0] * size
        self.shorter = [-1] * size  # the longest token that is a proper prefix of this one
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.length[rank] = len(token)
            for n in range(len(token) - 1, 0, -1):
                if (prefix := self.ranks.get(token[:n])) is not None:
                    self.shorter[rank] = prefix
                    break
        self.automaton.make_automaton()
        self.pairs = Memo()
        self.memo = Memo()
        self.made: dict[int, tuple[int, int] | None] = {}
        self.unmade: set[int] = set()

    def merge(self, data: bytes, until: int = 1) -> list[bytes]:
        """Merging step by step down to so many parts; quadratic, for the few bytes of a token."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(joined)
            if least == 1 << 60:
                break
            i = joined.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a byte, and for a token that merging never makes."""
        known = self.made.get(rank, 0)
        if known == 0:
            parts = self.merge(self.tokens[rank], 2)
            known = self.made[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            if known is None and self.length[rank] > 1:
                self.unmade.add(rank)
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens, side by side, gives just these two.

        The merges that made them are undone from the latest back; at each step the two tokens that meet at the border
        must not join earlier than the merge just undone.
        """
        key = a << 24 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        left, right = halves(a), halves(b)
        good = a not in self.unmade and b not in self.unmade
        limit = 1 << 60
        while good:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < limit:
                good = False
            elif left is not None and (a > b or right is None):
                limit, a = a, left[1]
                left = halves(a)
            elif right is not None:
                limit, b = b + 1, right[0]
                right = halves(b)
            else:
                break
        self.pairs.put(key, good)
        return good

    def cover(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        length, shorter, compatible, pairs, end = self.length, self.shorter, self.compatible, self.pairs, len(data)
        longest = [-1] * end
        for last, rank in self.automaton.iter(data.decode("latin-1")):
            longest[last + 1 - length[rank]] = rank  # ends come in order, so the longest token stays
        ids: list[int] = []
        dead: set[tuple[int, int]] = set()  # a place and the token before it from which no cover exists
        place, rank, before = 0, longest[0], -1
        while True:
            while rank >= 0:
                if before < 0:
                    fits = True
                elif (fits := pairs.young.get(before << 24 | rank)) is None:
                    fits = compatible(before, rank)
                if fits and not (dead and (place + length[rank], rank) in dead):
                    break
                rank = shorter[rank]
            if rank >= 0:
                before = rank
                ids.append(rank)
                place += length[rank]
                if place == end:
                    return ids
                rank = longest[place]
            elif ids:
                rank = ids.pop()
                before = ids[-1] if ids else -1
                dead.add((place, rank))
                place -= length[rank]
                rank = shorter[rank]
            else:
                raise ValueError("a byte of the text is in no token")

    def encode(self, text: str, into: array | None = None) -> array:
        """Ids of a whole text, appended to into; special tokens are ordinary text. Lone surrogates become '?'."""
        ids, memo = array("i") if into is None else into, self.memo
        for piece in self.pattern.findall(text):
            got = memo.young.get(piece)
            if got is None:
                got = memo.get(piece)
                if got is None:
                    got = array("i", self.cover(piece.encode("utf-8", "replace"))).tobytes()
                    if len(piece) <= MEMO_CHARS:
                        memo.put(piece, got)
            ids.frombytes(got)
        return ids

    def decode(self, ids) -> bytes:
        """The bytes of a sequence of ids; an id outside the vocabulary raises KeyError."""
        return b"".join(self.tokens[i] for i in ids)


class Bytes:
    """The bytes of token ids; no more than that, so that a worker that only decodes holds no automaton."""

    def __init__(self, ranks: bytes):
        tokens = {int(b): base64.b64decode(a) for a, b in (line.split() for line in ranks.splitlines() if line)}
        listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.joined = np.frombuffer(b"".join(listed), dtype=np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in listed])]).astype(np.int64)

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in one array, and where each id's bytes begin and end in it."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.starts) - 1):
            raise KeyError("a token id outside the vocabulary")
        sizes = self.starts[ids + 1] - self.starts[ids]
        if len(ids) and not sizes.all():
            raise KeyError("a token id outside the vocabulary")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(self.starts[ids] - ends[:-1], sizes)
        return self.joined[shift + np.arange(ends[-1])], ends


@cache
def _vocabulary(ranks: bytes, pattern: str) -> Bpe:
    return Bpe(ranks, pattern)


@cache
def _bytes(ranks: bytes) -> Bytes:
    return Bytes(ranks)


def _sent(df: DataFrame, path: str):
    """The rank file, read by the driver and sent to the executors: its size is the vocabulary's, not the data's."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the token ids of a text column as array<int>. A null or empty text has no ids.

    Other columns pass through; one named as the output is replaced. Texts of any length are encoded whole.
    """
    sent = _sent(df, path)

    def make():
        bpe = _vocabulary(sent.value, pattern)

        def run(column: pa.Array) -> list[pa.Array]:
            flat, ends = array("i"), [0]
            for x in texts(column):
                bpe.encode(x, flat)
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32))
            return [pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)]

        return run

    bound_batches(df.sparkSession)
    return add_columns(df, [text], [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of an array<int> column of token ids. Null ids count as none; an unknown id raises KeyError."""
    vocabulary = _sent(df, path)

    def make():
        known = _bytes(vocabulary.value)

        def run(column: pa.Array) -> list[pa.Array]:
            whole = column
            rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(whole), 0).to_numpy())])
            data, ends = known.decode_flat(whole.flatten().to_numpy().astype(np.int64))
            offsets = pa.py_buffer(ends[rows].astype(np.int32).tobytes())
            return [pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, offsets, pa.py_buffer(data.tobytes())])]

        return run

    bound_batches(df.sparkSession)
    return add_columns(df, [ids], [T.StructField(out, T.BinaryType())], make)
