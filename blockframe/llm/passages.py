"""Units of a text for near-duplicate search, cut by numpy over a whole Arrow batch at once.

A text is a stream of lower-cased words (line breaks are white space). Its units are
  - paragraphs: lines, consecutive ones joined until a unit has `UNIT` words; a shorter rest joins the paragraph before it,
    so every word lies in exactly one paragraph and hard-wrapped text has paragraphs too;
  - windows: `UNIT` words from each anchor. Anchors are the positions whose shingle hash is the least of some `REACH`
    consecutive positions (winnowing), so they depend on the words around them only. A run of UNIT + REACH - 1 = 50 words
    that two texts share contains a window that both have, wherever it stands and however its lines are broken, and
    neighbouring windows meet or overlap, so a longer shared run is covered without gaps.
Overlapping windows with the same words (a repeated word) are one longer occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .runtime import texts

WIDTH = 5
UNIT = 26
REACH = 25
#: (bands, hashes of a band) of paragraphs, and of whole texts, which are fewer. Pairs of similarity 0.8 collide with
#: probability 1 - (1 - 0.8^3)^8 = 0.997, and 0.99999. Windows have none: two of them, of 22 shingles each, that reach 0.8 share
#: 24 consecutive words, so that they are equal but for a word or two at their ends, and equality finds what they cover.
PARAGRAPH_BANDS = (8, 3)
WHOLE_BANDS = (18, 3)
#: Code points that are worked on at once; one text of any length is always whole.
_CHUNK = 200_000
#: Words whose letters are hashed at once.
_WORDS = 40_000
_RECENT = 1 << 17
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(0x3002, dtype=bool)  # no white space beyond; the last entry stands for all that follows
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _sliding(values: np.ndarray, n: int, take: np.ufunc, fill: np.uint64) -> np.ndarray:
    """take over each n consecutive values, beginning at each; beyond the end counts as fill."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        moved = np.full(len(out), fill, dtype=np.uint64)
        moved[: max(0, len(out) - step)] = out[step:]
        out = take(out, moved)
        have += step
    return out


def _points(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a text, and where its words start and end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    space = np.ones(len(points) + 2, dtype=bool)
    np.take(_SPACE, points, mode="clip", out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return points, edges[::2], edges[1::2]


def paragraph_borders(lines: np.ndarray, least: int = UNIT) -> list[int]:
    """Borders of paragraphs in a stream of words, given the line of each word."""
    n = len(lines)
    borders = [0]
    for at in (np.flatnonzero(lines[1:] != lines[:-1]) + 1).tolist():
        if at - borders[-1] >= least:
            borders.append(at)
    if len(borders) > 1 and n - borders[-1] < least:
        borders.pop()
    return [*borders, n]


class Cutter:
    """Cuts texts into units; keeps tables between batches of a task."""

    def __init__(self, whole: bool = False):
        random = np.random.default_rng(23)

        def odd(n: int) -> np.ndarray:
            return random.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)

        self.whole = whole
        self.banding = WHOLE_BANDS if whole else PARAGRAPH_BANDS
        self.order = odd(WIDTH)
        self.scale, self.shift = odd(self.banding[0] * self.banding[1]), odd(self.banding[0] * self.banding[1])
        self.base = [int(x) | 5 for x in odd(3)]  # of code points, and twice of words
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.recent = np.zeros(_RECENT, dtype=np.int64)

    def _powers(self, i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of a base and of its inverse."""
        if i not in self.powers or len(self.powers[i][0]) < n:
            up = np.full(n, self.base[i], dtype=np.uint64)
            down = np.full(n, pow(self.base[i], -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            self.powers[i] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        return self.powers[i]

    def _polynomial(self, i: int, values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of the values in each [a, b), wherever it lies: a polynomial modulo 2^64, mixed with the length."""
        up, down = self._powers(i, len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _named(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and further 32 bits of a hash of the words in each [a, b)."""
        check = self._polynomial(2, _mix(words), a, b) >> np.uint64(32)
        return self._polynomial(1, words, a, b).view(np.int64), check.astype(np.uint32).view(np.int32)

    def _bands(self, least: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """Band keys of (units, bands * rows) least hashes."""
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = np.broadcast_to(key, (len(least), bands)).copy()
        for i in range(rows):
            key = _mix(key ^ least[:, i::rows])
        return key.view(np.int64)

    def _chunks(self, column: pa.Array) -> Iterator[tuple[int, list[str]]]:
        """The texts of a column, some _CHUNK code points at once, with the row of the first."""
        chunk, first, n = [], 0, 0
        for row, text in enumerate(texts(column)):
            if chunk and n + len(text) > _CHUNK:
                yield first, chunk
                chunk, first, n = [], row, 0
            chunk.append(text)
            n += len(text) + 1
        if chunk:
            yield first, chunk

    def split(self, chunk: list[str]) -> tuple[np.ndarray, ...]:
        """(hash, text, start, end, line) of each lower-cased word of some texts; start and end are code points of its text."""
        lowered = [x.lower() for x in chunk]
        points, starts, ends = _points("\n".join(lowered))
        hashes = np.empty(len(starts), dtype=np.uint64)
        for i in range(0, len(starts), _WORDS):  # so that a text of any length takes a few bytes a letter
            a, b = starts[i : i + _WORDS], ends[i : i + _WORDS]
            hashes[i : i + _WORDS] = self._polynomial(0, points[a[0] : b[-1]].astype(np.uint64), a - a[0], b - a[0])
        begins = np.cumsum([0, *(len(x) + 1 for x in lowered)])[:-1]
        owner = np.searchsorted(begins, starts, "right") - 1
        lines = np.searchsorted(np.flatnonzero(points == 10), starts)
        starts, ends = starts - begins[owner], ends - begins[owner]
        for i, (x, y) in enumerate(zip(chunk, lowered, strict=True)):
            if len(x) != len(y):  # a letter whose lower case is two
                mine = owner == i
                starts[mine], ends[mine] = _points(x)[1:]
        return hashes, owner, starts, ends, lines

    def units(self, column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
        """Units of the texts of a column: row, first and n (words), start, end (code points), node, check;
        'windows' says how many of the units, at the end, are windows; 'shingles' are the hashes that begin at each word."""
        for row, chunk in self._chunks(column):
            hashes, text, starts, ends, lines = self.split(chunk)
            sizes = np.bincount(text, minlength=len(chunk))
            where = np.concatenate([[0], np.cumsum(sizes)])
            # zeros after each text: a shingle that begins in it never reaches into the next one, nor does an empty text's
            begins = where[:-1] + WIDTH * np.arange(len(chunk))
            words = np.zeros(len(hashes) + WIDTH * (len(chunk) + 1), dtype=np.uint64)
            words[np.arange(len(hashes)) + WIDTH * text] = hashes
            n = len(words) - WIDTH + 1
            shingles = np.zeros(n, dtype=np.uint64)
            for i in range(WIDTH):
                shingles += words[i : i + n] * self.order[i]
            shingles = _mix(shingles)
            if self.whole:
                a, b, owner = begins, begins + sizes, np.arange(len(chunk))
            else:
                borders = [paragraph_borders(lines[where[i] : where[i + 1]]) if sizes[i] else [0] for i in range(len(chunk))]
                owner = np.repeat(np.arange(len(chunk)), [len(x) - 1 for x in borders])
                a = np.array([y for x in borders for y in x[:-1]], dtype=np.int64) + begins[owner]
                b = np.array([y for x in borders for y in x[1:]], dtype=np.int64) + begins[owner]
            windows = 0
            if not self.whole:
                anchors = self._anchors(shingles, begins, sizes)
                anchors = anchors[~np.isin(anchors, a[b - a == UNIT])]  # a paragraph already
                windows = len(anchors)
                a, b = np.concatenate([a, anchors]), np.concatenate([b, anchors + UNIT])
                owner = np.concatenate([owner, np.searchsorted(begins, anchors, "right") - 1])
            node, check = self._named(words[:n], a, b)
            first = a - begins[owner]
            at = np.minimum(where[owner] + first, max(len(starts) - 1, 0))
            to = np.minimum(at + np.maximum(b - a - 1, 0), max(len(starts) - 1, 0))
            some = len(starts) > 0
            yield {
                "row": row + owner, "first": first, "n": b - a, "a": a, "node": node, "check": check,
                "start": np.where(b == a, 0, starts[at] if some else 0), "end": np.where(b == a, 0, ends[to] if some else 0),
                "windows": windows, "shingles": shingles,
            }

    def _anchors(self, shingles: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Positions that begin a window: those with the least shingle of some REACH positions of one text."""
        places = np.maximum(sizes - UNIT + 1, 0)  # positions that have UNIT words before them
        live = np.zeros(len(shingles) + 1, dtype=np.int64)
        np.add.at(live, begins, places > 0)
        np.add.at(live, begins + places, -(places > 0).astype(np.int64))
        value = np.where(np.cumsum(live[:-1]) > 0, shingles, _MOST)
        # beyond a text's positions lie at least UNIT - 1 + WIDTH > REACH others, so a window that begins in it meets no other text
        full = np.where(places > 0, np.maximum(places - REACH + 1, 1), 0)
        live[:] = 0
        np.add.at(live, begins, full > 0)
        np.add.at(live, begins + full, -(full > 0).astype(np.int64))
        least = np.where(np.cumsum(live[:-1]) > 0, _sliding(value, REACH, np.minimum, _MOST), np.uint64(0))
        met = _sliding(least[::-1], REACH, np.maximum, np.uint64(0))[::-1]
        return np.flatnonzero((met == value) & (value != _MOST))

    def bands(self, found: dict[str, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, values) of the band keys of the units; windows, and those not wanted, have none."""
        shingles, a, n = found["shingles"], found["a"], found["n"]
        wanted = wanted & (np.arange(len(a)) < len(a) - found["windows"])
        pick = np.flatnonzero(wanted)
        bands, rows = self.banding
        least = np.empty((len(pick), bands * rows), dtype=np.uint64)
        if len(pick):
            cuts = np.stack([a[pick], a[pick] + np.maximum(n[pick] - WIDTH + 1, 1)], axis=1).ravel()
            for k in range(bands * rows):
                g = np.append(shingles * self.scale[k] + self.shift[k], _MOST)
                least[:, k] = np.minimum.reduceat(g, cuts)[::2]
        return np.concatenate([[0], np.cumsum(wanted * bands)]), self._bands(least, bands, rows).ravel()

    def fingerprints(self, found: dict[str, np.ndarray]) -> np.ndarray:
        """The 64-bit SimHash of each unit: a bit is set where over half of its shingle hashes have it. No words: zero."""
        out = np.zeros(len(found["a"]), dtype=np.uint64)
        for i, (a, n) in enumerate(zip(found["a"].tolist(), found["n"].tolist(), strict=True)):
            if n:
                m = max(n - WIDTH + 1, 1)
                counts = np.zeros(64, dtype=np.int64)
                for at in range(a, a + m, 8192):
                    part = found["shingles"][at : min(at + 8192, a + m)]
                    counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out[i] = np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0]
        return out.view(np.int64)

    def news(self, node: np.ndarray) -> np.ndarray:
        """Which nodes this task hasn't just met: the first of each in the batch, if it isn't among the recent ones.

        So that a unit which fills a third of a table is banded a few times per task, not once per row.
        """
        out = np.zeros(len(node), dtype=bool)
        out[np.unique(node, return_index=True)[1]] = True
        slot = node & (_RECENT - 1)
        out &= self.recent[slot] != node
        self.recent[slot] = node
        return out


def shingle_set(shingles: np.ndarray, a: int, n: int) -> np.ndarray:
    """The distinct shingle hashes of n words from a, as signed longs."""
    return np.unique(shingles[a : a + max(n - WIDTH + 1, 1)]).view(np.int64)
