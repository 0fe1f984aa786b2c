"""A cover tree for inner products: exact best-first search within windows of scores.

Points are augmented by one coordinate so that all have the norm of the longest; then the inner product with a query is
the cosine of an angle times a constant, and a node whose points lie within an angle of its centre bounds it on both sides.
Each level's centres cover its points within a smaller radius than the level above, and are farther apart than that radius.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: A child's points lie within its parent's radius divided by this.
BASE = 1.5
#: Nodes of at most so many points are leaves; smaller groups than LEAST are points of their parent.
LEAF = 32
LEAST = 8
#: Centres that are tried at once.
BATCH = 64
#: Up to this squared norm all sums of products are exact in doubles.
EXACT = 2.0**53


class CoverTree:
    """A tree over integer vectors (as doubles) with their ids."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids = points[order], ids[order]
        squares = (self.points * self.points).sum(axis=1)
        top = float(squares.max(initial=0.0))
        self.norm = np.sqrt(top)
        self.exact = top < EXACT
        rest = np.sqrt(np.maximum(top - squares, 0.0))
        self.unit = np.column_stack([self.points, rest]) / self.norm if self.norm > 0 else None
        #: of each node: its centre, the angle that covers its points, its children, and the points of its own
        self.centre: list[int] = []
        self.angle: list[float] = []
        self.children: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self._grow()
        self.centres, self.angles = np.array(self.centre), np.array(self.angle)

    def _node(self, centre: int, radius: float) -> int:
        self.centre.append(centre)
        self.angle.append(2 * np.arcsin(min(radius / 2, 1.0)))
        self.children.append(np.empty(0, int))
        self.own.append(np.empty(0, int))
        return len(self.centre) - 1

    def _grow(self) -> None:
        everything = np.arange(len(self.points))
        if self.unit is None:  # all points are zero: any product with them is
            self.own[self._node(0, 0.0)] = everything
            return
        near = self.unit @ self.unit[0]
        radius = _chord(near.min())
        waiting = [(self._node(0, radius), everything, near, radius)]
        while waiting:
            node, members, near, radius = waiting.pop()
            if len(members) <= LEAF or radius < 1e-7:
                self.own[node] = members
                continue
            own, below = [], []
            for centre, group, close in self._cover(int(self.centre[node]), members, near, radius / BASE):
                if len(group) < LEAST:
                    own.append(group)
                else:
                    reach = _chord(close.min())
                    below.append(self._node(centre, reach))
                    waiting.append((below[-1], group, close, reach))
            self.own[node] = np.concatenate(own) if own else np.empty(0, int)
            self.children[node] = np.array(below, dtype=int)

    def _cover(self, centre: int, members: np.ndarray, near: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(centre, its points, their cosines): groups within the radius, of centres that are farther apart than it."""
        least = 1 - radius * radius / 2
        inside = near >= least
        yield centre, members[inside], near[inside]
        rest = members[~inside]
        while len(rest):
            tried = rest[:BATCH]
            close = self.unit[tried] @ self.unit[tried].T >= least
            free, chosen = np.ones(len(tried), bool), []
            for i in range(len(tried)):
                if free[i]:
                    chosen.append(i)
                    free &= ~close[i]
                    free[i] = False
            cosines = self.unit[rest] @ self.unit[tried[chosen]].T
            nearest = cosines.argmax(axis=1)
            best = cosines[np.arange(len(rest)), nearest]
            nearest[chosen], best[chosen] = np.arange(len(chosen)), 1.0  # a centre is its own, whatever rounding says
            covered = best >= least
            for i, place in enumerate(chosen):
                of = covered & (nearest == i)
                yield int(tried[place]), rest[of], best[of]
            rest = rest[~covered]

    def bounds(self, nodes: np.ndarray, query: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest inner product of the query with any point below each node, rounding allowed for."""
        scale = length * self.norm
        if scale == 0:
            return np.zeros(len(nodes)), np.zeros(len(nodes))
        away = np.arccos(np.clip(self.unit[self.centres[nodes], :-1] @ (query / length), -1, 1))
        slack = 1e-7 * scale + 1e-6
        most = scale * np.cos(np.maximum(away - self.angles[nodes], 0)) + slack
        return scale * np.cos(np.minimum(away + self.angles[nodes], np.pi)) - slack, most

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        if self.exact and float(query @ query) < EXACT:
            return (self.points[rows] @ query).astype(np.int64)
        whole = [[int(v) for v in x] for x in self.points[rows]]
        other = [int(v) for v in query]
        return np.array([sum(a * b for a, b in zip(x, other, strict=True)) for x in whole], dtype=np.int64)


def _chord(cosine: float) -> float:
    return float(np.sqrt(max(2 - 2 * cosine, 0.0)))


class Window:
    """The k highest scores between two bounds (both included), ties by the smaller id."""

    def __init__(self, low: float, high: float, k: int):
        self.low, self.high, self.k = low, high, k
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def floor(self) -> float:
        """What a score must reach to matter."""
        return self.low if len(self.score) < self.k else max(self.low, self.score[-1])

    def wants(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return (least <= self.high) & (most >= self.floor)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        fits = (score <= self.high) & (score >= self.floor)
        if fits.any():
            score, ids = np.concatenate([self.score, score[fits]]), np.concatenate([self.id, ids[fits]])
            best = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[best], ids[best]


def search(trees: list[CoverTree], query: np.ndarray, windows: list[Window], but: int | None = None) -> None:
    """Fill the windows from all trees, best bound first; a node that no window can use is skipped with all below it.

    but is an id that is left out.
    """
    length = float(np.sqrt(query @ query))
    heap: list[tuple[float, float, int, int]] = []

    def push(t: int, nodes: np.ndarray) -> None:
        if len(nodes):
            least, most = trees[t].bounds(nodes, query, length)
            useful = np.zeros(len(nodes), bool)
            for w in windows:
                useful |= w.wants(least, most)
            for i in np.flatnonzero(useful):
                heapq.heappush(heap, (-most[i], least[i], t, int(nodes[i])))

    for t in range(len(trees)):
        push(t, np.zeros(1, int))
    while heap:
        most, least, t, node = heapq.heappop(heap)
        if -most < min(w.floor for w in windows):
            break
        if not any(w.wants(least, -most) for w in windows):
            continue
        tree = trees[t]
        rows = tree.own[node]
        if len(rows):
            score, ids = tree.scores(rows, query), tree.ids[rows]
            if but is not None and (other := ids != but).sum() < len(ids):
                score, ids = score[other], ids[other]
            for w in windows:
                w.offer(score, ids)
        push(t, tree.children[node])
