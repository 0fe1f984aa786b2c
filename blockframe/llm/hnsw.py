"""Hierarchical navigable small-world graphs (Malkov & Yashunin, 2016) in NumPy, built and searched in batches.

A graph holds one shard's vectors; nearness is the inner product, so vectors of length 1 are ranked by cosine. Nodes
are put into nested layers with geometric sizes. Batches of nodes are inserted layer by layer: each node's beam search
in the graph so far, and its nearness to the rest of its batch, give candidates, of which those closer to the node than
to each other become neighbours; back links are pruned by the same rule. Queries run as one beam search over
matrices.
"""

from __future__ import annotations

import numpy as np

NEIGHBOURS = 12
BUILD_BEAM = 48
_BATCH = 384
#: Cells of a batch's visited table.
_VISITED = 32_000_000


class Graph:
    """Vectors with, for each layer, its nodes' neighbours: int32, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    def search(self, queries: np.ndarray, beam: int, layer: int = 0, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, nearness) of each query's beam, nearest first; -1 and -inf where it isn't full."""
        n = len(self.vectors)
        at = np.empty((len(queries), beam), dtype=np.int32)
        near = np.empty((len(queries), beam), dtype=np.float32)
        step = max(1, min(_BATCH, _VISITED // max(1, n)))
        for i in range(0, len(queries), step):
            q = queries[i : i + step]
            start = self._descend(q, layer) if begin is None else begin[i : i + step]
            at[i : i + step], near[i : i + step] = self._beam(q, beam, self.layers[layer], start)
        return at, near

    def _descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        """From the top down, the nearest node found in each layer above."""
        start = np.full((len(q), 1), self.entry, dtype=np.int32)
        for above in range(len(self.layers) - 1, layer, -1):
            start = self._beam(q, 4, self.layers[above], start)[0][:, :1]
        return start

    def _beam(self, q: np.ndarray, beam: int, links: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((m, len(self.vectors) + 1), dtype=bool)  # the last column stands for "none"
        width = max(beam, start.shape[1])
        at = np.full((m, width), -1, dtype=np.int32)
        near = np.full((m, width), -np.inf, dtype=np.float32)
        done = np.ones((m, width), dtype=bool)
        k = start.shape[1]
        at[:, :k] = start
        near[:, :k] = np.where(start >= 0, np.einsum("mkd,md->mk", self.vectors[start], q), -np.inf)
        done[:, :k] = start < 0
        seen[rows, start] = True
        expand = 4
        active = np.arange(m)
        while len(active):
            a = active[:, None]
            open_near = np.where(done[active], -np.inf, near[active])
            pick = np.argpartition(-open_near, min(expand, width) - 1, axis=1)[:, :expand] if width > expand else np.tile(np.arange(width), (len(active), 1))
            worth = np.take_along_axis(open_near, pick, axis=1) > -np.inf
            done[a, pick] = True
            nodes = np.where(worth, at[a, pick], -1)
            more = np.where((nodes >= 0)[:, :, None], links[nodes], -1).reshape(len(active), -1)
            more.sort(axis=1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            more[seen[a, more]] = -1
            seen[a, more] = True
            close = np.einsum("mkd,md->mk", self.vectors[more], q[active])
            close[more < 0] = -np.inf
            all_near = np.concatenate([near[active], close], axis=1)
            keep = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            near[active] = np.take_along_axis(all_near, keep, axis=1)
            at[active] = np.take_along_axis(np.concatenate([at[active], more], axis=1), keep, axis=1)
            done[active] = np.take_along_axis(np.concatenate([done[active], close == -np.inf], axis=1), keep, axis=1)
            active = active[~done[active].all(axis=1)]
        order = np.argsort(-near, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(at, order, axis=1), np.take_along_axis(near, order, axis=1)


def _diverse(vectors: np.ndarray, at: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those nearer to the row's node than to all chosen before; then the nearest."""
    m, k = at.shape
    chosen = np.zeros((m, k), dtype=bool)
    v = vectors[at]
    count = np.zeros(m, dtype=int)
    closest = np.full((m, k), -np.inf, dtype=np.float32)  # of each candidate to the chosen
    for j in range(k):
        take = (at[:, j] >= 0) & (count < most) & (near[:, j] > closest[:, j])
        if take.any():
            chosen[take, j] = True
            count[take] += 1
            closest[take] = np.maximum(closest[take], np.einsum("mkd,md->mk", v[take], v[take, j]))
    rank = np.where(at < 0, 2 * k + 1, np.where(chosen, 0, k) + np.arange(k))
    best = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(at, best, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def build(vectors: np.ndarray, seed: int = 5, neighbours: int = NEIGHBOURS, beam: int = BUILD_BEAM) -> Graph:
    """A graph of all vectors (float32 rows). Copies of a vector are allowed, but cost beam width; better pass it once."""
    vectors = np.ascontiguousarray(vectors, dtype=np.float32)
    n = len(vectors)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    sizes = [n]
    while sizes[-1] > 4 * neighbours:
        sizes.append(max(1, sizes[-1] // neighbours))
    graph = Graph(vectors, [], int(order[0]) if n else -1)
    tops = []
    for level in range(len(sizes) - 1, -1, -1):
        most = 2 * neighbours if level == 0 else neighbours
        links = np.full((n + 1, most), -1, dtype=np.int32)  # the last row stands for "none"
        nodes = order[: sizes[level]]  # layers are nested: each begins with the nodes of the one above
        done = 0
        while done < len(nodes):
            batch = nodes[done : done + min(_BATCH, max(1, done))]
            q = vectors[batch]
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            among = min(beam, len(batch))
            near_own = np.argsort(-own, axis=1)[:, :among]
            at = np.where(np.take_along_axis(own, near_own, axis=1) > -np.inf, batch[near_own], -1)
            near = np.take_along_axis(own, near_own, axis=1)
            if done:
                start = np.full((len(q), 1), graph.entry, dtype=np.int32)
                for above in reversed(tops):
                    start = graph._beam(q, 4, above, start)[0][:, :1]
                got, close = graph._beam(q, beam, links, start)
                at, near = np.concatenate([at, got], axis=1), np.concatenate([near, close], axis=1)
            best = np.argsort(-near, axis=1, kind="stable")[:, :beam]
            at, near = np.take_along_axis(at, best, axis=1).astype(np.int32), np.take_along_axis(near, best, axis=1)
            links[batch] = _diverse(vectors, at, near, most)
            _link_back(vectors, links, batch, most)
            done += len(batch)
        tops.insert(0, links)
    graph.layers = tops
    return graph


def _link_back(vectors: np.ndarray, links: np.ndarray, batch: np.ndarray, most: int) -> None:
    """Adds the batch's nodes to their neighbours' links, and prunes the rows that overflow."""
    to = links[batch]
    source = np.repeat(batch, to.shape[1])
    to = to.ravel()
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    heads, first, count = np.unique(to, return_index=True, return_counts=True)
    width = int(count.max()) if len(count) else 0
    for i in range(0, len(heads), 1024):
        h, f, c = heads[i : i + 1024], first[i : i + 1024], count[i : i + 1024]
        new = np.full((len(h), width), -1, dtype=np.int32)
        for j in range(width):
            some = c > j
            new[some, j] = source[f[some] + j]
        both = np.concatenate([links[h], new], axis=1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        near = np.einsum("mkd,md->mk", vectors[both], vectors[h])
        near[both < 0] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")[:, : most + 24]
        links[h] = _diverse(vectors, np.take_along_axis(both, best, axis=1), np.take_along_axis(near, best, axis=1), most)
