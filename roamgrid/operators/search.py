"""Least costs from many sources over one small graph, with numpy inside tasks; graph.py decides which graphs are small."""

from __future__ import annotations

import numpy as np

#: Costs (sources x edges, sources x nodes) that are in memory at a time.
CHUNK = 8_000_000
_NONE = np.iinfo(np.int64).max


class Graph:
    """Nodes by their place among the sorted ids, edges by their start."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, more: np.ndarray | None = None):
        every = [src, dst] if more is None else [src, dst, more]
        self.ids = np.unique(np.concatenate(every))
        order = np.argsort(src, kind="stable")
        self.src, self.dst = (np.searchsorted(self.ids, x[order]) for x in (src, dst))
        self.weight = weight[order].astype(float)
        self.start = np.searchsorted(self.src, np.arange(len(self.ids) + 1))
        self.by_dst = np.argsort(self.dst, kind="stable")

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ids, and whether each is a node."""
        if not len(self.ids):
            return np.zeros(len(ids), int), np.zeros(len(ids), bool)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return at, self.ids[at] == ids

    def chunk(self) -> int:
        """How many sources are searched at a time."""
        return max(1, CHUNK // max(1, len(self.src), len(self.ids)))

    def costs(self, sources: np.ndarray, max_hops: int) -> np.ndarray | None:
        """Sources (places) x nodes; None if costs still change after max_hops. Each hop follows the edges of nodes that the one before improved for any source."""
        dist = np.full((len(sources), len(self.ids)), np.inf)
        dist[np.arange(len(sources)), sources] = 0.0
        changed = np.unique(sources)
        for _ in range(max_hops):
            size = self.start[changed + 1] - self.start[changed]
            edge = np.repeat(self.start[changed] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            if not len(edge):
                return dist
            edge = edge[np.argsort(self.dst[edge], kind="stable")]
            to = self.dst[edge]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            least = np.minimum.reduceat(dist[:, self.src[edge]] + self.weight[edge], first, axis=1)
            to = to[first]
            better = least < dist[:, to]
            dist[:, to] = np.where(better, least, dist[:, to])
            changed = to[better.any(0)]
            if not len(changed):
                return dist
        return None

    def predecessors(self, sources: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Sources x nodes: the smallest predecessor on a best path that costs less than the node, or where there is none,
        one of equal cost that has a predecessor already; _NONE for the source and what isn't reached."""
        out = np.full(dist.shape, _NONE)
        if not len(self.src):
            return out
        edge = self.by_dst
        u, v = self.src[edge], self.dst[edge]
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        own = v[first]
        # Unreached ends don't count, though infinite costs are equal.
        tight = (dist[:, u] + self.weight[edge] == dist[:, v]) & np.isfinite(dist[:, v]) & (sources[:, None] != v)
        choose = lambda ok: np.minimum.reduceat(np.where(ok, u, _NONE), first, axis=1)
        out[:, own] = choose(tight & (dist[:, u] < dist[:, v]))
        even = tight & (dist[:, u] == dist[:, v])
        known = (out != _NONE) | (sources[:, None] == np.arange(dist.shape[1]))
        while True:
            open_ = even & ~known[:, v] & known[:, u]
            if not open_.any():
                return out
            found = choose(open_)
            out[:, own] = np.where(found != _NONE, found, out[:, own])
            known[:, own] |= found != _NONE
