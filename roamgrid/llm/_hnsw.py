"""Hierarchical navigable small-world graphs over unit vectors with numpy, built and searched in batches."""

from __future__ import annotations

import io

import numpy as np

#: Beams wider than this are as wide as the shard.
WIDE = 128


class Graph:
    """neighbours[layer]: for each node of the layer as many neighbours as fit; -1 pads. Nodes are
    numbered so that those of higher layers come first, hence layer L holds nodes 0 to sizes[L] - 1."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, weights: np.ndarray, *, m: int = 12, beam: int = 48, batch: int = 256, seed: int = 0) -> None:
        n = len(vectors)
        levels = np.minimum(6, (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int))
        order = np.argsort(-levels, kind="stable")
        levels = levels[order]
        self.vectors, self.ids, self.weights = vectors[order], ids[order], weights[order]
        self.sizes = [int(np.count_nonzero(levels >= layer)) for layer in range(int(levels.max(initial=0)) + 1)]
        self.neighbours = [np.full((size, m * (2 if layer == 0 else 1)), -1, np.int32) for layer, size in enumerate(self.sizes)]
        self.m, at = m, 0
        while at < n:
            stop = min(n, max(at + batch // 8, min(at + batch, 2 * at)))
            self._insert(at, stop, beam)
            at = stop

    def _insert(self, at: int, stop: int, beam: int) -> None:
        """Links nodes at to stop - 1 in all their layers to what is there and to each other."""
        for layer in reversed(range(len(self.sizes))):
            rows = np.arange(at, min(stop, self.sizes[layer]))
            if not len(rows):
                continue
            among = self.vectors[rows] @ self.vectors[rows].T
            np.fill_diagonal(among, -np.inf)
            k = min(beam, len(rows) - 1)
            mates = np.argpartition(-among, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(rows), 0), int)
            ids, sims = rows[mates], np.take_along_axis(among, mates, 1)
            if at:
                found, sim = self._beam(self.vectors[rows], layer, beam, at)
                ids, sims = np.hstack([ids, found]), np.hstack([sims, sim])
            width = self.neighbours[layer].shape[1]
            picked = self._select(ids, sims, self.m)
            self.neighbours[layer][rows, : picked.shape[1]] = picked
            # Back links: each target takes its new neighbours beside its old ones.
            target, source = picked.ravel(), np.repeat(rows, picked.shape[1])
            target, source = target[target >= 0], source[target >= 0]
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            heads, first, count = np.unique(target, return_index=True, return_counts=True)
            extra = np.full((len(heads), int(count.max(initial=0))), -1, np.int64)
            extra[np.repeat(np.arange(len(heads)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            every = np.hstack([self.neighbours[layer][heads], extra])
            sims = np.einsum("ij,ikj->ik", self.vectors[heads], self.vectors[every])
            sims[every < 0] = -np.inf
            again = self._select(every, sims, width)
            self.neighbours[layer][heads] = -1
            self.neighbours[layer][heads, : again.shape[1]] = again

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates those that are nearer to the row than to one already taken; then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * self.m]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = np.isfinite(sims)
        # A candidate that stands twice counts once.
        rank = np.argsort(ids, axis=1, kind="stable")
        in_order = np.take_along_axis(ids, rank, 1)
        twice = np.zeros_like(valid)
        np.put_along_axis(twice, rank, np.hstack([np.zeros((len(ids), 1), bool), in_order[:, 1:] == in_order[:, :-1]]), 1)
        valid &= ~twice
        near = self.vectors[ids]
        among = near @ near.transpose(0, 2, 1)
        taken = np.zeros_like(valid)
        for j in range(ids.shape[1]):
            close = (taken[:, :j] & (among[:, j, :j] > sims[:, j, None])).any(1)
            taken[:, j] = valid[:, j] & ~close & (taken.sum(1) < most)
        key = np.where(taken, 0, np.where(valid, 1, 2))
        order = np.argsort(key, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(key, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)

    def _enter(self, queries: np.ndarray, layer: int, limit: int) -> np.ndarray:
        """Greedy descent to the layer above `layer`'s nearest node, for each query."""
        now = np.zeros(len(queries), np.int64)
        sim = queries @ self.vectors[0]
        for above in range(len(self.sizes) - 1, layer, -1):
            moving = np.arange(len(queries))
            while len(moving):
                next_ = self.neighbours[above][now[moving]].astype(np.int64)
                s = np.einsum("ij,ikj->ik", queries[moving], self.vectors[next_])
                s[(next_ < 0) | (next_ >= limit)] = -np.inf
                best = s.argmax(1)
                better = s[np.arange(len(moving)), best] > sim[moving]
                moving, best, next_, s = moving[better], best[better], next_[better], s[better]
                now[moving], sim[moving] = next_[np.arange(len(moving)), best], s[np.arange(len(moving)), best]
        return now

    def _beam(self, queries: np.ndarray, layer: int, beam: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` best nodes below `limit` that a best-first search finds: ids and cosines (-inf pads)."""
        q = len(queries)
        limit = min(limit, self.sizes[layer])
        beam = min(beam, limit)
        start = self._enter(queries, layer, limit)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -np.inf)
        done = np.ones((q, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = start, np.einsum("ij,ij->i", queries, self.vectors[start]), False
        seen = np.zeros((q, limit), bool)
        seen[np.arange(q), start] = True
        live = np.arange(q)
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            best = open_.argmax(1)
            going = open_[np.arange(len(live)), best] > -np.inf
            live, best = live[going], best[going]
            if not len(live):
                break
            done[live, best] = True
            next_ = self.neighbours[layer][ids[live, best]].astype(np.int64)
            ok = (next_ >= 0) & (next_ < limit)
            next_ = np.where(ok, next_, 0)
            ok &= ~seen[live[:, None], next_]
            row, col = np.nonzero(ok)
            seen[live[row], next_[row, col]] = True
            s = np.full(next_.shape, -np.inf)
            s[row, col] = np.einsum("ij,ij->i", queries[live[row]], self.vectors[next_[row, col]])
            all_sims = np.hstack([sims[live], s])
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            take = lambda a, b: np.take_along_axis(np.hstack([a, b]), keep, 1)
            sims[live], ids[live], done[live] = np.take_along_axis(all_sims, keep, 1), take(ids[live], next_), take(done[live], s == -np.inf)
        return ids, sims

    def within(self, queries: np.ndarray, least: float, beam: int, block: int = 256):
        """Yields blocks of (query, node) with cosine >= least. A query whose whole beam is that near
        gets a wider one; past WIDE the beam is the whole shard, which is one product of matrices."""
        for at in range(0, len(queries), block):
            rows, width = np.arange(at, min(at + block, len(queries))), beam
            while len(rows):
                if width > WIDE or width >= len(self.vectors):
                    r, c = np.nonzero(queries[rows] @ self.vectors.T >= least)
                    yield rows[r], c
                    break
                ids, sims = self._beam(queries[rows], 0, width, len(self.vectors))
                full = (sims >= least).all(1)
                r, c = np.nonzero((sims >= least) & ~full[:, None])
                yield rows[r], ids[r, c]
                rows, width = rows[full], width * 4

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, ids=self.ids, weights=self.weights, m=self.m, **{f"layer{i}": x for i, x in enumerate(self.neighbours)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        self, z = cls.__new__(cls), np.load(io.BytesIO(data))
        self.vectors, self.ids, self.weights, self.m = z["vectors"], z["ids"], z["weights"], int(z["m"])
        self.neighbours = [z[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in z))]
        self.sizes = [len(x) for x in self.neighbours]
        return self
