"""A dense group of vectors, wider than any searched beam, keeps all its links."""

import numpy as np

from roamgrid.llm._hnsw import WIDE, Graph
from roamgrid.llm.embedding_dedup import LEAST, _union, audited


def test_dense_group_is_found_whole():
    rng = np.random.default_rng(1)
    near = rng.normal(size=16) + 0.01 * rng.normal(size=(3 * WIDE, 16))
    v = np.vstack([near, rng.normal(size=(200, 16))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph(v, np.arange(len(v)), np.ones(len(v), np.int64))
    got = [(q, node) for q, node in audited(graph, v)]
    a, b = (np.concatenate([g[k] for g in got]) for k in (0, 1))
    found = set(zip(a.tolist(), graph.ids[b].tolist()))
    assert len(found) == len(a)
    assert found == set(zip(*(x.tolist() for x in np.nonzero(v @ v.T >= LEAST))))


def test_union_points_to_the_smallest():
    root = _union(np.arange(7), np.array([5, 4, 6]), np.array([4, 2, 1]))
    root = _union(root, np.array([2]), np.array([6]))
    assert root.tolist() == [0, 1, 1, 3, 1, 1, 1]
    assert _union(root, np.array([], int), np.array([], int)).tolist() == root.tolist()
