"""Routing by hops, by searches inside tasks, and over an overlay: all give the costs and paths of one plain search."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from roamgrid.operators import graph
from roamgrid.sources import tables

REQUESTS = "request_id long, src long, dst long"


def made(seed, n=120, zero=False):
    """A directed graph with parallel edges, some of weight 0, unreachable nodes, and nodes at one place or none."""
    rng = random.Random(seed)
    at = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(n)]
    at += [(n + i, 50.0, 50.0) for i in range(15)] + [(n + 15 + i, None, math.nan) for i in range(5)]
    ids = [i for i, *_ in at]
    near = lambda a: sorted(ids[:n], key=lambda b: math.dist(at[a][1:], at[b][1:]))[1:4]
    edges = [(a, b, rng.choice([0.0, 1.0, 2.5]) if zero else rng.uniform(1, 9)) for a in range(n) for b in near(a) if rng.random() < 0.9]
    edges += [(rng.choice(ids), rng.choice(ids), rng.choice([3.0, 20.0])) for _ in range(60)] + edges[:10] + [(5, 9999, 1.0), (9998, 5, 1.0)]
    requests = [(k, rng.choice(ids), rng.choice(ids)) for k in range(150)] + [(900, 5, 5), (901, 7777, 7777), (902, 5, 7777), (903, 7777, 5), (904, 5, None), (905, None, None)]
    return at, edges, requests


def plain(at, edges, src):
    known = {i for i, *_ in at}
    out = {}
    for a, b, w in edges:
        if a in known and b in known:
            out.setdefault(a, []).append((b, w))
    dist, heap = {}, [(0.0, src)]
    while heap:
        d, a = heapq.heappop(heap)
        if a not in dist:
            dist[a] = d
            for b, w in out.get(a, []):
                heapq.heappush(heap, (d + w, b))
    return dist


def wanted(at, edges, requests):
    known = {i for i, *_ in at}
    out = {}
    for k, a, b in requests:
        if a is not None and a == b:
            out[k] = (0.0, True)
        else:
            d = plain(at, edges, a).get(b) if a in known else None
            out[k] = (0.0, False) if d is None else (d, True)
    return out


@pytest.fixture(params=["tasks", "hops", "overlay", "overlay of one cell", "overlay by hops"])
def cost(request, spark, monkeypatch):
    if "hops" in request.param:
        monkeypatch.setattr(graph.distances, "__defaults__", tuple(0 if d == graph.LOCAL_EDGES else d for d in graph.distances.__defaults__))
        monkeypatch.setattr(graph.overlay_costs, "__defaults__", (0,))
    capacity = {"tasks": None, "hops": None, "overlay": 20, "overlay of one cell": 10_000, "overlay by hops": 40}[request.param]
    return lambda requests, nodes, edges: graph.shortest_path_cost(requests, nodes, edges, capacity=capacity)


@pytest.mark.parametrize("seed", [1, 2])
def test_costs(spark, cost, seed):
    at, edges, requests = made(seed, zero=seed == 2)
    got = cost(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(at, tables.NODES), spark.createDataFrame(edges, tables.EDGES)).collect()
    want = wanted(at, edges, requests)
    assert len(got) == len(want)
    for r in got:
        assert r["found"] == want[r["request_id"]][1] and r["total_cost"] == pytest.approx(want[r["request_id"]][0], abs=1e-9), r


def test_overlay_has_few_rows(spark, monkeypatch):
    """On the grid the search has a row for each source and entered node, less than a quarter of all nodes."""
    nodes, edges = tables.road_grid(spark, 20, 20, 50.0)
    requests = spark.range(400).select(F.col("id").alias("request_id"), F.col("id").alias("src"), (399 - F.col("id")).alias("dst"))
    seen = []
    search = graph.distances
    monkeypatch.setattr(graph, "distances", lambda *a, **k: seen.append(search(*a, **k)) or seen[-1])
    got = graph.shortest_path_cost(requests, nodes, edges, capacity=100)
    assert got.filter("not found").count() == 0 and got.agg(F.sum("total_cost")).first()[0] == sum(50.0 * (abs(i % 20 - (399 - i) % 20) + abs(i // 20 - (399 - i) // 20)) for i in range(400))
    assert len(seen) == 1 and seen[0].count() < 400 * 400 / 4


@pytest.mark.parametrize("seed", [3, 4])
def test_paths_do_not_depend_on_the_way(spark, seed):
    """Predecessors by numpy and by joins; a path costs what it should and each step takes the smallest node that can precede."""
    at, edges, requests = made(seed, zero=seed == 4)
    nodes, links, asked = spark.createDataFrame(at, tables.NODES), spark.createDataFrame(edges, tables.EDGES), spark.createDataFrame(requests, REQUESTS)
    paths = {}
    for r in graph.shortest_path_nodes(asked, nodes, links).orderBy("request_id", "seq").collect():
        paths.setdefault(r["request_id"], []).append((r["seq"], r["node_id"]))
    known = graph.known_edges(nodes, links)
    sources = asked.select(F.col("src").alias("source")).distinct()
    by_hops = graph.distances(sources, known, local_edges=0, previous=True)
    in_tasks = graph.distances(sources, known, previous=True)
    assert sorted(map(tuple, by_hops.collect()), key=str) == sorted(map(tuple, in_tasks.collect()), key=str)
    other = graph.shortest_path_nodes(asked, nodes, links, by_hops.drop("prev"))
    again = {}
    for r in other.orderBy("request_id", "seq").collect():
        again.setdefault(r["request_id"], []).append((r["seq"], r["node_id"]))
    assert again == paths
    want = {k: v for k, v in wanted(at, edges, requests).items() if v[1]}
    assert paths.keys() == want.keys()
    least = {}
    for a, b, w in edges:
        least[a, b] = min(w, least.get((a, b), math.inf))
    for k, path in paths.items():
        assert [s for s, _ in path] == list(range(len(path))) and len({n for _, n in path}) == len(path)
        assert sum(least[a, b] for (_, a), (_, b) in zip(path, path[1:], strict=False)) == pytest.approx(want[k][0], abs=1e-9)


def test_long_path(spark):
    """A path of 300 nodes takes nine doublings."""
    nodes = spark.range(300).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    edges = spark.range(299).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    path = graph.shortest_path_nodes(spark.createDataFrame([(1, 0, 299), (2, 3, 3), (3, 7, 6)], REQUESTS), nodes, edges)
    assert sorted((r["request_id"], r["seq"], r["node_id"]) for r in path.collect()) == [(1, i, i) for i in range(300)] + [(2, 0, 3)]


def test_bounds_prune_with_unreachable_goals(spark, monkeypatch):
    """Hops with goals, of which one can't be reached from its source; other sources stop early and lose nothing."""
    monkeypatch.setattr(graph, "BOUND_EVERY", 1)
    nodes, edges = tables.road_grid(spark, 12, 12, 10.0)
    edges = edges.filter("dst <> 143 and src <> 143")
    goals = [(0, 5), (0, 143), (60, 61), (130, 2)]
    g = spark.createDataFrame(goals, "source long, goal long")
    got = {(r["source"], r["node"]): r["dist"] for r in graph.distances(g.select("source"), edges, goals=g, nodes=nodes, local_edges=0).collect()}
    for a, b in goals:
        assert got.get((a, b)) == (None if b == 143 else 10.0 * (abs(a % 12 - b % 12) + abs(a // 12 - b // 12)))
    assert sum(a == 60 for a, _ in got) < 40  # of 143
