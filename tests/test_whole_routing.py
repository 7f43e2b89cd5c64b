"""The routing queries over whole tables against brute force; keys lie beyond the cuts of the SQL too."""

import math
from itertools import pairwise

import pytest

from roamgrid.plans.registry import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spark-sf"))
    t = {
        "orders": ([(k, k * 31 % 977) for k in (1, 7, 49, 50, 51, 399, 800, 14999, 100000, 100001)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(k * 13 + j * 997, k * 17 + j * 5, float(k % 9 + j)) for k in range(1, 500) for j in (0, 1, 1)], "l_orderkey long, l_partkey long, l_quantity double"),
        "supplier": ([(k,) for k in (1, 20, 21, 22, 500, 999)], "s_suppkey long"),
    }
    for name, (rows, schema) in t.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path, {name: rows for name, (rows, _) in t.items()}


def wanted(tables, n):
    return {**{k: (k * 7 % n, c % n) for k, c in tables["orders"]}, -1: (5, 5), -2: (5, 9999)}


def steps(a, b):
    return abs(a % 20 - b % 20) + abs(a // 20 - b // 20)


def test_costs_on_the_grid(spark, tables):
    path, t = tables
    got = {r["request_id"]: (r["total_cost"], r["found"]) for r in QUERIES["shortest_path_cost"](spark, path).collect()}
    assert got == {k: (0.0, a == b) if b >= 400 or a == b else (50.0 * steps(a, b), True) for k, (a, b) in wanted(t, 400).items()}


def test_paths_and_segments(spark, tables):
    path, t = tables
    paths = {}
    for r in QUERIES["shortest_path_nodes"](spark, path).orderBy("request_id", "seq").collect():
        paths.setdefault(r["request_id"], []).append(r["node_id"])
    known = {k: v for k, v in wanted(t, 400).items() if v[1] < 400}
    assert paths.keys() == known.keys()
    for k, (a, b) in known.items():
        # Back from dst by the smallest predecessor that is nearer to src.
        p = [b]
        while p[-1] != a:
            p.append(min(x for x in range(400) if steps(x, p[-1]) == 1 and steps(x, a) < steps(p[-1], a)))
        assert paths[k] == p[::-1]
    at = lambda i: (i % 20 * 50.0, i // 20 * 50.0)
    want = sorted((k, i, *at(a), *at(b)) for k, p in paths.items() for i, (a, b) in enumerate(pairwise(p)))
    assert sorted(map(tuple, QUERIES["route_segments"](spark, path).collect())) == want


def test_irregular_graph(spark, tables):
    path, t = tables
    at = [(i * 37 % 1001, i * 91 % 1001) for i in range(300)]
    dist = [[0.0 if i == j else math.inf for j in range(300)] for i in range(300)]
    for o, p, q in t["lineitem"]:
        a, b = p % 300, o % 300
        if a != b:
            dist[a][b] = min(dist[a][b], math.dist(at[a], at[b]) + q)
    for k in range(300):
        for row in dist:
            if (via := row[k]) < math.inf:
                row[:] = [min(x, via + y) for x, y in zip(row, dist[k], strict=True)]
    got = {r["request_id"]: (r["total_cost"], r["found"]) for r in QUERIES["shortest_path_irregular"](spark, path).collect()}
    req = wanted(t, 300)
    assert got.keys() == req.keys()
    for k, (a, b) in req.items():
        d = dist[a][b] if b < 300 else math.inf
        assert got[k] == (pytest.approx(d if d < math.inf else 0.0, abs=2e-6), d < math.inf), k


def test_routes_of_all_points(spark, tables):
    path, t = tables
    near = lambda x, y: min(range(400), key=lambda i: ((i % 20 * 50.0 - x) ** 2 + (i // 20 * 50.0 - y) ** 2, i))
    want = {}
    for (k,) in t["supplier"]:
        x, y = float(k * 37 % 1001), float(k * 91 % 1001)
        a, b = near(x, y), near(1000 - x, y / 2)
        want[k] = (a, b, 50.0 * steps(a, b), True)
    assert {r["request_id"]: tuple(r)[1:] for r in QUERIES["route"](spark, path).collect()} == want
