from pyspark.sql import functions as F

from roamgrid.functions import expr
from roamgrid.operators import geofence, graph, spatial, state
from roamgrid.sources import frames, tables

POINTS = "vehicle_id long, x double, y double"


def points(spark, *rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], POINTS)


def ids(df, c="vehicle_id"):
    return sorted(r[c] for r in df.collect())


def test_range_and_nearest(spark):
    p = points(spark, (1, 10, 10), (2, 20, 20), (3, 15, 15))
    assert ids(spatial.range_query(p, (12.0, 12.0, 22.0, 22.0))) == [2, 3]
    n = spatial.nearest(points(spark, (1, 0, 0), (2, 10, 0)), 0.0, 1.0).first()
    assert (n["vehicle_id"], n["distance"]) == (1, 1.0)
    assert spatial.nearest(points(spark), 0.0, 0.0).first()["vehicle_id"] is None


def test_range_join_is_range_query_for_each_box(spark):
    p = points(spark, *[(i, i * 37 % 101, i * 53 % 97) for i in range(200)])
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 5.0, 5.0), (1, 10.0, 10.0, 90.0, 40.0), (2, -500.0, -500.0, 900.0, 900.0)], "box_id long, min_x double, min_y double, max_x double, max_y double")
    got = spatial.range_join(p, boxes, 7.0)
    for b in boxes.collect():
        assert ids(got.filter(F.col("box_id") == b["box_id"])) == ids(spatial.range_query(p, tuple(b)[1:]))


def test_polygon(spark):
    square, tri = [(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (10, 5), (0, 10)]
    cases = [(square, 5, 5, True), (square, 15, 5, False), (square, 5, 0, True), (square, 0, 5, True), (square, 5, 10, False), (square, 10, 5, False), (tri, 2, 5, True), (tri, 8, 5, True), (square[:2], 5, 0, False)]
    df = spark.createDataFrame([([tuple(map(float, v)) for v in p], float(x), float(y), e) for p, x, y, e in cases], "p array<struct<x: double, y: double>>, x double, y double, e boolean")
    assert all(r["e"] == r["got"] for r in df.withColumn("got", expr.point_in_polygon("x", "y", "p")).collect())


def test_latest_and_changes(spark):
    u = spark.createDataFrame([(1, 42, 1000, 10.0, 20.0), (2, 42, 2000, 30.0, 40.0)], "event_id long, vehicle_id long, ts_ms long, x double, y double")
    last = state.latest_positions(u)
    assert tuple(last.first()) == (42, 30.0, 40.0, 2000)
    change = spark.createDataFrame([(3, "remove", 42, 0.0, 0.0, 3000), (4, "remove", 7, 0.0, 0.0, 3000)], "seq long, op string, vehicle_id long, x double, y double, ts_ms long")
    assert state.apply_changes(last, change).count() == 0
    assert state.lookup(last, spark.createDataFrame([(42,), (999,)], "vehicle_id long")).count() == 1


def test_routing(spark):
    nodes, edges = tables.road_grid(spark, 2, 2, 10.0)
    req = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 0, 99), (4, 0, 3)], "request_id long, src long, dst long")
    cost = {r["request_id"]: (r["total_cost"], r["found"]) for r in graph.shortest_path_cost(req, nodes, edges).collect()}
    assert cost == {1: (10.0, True), 2: (0.0, True), 3: (0.0, False), 4: (20.0, True)}
    path = {}
    for r in graph.shortest_path_nodes(req, nodes, edges).orderBy("request_id", "seq").collect():
        path.setdefault(r["request_id"], []).append(r["node_id"])
    assert path == {1: [0, 1], 2: [0], 4: [0, 1, 3]}
    n, e = tables.road_grid(spark, 20, 20, 50.0)
    assert (n.count(), e.count()) == (400, 1520)


def test_transitions(spark):
    rows = [(i, 1, i * 10, x, 500.0) for i, x in enumerate([0.0, 450.0, 460.0, 700.0, 500.0])]
    u = spark.createDataFrame(rows, "event_id long, vehicle_id long, ts_ms long, x double, y double")
    got = geofence.zone_transitions(u, tables.demo_zones(spark)).orderBy("ts_ms").collect()
    assert [(r["zone_id"], r["event_type"], r["ts_ms"]) for r in got] == [("center", "ENTER", 10), ("center", "EXIT", 30), ("center", "ENTER", 40)]


def test_frames(spark):
    df = spark.createDataFrame([(1, 2.5, 3.5, 4)], "vehicle_id long, x double, y double, ts_ms long")
    data = frames.encode_frames(df).first()["content"]
    assert len(data) == 32
    cut = spark.createDataFrame([(data + b"abc",), (None,)], "content binary")
    assert [tuple(r) for r in frames.decode_frames(cut).collect()] == [(1, 2.5, 3.5, 4)]
