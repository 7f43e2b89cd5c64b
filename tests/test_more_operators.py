"""Cases that the first round's operators got wrong or that no test held."""

import random

import pytest
from pyspark.sql import functions as F

from roamgrid.functions import expr
from roamgrid.operators import geofence, graph, spatial, summary
from roamgrid.plans import cut
from roamgrid.sources import tables
from roamgrid.streaming import streams

UPDATES = "event_id long, vehicle_id long, ts_ms long, x double, y double"
BOXES = "min_x double, min_y double, max_x double, max_y double"


def test_every_update_is_valid_or_rejected(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, 1, 5.0, 5.0), (2, None, 1, 5.0, 5.0), (3, -(2**63), 1, 5.0, 5.0), (4, 1, 1, nan, 5.0), (5, 1, 1, 5.0, inf), (6, 1, 1, None, 5.0), (7, 1, 1, 5.0, 1000.1), (8, None, 1, -1.0, 0.0)]
    df = spark.createDataFrame(rows, UPDATES)
    assert [r["event_id"] for r in expr.validate_updates(df).collect()] == [1]
    got = {r["event_id"]: r["reason"] for r in expr.rejected_updates(df).collect()}
    assert got == {2: "bad_id", 3: "bad_id", 4: "nan_or_inf", 5: "nan_or_inf", 6: "nan_or_inf", 7: "out_of_bounds", 8: "out_of_bounds"}


def routes(spark, edges, requests, n=6):
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(n)], tables.NODES)
    e = spark.createDataFrame(edges, tables.EDGES)
    req = spark.createDataFrame(requests, "request_id long, src long, dst long")
    cost = {r["request_id"]: (r["total_cost"], r["found"]) for r in graph.shortest_path_cost(req, nodes, e).collect()}
    paths = {}
    for r in graph.shortest_path_nodes(req, nodes, e).orderBy("request_id", "seq").collect():
        paths.setdefault(r["request_id"], []).append(r["node_id"])
    return cost, paths


def test_zero_weights_end(spark):
    edges = [(0, 1, 0.0), (1, 0, 0.0), (1, 2, 3.0), (2, 3, 0.0), (3, 2, 0.0), (3, 4, 0.0), (4, 2, 0.0), (0, 4, 9.0)]
    cost, paths = routes(spark, edges, [(1, 0, 1), (2, 0, 4), (3, 0, 5), (4, 2, 4)])
    assert cost == {1: (0.0, True), 2: (3.0, True), 3: (0.0, False), 4: (0.0, True)}
    assert paths == {1: [0, 1], 2: [0, 1, 2, 3, 4], 4: [2, 3, 4]}


def test_costs_that_arent_final_raise(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], tables.EDGES)
    start = spark.createDataFrame([(0,)], "source long")
    with pytest.raises(RuntimeError):
        graph.distances(start, edges, max_rounds=1)
    with pytest.raises(ValueError, match="weights"):
        graph.distances(start, edges.withColumn("weight", -F.col("weight")))
    assert graph.distances(start, edges).agg(F.max("dist")).first()[0] == 30.0


def test_pruned_costs_are_those_of_the_whole_graph(spark):
    rng = random.Random(1)
    at = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40)]
    edges = [(a, b, rng.choice([1.0, 1.3, 2.0]) * ((at[a][1] - at[b][1]) ** 2 + (at[a][2] - at[b][2]) ** 2) ** 0.5) for a in range(40) for b in rng.sample(range(40), 4) if a != b]
    best = [[0.0 if a == b else float("inf") for b in range(40)] for a in range(40)]
    for a, b, w in edges:
        best[a][b] = min(best[a][b], w)
    for k in range(40):
        best = [[min(best[a][b], best[a][k] + best[k][b]) for b in range(40)] for a in range(40)]
    req = [(i, rng.randrange(40), rng.randrange(40)) for i in range(30)]
    got = graph.shortest_path_cost(spark.createDataFrame(req, "request_id long, src long, dst long"), spark.createDataFrame(at, tables.NODES), spark.createDataFrame(edges, tables.EDGES))
    for r in got.collect():
        _, a, b = req[r["request_id"]]
        assert r["total_cost"] == pytest.approx(best[a][b] if best[a][b] < float("inf") else 0.0)


def test_segments_on_screen(spark):
    nodes, edges = tables.road_grid(spark, 2, 2, 10.0)
    paths = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 3)], "request_id long, seq int, node_id long")
    got = graph.route_segments(paths, nodes, (0.0, 5.0, 2.0)).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, -10, 20, -10), (1, 1, 20, -10, 20, 10)]


def test_boxes_of_any_size_meet(spark):
    rng = random.Random(2)
    box = lambda w: (x := rng.uniform(-500, 500), y := rng.uniform(-500, 500), x + rng.uniform(0, w), y + rng.uniform(0, w))
    a = [(i, *box(rng.choice([0, 1, 90, 3000]))) for i in range(60)] + [(60, -1e5, -1e5, 1e5, 1e5), (61, 5.0, 5.0, 4.0, 9.0)]
    b = [(i, *box(rng.choice([0, 40, 800]))) for i in range(60)] + [(60, -2e5, 0.0, 2e5, 0.0)]
    met = spatial.bbox_join(spark.createDataFrame(a, f"a long, {BOXES}"), spark.createDataFrame(b, f"b long, {BOXES}"))
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] <= p[3] and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert sorted((r["a"], r["b"]) for r in met.collect()) == want


def test_points_keep_columns_named_like_cells(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0, "l", 7, 8)], "vehicle_id long, x double, y double, level string, cx int, cy int")
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 5.0, 5.0)], f"box_id long, {BOXES}")
    r = spatial.range_join(p, boxes).first()
    assert (r["level"], r["cx"], r["cy"], r["box_id"]) == ("l", 7, 8, 0)
    with pytest.raises(ValueError, match="reserved"):
        spatial.range_join(p.withColumn("_cell", F.lit(1)), boxes)


@pytest.mark.parametrize("spread", [1.0, 1000.0, 1e6])
def test_nearest_join_is_nearest_for_each_query(spark, spread):
    rng = random.Random(3)
    points = [(i, rng.gauss(0, 1) * (spread if i % 10 == 0 else 1), rng.gauss(0, 1)) for i in range(300)] + [(300, 5.0, 5.0), (301, 5.0, 5.0)]
    queries = [(i, rng.uniform(-2, 2) * spread, rng.uniform(-3, 3)) for i in range(60)] + [(60, 5.0, 5.0), (61, -3 * spread, 4 * spread), (62, float("nan"), 1.0)]
    p, q = spark.createDataFrame(points, "vehicle_id long, x double, y double"), spark.createDataFrame(queries, "query_id long, x double, y double")
    for cell in (None, 25.0):
        got = {r["query_id"]: r["vehicle_id"] for r in spatial.nearest_join(q, p, cell).collect()}
        want = {k: min(((x - a) * (x - a) + (y - b) * (y - b), i) for i, x, y in points)[1] for k, a, b in queries[:-1]}
        assert got == {**want, 62: None}
    assert spatial.nearest_join(q, p.limit(0)).filter("vehicle_id is null").count() == len(queries)


def test_unclamped_cells_and_text(spark):
    df = spark.createDataFrame([(7, -1.0, 1020.0, 2.345)], "vehicle_id long, x double, y double, distance double")
    r = df.select(expr.grid_cell("x", "y", clamp=False).alias("c"), expr.grid_cell("x", "y").alias("k"), expr.vehicle_line().alias("v"), expr.pick_line().alias("p"), expr.quad_key(F.lit(500.0), F.lit(499.0), depth=2).alias("q")).first()
    assert (tuple(r["c"]), tuple(r["k"])) == ((-1, 51), (0, 49))
    assert r["v"] == "Vehicle 7: (-1.0, 1020.0)" and r["p"].endswith("dist 2.35") and r["q"] == "30"


def test_quantiles(spark):
    rng = random.Random(4)
    rows = [("a", rng.randrange(-(10**12), 10**12)) for _ in range(500)] + [("b", 5)] * 40 + [("b", 6)] + [("c", None), (None, 3)]
    got = {r["grp"]: r for r in summary.latency_summary(spark.createDataFrame(rows, "grp string, ns long")).collect()}
    for g in ("a", "b", None):
        v = sorted(n for k, n in rows if k == g)
        for p in (50, 95, 99):
            assert got[g][f"p{p}"] == v[-(-p * len(v) // 100) - 1] / 1e6, (g, p)
    assert tuple(got["c"])[1:] == (0.0, 0.0, 0.0, 0.0, 0)


def test_graph_and_zones_from_files(spark, tmp_path):
    first = spark.createDataFrame([(1, 9.0, 9.0), (2, 1.0, 1.0), (1, 3.0, 3.0)], tables.NODES).coalesce(1)
    first.write.parquet(f"{tmp_path}/n")
    spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], tables.EDGES).write.parquet(f"{tmp_path}/e")
    nodes, edges, dangling = tables.read_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e")
    assert sorted(map(tuple, nodes.collect())) == [(1, 3.0, 3.0), (2, 1.0, 1.0)]
    assert (edges.count(), dangling.first()["dangling"]) == (1, 1)
    tables.demo_zones(spark).write.json(f"{tmp_path}/z")
    zones = tables.read_zones(spark, f"{tmp_path}/z")
    inside = spark.createDataFrame([(1, 500.0, 500.0), (2, 850.0, 850.0), (3, 1.0, 1.0)], "vehicle_id long, x double, y double")
    assert sorted((r["zone_id"], r["vehicle_id"]) for r in geofence.zone_membership(inside, zones).collect()) == [("airport", 2), ("center", 1)]


def feed(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, UPDATES).coalesce(1).write.mode("append").parquet(path)


def test_snapshots_wait_compact_and_go_on_after_a_restart(spark, tmp_path):
    inp, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    run = lambda **k: streams.write_snapshots(tables.read_position_stream(spark, inp, 1), out, state, {"availableNow": True}, compact_every=2, **k).awaitTermination()
    seen = lambda: {r["vehicle_id"]: (r["x"], r["ts_ms"]) for r in streams.read_snapshot(spark, out).collect()}
    feed(spark, inp, [(1, 1, 10, 1.0, 0.0), (2, 2, 10, 1.0, 0.0)], [(3, 1, 20, 2.0, 0.0)])
    run(publish_max_rows=3)
    assert seen() == {1: (2.0, 20), 2: (1.0, 10)}  # two rows waited for the third
    # A late row changes nothing; after the restart older state is still there.
    feed(spark, inp, [(4, 1, 15, 9.0, 0.0)], [(5, 3, 30, 3.0, 0.0)])
    run(publish_max_rows=100)
    assert 3 not in seen()
    streams.publish(spark, out)
    assert seen() == {1: (2.0, 20), 2: (1.0, 10), 3: (3.0, 30)}
    for k in range(6):
        feed(spark, inp, [(10 + k, 2, 100 + k, float(k), 0.0)])
    run()
    assert seen() == {1: (2.0, 20), 2: (5.0, 105), 3: (3.0, 30)}
    # Retired publishes keep their files for one compaction more.
    assert len(streams._batches(spark, out, "changes")) <= 4 and len(streams._batches(spark, out, "base")) <= 3


def test_rows_beyond_the_watermark_are_left_out(spark, tmp_path):
    inp = f"{tmp_path}/in"
    minute = 60_000
    feed(spark, inp, [(1, 2, 100 * minute, 0.0, 0.0)], [(2, 2, 101 * minute, 0.0, 0.0)], [(3, 2, minute, 0.0, 0.0), (4, 2, 100 * minute, 0.0, 0.0)])
    got = {}
    q = streams.update_rate_stream(tables.read_position_stream(spark, inp, 1), "1 minute", late="10 minutes").writeStream.outputMode("update")
    q = q.foreachBatch(lambda df, _: got.update({r["window_ms"] // minute: r["n"] for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == {100: 2, 101: 1}


def test_zone_events_leave_late_rows_out(spark, tmp_path):
    inp, out = f"{tmp_path}/in", f"{tmp_path}/out"
    feed(spark, inp, [(1, 1, 10, 500.0, 500.0)], [(2, 1, 5, 0.0, 0.0), (3, 1, 20, 850.0, 850.0)], [(4, 1, 30, float("nan"), 0.0), (5, 1, 40, 500.0, 500.0)])
    events = streams.zone_event_stream(expr.validate_updates(tables.read_position_stream(spark, inp, 1)), tables.demo_zones(spark))
    streams.write_alert_stream(events, out, f"{tmp_path}/state", {"availableNow": True}).awaitTermination()
    want = ["ENTER zone center", "EXIT zone center", "ENTER zone airport", "EXIT zone airport", "ENTER zone center"]
    assert sorted(r["value"] for r in spark.read.text(out).collect()) == sorted(f"ALERT: Vehicle 1 {w}" for w in want)


def test_a_cluster_must_name_a_shared_folder():
    class Other:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        cut.shared_dir(Other)
