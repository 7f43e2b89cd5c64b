"""Clustered files, cells that split where points are dense, order within hot keys, and sketches that are merged."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roamgrid.functions import expr
from roamgrid.operators import geofence, ordered, spatial, state, summary
from roamgrid.sources import clustered, tables

POINTS = "vehicle_id long, x double, y double"
BOXES = "box_id long, min_x double, min_y double, max_x double, max_y double"
INF, NAN = math.inf, math.nan


def test_quad_code_is_the_quad_key(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.choice([rng.uniform(0, 1000), 500.0, 1000.0, 0.0]), rng.uniform(0, 1000)) for i in range(300)], POINTS)
    for r in df.select(expr.quad_key("x", "y", depth=9).alias("k"), expr.quad_code("x", "y", depth=9).alias("c")).collect():
        assert int(r["k"], 4) == r["c"]


def test_intervals_cover_the_box():
    rng = random.Random(2)
    for _ in range(200):
        box = sorted(rng.uniform(-100, 1100) for _ in range(2)), sorted(rng.uniform(-100, 1100) for _ in range(2))
        box = (box[0][0], box[1][0], box[0][1], box[1][1])
        found = clustered.intervals(box, depth=5, most=rng.choice([1, 8, 10_000]))
        assert found == sorted(found) and all(a <= b for a, b in found) and all(p[1] + 1 < q[0] for p, q in zip(found, found[1:], strict=False))
        exact = set()
        for i in range(32):
            for j in range(32):
                code = sum((1 - (j >> n & 1)) * 2 * 4**n + (i >> n & 1) * 4**n for n in range(5))
                if box[0] <= (i + 1) * 31.25 and i * 31.25 <= box[2] and box[1] <= (j + 1) * 31.25 and j * 31.25 <= box[3]:
                    exact.add(code)
        covered = {c for a, b in found for c in range(a, b + 1)}
        inside = {c for c in exact if c in covered}
        # Cells that the box only touches at their upper border hold none of its points.
        for c in exact - inside:
            i = sum((c >> 2 * n & 1) << n for n in range(5))
            j = sum((1 - (c >> 2 * n + 1 & 1)) << n for n in range(5))
            assert (i + 1) * 31.25 == box[0] or (j + 1) * 31.25 == box[1]
    assert len(clustered.intervals((1, 1, 999, 999))) <= 3 * clustered.INTERVALS
    assert clustered.intervals((5, 5, 1, 1)) == [] == clustered.intervals((2000, 0, 3000, 1000))


def files_read(spark, df):
    """Files in the folders that are left, and rows that row groups and filters leave: each file is a partition of its own here."""
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 27)
    try:
        return df.select("x").rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_read_fall_with_the_box(spark, tmp_path):
    points = spark.range(40_000).select(F.col("id").alias("vehicle_id"), (F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000).alias("y"))
    odd = spark.createDataFrame([(-1, NAN, 1.0), (-2, None, 5.0), (-3, 2000.0, 5.0), (-4, 1000.0, 1000.0), (-5, 0.0, 0.0), (-6, INF, 500.0)], POINTS)
    every = points.unionByName(odd).cache()
    path = f"{tmp_path}/clustered"
    clustered.write_clustered(every, path, files=16)
    assert clustered.read_box(spark, path, (-INF, -INF, INF, INF)).columns == every.columns
    seen = []
    for box in [(0, 0, 1000, 1000), (100, 100, 600, 600), (300, 300, 420, 420), (301, 301, 302, 302)]:
        df = clustered.read_box(spark, path, box)
        want = sorted(r["vehicle_id"] for r in every.filter(expr.in_box("x", "y", *box)).collect())
        assert sorted(r["vehicle_id"] for r in df.collect()) == want
        seen.append(files_read(spark, clustered.read_box(spark, path, box)))
    assert seen == sorted(seen, reverse=True) and seen[-1] <= 4 < seen[0] / 8, seen
    for box in [(-10, 400, 10, 500), (900, -INF, INF, INF), (1500, 0, 2500, 10), (5, 5, 1, 1)]:
        want = sorted(r["vehicle_id"] for r in every.filter(expr.in_box("x", "y", *box)).collect())
        assert sorted(r["vehicle_id"] for r in clustered.read_box(spark, path, box).collect()) == want


def boxes_of(spark, boxes):
    return spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(boxes)], BOXES)


@pytest.mark.parametrize("capacity", [5, 60, 10_000])
def test_dense_range_join(spark, capacity):
    rng = random.Random(4)
    points = [(i, rng.gauss(500, 2), rng.gauss(500, 2)) for i in range(900)] + [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(900, 1000)]
    points += [(2000 + i, 7.0, 7.0) for i in range(20)] + [(3000, NAN, 1.0), (3001, None, 2.0)]
    boxes = [(x := rng.gauss(500, 3), y := rng.gauss(500, 3), x + rng.uniform(0, 2), y + rng.uniform(0, 2)) for _ in range(60)]
    boxes += [(0, 0, 1000, 1000), (-INF, -INF, INF, INF), (7, 7, 7, 7), (400, 400, 600, 501), (2000, 2000, 3000, 3000), (9, 9, 1, 1), (NAN, 0, NAN, 1), (-5, 499, 2000, 499.5)]
    p, b = spark.createDataFrame(points, POINTS), boxes_of(spark, boxes)
    got = [(r["box_id"], r["vehicle_id"]) for r in spatial.dense_range_join(p, b, capacity).collect()]
    fine = lambda v: v is not None and not math.isnan(v)
    want = {(k, i) for k, (ax, ay, bx, by) in enumerate(boxes) for i, x, y in points if fine(x) and ax <= x <= bx and ay <= y <= by}
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.dense_range_join(p.filter("vehicle_id >= 3000"), b, capacity).count() == 0
    pairs = lambda method: sorted(map(tuple, spatial.neighbours(p, 0.5, method=method).collect()))
    assert pairs("tree") == pairs("grid")


def test_dense_points_do_not_meet_in_one_cell(spark):
    """Nine points of ten lie in one cell of the plain join; by leaves no key holds more than the capacity."""
    p = spark.range(20_000).select(F.col("id").alias("vehicle_id"), F.when(F.col("id") % 10 < 9, 500 + F.rand(1)).otherwise(F.rand(2) * 1000).alias("x"), F.when(F.col("id") % 10 < 9, 500 + F.rand(3)).otherwise(F.rand(4) * 1000).alias("y"))
    dealt, leaves, _ = spatial._tree(p, 200, 24)
    assert dealt.groupBy("_leaf").count().agg(F.max("count")).first()[0] <= 200 and dealt.count() == 20_000 and leaves.count() > 100


def test_tables_of_places_are_not_broadcast(spark):
    """Places that many points share: nothing that grows with them reaches the driver, and their cells don't split below what parts them."""
    p = spark.range(5000).select(F.col("id").alias("vehicle_id"), (F.col("id") % 10).cast("double").alias("x"), (F.floor(F.col("id") / 10) % 10).cast("double").alias("y"))
    dealt, leaves, _ = spatial._tree(p, 5, 24)
    assert "Broadcast" not in dealt._jdf.queryExecution().toString()
    assert leaves.count() == 100 and leaves.agg(F.max("_leaf.depth")).first()[0] < 8
    b = boxes_of(spark, [(2, 2, 4, 3.5), (-9, 9, 99, 9), (0.5, 0.5, 0.9, 0.9)])
    want = sorted(map(tuple, spatial.range_join(p, b).select("box_id", "vehicle_id").collect()))
    for few in (0, 1000):
        spatial.FEW_BOXES, before = few, spatial.FEW_BOXES
        try:
            assert sorted(map(tuple, spatial.dense_range_join(p, b, 5).select("box_id", "vehicle_id").collect())) == want and want
        finally:
            spatial.FEW_BOXES = before


UPDATES = "event_id long, vehicle_id long, ts_ms long, x double, y double"


def hot_updates(spark):
    """Vehicle 0 has half of all updates, many of them at one time."""
    rng = random.Random(5)
    rows = [(i, 0 if i % 2 else 1 + i % 40, rng.choice([rng.randrange(10**6), 777, rng.randrange(10**4)]), rng.uniform(300, 700), rng.uniform(300, 700)) for i in range(4000)]
    return spark.createDataFrame(rows, UPDATES).repartition(4)


def test_next_rows_of_hot_keys(spark):
    u = hot_updates(spark)
    plain = ordered.with_next(u, "vehicle_id", ["ts_ms", "event_id"], "ts_ms", "next", "seq")
    cut_up = ordered.with_next(u, "vehicle_id", ["ts_ms", "event_id"], "ts_ms", "next", "seq", limit=100)
    assert plain.columns == cut_up.columns and sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut_up.collect()))
    sizes = [r["count"] for r in ordered.sliced(u, "vehicle_id", "ts_ms", 100).filter("ts_ms <> 777").groupBy("vehicle_id", "_slice").count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == u.filter("ts_ms <> 777").count()
    assert ordered.sliced(u, "vehicle_id", "ts_ms") is None


def test_transitions_and_ticks_of_hot_vehicles(spark):
    u, zones = hot_updates(spark), tables.demo_zones(spark)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(geofence.zone_transitions(u, zones, limit=50)) == rows(geofence.zone_transitions(u, zones))
    assert rows(state.snapshots_at_ticks(u, 1000, limit=50)) == rows(state.snapshots_at_ticks(u, 1000))
    # Against a plain walk along each vehicle's updates.
    want, inside = [], {}
    for e, v, ts, x, y in sorted(map(tuple, u.collect()), key=lambda r: (r[1], r[2], r[0])):
        now = 400 <= x < 600 and 400 <= y < 600
        if now != inside.get(v, False):
            want.append((v, "center", "ENTER" if now else "EXIT", ts))
        inside[v] = now
    assert rows(geofence.zone_transitions(u, zones)) == sorted(want, key=str)


def test_sketches(spark):
    rng = random.Random(6)
    rows = [(g, rng.randrange(10**9) if g == "a" else int(rng.paretovariate(1) * 1000), i * 40) for i, g in ((i, rng.choice(["a", "b", None])) for i in range(60_000))] + [("none", None, 5)]
    df = spark.createDataFrame(rows, "grp string, ns long, ts_ms long").withColumn("shard", F.col("ts_ms") % 3)
    kept = summary.latency_sketches(df, shard="shard")
    assert kept.count() > 300
    for low, high in ((None, None), (600_000, 1_800_000)):
        got = {r["grp"]: r for r in summary.summary_of_sketches(kept, from_ms=low, to_ms=high).collect()}
        for g in ("a", "b", None):
            v = sorted(n for k, n, t in rows if k == g and (low is None or low <= t < high))
            assert got[g]["n"] == len(v) and got[g]["mean"] == pytest.approx(sum(v) / len(v) / 1e6)
            for p in (50, 95, 99):
                q = got[g][f"p{p}"] * 1e6
                less, upto = sum(n < q - 0.5 for n in v) / len(v), sum(n <= q + 0.5 for n in v) / len(v)
                assert less - summary.SKETCH_ERROR <= p / 100 <= upto + summary.SKETCH_ERROR
    assert tuple(summary.summary_of_sketches(kept).filter("grp = 'none'").first()) == ("none", 0.0, 0.0, 0.0, 0.0, 0)
