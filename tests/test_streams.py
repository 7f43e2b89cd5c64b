"""Streams with state: silent vehicles, many zones, publish intervals, older publishes and leases."""

import time

import pytest
from pyspark.sql import functions as F

from roamgrid.functions import expr
from roamgrid.sources import tables
from roamgrid.streaming import streams

UPDATES = "event_id long, vehicle_id long, ts_ms long, x double, y double"
HOUR = 3_600_000


def feed(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, UPDATES).coalesce(1).write.mode("append").parquet(path)


def events(spark, tmp_path, zones, **options):
    stream = expr.validate_updates(tables.read_position_stream(spark, f"{tmp_path}/in", 1))
    out = streams.zone_event_stream(stream, zones, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return sorted((r["vehicle_id"], r["ts_ms"], r["event_type"], r["zone_id"]) for r in spark.read.schema(streams.EVENTS).parquet(f"{tmp_path}/out").collect())


def test_silent_vehicles_leave_their_zones(spark, tmp_path):
    """One is silent until the watermark passes, across a restart; one comes back after a gap; one goes on."""
    zones = tables.demo_zones(spark)
    day, t0 = 24 * HOUR, 1000 * HOUR  # the watermark begins at 0
    options = {"silent_ms": day, "wait": "1 hour"}
    later = lambda rows: [(e, v, t0 + ts, x, y) for e, v, ts, x, y in rows]
    same = lambda: [(v, ts - t0, kind, z) for v, ts, kind, z in events(spark, tmp_path, zones, **options)]
    feed(spark, f"{tmp_path}/in", later([(1, 1, 0, 500.0, 500.0), (2, 2, 0, 500.0, 500.0), (3, 3, 0, 850.0, 850.0)]), later([(4, 3, 20 * HOUR, 500.0, 500.0)]))
    want = [(1, 0, "ENTER", "center"), (2, 0, "ENTER", "center"), (3, 0, "ENTER", "airport"), (3, 20 * HOUR, "ENTER", "center"), (3, 20 * HOUR, "EXIT", "airport")]
    assert same() == sorted(want)
    # Vehicle 2 is back after two days in the same zone: it left after one. Vehicle 1 says nothing any more.
    feed(spark, f"{tmp_path}/in", later([(5, 2, 2 * day, 500.0, 500.0), (6, 3, 40 * HOUR, 500.0, 500.0)]), later([(7, 3, 50 * HOUR, 0.0, 0.0)]))
    want += [(2, day, "EXIT", "center"), (2, 2 * day, "ENTER", "center"), (1, day, "EXIT", "center"), (3, 50 * HOUR, "EXIT", "center")]
    assert same() == sorted(want)
    # What is behind the watermark by now isn't taken up.
    feed(spark, f"{tmp_path}/in", later([(8, 1, HOUR, 500.0, 500.0), (9, 4, 60 * HOUR, 0.0, 0.0)]))
    assert same() == sorted(want)


def test_vehicles_that_share_a_row_of_state(spark, tmp_path, monkeypatch):
    """All vehicles in one group: each has its own zones and falls silent by itself; updates without a vehicle are one more."""
    monkeypatch.setattr(streams, "GROUPS", 1)
    test_silent_vehicles_leave_their_zones(spark, f"{tmp_path}/a")
    zones = tables.demo_zones(spark)
    feed(spark, f"{tmp_path}/b/in", [(1, None, 10, 500.0, 500.0), (2, 7, 10, 500.0, 500.0)], [(3, None, 20, 0.0, 0.0)])
    out = streams.zone_event_stream(tables.read_position_stream(spark, f"{tmp_path}/b/in", 1), zones).writeStream.format("parquet").option("path", f"{tmp_path}/b/out")
    out.option("checkpointLocation", f"{tmp_path}/b/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r["vehicle_id"], r["ts_ms"], r["event_type"]) for r in spark.read.schema(streams.EVENTS).parquet(f"{tmp_path}/b/out").collect()}
    assert got == {(None, 10, "ENTER"), (7, 10, "ENTER"), (None, 20, "EXIT")}


def test_ten_thousand_zones(spark, tmp_path):
    """A table of zones, not literals: one square for each tenth of the map's sides, and a change of zones at the restart."""
    square = lambda a, b: F.array(*[F.struct(F.lit(x).cast("double").alias("x") if isinstance(x, float) else x.alias("x"), y.alias("y")) for x, y in ((a, b), (a + 10, b), (a + 10, b + 10), (a, b + 10))])
    at = spark.range(10_000).select(F.concat(F.lit("z"), "id").alias("zone_id"), (F.col("id") % 100 * 10).cast("double").alias("a"), (F.floor(F.col("id") / 100) * 10).cast("double").alias("b"))
    zones = at.select("zone_id", square(F.col("a"), F.col("b")).alias("polygon"), F.col("a").alias("min_x"), F.col("b").alias("min_y"), (F.col("a") + 10).alias("max_x"), (F.col("b") + 10).alias("max_y"))
    feed(spark, f"{tmp_path}/in", [(k, k, 10, k * 10 + 5.0, 15.0) for k in range(50)], [(100 + k, k, 20, k * 10 + 5.0, 25.0) for k in range(50)])
    want = [(k, 10, "ENTER", f"z{100 + k}") for k in range(50)] + [(k, 20, "EXIT", f"z{100 + k}") for k in range(50)] + [(k, 20, "ENTER", f"z{200 + k}") for k in range(50)]
    assert events(spark, tmp_path, zones) == sorted(want)
    feed(spark, f"{tmp_path}/in", [(200, 0, 30, 5.0, 25.0), (201, 1, 30, 15.0, 25.0)])
    want += [(0, 30, "EXIT", "z200")]
    assert events(spark, tmp_path, zones.filter("zone_id <> 'z200'")) == sorted(want)


def test_vehicles_in_no_zone_and_overlapping_zones(spark, tmp_path):
    zones = tables.zones_of(spark, [("a", tables.square(0, 100), (0, 0, 100, 100)), ("b", tables.square(50, 700), (50, 50, 700, 700)), ("c", tables.square(60, 61), (60, 60, 61, 61))])
    feed(spark, f"{tmp_path}/in", [(1, 1, 10, 70.0, 70.0), (2, 2, 10, 900.0, 900.0), (3, 1, 20, 60.5, 60.5), (4, 1, 30, 200.0, 70.0), (5, 1, 40, 900.0, 0.0)])
    assert events(spark, tmp_path, zones) == sorted([(1, 10, "ENTER", "a"), (1, 10, "ENTER", "b"), (1, 20, "ENTER", "c"), (1, 30, "EXIT", "a"), (1, 30, "EXIT", "c"), (1, 40, "EXIT", "b")])


def snapshots(spark, tmp_path, **options):
    stream = tables.read_position_stream(spark, f"{tmp_path}/in", 1)
    streams.write_snapshots(stream, f"{tmp_path}/out", f"{tmp_path}/state", {"availableNow": True}, **options).awaitTermination()


def seen(df):
    return {r["vehicle_id"]: r["ts_ms"] for r in df.collect()}


def test_publish_interval(spark, tmp_path):
    """Few rows are published once the interval has passed, not before; the first waits for rows."""
    out = f"{tmp_path}/out"
    options = {"publish_max_rows": 3, "publish_interval": 1.5}
    feed(spark, f"{tmp_path}/in", [(k, k, 10, 0.0, 0.0) for k in range(3)])
    snapshots(spark, tmp_path, **options)
    feed(spark, f"{tmp_path}/in", [(5, 1, 20, 0.0, 0.0)])
    began = time.time()
    snapshots(spark, tmp_path, **options | {"publish_interval": 3600.0})
    assert len(streams.versions(spark, out)) == 1 and seen(streams.read_snapshot(spark, out))[1] == 10
    time.sleep(max(0.0, 1.6 - (time.time() - began)))
    feed(spark, f"{tmp_path}/in", [(6, 2, 20, 0.0, 0.0)])
    snapshots(spark, tmp_path, **options)
    assert len(streams.versions(spark, out)) == 2 and seen(streams.read_snapshot(spark, out)) == {0: 10, 1: 20, 2: 20}


def test_older_publishes(spark, tmp_path):
    """Each of seven publishes reads as it was, while the batches after it are compacted."""
    out = f"{tmp_path}/out"
    for k in range(7):
        feed(spark, f"{tmp_path}/in", [(10 * k, k % 3, k, 0.0, 0.0), (10 * k + 1, 50 + k, k, 0.0, 0.0)])
        snapshots(spark, tmp_path, compact_every=2, keep_versions=10)
    state, want = {}, {}
    for k in range(7):
        state |= {k % 3: k, 50 + k: k}
        want[k + 1] = dict(state)
    assert streams.versions(spark, out) == list(range(1, 8))
    assert {v: seen(streams.read_snapshot(spark, out, v)) for v in streams.versions(spark, out)} == want
    assert streams._batches(spark, out, "base")  # there were compactions
    streams.publish(spark, out)  # nothing new: no new version
    assert streams.versions(spark, out)[-1] == 7


def test_leases_hold_files(spark, tmp_path):
    out = f"{tmp_path}/out"
    step = lambda k: (feed(spark, f"{tmp_path}/in", [(k, k % 2, k, 0.0, 0.0)]), snapshots(spark, tmp_path, compact_every=1, keep_versions=1))
    step(1)
    step(2)
    first = streams.versions(spark, out)[-1]
    with streams.lease(spark, out, first) as held, streams.lease(spark, out, first, seconds=-1):
        for k in range(3, 9):
            step(k)
        assert first not in streams.versions(spark, out)  # not for others any more
        assert seen(held) == {0: 2, 1: 1}
    with pytest.raises(ValueError, match="isn't kept"):
        streams.read_snapshot(spark, out, first)
    for k in (9, 10):
        step(k)
    assert first not in streams._batches(spark, out, "retired") and streams._leased(spark, out) == set()
    assert len(streams._batches(spark, out, "base")) <= 3 and seen(streams.read_snapshot(spark, out)) == {0: 10, 1: 9}
