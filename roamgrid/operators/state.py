"""Latest state, lookup and change application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import BOUNDS, in_box
from .ordered import with_next


def _last(*keys: str) -> Column:
    return F.max_by(F.struct("x", "y", "ts_ms"), F.struct("ts_ms", *keys)).alias("p")


def latest_positions(updates: DataFrame) -> DataFrame:
    """vehicle_id, x, y, ts_ms of the last update by (ts_ms, event_id); partial aggregates before the one shuffle."""
    return updates.groupBy("vehicle_id").agg(_last("event_id")).select("vehicle_id", "p.*")


def lookup(snapshot: DataFrame, ids: DataFrame, how: str = "inner") -> DataFrame:
    """ids(vehicle_id) with their rows; how="left" keeps missing ids with nulls. Catalyst broadcasts what is small."""
    return ids.select("vehicle_id").distinct().join(snapshot, "vehicle_id", how)


def apply_changes(snapshot: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(seq, op, vehicle_id, x, y, ts_ms), op insert, update or remove, over a snapshot; the last by (ts_ms, seq) counts."""
    old = snapshot.select(F.lit(None).cast("long").alias("seq"), F.lit("insert").alias("op"), "vehicle_id", "x", "y", "ts_ms")
    every = old.withColumn("age", F.lit(0)).unionByName(changes.select("seq", "op", "vehicle_id", "x", "y", "ts_ms").withColumn("age", F.lit(1)))
    last = every.groupBy("vehicle_id").agg(F.max_by(F.struct("op", "x", "y", "ts_ms"), F.struct("age", "ts_ms", "seq")).alias("p"))
    return last.filter("p.op <> 'remove'").select("vehicle_id", "p.x", "p.y", "p.ts_ms")


def snapshot_asof(updates: DataFrame, ts_ms: int) -> DataFrame:
    """U4: latest positions of updates up to ts_ms."""
    return latest_positions(updates.filter(F.col("ts_ms") <= ts_ms))


def snapshots_at_ticks(updates: DataFrame, tick_ms: int, limit: int | None = None) -> DataFrame:
    """vehicle_id, tick, valid_to, x, y, ts_ms: the state at each tick's end in which the vehicle was heard of, valid until the next one."""
    tick = (F.expr(f"ts_ms div {tick_ms}") + 1) * tick_ms
    last = updates.withColumn("tick", tick).groupBy("vehicle_id", "tick").agg(_last("event_id"))
    return with_next(last.select("vehicle_id", "tick", "p.*"), "vehicle_id", ["tick"], "tick", "valid_to", limit=limit).select("vehicle_id", "tick", "valid_to", "x", "y", "ts_ms")


def vehicle_count(snapshot: DataFrame, bounds=BOUNDS) -> DataFrame:
    """U6."""
    return snapshot.filter(in_box("x", "y", *bounds)).agg(F.count("*").alias("n"))


def sample_positions(snapshot: DataFrame, n: int = 10) -> DataFrame:
    """The n smallest ids, and in `more` how many others there are."""
    first = snapshot.orderBy("vehicle_id").limit(n)
    total = snapshot.agg(F.count("*").alias("total"))
    return first.join(F.broadcast(total)).select("vehicle_id", "x", "y", F.greatest(F.col("total") - n, F.lit(0)).alias("more"))
