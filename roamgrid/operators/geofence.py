"""Zone membership and ENTER/EXIT events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import with_next
from .spatial import with_boxes, zone_join
from .state import snapshots_at_ticks


def zone_membership(snapshot: DataFrame, zones: DataFrame) -> DataFrame:
    """G1: (zone_id, vehicle_id) of vehicles inside."""
    return zone_join(snapshot.select("vehicle_id", "x", "y"), zones).select("zone_id", "vehicle_id")


def zone_occupancy(snapshot: DataFrame, zones: DataFrame) -> DataFrame:
    """G1: vehicles per zone; zones without any stay with 0."""
    n = zone_membership(snapshot, zones).groupBy("zone_id").agg(F.count("*").alias("n"))
    return zones.select("zone_id").join(n, "zone_id", "left").select("zone_id", F.coalesce("n", F.lit(0)).alias("n"))


def zone_events_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """ENTER for members (zone_id, vehicle_id) of cur alone, EXIT for those of prev alone."""
    key = ["zone_id", "vehicle_id"]
    enter = cur.select(*key).join(prev, key, "left_anti").withColumn("event_type", F.lit("ENTER"))
    return enter.unionByName(prev.select(*key).join(cur, key, "left_anti").withColumn("event_type", F.lit("EXIT")))


def zone_transitions(updates: DataFrame, zones: DataFrame, limit: int | None = None) -> DataFrame:
    """vehicle_id, zone_id, event_type, ts_ms at every update: updates(event_id, vehicle_id, ts_ms, x, y).

    Only updates inside a zone are joined. Each of them says that its vehicle is in the zone at its number, and was at
    the next one; where only one of both is said, there is an event. Rows meet by vehicle, zone and number, so
    that a vehicle with many updates is in many tasks; with_next() numbers those of such a vehicle by slices of time.
    """
    seq = with_next(updates.select("vehicle_id", "x", "y", "ts_ms", "event_id"), "vehicle_id", ["ts_ms", "event_id"], "ts_ms", "next_ts", "seq", limit)
    inside = zone_join(seq.drop("event_id"), zones)
    says = F.explode(F.array(F.struct("seq", "ts_ms", F.lit(True).alias("now")), F.struct((F.col("seq") + 1).alias("seq"), F.col("next_ts").alias("ts_ms"), F.lit(False).alias("now"))))
    said = inside.select("vehicle_id", "zone_id", says.alias("s")).select("vehicle_id", "zone_id", "s.*").filter("ts_ms is not null")
    turns = said.groupBy("vehicle_id", "zone_id", "seq").agg(F.max("ts_ms").alias("ts_ms"), F.bool_or("now").alias("now"), F.bool_or(~F.col("now")).alias("was")).filter("now <> was")
    return turns.select("vehicle_id", "zone_id", F.when(F.col("now"), "ENTER").otherwise("EXIT").alias("event_type"), "ts_ms")


def zone_events_ticks(updates: DataFrame, zones: DataFrame, tick_ms: int) -> DataFrame:
    """As G3, but seen at the ends of ticks only; ts_ms is the tick's end."""
    sampled = snapshots_at_ticks(updates, tick_ms).select("vehicle_id", "x", "y", F.col("tick").alias("ts_ms"), F.col("tick").alias("event_id"))
    return zone_transitions(sampled, with_boxes(zones))


def alert_lines(events: DataFrame) -> DataFrame:
    """The text of each event."""
    return events.select(F.format_string("ALERT: Vehicle %d %s zone %s", "vehicle_id", "event_type", "zone_id").alias("line"))
