"""Structured Streaming: latest state, snapshots, zone events and rates."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.expr import in_box
from ..operators.geofence import alert_lines
from ..operators.spatial import BOX, CELL, in_zone_cell, point_cells, zone_cells
from ..operators.summary import update_rate
from ..plans.cut import cut


def latest_position_stream(stream: DataFrame) -> DataFrame:
    """The latest position per vehicle, kept in the state store; use with output mode update."""
    last = F.max_by(F.struct("x", "y", "ts_ms", "event_id"), F.struct("ts_ms", "event_id")).alias("p")
    return stream.groupBy("vehicle_id").agg(last).select("vehicle_id", "p.*")


def _batches(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of what is whole under path/kind."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(f"{path}/{kind}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch_id=") and fs.exists(hadoop(f"{path}/{kind}/{n}/_SUCCESS")))


def _remove(spark: SparkSession, path: str, kind: str, batches: list[int]) -> None:
    for b in batches:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/batch_id={b}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


SNAPSHOT = "vehicle_id long, x double, y double, ts_ms long, event_id long"
#: What a publish consists of: the state after batch `upto` is a base (-1: none) and the changes since.
MANIFEST = "at_ms long, upto long, base long, changes array<bigint>"
LEASE = "version long, until_ms long"


def _now() -> int:
    return int(time.time() * 1000)


def _state(spark: SparkSession, path: str, base: int, changes: list[int]) -> DataFrame:
    parts = [f"{path}/base/batch_id={base}"] if base >= 0 else []
    parts += [f"{path}/changes/batch_id={b}" for b in changes]
    rows = spark.read.schema(SNAPSHOT).parquet(*parts) if parts else spark.createDataFrame([], SNAPSHOT)
    last = F.max_by(F.struct("x", "y", "ts_ms", "event_id"), F.struct("ts_ms", "event_id")).alias("p")
    return rows.groupBy("vehicle_id").agg(last).select("vehicle_id", "p.*")


def _parts(spark: SparkSession, path: str, upto: int) -> tuple[int, list[int]]:
    """The newest whole base up to a batch (-1: none), and the changes after it up to there."""
    base = max((b for b in _batches(spark, path, "base") if b <= upto), default=-1)
    return base, [b for b in _batches(spark, path, "changes") if base < b <= upto]


def versions(spark: SparkSession, path: str) -> list[int]:
    """U4: the publishes that can still be read, by number from 1."""
    return _batches(spark, path, "published")


def _manifest(spark: SparkSession, path: str, version: int, kind: str = "published"):
    return spark.read.schema(MANIFEST).parquet(f"{path}/{kind}/batch_id={version}").first()


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The snapshot published last, or that of publish `version`, and nothing of batches after it or of one that is
    being written. Nothing was published: no rows; a version that isn't kept: ValueError.

    The last snapshots are kept as write_snapshots() says. Who reads one for longer holds a lease().
    """
    found = versions(spark, path)
    if version is None:
        if not found:
            return _state(spark, path, -1, [])
        version = found[-1]
    if version not in found:
        raise ValueError(f"publish {version} isn't kept; there are {found}")
    m = _manifest(spark, path, version)
    return _state(spark, path, m["base"], list(m["changes"]))


@contextmanager
def lease(spark: SparkSession, path: str, version: int, seconds: float = 3600.0) -> Iterator[DataFrame]:
    """U4: the snapshot of a publish, whose files aren't removed while the lease is held, nor before `seconds` have passed if its holder dies."""
    number = uuid.uuid4().int >> 66
    spark.createDataFrame([(version, _now() + int(seconds * 1000))], LEASE).coalesce(1).write.parquet(f"{path}/leases/batch_id={number}")
    try:
        # Only now: what is there after the lease was written stays.
        yield read_snapshot(spark, path, version)
    finally:
        _remove(spark, path, "leases", [number])


def _leased(spark: SparkSession, path: str) -> set[int]:
    """Versions under a lease; leases that have run out are removed."""
    out = set()
    for n in _batches(spark, path, "leases"):
        row = spark.read.schema(LEASE).parquet(f"{path}/leases/batch_id={n}").first()
        if row["until_ms"] >= _now():
            out.add(row["version"])
        else:
            _remove(spark, path, "leases", [n])
    return out


def publish(spark: SparkSession, path: str) -> None:
    """Makes all whole batches visible now, as the next version, if there are any since the last one."""
    every, shown = _batches(spark, path, "changes"), versions(spark, path)
    upto = _manifest(spark, path, shown[-1])["upto"] if shown else -1
    if every and every[-1] > upto:
        base, changes = _parts(spark, path, every[-1])
        row = spark.createDataFrame([(_now(), every[-1], base, changes)], MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/published/batch_id={(shown[-1] if shown else 0) + 1}")


def compact(spark: SparkSession, path: str, upto: int, keep_versions: int) -> None:
    """Writes the state after batch `upto` whole as a new base, and removes files that no publish needs any more.

    Publishes before the last keep_versions are retired: they can't be read anew. Their files go with the next
    compaction, when the leases of all who found them before are there to be seen, or once these leases end.
    """
    base, changes = _parts(spark, path, upto)
    if base < upto:
        _state(spark, path, base, changes).write.mode("overwrite").parquet(f"{path}/base/batch_id={upto}")
    shown, leased = versions(spark, path), _leased(spark, path)
    _remove(spark, path, "retired", [v for v in _batches(spark, path, "retired") if v not in leased and v not in shown])
    for v in shown[: max(0, len(shown) - keep_versions)]:
        spark.createDataFrame([_manifest(spark, path, v)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/retired/batch_id={v}")
        _remove(spark, path, "published", [v])
    kept = [_manifest(spark, path, v, kind) for kind in ("published", "retired") for v in _batches(spark, path, kind)]
    needed = {"base": {m["base"] for m in kept}, "changes": {b for m in kept for b in m["changes"]}}
    # The newest base and what came since it belong to publishes to come; changes that wait for one are counted until then.
    newest, upto = max(_batches(spark, path, "base")), max((m["upto"] for m in kept), default=-1)
    _remove(spark, path, "base", [b for b in _batches(spark, path, "base") if b not in needed["base"] and b < newest])
    _remove(spark, path, "changes", [b for b in _batches(spark, path, "changes") if b not in needed["changes"] and b <= min(newest, upto)])


def write_snapshots(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    *,
    publish_max_rows: int = 1,
    publish_interval: float = 0.0,
    compact_every: int = 16,
    keep_versions: int = 1,
):
    """Each batch writes the vehicles that it changed under its own batch id; a batch that is
    run again writes the same again.

    It becomes visible once at least publish_max_rows changed rows wait, or publish_interval seconds
    have passed since the last time (0: only rows count); publish() does it at once, as for the
    rest when the stream is stopped. Every compact_every batches the state is written whole as a new
    base, and what only older publishes than the last keep_versions need is removed, but for those under a lease().
    trigger: {"processingTime": ...} or {"availableNow": True}; rows per batch are bounded at the source.
    """

    def step(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        changed.select("vehicle_id", "x", "y", "ts_ms", "event_id").write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch}")
        shown = versions(spark, path)
        last = _manifest(spark, path, shown[-1]) if shown else None
        waiting = [b for b in _batches(spark, path, "changes") if b > (last["upto"] if last else -1)]
        if waiting:
            rows = spark.read.schema(SNAPSHOT).parquet(*[f"{path}/changes/batch_id={b}" for b in waiting]).count()
            due = publish_interval and last and _now() - last["at_ms"] >= publish_interval * 1000
            if rows >= publish_max_rows or due:
                publish(spark, path)
        if batch % compact_every == compact_every - 1:
            compact(spark, path, batch, keep_versions)

    return latest_position_stream(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(step).start()


EVENTS = "vehicle_id long, zone_id string, event_type string, ts_ms long"


#: Vehicles are dealt to so many groups, whose vehicles share a row of state: a call of Python and its trips to the state store are for a group, not for a vehicle.
GROUPS = 4096
#: The group of updates without a vehicle, which count as one.
UNKNOWN = -1


class ZoneTracker(StatefulProcessor):
    """Per vehicle of a group the zones that it is in, and its newest update; with silent_ms also a timer for when the first of them has said nothing for so long."""

    def __init__(self, silent_ms: int | None):
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "vehicle_id array<bigint>, ts_ms array<bigint>, event_id array<bigint>, zones array<array<string>>, timer bigint")

    def _load(self) -> tuple[dict, int | None]:
        """(ts_ms, event_id, zones) by vehicle, and the timer that is set."""
        if not self.seen.exists():
            return {}, None
        vehicle, at, event, zones, timer = self.seen.get()
        return dict(zip(vehicle, zip(at, event, zones, strict=True), strict=True)), timer

    def _store(self, seen: dict, timer: int | None, fired: int | None = None) -> None:
        """Also sets the timer anew where the first vehicle to fall silent is another one; one that fired goes by itself."""
        due = min(at for at, _, _ in seen.values()) + self.silent_ms if seen and self.silent_ms is not None else None
        if due != timer:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if seen:
            at, event, zones = (list(c) for c in zip(*seen.values(), strict=True))
            self.seen.update((list(seen), at, event, zones, due))
        else:
            self.seen.clear()

    def _events(self, rows):
        vehicle, zone, kind, ts = zip(*rows, strict=True)
        return pd.DataFrame({"vehicle_id": vehicle, "zone_id": zone, "event_type": kind, "ts_ms": ts})

    def handleInputRows(self, key, rows, timerValues):
        """rows: one or more for each update, with a zone that it lies in or none."""
        seen, timer = self._load()
        updates: dict = {}
        for pdf in rows:
            vehicles = [None] * len(pdf) if key[0] == UNKNOWN else pdf["vehicle_id"].tolist()
            for vehicle, ts, e, zone in zip(vehicles, *(pdf[c].tolist() for c in ("ts_ms", "event_id", "zone_id")), strict=True):
                if (before := seen.get(vehicle)) is None or (ts, e) >= before[:2]:
                    held = updates.setdefault(vehicle, {}).setdefault((ts, e), set())
                    if isinstance(zone, str):
                        held.add(zone)
        out = []
        for vehicle, own in updates.items():
            at, event, zones = seen.get(vehicle, (None, None, ()))
            inside = set(zones)
            for (ts, e), now in sorted(own.items(), key=lambda u: u[0]):
                if self.silent_ms is not None and at is not None and ts > at + self.silent_ms:
                    out += [(vehicle, z, "EXIT", at + self.silent_ms) for z in sorted(inside)]
                    inside = set()
                if inside != now:
                    out += [(vehicle, z, "EXIT", ts) for z in sorted(inside - now)] + [(vehicle, z, "ENTER", ts) for z in sorted(now - inside)]
                at, event, inside = ts, e, now
            seen[vehicle] = (at, event, sorted(inside))
        if updates:
            self._store(seen, timer)
        if out:
            yield self._events(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Vehicles that are silent by now leave their zones and are forgotten."""
        seen, timer = self._load()
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        silent = lambda at: at + self.silent_ms <= fired or at + self.silent_ms < now
        out = [(v, z, "EXIT", at + self.silent_ms) for v, (at, _, zones) in seen.items() if silent(at) for z in zones]
        self._store({v: s for v, s in seen.items() if not silent(s[0])}, timer, fired)
        if out:
            yield self._events(out)

    def close(self) -> None:
        pass


def zone_event_stream(stream: DataFrame, zones: DataFrame, *, cell: float = 50.0, silent_ms: int | None = None, wait: str = "10 minutes") -> DataFrame:
    """vehicle_id, zone_id, event_type, ts_ms of the transitions of each vehicle's zones, which are its state.

    zones(zone_id, polygon, min_x to max_y) is a table, which each batch is joined with by cells as in zone_join();
    after a restart it may be another one. Of a vehicle's updates those count that aren't older than its newest in the
    batches before. With silent_ms a vehicle that says nothing for so long leaves its zones then and is forgotten, as
    soon as the watermark says so, `wait` behind the newest update; updates behind the watermark are left out.
    Needs the RocksDB state store, which is set in the session.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cells = cut(zone_cells(zones.select("zone_id", "polygon", *BOX), cell))
    levels = sorted(r["level"] for r in cells.select(f"{CELL}.level").distinct().collect()) or [0]
    rows = stream.select("vehicle_id", "ts_ms", "event_id", "x", "y")
    if silent_ms is not None:
        rows = rows.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", wait)
    # The place of an update in no grid at all stands for the update itself.
    rows = rows.withColumn(CELL, F.explode(F.concat(F.array(F.lit(None).cast("struct<level:int,cx:bigint,cy:bigint>")), point_cells(levels, cell))))
    held = rows.join(cells, CELL, "left").withColumn("zone_id", F.when(in_box("x", "y", *BOX) & in_zone_cell(), F.col("zone_id")))
    held = held.filter(F.col(CELL).isNull() | F.col("zone_id").isNotNull()).select("vehicle_id", "ts_ms", "event_id", "zone_id", *(["at"] if silent_ms is not None else []))
    mode = "none" if silent_ms is None else "eventTime"
    held = held.withColumn("group", F.when(F.col("vehicle_id").isNull(), UNKNOWN).otherwise(F.pmod(F.xxhash64("vehicle_id"), F.lit(GROUPS))))
    return held.groupBy("group").transformWithStateInPandas(ZoneTracker(silent_ms), EVENTS, "Append", mode)


def update_rate_stream(stream: DataFrame, width: str = "1 second", n: int = 2, late: str = "10 minutes") -> DataFrame:
    """T5: A4 on a stream, with a watermark."""
    return update_rate(stream.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late), width, n)


def write_alert_stream(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Alert lines as text files."""
    return alert_lines(events).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
