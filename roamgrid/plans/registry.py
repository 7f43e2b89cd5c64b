"""Registered queries and their SQL for DuckDB, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..operators import geofence, graph, spatial, state, summary
from ..sources import clustered, frames, tables
from ..streaming import streams
from . import fixtures as fx
from .cut import cut, new_dir

QUERIES: dict = {}
ORACLES: dict = {}
#: Corners of a box in order, for SQL.
_CORNERS = "(0, min_x, min_y), (1, max_x, min_y), (2, max_x, max_y), (3, min_x, max_y)"
CENTER = (400.0, 400.0, 600.0, 600.0)


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL after the common expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fx.CTE + sql
        return f

    return add


def latest(s, d):
    return state.latest_positions(fx.positions(s, d))


def grid(s):
    return tables.road_grid(s, 20, 20, 50.0)


@query("SELECT event_id, vehicle_id, ts_ms, x, y FROM p")
def validate_updates(s, d):
    return fx.positions(s, d)


@query("SELECT event_id, vehicle_id, CASE WHEN isnan(x) THEN 'nan_or_inf' ELSE 'out_of_bounds' END AS reason FROM pr WHERE event_id NOT IN (SELECT event_id FROM p)")
def rejected_updates(s, d):
    return expr.rejected_updates(fx.positions_raw(s, d)).select("event_id", "vehicle_id", "reason")


@query("SELECT * FROM latest")
def latest_positions(s, d):
    return latest(s, d)


@query("SELECT i.id AS vehicle_id, x, y, ts_ms FROM (SELECT DISTINCT s_suppkey::BIGINT AS id FROM supplier) i LEFT JOIN latest ON vehicle_id = i.id")
def position_lookup(s, d):
    ids = fx.point_queries(s, d).select(F.col("query_id").alias("vehicle_id"))
    return state.lookup(latest(s, d), ids, "left")


@query(f"""
, s0 AS (SELECT vehicle_id, x, y, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts_ms DESC, event_id DESC) AS rn FROM p WHERE ts_ms <= {fx.AS_OF}) WHERE rn = 1),
c AS (SELECT 0 AS age, NULL::BIGINT AS seq, 'insert' AS op, * FROM s0 UNION ALL SELECT 1, event_id, CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'insert' ELSE 'update' END, vehicle_id, x, y, ts_ms FROM p WHERE ts_ms > {fx.AS_OF})
SELECT vehicle_id, x, y, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY age DESC, ts_ms DESC, seq DESC) AS rn FROM c) WHERE rn = 1 AND op <> 'remove'""")
def apply_changes(s, d):
    return state.apply_changes(state.snapshot_asof(fx.positions(s, d), fx.AS_OF), fx.changes(s, d).filter(F.col("ts_ms") > fx.AS_OF))


@query(f"SELECT vehicle_id, x, y, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts_ms DESC, event_id DESC) AS rn FROM p WHERE ts_ms <= {fx.AS_OF}) WHERE rn = 1")
def snapshot_asof(s, d):
    return state.snapshot_asof(fx.positions(s, d), fx.AS_OF)


_TICKS = f"t AS (SELECT *, (ts_ms // {fx.TICK} + 1) * {fx.TICK} AS tick FROM p), tk AS (SELECT vehicle_id, tick, x, y, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, tick ORDER BY ts_ms DESC, event_id DESC) AS rn FROM t) WHERE rn = 1)"


@query(f", {_TICKS} SELECT vehicle_id, tick, lead(tick) OVER (PARTITION BY vehicle_id ORDER BY tick) AS valid_to, x, y, ts_ms FROM tk")
def snapshots_at_ticks(s, d):
    return state.snapshots_at_ticks(fx.positions(s, d), fx.TICK)


@query("SELECT * FROM latest WHERE x BETWEEN 400 AND 600 AND y BETWEEN 400 AND 600")
def range_query(s, d):
    return spatial.range_query(latest(s, d), CENTER)


@query("SELECT box_id, event_id FROM p JOIN boxes ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y")
def range_join(s, d):
    return spatial.range_join(fx.positions(s, d), fx.boxes(s, d)).select("box_id", "event_id")


@query("SELECT box_id, event_id FROM p JOIN boxes ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y")
def range_join_dense(s, d):
    """By cells that split where points are dense."""
    return spatial.dense_range_join(fx.positions(s, d), fx.boxes(s, d), 64).select("box_id", "event_id")


@query("SELECT event_id, vehicle_id, ts_ms, x, y FROM p WHERE x BETWEEN 400 AND 600 AND y BETWEEN 400 AND 600")
def range_query_clustered(s, d):
    """From files sorted by place."""
    path = new_dir(s, "clustered")
    clustered.write_clustered(fx.positions(s, d).select("event_id", "vehicle_id", "ts_ms", "x", "y"), path)
    return clustered.read_box(s, path, CENTER)


@query("SELECT DISTINCT vehicle_id FROM latest WHERE least(49, trunc(x / 20)) BETWEEN 20 AND 30 AND least(49, trunc(y / 20)) BETWEEN 20 AND 30")
def range_query_coarse(s, d):
    return spatial.range_query_coarse(latest(s, d), CENTER)


@query("SELECT a.vehicle_id, b.vehicle_id AS neighbour_id FROM latest a JOIN latest b ON b.x BETWEEN a.x - 10 AND a.x + 10 AND b.y BETWEEN a.y - 10 AND a.y + 10")
def neighbours(s, d):
    return spatial.neighbours(latest(s, d), 10.0)


_D2 = "(x - qx) * (x - qx) + (y - qy) * (y - qy)"


@query("SELECT vehicle_id, x, y, sqrt((x - 500) * (x - 500) + (y - 500) * (y - 500)) AS distance FROM latest ORDER BY (x - 500) * (x - 500) + (y - 500) * (y - 500), vehicle_id LIMIT 1")
def nearest(s, d):
    return spatial.nearest(latest(s, d), 500.0, 500.0)


@query(f"SELECT query_id, vehicle_id, x, y, sqrt(d2) AS distance FROM (SELECT *, {_D2} AS d2, row_number() OVER (PARTITION BY query_id ORDER BY {_D2}, vehicle_id) AS rn FROM pq, latest) WHERE rn = 1")
def nearest_join(s, d):
    return spatial.nearest_join(fx.point_queries(s, d), latest(s, d))


@query(f"SELECT query_id, vehicle_id, x, y, sqrt(d2) AS distance FROM (SELECT *, {_D2} AS d2, row_number() OVER (PARTITION BY query_id ORDER BY {_D2}, vehicle_id) AS rn FROM pq, latest) WHERE rn = 1 AND sqrt(d2) < 50")
def pick_vehicle(s, d):
    return spatial.pick(fx.point_queries(s, d), latest(s, d), 50.0)


@query(f"SELECT vehicle_id AS query_id, node_id, x, y, sqrt(d2) AS distance FROM (SELECT l.vehicle_id, gn.*, {_D2} AS d2, row_number() OVER (PARTITION BY vehicle_id ORDER BY {_D2}, node_id) AS rn FROM (SELECT vehicle_id, x AS qx, y AS qy FROM latest) l, gn) WHERE rn = 1")
def snap_to_node(s, d):
    return spatial.snap_to_node(latest(s, d).select(F.col("vehicle_id").alias("query_id"), "x", "y"), grid(s)[0])


@query(f"SELECT event_id, zone_id FROM {fx.inside('p')}")
def zone_join(s, d):
    return spatial.zone_join(fx.positions(s, d), fx.zones(s)).select("event_id", "zone_id")


@query(f"SELECT zone_id, count(vehicle_id) AS n FROM z LEFT JOIN {fx.inside('latest')} i USING (zone_id) GROUP BY zone_id")
def zone_occupancy(s, d):
    return geofence.zone_occupancy(latest(s, d), fx.zones(s))


@query(f"""
, s0 AS (SELECT vehicle_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts_ms DESC, event_id DESC) AS rn FROM p WHERE ts_ms <= {fx.AS_OF}) WHERE rn = 1),
a AS (SELECT zone_id, vehicle_id FROM {fx.inside('s0')}), b AS (SELECT zone_id, vehicle_id FROM {fx.inside('latest')})
SELECT *, 'ENTER' AS event_type FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'EXIT' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def zone_events_diff(s, d):
    member = lambda df: geofence.zone_membership(df, fx.zones(s))
    return geofence.zone_events_diff(member(state.snapshot_asof(fx.positions(s, d), fx.AS_OF)), member(latest(s, d)))


def _transitions(points: str, order: str) -> str:
    return f"""n AS (SELECT *, row_number() OVER () AS id FROM {points}),
i AS (SELECT id, zone_id FROM {fx.inside('n')}),
f AS (SELECT n.*, z.zone_id, i.id IS NOT NULL AS now FROM n CROSS JOIN z LEFT JOIN i ON i.id = n.id AND i.zone_id = z.zone_id),
g AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY vehicle_id, zone_id ORDER BY {order}), false) AS was FROM f)
SELECT vehicle_id, zone_id, CASE WHEN now THEN 'ENTER' ELSE 'EXIT' END AS event_type, ts_ms FROM g WHERE now <> was"""


@query(", " + _transitions("p", "ts_ms, event_id"))
def zone_transitions(s, d):
    return geofence.zone_transitions(fx.positions(s, d), fx.zones(s))


@query(f", {_TICKS}, ticks AS (SELECT vehicle_id, x, y, tick AS ts_ms FROM tk), " + _transitions("ticks", "ts_ms"))
def zone_events_ticks(s, d):
    return geofence.zone_events_ticks(fx.positions(s, d), fx.zones(s), fx.TICK)


@query(", g0 AS (" + "SELECT * FROM (WITH " + _transitions("p", "ts_ms, event_id") + ")) SELECT 'ALERT: Vehicle ' || vehicle_id || ' ' || event_type || ' zone ' || zone_id AS line FROM g0")
def alert_lines(s, d):
    return geofence.alert_lines(zone_transitions(s, d))


@query("SELECT box_id, zone_id FROM boxes b JOIN z ON NOT (b.max_x < z.min_x OR z.max_x < b.min_x OR b.max_y < z.min_y OR z.max_y < b.min_y)")
def bbox_join(s, d):
    return spatial.bbox_join(fx.boxes(s, d), fx.zones(s)).select("box_id", "zone_id")


@query("SELECT vp_id, vehicle_id, sx, sy FROM (SELECT vp_id, w, h, vehicle_id, trunc((x - min_x) * scale)::INT AS sx, trunc((y - min_y) * scale)::INT AS sy FROM latest JOIN vp ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y) WHERE sx >= 0 AND sx < w AND sy >= 0 AND sy < h")
def viewport_points(s, d):
    return spatial.viewport_points(latest(s, d), fx.viewports(s))


# A viewport of its own size and scale around each query point, and zones of the boxes beside the fixed ones.
_VERTICES = f"SELECT zone_id, seq, vx, vy, min_x, min_y, max_x, max_y FROM z JOIN (VALUES {fx._values([(z, i, *map(float, v)) for z, p, _ in fx.ZONES for i, v in enumerate(p)])}) v(zone_id, seq, vx, vy) USING (zone_id) UNION ALL SELECT 'box ' || box_id, seq, t.x, t.y, min_x, min_y, max_x, max_y FROM boxes, LATERAL (VALUES {_CORNERS}) t(seq, x, y)"


@query(f"""
, v0 AS (SELECT query_id AS vp_id, (100 + query_id % 7 * 50)::DOUBLE AS w, (100 + query_id % 5 * 50)::DOUBLE AS h, qx, qy, (1 + query_id % 3)::DOUBLE / 2 AS scale FROM pq),
v1 AS (SELECT *, qx - w / 2 / scale AS ax, qy - h / 2 / scale AS ay, qx + w / 2 / scale AS ox, qy + h / 2 / scale AS oy FROM v0), vz AS ({_VERTICES})
SELECT vp_id, zone_id, seq, trunc((vx - ax) * scale)::INT AS sx, trunc((vy - ay) * scale)::INT AS sy FROM v1 JOIN vz ON NOT (ox < min_x OR max_x < ax OR oy < min_y OR max_y < ay)""")
def viewport_zones(s, d):
    zones = fx.zones(s).unionByName(tables.box_zones(fx.boxes(s, d), F.concat(F.lit("box "), "box_id")))
    q = F.col("query_id")
    vps = fx.point_queries(s, d).select(q.alias("vp_id"), (100 + q % 7 * 50).cast("double").alias("w"), (100 + q % 5 * 50).cast("double").alias("h"), F.col("x").alias("cx"), F.col("y").alias("cy"), ((1 + q % 3) / 2).alias("scale"))
    return spatial.viewport_zones(zones, vps)


@query("SELECT count(*) AS n FROM latest WHERE x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000")
def vehicle_count(s, d):
    return state.vehicle_count(latest(s, d))


@query("SELECT vehicle_id, x, y, greatest((SELECT count(*) FROM latest) - 10, 0) AS more FROM latest ORDER BY vehicle_id LIMIT 10")
def sample_positions(s, d):
    return state.sample_positions(latest(s, d))


@query("SELECT abs(vehicle_id) % 2 AS shard, count(*) AS n FROM latest GROUP BY ALL UNION ALL SELECT NULL, count(*) FROM latest")
def shard_counts(s, d):
    return summary.shard_counts(latest(s, d), 2)


_RATE = "SELECT ts_ms // 60000 * 60000 AS window_ms, abs(vehicle_id) % 2 AS shard, count(*) AS n FROM p GROUP BY ALL"


@query(_RATE)
def update_rate(s, d):
    return summary.update_rate(fx.positions(s, d), "1 minute")


_LAT = ", l AS (SELECT event_type AS grp, round(value * 1000000)::BIGINT AS ns, epoch_us(ts) // 1000 AS ts_ms FROM events)"


@query(f"{_LAT} SELECT grp, quantile_disc(ns, 0.5) / 1e6 AS p50, quantile_disc(ns, 0.95) / 1e6 AS p95, quantile_disc(ns, 0.99) / 1e6 AS p99, sum(ns)::BIGINT / count(ns) / 1e6 AS mean, count(ns) AS n FROM l GROUP BY grp")
def latency_summary(s, d):
    return summary.latency_summary(fx.latencies(s, d))


@query(f"{_LAT} SELECT grp, p, true AS near, sum(ns)::BIGINT / count(ns) / 1e6 AS mean, count(ns) AS n FROM l, (VALUES (50), (95), (99)) q(p) GROUP BY grp, p")
def latency_from_sketches(s, d):
    """A sketch for each group, shard and hour, merged; whether each quantile's rank is as near as it should be, by counting."""
    f = fx.latencies(s, d)
    path = new_dir(s, "sketches")
    summary.latency_sketches(f.withColumn("shard", F.col("ns") % 4), shard="shard", width_ms=3_600_000).write.parquet(path)
    merged = summary.summary_of_sketches(s.read.parquet(path))
    each = merged.select("grp", "mean", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{p}").alias("v")) for p in (50, 95, 99)])).alias("q")).select("grp", "mean", "n", "q.*")
    ranks = f.join(F.broadcast(each), "grp").groupBy("grp", "p", "mean", "n").agg(F.count_if(F.col("ns") / 1e6 < F.col("v")).alias("less"), F.count_if(F.col("ns") / 1e6 <= F.col("v")).alias("upto"))
    off = F.greatest(F.col("less") / F.col("n") - F.col("p") / 100, F.col("p") / 100 - F.col("upto") / F.col("n"))
    return ranks.select("grp", "p", (off <= summary.SKETCH_ERROR).alias("near"), "mean", "n")


@query(f"{_LAT} SELECT grp, count(*) / nullif((max(ts_ms) - min(ts_ms)) / 1000, 0) AS throughput FROM l GROUP BY grp")
def throughput(s, d):
    return summary.throughput(fx.latencies(s, d))


@query(f"{_LAT}, c AS (SELECT grp, count(*) AS n FROM l GROUP BY grp) SELECT grp, n, repeat('=', (n * 40 // (SELECT max(n) FROM c))::INT) AS bar FROM c")
def relative_bar(s, d):
    return expr.relative_bar(fx.latencies(s, d).groupBy("grp").agg(F.count("*").alias("n")), "n")


@query("""
, q AS MATERIALIZED (SELECT d, least(floor(x / (1000 / 2.0 ** d)), 2 ** d - 1)::BIGINT AS cx, least(floor(y / (1000 / 2.0 ** d)), 2 ** d - 1)::BIGINT AS cy FROM p, range(21) t(d)),
c AS MATERIALIZED (SELECT d, cx, cy, count(*) AS n FROM q GROUP BY ALL),
k AS MATERIALIZED (SELECT d + 1 AS d, 2 * cx + i AS cx, 2 * cy + j AS cy FROM c, range(2) a(i), range(2) b(j) WHERE n > 32 AND d < 20 UNION ALL VALUES (0, 0, 0))
SELECT k.d::INT AS depth, k.cx * (1000 / 2.0 ** k.d) AS min_x, k.cy * (1000 / 2.0 ** k.d) AS min_y, (k.cx + 1) * (1000 / 2.0 ** k.d) AS max_x, (k.cy + 1) * (1000 / 2.0 ** k.d) AS max_y, coalesce(n, 0) AS n
FROM k LEFT JOIN c ON c.d = k.d AND c.cx = k.cx AND c.cy = k.cy WHERE coalesce(n, 0) <= 32 OR k.d = 20""")
def quadtree_leaves(s, d):
    return spatial.quadtree_leaves(fx.positions(s, d))


@query("SELECT vehicle_id, node_id FROM latest JOIN gn ON node_id = trunc(latest.x / 50.0001)::BIGINT + 20 * trunc(latest.y / 50.0001)::BIGINT")
def road_grid_nodes(s, d):
    """Vehicles by the grid cell that they are in, named by its node."""
    n = F.floor(F.col("x") / 50.0001).cast("long") + 20 * F.floor(F.col("y") / 50.0001).cast("long")
    return latest(s, d).withColumn("node_id", n).join(grid(s)[0].select("node_id"), "node_id").select("vehicle_id", "node_id")


_AT = "a AS (SELECT DISTINCT trunc(x / 50.0001)::BIGINT + 20 * trunc(y / 50.0001)::BIGINT AS src FROM latest)"


@query(f", {_AT} SELECT src, dst, 50.0::DOUBLE AS weight FROM ge WHERE src IN (SELECT src FROM a)")
def out_edges(s, d):
    return graph.out_edges(grid(s)[1], road_grid_nodes(s, d))


@query(f", {_AT} SELECT src, count(*) AS degree, count(*) * 50.0::DOUBLE AS weight FROM ge JOIN a USING (src) GROUP BY src")
def road_grid_edges(s, d):
    return out_edges(s, d).groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


_COST = "CASE WHEN dst < 400 THEN 50.0::DOUBLE * (abs(src % 20 - dst % 20) + abs(src // 20 - dst // 20)) ELSE 0 END"


@query(f"SELECT request_id, {_COST} AS total_cost, src = dst OR dst < 400 AS found FROM rq")
def shortest_path_cost(s, d):
    """Over an overlay of cells of at most 100 nodes."""
    return graph.shortest_path_cost(fx.requests(s, d), *grid(s), capacity=100)


@query("""
, nd AS (SELECT i AS node_id, (i * 37 % 1001)::DOUBLE AS x, (i * 91 % 1001)::DOUBLE AS y FROM range(300) t(i)),
li AS (SELECT l_partkey % 300 AS src, l_orderkey % 300 AS dst, l_quantity FROM lineitem),
ie AS (SELECT src, dst, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + l_quantity) AS w FROM li JOIN nd a ON a.node_id = src JOIN nd b ON b.node_id = dst WHERE src <> dst GROUP BY src, dst),
r3 AS (SELECT o_orderkey::BIGINT AS request_id, (o_orderkey * 7 % 300)::BIGINT AS src, (o_custkey % 300)::BIGINT AS dst FROM orders UNION ALL VALUES (-1, 5, 5), (-2, 5, 9999)),
b AS (SELECT DISTINCT src AS source, src AS node, 0.0::DOUBLE AS dist, 0 AS hop FROM r3 UNION ALL
      SELECT source, node, min(dist), hop FROM (SELECT b.source, ie.dst AS node, b.dist + ie.w AS dist, b.hop + 1 AS hop FROM b JOIN ie ON ie.src = b.node WHERE b.hop < 14) GROUP BY source, node, hop),
m AS (SELECT source, node, min(dist) AS dist FROM b GROUP BY source, node)
SELECT request_id, round(CASE WHEN src = dst THEN 0 ELSE coalesce(dist, 0) END, 6) AS total_cost, src = dst OR dist IS NOT NULL AS found FROM r3 LEFT JOIN m ON m.source = src AND m.node = dst""")
def shortest_path_irregular(s, d):
    cost = graph.shortest_path_cost(fx.requests(s, d, 300), *fx.irregular_graph(s, d))
    return cost.withColumn("total_cost", F.round("total_cost", 6))


# Walking back from dst with the smallest predecessor: rows first if dst lies in a later row, else columns first.
_PATH = """
, r0 AS (SELECT request_id, src, dst, src % 20 AS sc, src // 20 AS sr, dst % 20 AS dc, dst // 20 AS dr FROM rq WHERE dst < 400),
st AS (SELECT *, abs(sc - dc) + abs(sr - dr) AS len, unnest(range(abs(sc - dc) + abs(sr - dr) + 1)) AS k FROM r0),
bk AS (SELECT *, CASE WHEN dr > sr THEN least(k, abs(sr - dr)) ELSE greatest(k - abs(sc - dc), 0) END AS kr FROM st),
pn AS (SELECT request_id, (len - k)::INT AS seq, (dr + CASE WHEN sr > dr THEN kr WHEN sr < dr THEN -kr ELSE 0 END) * 20 + dc + CASE WHEN sc > dc THEN k - kr WHEN sc < dc THEN kr - k ELSE 0 END AS node_id FROM bk)
"""


@query(f"{_PATH} SELECT * FROM pn")
def shortest_path_nodes(s, d):
    return graph.shortest_path_nodes(fx.requests(s, d), *grid(s))


@query(f"{_PATH}, nx AS (SELECT *, lead(node_id) OVER (PARTITION BY request_id ORDER BY seq) AS nxt FROM pn) SELECT request_id, seq, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM nx JOIN gn a ON a.node_id = nx.node_id JOIN gn b ON b.node_id = nxt")
def route_segments(s, d):
    return graph.route_segments(shortest_path_nodes(s, d), grid(s)[0])


def _snap(name: str, points: str) -> str:
    return f"{name} AS (SELECT query_id, node_id FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY {_D2}, node_id) AS rn FROM ({points}) q, gn) WHERE rn = 1)"


_FROM, _TO = "SELECT query_id, qx, qy FROM pq", "SELECT query_id, 1000 - qx AS qx, qy / 2 AS qy FROM pq"


@query(f", {_snap('a', _FROM)}, {_snap('b', _TO)} SELECT query_id AS request_id, a.node_id AS src, b.node_id AS dst, 50.0::DOUBLE * (abs(a.node_id % 20 - b.node_id % 20) + abs(a.node_id // 20 - b.node_id // 20)) AS total_cost, true AS found FROM a JOIN b USING (query_id)")
def route(s, d):
    q = fx.point_queries(s, d)
    return graph.route(q.select(F.col("query_id").alias("request_id"), "x", "y", (1000 - F.col("x")).alias("dest_x"), (F.col("y") / 2).alias("dest_y")), *grid(s))


@query("SELECT vehicle_id, x, y, ts_ms FROM p")
def frames_roundtrip(s, d):
    return frames.decode_frames(frames.encode_frames(fx.positions(s, d)))


@query("SELECT vehicle_id, x, y, ts_ms FROM p")
def frame_files(s, d):
    """Files of frames, with a part of a frame at the end of each, read in ranges."""
    path = new_dir(s, "frames")
    frames.write_frame_files(fx.positions(s, d), path)
    frames.append_bytes(path, b"partial frame")
    return frames.read_frame_files(s, path, part=1 << 16)


@query("SELECT vehicle_id, x, y, ts_ms FROM p")
def stream_frame_files(s, d):
    """The same by a stream: half of the updates, a part of a frame, its rest and the other half later."""
    path, out, state = new_dir(s, "frames"), new_dir(s, "stream-out"), new_dir(s, "stream-state")
    p = fx.positions(s, d)
    one = frames.encode_frames(s.createDataFrame([(-1, 0.5, 0.5, 7)], frames.UPDATES)).first()["content"]
    grown = None
    for half, tail in ((0, one[:13]), (1, one[13:])):
        frames.write_frame_files(p.filter(F.col("event_id") % 2 == half), path)
        grown = frames.append_bytes(path, tail, grown)
        _run(frames.read_frame_stream(s, path, 1 << 16).writeStream.format("parquet").option("path", out).outputMode("append"), state)
    return s.read.schema(frames.UPDATES).parquet(out).filter("vehicle_id >= 0")


#: Batches of the streams, of one file for each ROWS updates; the stream is stopped and started again after the first few.
FILES, FIRST, ROWS = 6, 3, 1_000_000


def _key(c="event_id"):
    """Which batch an update lies in: by time, but every 50th comes one batch later than its time."""
    return F.least(F.col("age") + F.when(F.col(c) % 50 == 7, 1).otherwise(0), F.lit(FILES - 1))


_AGE = f"least((ts_ms - lo) * {FILES} // (hi - lo + 1), {FILES - 1})"
#: SQL for positions with the number of their file.
_FILED = f"lim AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM pr), fp AS (SELECT p.*, least({_AGE} + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END, {FILES - 1}) AS part FROM p, lim)"


def _stream(s, d, start, late=True):
    """All raw updates through start(stream of valid positions), a writer that ends when all files are read.

    Batches arrive one by one and are read one by one; after FIRST of them the stream ends and goes on
    from its checkpoint when all are there. Some updates come a batch later than their time if `late`.
    """
    path, state = new_dir(s, "stream-in"), new_dir(s, "stream-state")
    raw = fx.positions_raw(s, d)
    span = raw.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")).first()
    if span["lo"] is None:
        span = {"lo": 0, "hi": 0}
    files = max(1, raw.count() // (FILES * ROWS))  # of each batch
    dealt = cut(raw.withColumn("age", F.least(F.expr(f"(ts_ms - {span['lo']}) * {FILES} div {span['hi'] - span['lo'] + 1}"), F.lit(FILES - 1))).withColumn("part", _key() if late else F.col("age")))
    for k in range(FILES):
        rows = dealt.filter(F.col("part") == k).select("event_id", "vehicle_id", "ts_ms", "x", "y")
        rows.repartition(files).write.mode("append").parquet(path)
        if k in (FIRST - 1, FILES - 1):
            start(expr.validate_updates(tables.read_position_stream(s, path, files)), state)


def _run(writer, state):
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@query("SELECT * FROM latest")
def stream_latest(s, d):
    path = new_dir(s, "snapshots")
    _stream(s, d, lambda stream, state: streams.write_snapshots(stream, path, state, {"availableNow": True}, publish_max_rows=50, compact_every=4).awaitTermination())
    streams.publish(s, path)
    return streams.read_snapshot(s, path).select("vehicle_id", "x", "y", "ts_ms")


@query(f""", {_FILED}, k AS (SELECT unnest(range(1, {FILES} + 1)) AS version)
SELECT version, vehicle_id, x, y, ts_ms FROM (SELECT version, vehicle_id, x, y, ts_ms, row_number() OVER (PARTITION BY version, vehicle_id ORDER BY ts_ms DESC, event_id DESC) AS rn FROM k JOIN fp ON part < version) WHERE rn = 1""")
def snapshot_versions(s, d):
    """What each publish of a stream showed; the first is read under a lease, which two compactions leave alone."""
    path = new_dir(s, "snapshots")
    start = lambda stream, state: streams.write_snapshots(stream, path, state, {"availableNow": True}, compact_every=2, keep_versions=FILES).awaitTermination()
    _stream(s, d, start)
    with streams.lease(s, path, 1) as first:
        streams.compact(s, path, FILES - 1, FILES - 1)
        streams.compact(s, path, FILES - 1, FILES - 1)
        first = cut(first)
    every = first.withColumn("version", F.lit(1))
    for v in streams.versions(s, path):
        every = every.unionByName(streams.read_snapshot(s, path, v).withColumn("version", F.lit(v)))
    return every.select(F.col("version").cast("long"), "vehicle_id", "x", "y", "ts_ms")


def _zone_events(s, d, write, late=True, **options):
    _stream(s, d, lambda stream, state: write(streams.zone_event_stream(stream, fx.zones(s), **options), state), late)


# Of a vehicle's updates those count that aren't older than the newest of the files before.
_ON_TIME = f", {_FILED}, nw AS (SELECT vehicle_id, part, max(ts_ms::HUGEINT * 10000000000 + event_id) AS newest FROM fp GROUP BY ALL), bf AS (SELECT vehicle_id, part, max(newest) OVER (PARTITION BY vehicle_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM nw), ot AS (SELECT fp.* FROM fp JOIN bf USING (vehicle_id, part) WHERE before IS NULL OR ts_ms::HUGEINT * 10000000000 + event_id >= before), "


@query(_ON_TIME + _transitions("ot", "ts_ms, event_id"))
def stream_zone_events(s, d):
    path = new_dir(s, "stream-out")
    _zone_events(s, d, lambda events, state: _run(events.writeStream.format("parquet").option("path", path).outputMode("append"), state))
    return s.read.schema(streams.EVENTS).parquet(path)


#: A vehicle that is silent for a day leaves its zones then; at the end, if the watermark, six hours behind the newest update, says so.
SILENT, LATE_HOURS = 24 * 3600 * 1000, 6


@query(f""", n AS (SELECT *, row_number() OVER () AS id FROM p), i AS (SELECT id, zone_id FROM {fx.inside('n')}),
f AS (SELECT n.*, z.zone_id, i.id IS NOT NULL AS now FROM n CROSS JOIN z LEFT JOIN i ON i.id = n.id AND i.zone_id = z.zone_id),
g AS (SELECT *, lag(ts_ms) OVER w AS before, lead(ts_ms) OVER w AS after, coalesce(lag(now) OVER w, false) AS prev FROM f WINDOW w AS (PARTITION BY vehicle_id, zone_id ORDER BY ts_ms, event_id)),
h AS (SELECT *, prev AND ts_ms - before <= {SILENT} AS was FROM g)
SELECT vehicle_id, zone_id, CASE WHEN now THEN 'ENTER' ELSE 'EXIT' END AS event_type, ts_ms FROM h WHERE now <> was
UNION ALL SELECT vehicle_id, zone_id, 'EXIT', ts_ms + {SILENT} FROM h WHERE now AND (after - ts_ms > {SILENT} OR after IS NULL AND ts_ms + {SILENT} <= (SELECT max(ts_ms) FROM p) - {LATE_HOURS * 3600 * 1000})""")
def stream_silent_vehicles(s, d):
    path = new_dir(s, "stream-out")
    _zone_events(s, d, lambda events, state: _run(events.writeStream.format("parquet").option("path", path).outputMode("append"), state), late=False, silent_ms=SILENT, wait=f"{LATE_HOURS} hours")
    return s.read.schema(streams.EVENTS).parquet(path)


@query(_ON_TIME + "g0 AS (SELECT * FROM (WITH " + _transitions("ot", "ts_ms, event_id") + ")) SELECT 'ALERT: Vehicle ' || vehicle_id || ' ' || event_type || ' zone ' || zone_id AS line FROM g0")
def stream_alert_lines(s, d):
    path = new_dir(s, "stream-out")
    _zone_events(s, d, lambda events, state: streams.write_alert_stream(events, path, state, {"availableNow": True}).awaitTermination())
    return s.read.text(path).withColumnRenamed("value", "line")


@query(_RATE)
def stream_update_rate(s, d):
    path = new_dir(s, "stream-out")
    keep = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    _stream(s, d, lambda stream, state: _run(streams.update_rate_stream(stream, "1 minute", late="6 days").writeStream.outputMode("update").foreachBatch(keep), state))
    # A window that several batches changed counts as it was last.
    rows = s.read.schema("window_ms long, shard long, n long, batch long").parquet(path)
    return rows.groupBy("window_ms", "shard").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT event_id, vehicle_id, ts_ms, x, y FROM p")
def read_positions(s, d):
    path = new_dir(s, "positions")
    fx.positions(s, d).select("event_id", "vehicle_id", "ts_ms", "x", "y").write.parquet(path)
    return tables.read_positions(s, path)



@query(f"SELECT 'box ' || box_id AS zone_id, seq, t.x, t.y, min_x, max_y FROM boxes, LATERAL (VALUES {_CORNERS}) t(seq, x, y)")
def read_zones(s, d):
    """Zones of the boxes' corners, written as JSON and read back."""
    path = new_dir(s, "zones")
    tables.box_zones(fx.boxes(s, d), F.concat(F.lit("box "), "box_id")).write.json(path)
    return tables.read_zones(s, path).select("zone_id", F.posexplode("polygon").alias("seq", "v"), "min_x", "max_y").select("zone_id", "seq", "v.x", "v.y", "min_x", "max_y")


@query("""
, e AS (SELECT l_partkey % 300 AS src, l_orderkey % 330 AS dst, l_quantity AS weight FROM lineitem),
g AS (SELECT * FROM e WHERE dst < 300)
SELECT src, dst, weight, (src * 37 % 1001)::DOUBLE AS x, (src * 91 % 1001)::DOUBLE AS y, (SELECT count(*) FROM e) - (SELECT count(*) FROM g) AS dangling FROM g""")
def read_graph(s, d):
    """Edges with the place of their start; each node was written twice, wrong at first."""
    nodes, edges = new_dir(s, "nodes"), new_dir(s, "edges")
    n = s.range(300).select(F.col("id").alias("node_id"), (F.col("id") * 37 % 1001).cast("double").alias("x"), (F.col("id") * 91 % 1001).cast("double").alias("y"))
    n.withColumn("x", F.col("x") + 5000).withColumn("round", F.lit(0)).unionByName(n.withColumn("round", F.lit(1))).coalesce(1).sortWithinPartitions("round").drop("round").write.parquet(nodes)
    li = s.read.parquet(f"{d}/lineitem.parquet")
    li.select((F.col("l_partkey") % 300).cast("long").alias("src"), (F.col("l_orderkey") % 330).cast("long").alias("dst"), F.col("l_quantity").alias("weight")).write.parquet(edges)
    n, e, dangling = tables.read_graph(s, nodes, edges)
    return e.join(n.withColumnRenamed("node_id", "src"), "src").join(F.broadcast(dangling)).select("src", "dst", "weight", "x", "y", "dangling")


_QUAD = "least(floor({0} / (1000 / 256.0)), 255)::BIGINT"


@query(f"SELECT event_id, (SELECT string_agg(((1 - ({_QUAD.format('y')} >> (8 - i)) % 2) * 2 + ({_QUAD.format('x')} >> (8 - i)) % 2)::VARCHAR, '' ORDER BY i) FROM range(1, 9) t(i)) AS quad_key FROM p")
def quad_keys(s, d):
    return fx.positions(s, d).select("event_id", expr.quad_key("x", "y", depth=8).alias("quad_key"))


@query("SELECT vp_id, vehicle_id, (sx / scale + min_x)::DOUBLE AS x, (sy / scale + min_y)::DOUBLE AS y FROM (SELECT *, trunc((x - min_x) * scale)::INT AS sx, trunc((y - min_y) * scale)::INT AS sy FROM latest JOIN vp ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y) WHERE sx >= 0 AND sx < w AND sy >= 0 AND sy < h")
def screen_to_world(s, d):
    """Where on the map the pixels of viewport_points lie."""
    vps = fx.viewports(s).select("vp_id", "scale", *expr.viewport_box("w", "h", "cx", "cy", "scale"))
    return viewport_points(s, d).join(vps, "vp_id").select("vp_id", "vehicle_id", *expr.to_world("sx", "sy", "min_x", "min_y", "scale"))


@query("SELECT vehicle_id, printf('Vehicle %d: (%.1f, %.1f)', vehicle_id, x, y) AS line FROM latest")
def vehicle_lines(s, d):
    return latest(s, d).select("vehicle_id", expr.vehicle_line().alias("line"))


@query(f"SELECT query_id, printf('Vehicle %d: (%.1f, %.1f) dist %.2f', vehicle_id, x, y, sqrt(d2)) AS line FROM (SELECT *, {_D2} AS d2, row_number() OVER (PARTITION BY query_id ORDER BY {_D2}, vehicle_id) AS rn FROM pq, latest) WHERE rn = 1 AND sqrt(d2) < 50")
def pick_lines(s, d):
    return pick_vehicle(s, d).select("query_id", expr.pick_line().alias("line"))


@query(f"""{_LAT}, m AS (SELECT grp, count(*) / nullif((max(ts_ms) - min(ts_ms)) / 1000, 0) AS throughput, quantile_disc(ns, 0.5) / 1e6 AS p50, quantile_disc(ns, 0.95) / 1e6 AS p95, quantile_disc(ns, 0.99) / 1e6 AS p99, sum(ns)::BIGINT / count(ns) / 1e6 AS mean FROM l GROUP BY grp)
SELECT grp AS name, printf('%.1f', throughput)::DOUBLE AS throughput, {", ".join(f"printf('%.2f', {c})::DOUBLE AS {c}" for c in ("p50", "p95", "p99", "mean"))} FROM m""")
def summary_csv(s, d):
    path = new_dir(s, "summary")
    f = fx.latencies(s, d)
    tables.write_summary_csv(summary.latency_summary(f).join(summary.throughput(f), "grp").withColumnRenamed("grp", "name"), path)
    return s.read.option("header", True).schema("name string, throughput double, p50 double, p95 double, p99 double, mean double").csv(path)
