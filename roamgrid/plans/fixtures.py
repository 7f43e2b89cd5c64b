"""Inputs of the registered queries, derived from the given tables by integer arithmetic, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import validate_updates
from ..sources.tables import square, zones_of

#: Minutes from the epoch to 2024-01-01, and the zones (id, polygon, box).
MINUTES = 28401120
ZONES = [
    ("center", square(400, 600), (400, 400, 600, 600)),
    ("airport", square(800, 900), (800, 800, 900, 900)),
    ("tri", [(0, 0), (1000, 500), (0, 1000)], (0, 0, 1000, 1000)),
    ("ell", [(100, 100), (500, 100), (500, 200), (200, 200), (200, 500), (100, 500)], (100, 100, 500, 500)),
    ("clipped", square(400, 600), (400, 400, 500, 500)),
    ("empty", [(0, 0), (1000, 1000)], (0, 0, 1000, 1000)),
]
VIEWPORTS = [(1, 1000, 700, 500.0, 500.0, 1.0), (2, 400, 300, 850.0, 850.0, 1.25)]
#: When `as of` is: ten days after MINUTES.
AS_OF = (MINUTES + 14400) * 60000
TICK = 6 * 3600 * 1000


def positions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("vehicle_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    e = e.withColumn("m", F.expr(f"ts_ms div 60000 - {MINUTES}"))
    wave = lambda k, d: F.expr(f"cast(1000 - abs(1000 - (vehicle_id * {k} + m div {d}) % 2000) as double)")
    x = F.when(F.col("event_id") % 101 == 0, float("nan")).when(F.col("event_id") % 97 == 0, wave(137, 40) + 2000).otherwise(wave(137, 40))
    return e.select("event_id", "vehicle_id", "ts_ms", x.alias("x"), wave(251, 56).alias("y"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate_updates(positions_raw(spark, sf_dir))


def zones(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return zones_of(spark, ZONES)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("box_id"))
    n = n.withColumns({"min_x": (F.col("box_id") * 40 % 1000).cast("double"), "min_y": (F.col("box_id") * 173 % 1000).cast("double")})
    return n.withColumns({"max_x": F.col("min_x") + 50 + 4 * F.col("box_id"), "max_y": F.col("min_y") + 50 + 4 * F.col("box_id")})


def point_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("query_id"))
    return s.select("query_id", (F.col("query_id") * 37 % 1001).cast("double").alias("x"), (F.col("query_id") * 91 % 1001).cast("double").alias("y"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return positions(spark, sf_dir).join(kind, "event_id").select(F.col("event_id").alias("seq"), op.alias("op"), "vehicle_id", "x", "y", "ts_ms")


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("grp"), F.round(F.col("value") * 1000000).cast("long").alias("ns"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


def viewports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VIEWPORTS, "vp_id int, w int, h int, cx double, cy double, scale double")


def requests(spark: SparkSession, sf_dir: str, n: int = 400) -> DataFrame:
    """Route requests between node numbers below n, from all orders, with one to the same node (-1) and one to an unknown node (-2)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = o.select(F.col("o_orderkey").cast("long").alias("request_id"), (F.col("o_orderkey") * 7 % n).cast("long").alias("src"), (F.col("o_custkey") % n).cast("long").alias("dst"))
    return o.unionByName(spark.createDataFrame([(-1, 5, 5), (-2, 5, 9999)], "request_id long, src long, dst long"))


def irregular_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges from all of lineitem."""
    nodes = spark.range(300).select(F.col("id").alias("node_id"), (F.col("id") * 37 % 1001).cast("double").alias("x"), (F.col("id") * 91 % 1001).cast("double").alias("y"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li = li.select((F.col("l_partkey") % 300).cast("long").alias("src"), (F.col("l_orderkey") % 300).cast("long").alias("dst"), "l_quantity").filter("src <> dst")
    # Parallel edges differ by l_quantity alone; the smallest of each pair is taken before coordinates are joined.
    li = li.groupBy("src", "dst").agg(F.min("l_quantity").alias("l_quantity"))
    at = lambda s: nodes.select(F.col("node_id").alias(s), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"))
    d = F.sqrt((F.col("src_x") - F.col("dst_x")) * (F.col("src_x") - F.col("dst_x")) + (F.col("src_y") - F.col("dst_y")) * (F.col("src_y") - F.col("dst_y")))
    return nodes, li.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", (d + F.col("l_quantity")).alias("weight"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{float(v)}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


_EDGES = [(z, *map(float, (*p[i], *p[i - 1]))) for z, p, _ in ZONES if len(p) > 2 for i in range(len(p))]
#: Common table expressions: raw and valid positions, latest state, zones, boxes, queries, viewports, grid.
CTE = f"""
WITH RECURSIVE e0 AS (SELECT event_id, event_type, user_id AS vehicle_id, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 60000000 - {MINUTES} AS m FROM events),
e1 AS (SELECT *, (1000 - abs(1000 - (vehicle_id * 137 + m // 40) % 2000))::DOUBLE AS x0, (1000 - abs(1000 - (vehicle_id * 251 + m // 56) % 2000))::DOUBLE AS y FROM e0),
pr AS (SELECT event_id, event_type, vehicle_id, ts_ms, CASE WHEN event_id % 101 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 97 = 0 THEN x0 + 2000 ELSE x0 END AS x, y FROM e1),
p AS (SELECT * FROM pr WHERE NOT isnan(x) AND x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000),
latest AS (SELECT vehicle_id, x, y, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY ts_ms DESC, event_id DESC) AS rn FROM p) WHERE rn = 1),
z AS (SELECT * FROM (VALUES {_values([(z, *map(float, b)) for z, _, b in ZONES])}) t(zone_id, min_x, min_y, max_x, max_y)),
ze AS (SELECT * FROM (VALUES {_values(_EDGES)}) t(zone_id, xi, yi, xj, yj)),
boxes AS (SELECT *, min_x + 50 + 4 * box_id AS max_x, min_y + 50 + 4 * box_id AS max_y FROM (SELECT n_nationkey::BIGINT AS box_id, (n_nationkey::BIGINT * 40 % 1000)::DOUBLE AS min_x, (n_nationkey::BIGINT * 173 % 1000)::DOUBLE AS min_y FROM nation)),
pq AS (SELECT s_suppkey::BIGINT AS query_id, (s_suppkey * 37 % 1001)::DOUBLE AS qx, (s_suppkey * 91 % 1001)::DOUBLE AS qy FROM supplier),
vp AS (SELECT *, cx - w / 2 / scale AS min_x, cy - h / 2 / scale AS min_y, cx + w / 2 / scale AS max_x, cy + h / 2 / scale AS max_y FROM (VALUES {_values(VIEWPORTS)}) t(vp_id, w, h, cx, cy, scale)),
gn AS (SELECT i AS node_id, (i % 20) * 50.0::DOUBLE AS x, (i // 20) * 50.0::DOUBLE AS y FROM range(400) t(i)),
ge AS (SELECT i AS src, i + 1 AS dst FROM range(400) t(i) WHERE i % 20 < 19 UNION ALL SELECT i + 1, i FROM range(400) t(i) WHERE i % 20 < 19 UNION ALL SELECT i, i + 20 FROM range(380) t(i) UNION ALL SELECT i + 20, i FROM range(380) t(i)),
rq AS (SELECT o_orderkey::BIGINT AS request_id, (o_orderkey * 7 % 400)::BIGINT AS src, (o_custkey % 400)::BIGINT AS dst FROM orders UNION ALL VALUES (-1, 5, 5), (-2, 5, 9999))
"""


def inside(points: str) -> str:
    """SQL for (columns of points) with the zones that hold them."""
    return f"(SELECT q.*, z.zone_id FROM {points} q JOIN z ON q.x BETWEEN min_x AND max_x AND q.y BETWEEN min_y AND max_y WHERE (SELECT count(*) FROM ze WHERE ze.zone_id = z.zone_id AND (yi > q.y) <> (yj > q.y) AND q.x < (xj - xi) * (q.y - yi) / (yj - yi) + xi) % 2 = 1)"
