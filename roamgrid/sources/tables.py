"""Table sources and sinks (S1, S2, S5 to S8) with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import BOUNDS  # noqa: F401  the map's bounds belong to the schema
from ..operators.summary import summary_lines

POSITIONS = "event_id long, vehicle_id long, ts_ms long, x double, y double"
ZONES = "zone_id string, polygon array<struct<x: double, y: double>>, min_x double, min_y double, max_x double, max_y double"
NODES, EDGES = "node_id long, x double, y double", "src long, dst long, weight double"


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """S1."""
    return spark.read.schema(POSITIONS).parquet(path)


def read_position_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New Parquet files of a folder, at most max_files in a batch, so that nothing is lost under load."""
    return spark.readStream.schema(POSITIONS).option("maxFilesPerTrigger", max_files).parquet(path)


def read_zones(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """S5."""
    return spark.read.schema(ZONES).format(form).load(path)


def square(a: float, b: float) -> list[tuple[float, float]]:
    return [(a, a), (b, a), (b, b), (a, b)]


def zones_of(spark: SparkSession, rows: list[tuple[str, list, tuple]]) -> DataFrame:
    return spark.createDataFrame([(z, [tuple(map(float, v)) for v in p], *map(float, b)) for z, p, b in rows], ZONES)


def box_zones(boxes: DataFrame, zone_id) -> DataFrame:
    """Zones from boxes(min_x to max_y): their corners as polygon."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    corners = F.array(corner("min_x", "min_y"), corner("max_x", "min_y"), corner("max_x", "max_y"), corner("min_x", "max_y"))
    return boxes.select(zone_id.alias("zone_id"), corners.alias("polygon"), "min_x", "min_y", "max_x", "max_y")


def demo_zones(spark: SparkSession) -> DataFrame:
    """The two fixed zones of the demonstration."""
    return zones_of(spark, [("center", square(400, 600), (400, 400, 600, 600)), ("airport", square(800, 900), (800, 800, 900, 900))])


def road_grid(spark: SparkSession, cols: int, rows: int, spacing: float, id_offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (both ways, right and down) of a grid."""
    cell = spark.range(cols * rows).select("id", (F.col("id") % cols).alias("c"), F.expr(f"id div {cols}").alias("r"))
    nodes = cell.select((F.col("id") + id_offset).alias("node_id"), (F.col("c") * spacing).alias("x"), (F.col("r") * spacing).alias("y"))
    to = F.filter(F.array(F.when(F.col("c") < cols - 1, F.col("id") + 1), F.when(F.col("r") < rows - 1, F.col("id") + cols)), lambda x: x.isNotNull())
    pair = cell.select("id", F.explode(to).alias("to")).select((F.col("id") + id_offset).alias("a"), (F.col("to") + id_offset).alias("b"))
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return nodes, pair.select(both.alias("e")).select("e.src", "e.dst", F.lit(float(spacing)).alias("weight"))


def read_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges between them, and one row with the number of edges left out. Of rows that repeat
    a node's id the last one counts, in the order of the files' names and of rows in a file."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    n = spark.read.schema(NODES).parquet(nodes).groupBy("node_id").agg(F.max_by(F.struct("x", "y"), place).alias("p")).select("node_id", "p.*")
    e = spark.read.schema(EDGES).parquet(edges)
    ids = n.select("node_id")
    good = e.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return n, good, e.agg(F.count("*").alias("all")).join(good.agg(F.count("*").alias("good"))).select((F.col("all") - F.col("good")).alias("dangling"))


def write_summary_csv(df: DataFrame, path: str) -> None:
    """S8."""
    summary_lines(df).write.mode("overwrite").option("header", True).csv(path)
