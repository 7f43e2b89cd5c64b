"""Positions in a layout by place (J1, F7): files sorted by quad code in folders by its first digits, and boxes as intervals of codes."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import BOUNDS, in_box, quad_code

#: Digits of a code, and of those the ones that name a folder; folders of what lies outside bounds or has no place.
DEPTH, FOLDER = 16, 3
OUTSIDE = -1
#: Intervals of codes that a box is cut into, at most about so many.
INTERVALS = 64


def write_clustered(points: DataFrame, path: str, *, bounds=BOUNDS, depth: int = DEPTH, folder: int = FOLDER, files: int | None = None) -> None:
    """Writes points(x, y, ...) to a new folder, sorted by place: `files` (by default as many as shuffle partitions) ranges of codes of about equal size.

    Two columns are added, part (the folder) and code; read_box() drops them. All rows are kept.
    """
    n = files or int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = F.coalesce(in_box("x", "y", *bounds), F.lit(False))
    code = F.when(inside, quad_code("x", "y", bounds, depth)).otherwise(OUTSIDE)
    dealt = points.withColumn("code", code).withColumn("part", F.shiftright("code", 2 * (depth - folder)))
    dealt.repartitionByRange(n, "code").sortWithinPartitions("code").write.partitionBy("part").parquet(path)
    layout = json.dumps({"bounds": list(bounds), "depth": depth, "folder": folder, "schema": points.schema.json()})
    points.sparkSession.createDataFrame([(layout,)], "value string").coalesce(1).write.text(f"{path}/_layout")


def intervals(box, bounds=BOUNDS, depth: int = DEPTH, most: int = INTERVALS) -> list[tuple[int, int]]:
    """Closed intervals of codes that hold all points of a box within bounds, in order: quadrants that the box covers, and
    of those that it cuts smaller ones, level by level, until there are about `most`."""
    side = 1 << depth
    at = lambda v, low, high: min(max(math.floor((min(max(v, low), high) - low) / ((high - low) / side)), 0), side - 1)
    x0, x1 = (at(box[k], bounds[0], bounds[2]) for k in (0, 2))
    y0, y1 = (at(box[k], bounds[1], bounds[3]) for k in (1, 3))
    if not (box[0] <= box[2] and box[1] <= box[3]) or box[2] < bounds[0] or box[0] > bounds[2] or box[3] < bounds[1] or box[1] > bounds[3]:
        return []
    done, level = [], [(0, 0, 0, 0)]  # depth, x, y, code of quadrants that the box cuts
    while level:
        below = []
        for d, x, y, code in level:
            n = depth - d
            ax, bx, ay, by = x << n, ((x + 1) << n) - 1, y << n, ((y + 1) << n) - 1
            if bx < x0 or ax > x1 or by < y0 or ay > y1:
                continue
            if (x0 <= ax and bx <= x1 and y0 <= ay and by <= y1) or d == depth:
                done.append((code << 2 * n, ((code + 1) << 2 * n) - 1))
            else:
                below.append((d, x, y, code))
        if len(done) + len(below) >= most:
            done += [(code << 2 * (depth - d), ((code + 1) << 2 * (depth - d)) - 1) for d, _, _, code in below]
            break
        level = [(d + 1, 2 * x + i, 2 * y + j, code * 4 + (1 - j) * 2 + i) for d, x, y, code in below for i in (0, 1) for j in (0, 1)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _within(column: Column, ranges) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | (column == a if a == b else column.between(a, b))
    return out


def read_box(spark: SparkSession, path: str, box) -> DataFrame:
    """J1 on the layout of write_clustered(): points in a closed box. Folders are pruned by their number, row groups by the intervals of codes."""
    layout = json.loads(spark.read.text(f"{path}/_layout").first()["value"])
    bounds, depth, folder = layout["bounds"], layout["depth"], layout["folder"]
    found = intervals(box, bounds, depth)
    shift = 2 * (depth - folder)
    parts = [(a >> shift, b >> shift) for a, b in found]
    whole = bounds[0] <= box[0] and box[2] <= bounds[2] and bounds[1] <= box[1] and box[3] <= bounds[3]
    if not whole:  # the box reaches beyond the bounds
        found, parts = [(OUTSIDE, OUTSIDE), *found], [(OUTSIDE, OUTSIDE), *parts]
    rows = spark.read.schema(f"part long, code long, {_ddl(layout['schema'])}").parquet(path)
    return rows.filter(_within(F.col("part"), parts) & _within(F.col("code"), found) & in_box("x", "y", *box)).drop("part", "code")


def _ddl(schema: str) -> str:
    return ", ".join(f"`{f['name']}` {f['type']}" for f in json.loads(schema)["fields"])
