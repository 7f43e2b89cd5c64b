"""Spatial selections and joins (J1 to J12) and density-adaptive cells (A5).

Joins turn a spatial predicate into an equi-join on grid cells and refine it with the exact
predicate. Boxes of very different sizes go to grids of different levels (cells double), so that a
box always covers a few cells; a point has one cell in each level that occurs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import BOUNDS, _c, boxes_meet, dist2, grid_cell, in_box, on_screen, point_in_polygon, quad_index, to_screen, viewport_box
from ..plans.cut import cut
from .state import lookup

BOX = ("min_x", "min_y", "max_x", "max_y")


#: The one column that these joins add for a time; points and boxes must not have one of this name.
CELL = "_cell"


#: The level of boxes that no grid of doubling cells can hold: unbounded ones, and small ones so far off that
#: their cells' numbers aren't exact. Points are dealt to so many parts of it by their place, boxes to all.
TOP, PARTS = 5000, 32
_EXACT = float(1 << 53)


def _side() -> Column:
    return F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))


def _level(cell: float) -> Column:
    level = F.ceil(F.log2(F.greatest(_side(), F.lit(cell)) / cell))
    far = F.greatest(*[F.abs(c) for c in BOX]) / (F.pow(F.lit(2.0), level) * cell)
    return F.when((_side() < float("inf")) & (far < _EXACT), level.cast("int")).otherwise(TOP)


def _part(*place: str) -> Column:
    return F.pmod(F.xxhash64(*place), F.lit(PARTS))


def _cell(level, cx, cy) -> Column:
    return F.struct(level.alias("level"), cx.cast("long").alias("cx"), cy.cast("long").alias("cy"))


def _cell_of(level: int, x, y, cell: float) -> Column:
    """struct(level, cx, cy) of the cell that holds (x, y); null if its numbers aren't exact: no box of that level is so far off."""
    if level == TOP:
        return _cell(F.lit(TOP), F.pmod(F.xxhash64(x, y), F.lit(PARTS)), F.lit(0))
    size = 2.0**level * cell
    near = (F.abs(x / size) <= _EXACT + 1) & (F.abs(y / size) <= _EXACT + 1)
    return F.when(near, _cell(F.lit(level), F.floor(x / size), F.floor(y / size)))


def _cells(level, cell: float) -> Column:
    """All cells of a level that the box of a row meets: at most nine, at its own level or a coarser one."""
    size = F.pow(F.lit(2.0), level) * cell
    side = lambda c: F.sequence(F.floor(F.col(f"min_{c}") / size).cast("long"), F.floor(F.col(f"max_{c}") / size).cast("long"))
    grid = F.flatten(F.transform(side("x"), lambda x: F.transform(side("y"), lambda y: _cell(level, x, y))))
    return F.when(level == TOP, F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: _cell(level, i, F.lit(0)))).otherwise(grid)


def placed(x="x", y="y") -> Column:
    """Whether both coordinates are finite numbers."""
    fine = lambda c: _c(c).isNotNull() & ~F.isnan(_c(c)) & (F.abs(_c(c)) < float("inf"))
    return fine(x) & fine(y)


def _own_name(*dfs: DataFrame) -> None:
    if any(CELL in df.columns for df in dfs):
        raise ValueError(f"the column name {CELL} is reserved")


def _proper(boxes: DataFrame) -> DataFrame:
    return boxes.filter((F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")))


def _levels(boxes: DataFrame, cell: float) -> list[int]:
    return sorted(r["level"] for r in boxes.select(_level(cell).alias("level")).distinct().collect())  # a few dozen at most


def range_query(points: DataFrame, box) -> DataFrame:
    """Points in a closed box; the four bounds reach the Parquet scan."""
    return points.filter(in_box("x", "y", *box))


def range_join(points: DataFrame, boxes: DataFrame, cell: float = 50.0, method: str = "grid") -> DataFrame:
    """Points with every box that holds them. Columns of both, whose names must differ. Boxes may be unbounded.

    method: "grid" for cells of doubling size from `cell` on, or "tree" for dense_range_join(), whose cells split where points are dense.
    """
    if method not in ("grid", "tree"):
        raise ValueError(f"no method {method!r}")
    if method == "tree":
        return dense_range_join(points, boxes)
    _own_name(points, boxes)
    boxes = _proper(boxes)
    levels = _levels(boxes, cell)
    if not levels:
        return points.join(boxes, F.lit(False))
    p = points.filter(~F.isnan("x") & ~F.isnan("y")).withColumn(CELL, F.explode(point_cells(levels, cell)))
    return p.join(boxes.withColumn(CELL, F.explode(_cells(_level(cell), cell))), CELL).filter(in_box("x", "y", *BOX)).drop(CELL)


def range_query_coarse(points: DataFrame, box, bounds=BOUNDS, nx: int = 50, ny: int = 50) -> DataFrame:
    """Ids in all cells that the box touches, a superset of J1."""
    corner = lambda x, y: grid_cell(F.lit(x), F.lit(y), bounds, nx, ny)
    low, high, own = corner(box[0], box[1]), corner(box[2], box[3]), grid_cell("x", "y", bounds, nx, ny)
    inside = own["cx"].between(low["cx"], high["cx"]) & own["cy"].between(low["cy"], high["cy"])
    return points.filter(~F.isnan("x") & ~F.isnan("y")).filter(inside).select("vehicle_id").distinct()


def _nearest(d2: Column, id_col: str = "vehicle_id") -> Column:
    return F.min_by(F.struct(F.col(id_col).alias("vehicle_id"), "x", "y", F.sqrt(d2).alias("distance")), F.struct(d2, id_col))


def nearest(points: DataFrame, x: float, y: float) -> DataFrame:
    """One row; nulls without points that have a place. Ties go to the smallest id."""
    p = points.filter(placed())
    return p.agg(_nearest(dist2("x", "y", F.lit(x), F.lit(y))).alias("n")).select("n.*")


def nearest_join(queries: DataFrame, points: DataFrame, cell: float | None = None, id_col: str = "vehicle_id") -> DataFrame:
    """queries(query_id, x, y) with their nearest point: query_id, id, x, y, distance (nulls without points, and for queries without a place). Places must be finite
    numbers; points elsewhere are left out. An id may repeat, at one place or several: each row has its own nearest point.

    Points are counted by cells of doubling size first. A query takes the smallest size at which its
    own cell holds a point: then its nearest point is at most that cell's diagonal away, in the 3 x 3
    cells of twice the size around it. These are followed down to the finest cells that hold points;
    of those only the ones that can be nearer than the farthest corner of another are joined with the
    points, which are shuffled once. `cell` is the finest size; None: about four points to a cell on average.
    """
    p = points.filter(placed()).select(id_col, "x", "y")
    every = queries.select("query_id", F.col("x").alias("qx"), F.col("y").alias("qy"))
    q = every.filter(placed("qx", "qy")).select("qx", "qy").distinct()
    corners = lambda df, x, y: df.agg(*[f(c).alias(n) for c, n in ((x, "x"), (y, "y")) for f, n in ((F.min, f"a{n}"), (F.max, f"b{n}"))], F.count(F.lit(1)).alias("n")).first()
    there, asked = corners(p, "x", "y"), corners(q, "qx", "qy")
    if there["ax"] is None or asked["ax"] is None:
        kind = dict(points.dtypes)[id_col]
        return every.select("query_id", F.lit(None).cast(kind).alias(id_col), *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "distance")])
    low = {c: min(there[f"a{c}"], asked[f"a{c}"]) for c in "xy"}
    extent = max(max(there[f"b{c}"], asked[f"b{c}"]) - low[c] for c in "xy")
    if cell is None:
        own = max(max(there[f"b{c}"] - there[f"a{c}"] for c in "xy"), extent / 1024)
        cell = max(own / max(1.0, (there["n"] / 4) ** 0.5), extent / (1 << 20)) or 1.0
    levels = max(0, math.ceil(math.log2(max(extent / cell, 1)))) + 1  # at most 21 by default; one cell holds all at the last
    at = lambda level, x, y: _cell_of(level, F.col(x) - low["x"], F.col(y) - low["y"], cell)
    dealt = p.withColumn("fine", at(0, "x", "y"))
    fine = cut(dealt.groupBy("fine").agg(F.count(F.lit(1)).alias("n")))
    above = lambda c, level: _cell(F.lit(level), F.shiftright(f"{c}.cx", level), F.shiftright(f"{c}.cy", level))
    pyramid = fine.select("fine", F.explode(F.array(*[above("fine", k) for k in range(levels + 1)])).alias("cell"))
    # The smallest size at which a query's own cell holds points.
    own = q.withColumn("cell", F.explode(F.array(*[at(k, "qx", "qy") for k in range(levels + 1)])))
    first = own.join(pyramid.select("cell").distinct(), "cell").groupBy("qx", "qy").agg(F.min("cell").alias("c"))
    around = F.sequence(F.lit(-1), F.lit(1))
    up = F.struct((F.col("c.level") + 1).alias("level"), F.shiftright("c.cx", 1).alias("cx"), F.shiftright("c.cy", 1).alias("cy"))
    block = F.flatten(F.transform(around, lambda i: F.transform(around, lambda j: F.struct(F.col("u.level").alias("level"), (F.col("u.cx") + i).alias("cx"), (F.col("u.cy") + j).alias("cy")))))
    near = first.withColumn("u", up).select("qx", "qy", F.explode(block).alias("cell"))
    top = fine.select("fine", F.explode(F.array(*[above("fine", k) for k in range(levels + 2)])).alias("cell"))
    pairs = near.join(top, "cell").select("qx", "qy", "fine")
    side = lambda c: (F.col(f"fine.c{c}") * cell + low[c], (F.col(f"fine.c{c}") + 1) * cell + low[c], F.col(f"q{c}"))
    gap = lambda c: F.greatest(side(c)[0] - side(c)[2], side(c)[2] - side(c)[1], F.lit(0.0))
    reach = lambda c: F.greatest(F.abs(side(c)[2] - side(c)[0]), F.abs(side(c)[1] - side(c)[2]))
    pairs = pairs.withColumns({"gap": F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")), "reach": F.sqrt(reach("x") * reach("x") + reach("y") * reach("y"))})
    # A little slack covers the rounding of cells' borders.
    bound = F.min("reach").over(Window.partitionBy("qx", "qy"))
    kept = pairs.withColumn("bound", bound).filter(F.col("gap") <= F.col("bound") * 1.000001 + extent * 1e-9).select("qx", "qy", "fine")
    best = kept.join(dealt, "fine").groupBy("qx", "qy").agg(_nearest(dist2("x", "y", "qx", "qy"), id_col).alias("n"))
    out = best.select("qx", "qy", F.col("n.vehicle_id").alias(id_col), "n.x", "n.y", "n.distance")
    return every.join(out, ["qx", "qy"], "left").select("query_id", id_col, "x", "y", "distance")


def pick(queries: DataFrame, points: DataFrame, radius: float, cell: float = 50.0) -> DataFrame:
    """queries(query_id, x, y) with the nearest point strictly within radius; queries without one are left out. An id may repeat."""
    every = queries.select("query_id", F.col("x").alias("qx"), F.col("y").alias("qy")).filter(placed("qx", "qy"))
    boxes = queries.filter(placed()).select("x", "y").distinct().select(F.col("x").alias("qx"), F.col("y").alias("qy"), (F.col("x") - radius).alias("min_x"), (F.col("y") - radius).alias("min_y"), (F.col("x") + radius).alias("max_x"), (F.col("y") + radius).alias("max_y"))
    d2 = dist2("x", "y", "qx", "qy")
    near = range_join(points, boxes, cell).filter(F.sqrt(d2) < radius)
    return every.join(near.groupBy("qx", "qy").agg(_nearest(d2).alias("n")), ["qx", "qy"]).select("query_id", "n.*")


#: Cells of a zone: a polygon of n vertices is cut into about n / 2 cells, at most 4**FINEST.
FINEST = 6


def zone_cells(zones: DataFrame, cell: float = 50.0) -> DataFrame:
    """The columns of zones but polygon, with CELL, odd, steps and edges: one row for each cell in which points may lie inside.

    A cell keeps the edges that its points must be tested with: `edges` is null where all its points are inside the polygon, and
    cells with no point inside are left out. Edges left of a cell, and above or below its row, cross no ray from it. Whether an edge
    right of it crosses a ray depends on the heights of its two ends alone; a height that two such edges share counts twice and so
    not at all. Of the heights that are left, `odd` is whether those above the row are odd in number, and `steps` are those in it.
    """
    z = with_boxes(zones)
    _own_name(z)
    z = _proper(z).filter(F.size("polygon") >= 3)
    n = F.size("polygon")
    fine = F.least(F.greatest(F.floor(F.log2(F.greatest(n, F.lit(2)) / 2.0) / 2), F.lit(0)), F.lit(FINEST)).cast("int")
    own = _level(cell)
    # Finer grids are levels below those of boxes, down to -FINEST.
    z = z.withColumn("_level", F.when(own == TOP, own).otherwise(own - fine))
    point = lambda i: F.get("polygon", i)
    edge = lambda i: F.struct(point(i)["x"].alias("xi"), point(i)["y"].alias("yi"), point(F.when(i == 0, n - 1).otherwise(i - 1))["x"].alias("xj"), point(F.when(i == 0, n - 1).otherwise(i - 1))["y"].alias("yj"))
    # Level edges cross no ray.
    sides = F.filter(F.transform(F.sequence(F.lit(0), n - 1), edge), lambda e: e["yi"] != e["yj"])
    z = z.withColumn("_edges", sides)
    size = F.pow(F.lit(2.0), F.col("_level")) * cell
    numbers = lambda c: F.sequence(F.floor(F.col(f"min_{c}") / size).cast("long"), F.floor(F.col(f"max_{c}") / size).cast("long"))
    wide = F.col("_level") == TOP
    # Row by row, then cell by cell of the row. A little slack covers the rounding of cells' borders.
    slack = lambda v: F.abs(v) * 1e-9 + size * 1e-9
    rows = z.withColumn("_cy", F.explode(F.when(wide, F.array(F.lit(0).cast("long"))).otherwise(numbers("y"))))
    low, high = F.col("_cy") * size, (F.col("_cy") + 1) * size
    low, high = low - slack(low), high + slack(high)
    in_row = F.filter("_edges", lambda e: (F.least(e["yi"], e["yj"]) <= high) & (F.greatest(e["yi"], e["yj"]) > low))
    rows = rows.withColumn("_edges", F.when(wide, F.col("_edges")).otherwise(in_row))
    rows = rows.withColumn("_cx", F.explode(F.when(wide, F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")).otherwise(numbers("x"))))
    left, right = F.col("_cx") * size, (F.col("_cx") + 1) * size
    left, right = left - slack(left), right + slack(right)
    near = F.filter("_edges", lambda e: F.greatest(e["xi"], e["xj"]) >= left - (F.abs(e["xi"]) + F.abs(e["xj"])) * 1e-9)
    beyond = lambda e: F.least(e["xi"], e["xj"]) - (F.abs(e["xi"]) + F.abs(e["xj"])) * 1e-9 > right
    rows = rows.withColumn("_edges", F.when(wide, F.col("_edges")).otherwise(near))
    ends = F.flatten(F.transform(F.filter("_edges", beyond), lambda e: F.array(e["yi"], e["yj"])))
    rows = rows.withColumn("_ends", F.when(~wide, F.filter(ends, lambda y: y > low))).withColumn("edges", F.when(wide, F.col("_edges")).otherwise(F.filter("_edges", lambda e: ~beyond(e))))
    none = F.array().cast("array<double>")
    toggled = lambda acc, y: F.when(F.try_element_at(acc, F.lit(-1)) == y, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(y)))
    rows = rows.withColumn("odd", F.coalesce(F.size(F.filter("_ends", lambda y: y > high)) % 2 == 1, F.lit(False)))
    rows = rows.withColumn("steps", F.aggregate(F.coalesce(F.sort_array(F.filter("_ends", lambda y: y <= high)), none), none, toggled))
    tested = F.size("edges") + F.size("steps") > 0
    rows = rows.filter(F.col("odd") | tested).withColumn("edges", F.when(tested, F.col("edges")))
    return rows.withColumn(CELL, _cell(F.col("_level"), F.col("_cx"), F.col("_cy"))).drop("_level", "_cx", "_cy", "_edges", "_ends", "polygon")


#: What in_zone_cell() reads, beside CELL.
TEST = ("odd", "steps", "edges")


def in_zone_cell(x="x", y="y") -> Column:
    """Whether a point lies in the polygon, by what zone_cells() kept for its cell: F4 with the edges left to test."""
    x, y = _c(x), _c(y)
    at = lambda e: F.try_divide((e["xj"] - e["xi"]) * (y - e["yi"]), e["yj"] - e["yi"]) + e["xi"]
    crossed = F.size(F.filter("edges", lambda e: ((e["yi"] > y) != (e["yj"] > y)) & (x < at(e))))
    crossed = (crossed + F.size(F.filter("steps", lambda s: s > y))) % 2 == 1
    return F.when(F.col("edges").isNull(), F.col("odd")).otherwise(crossed != F.col("odd"))


def point_cells(levels: list[int], cell: float) -> Column:
    """The cells of a point on the grids of some levels."""
    return F.filter(F.array(*[_cell_of(x, F.col("x"), F.col("y"), cell) for x in levels]), lambda c: c.isNotNull())


def zone_join(points: DataFrame, zones: DataFrame, cell: float = 50.0) -> DataFrame:
    """Points with every zone whose box and polygon hold them. zones(zone_id, polygon, min_x to max_y).

    Cells inside a polygon need no test, those on its edge are tested with the edges near them.
    """
    _own_name(points)
    cells = cut(zone_cells(zones, cell))
    levels = sorted(r["level"] for r in cells.select(f"{CELL}.level").distinct().collect())  # a few dozen at most
    if not levels:
        return points.join(cells.drop(CELL, *TEST, *BOX), F.lit(False))
    p = points.filter(~F.isnan("x") & ~F.isnan("y")).withColumn(CELL, F.explode(point_cells(levels, cell)))
    return p.join(cells, CELL).filter(in_box("x", "y", *BOX) & in_zone_cell()).drop(CELL, *TEST, *BOX)


def with_boxes(zones: DataFrame) -> DataFrame:
    """Zones with their box; where its columns are absent it is the polygon's."""
    if set(BOX) <= set(zones.columns):
        return zones
    side = lambda f, c: f(F.transform("polygon", lambda v: v[c]))
    return zones.withColumns({"min_x": side(F.array_min, "x"), "min_y": side(F.array_min, "y"), "max_x": side(F.array_max, "x"), "max_y": side(F.array_max, "y")})


def bbox_join(a: DataFrame, b: DataFrame, cell: float = 100.0) -> DataFrame:
    """Boxes of a with boxes of b that they meet; both have min_x to max_y, which are left out of the result; other names must differ.

    Boxes lie on grids of doubling cells by their size. A pair meets at the coarser of its two levels,
    where each covers at most nine cells; of the cells that it shares, only the lowest one reports it.
    """
    _own_name(a, b)
    a, b = _proper(a), _proper(b)
    sides = {}
    for s, df, other in (("a", a, b), ("b", b, a)):
        more = _levels(other, cell)
        level = _level(cell)
        grids = [x for x in more if x != TOP]
        every = F.array_distinct(F.concat(F.array(level), F.filter(F.array(*[F.lit(x) for x in grids]), lambda x: x > level))) if grids else F.array(level)
        cells = F.flatten(F.transform(every, lambda x: _cells(x, cell)))
        if TOP in more:  # unbounded boxes of the other side are in every part; any other box looks into one
            cells = F.when(level == TOP, cells).otherwise(F.concat(cells, F.array(_cell(F.lit(TOP), _part(*BOX), F.lit(0)))))
        sides[s] = df.withColumn(f"_level_{s}", level).withColumn(CELL, F.explode(cells)).withColumnsRenamed({c: f"{c}_{s}" for c in BOX})
    met = sides["a"].join(sides["b"], CELL).filter(F.col(f"{CELL}.level") == F.greatest("_level_a", "_level_b"))
    meets = boxes_meet([f"{c}_a" for c in BOX], [f"{c}_b" for c in BOX])
    size = F.pow(F.lit(2.0), F.col(f"{CELL}.level")) * cell
    own = lambda c: F.col(f"{CELL}.c{c}") == F.floor(F.greatest(f"min_{c}_a", f"min_{c}_b") / size)
    # Two unbounded boxes meet in every part, and report in the first; others there meet in one.
    first = (F.least("_level_a", "_level_b") < TOP) | (F.col(f"{CELL}.cx") == 0)
    met = met.filter(meets & F.when(F.greatest("_level_a", "_level_b") == TOP, first).otherwise(own("x") & own("y")))
    return met.drop(CELL, *[f"{c}_{s}" for c in (*BOX, "_level") for s in "ab"])


def viewport_points(snapshot: DataFrame, viewports: DataFrame) -> DataFrame:
    """vp_id, vehicle_id, sx, sy of vehicles on each screen; viewports(vp_id, w, h, cx, cy, scale)."""
    vps = viewports.select("vp_id", "w", "h", "scale", *viewport_box("w", "h", "cx", "cy", "scale"))
    seen = range_join(snapshot.select("vehicle_id", "x", "y"), vps.withColumns({"left": F.col("min_x"), "top": F.col("min_y")}))
    return seen.select("vp_id", "vehicle_id", "w", "h", *to_screen("x", "y", "left", "top", "scale")).filter(on_screen("sx", "sy", "w", "h")).drop("w", "h")


def viewport_zones(zones: DataFrame, viewports: DataFrame) -> DataFrame:
    """vp_id, zone_id, seq, sx, sy of the vertices of zones whose box a viewport meets."""
    vps = viewports.select("vp_id", "scale", *viewport_box("w", "h", "cx", "cy", "scale")).withColumns({"left": F.col("min_x"), "top": F.col("min_y")})
    seen = bbox_join(with_boxes(zones), vps).select("vp_id", "zone_id", "left", "top", "scale", F.posexplode("polygon").alias("seq", "v"))
    return seen.select("vp_id", "zone_id", "seq", *to_screen(F.col("v.x"), F.col("v.y"), "left", "top", "scale"))


def neighbours(points: DataFrame, r: float, cell: float | None = None, method: str = "grid") -> DataFrame:
    """vehicle_id, neighbour_id: points in the closed box of half side r around each, itself included. method as in range_join()."""
    boxes = points.filter(placed()).select(F.col("vehicle_id").alias("center_id"), (F.col("x") - r).alias("min_x"), (F.col("y") - r).alias("min_y"), (F.col("x") + r).alias("max_x"), (F.col("y") + r).alias("max_y"))
    return range_join(points.select("vehicle_id", "x", "y").filter(placed()), boxes, cell or 2 * r, method).select(F.col("center_id").alias("vehicle_id"), F.col("vehicle_id").alias("neighbour_id"))


def snap_to_node(points: DataFrame, nodes: DataFrame, cell: float | None = None) -> DataFrame:
    """points(query_id, x, y) with node_id, x, y, distance of the nearest node; ties go to the smallest id."""
    return nearest_join(points, nodes, cell, "node_id")


def quadtree_leaves(points: DataFrame, bounds=BOUNDS, capacity: int = 32, max_depth: int = 20) -> DataFrame:
    """A5: depth, min_x, min_y, max_x, max_y, n of the leaves of the tree whose cells split while they
    hold more than `capacity` points and aren't at max_depth; points outside bounds are ignored.

    Points are counted once in the finest cells, and counts are rolled up from there.
    """
    x0, y0, x1, y1 = bounds
    inside = points.filter(in_box("x", "y", *bounds))
    fine = inside.select(quad_index("x", x0, x1, max_depth).alias("ix"), quad_index("y", y0, y1, max_depth).alias("iy")).groupBy("ix", "iy").count()
    up = fine.select(F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"), "ix", "iy", "count")
    cells = up.groupBy("depth", F.expr(f"shiftright(ix, {max_depth} - depth)").alias("cx"), F.expr(f"shiftright(iy, {max_depth} - depth)").alias("cy")).agg(F.sum("count").alias("n"))
    split = cells.filter((F.col("n") > capacity) & (F.col("depth") < max_depth))
    child = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)])).alias("c")).select("depth", "c.*")
    root = points.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    every = child.unionByName(root).join(cells, ["depth", "cx", "cy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    leaves = every.filter((F.col("n") <= capacity) | (F.col("depth") == max_depth))
    w, h = F.lit(x1 - x0) / F.pow(F.lit(2.0), F.col("depth")), F.lit(y1 - y0) / F.pow(F.lit(2.0), F.col("depth"))
    return leaves.select("depth", (F.col("cx") * w + x0).alias("min_x"), (F.col("cy") * h + y0).alias("min_y"), ((F.col("cx") + 1) * w + x0).alias("max_x"), ((F.col("cy") + 1) * h + y0).alias("max_y"), "n")


def _tree(points: DataFrame, capacity: int, max_depth: int):
    """Points that have a place with `_leaf`, struct(depth, cx, cy) of A5's tree over their own extent; these leaves; the extent's corner and side.
    None without points."""
    fine = points.filter(placed())
    ends = fine.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    if ends["ax"] is None:
        return None
    x0, y0 = ends["ax"], ends["ay"]
    side = max(ends["bx"] - x0, ends["by"] - y0) or 1.0
    bounds = (x0, y0, x0 + side, y0 + side)
    at = lambda c, k: quad_index(c, bounds[k], bounds[k + 2], max_depth)
    dealt = fine.withColumn("_fine", F.struct(at("x", 0).alias("ix"), at("y", 1).alias("iy")))
    # Points are counted once in the finest cells; cells that hold more than capacity split.
    counts = cut(dealt.groupBy("_fine").agg(F.count(F.lit(1)).alias("n")))
    depths = F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth")
    up = counts.select("_fine", "n", depths)
    shift = lambda c, d: F.expr(f"shiftright(_fine.{c}, {max_depth} - {d})")
    cells = up.groupBy("depth", shift("ix", "depth").alias("cx"), shift("iy", "depth").alias("cy")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("fine"))
    # Below one finest cell there is nothing to part.
    small = cells.filter((F.col("n") <= capacity) | (F.col("fine") == 1) | (F.col("depth") == max_depth)).select("depth", "cx", "cy")
    # Of the cells above a finest one that are small enough, the largest is its leaf. These tables grow with the points, however
    # small their files are: none is broadcast.
    met = up.select("_fine", "depth", shift("ix", "depth").alias("cx"), shift("iy", "depth").alias("cy")).join(small.hint("merge"), ["depth", "cx", "cy"])
    of_fine = cut(met.groupBy("_fine").agg(F.min(F.struct("depth", "cx", "cy")).alias("_leaf")))
    leaves = of_fine.select("_leaf").distinct()
    return dealt.join(of_fine.hint("merge"), "_fine").drop("_fine"), leaves, (x0, y0, side)


def leaf_cells(points: DataFrame, capacity: int, max_depth: int = 24) -> DataFrame:
    """points(x, y) with `cell`, a long: a leaf of A5's tree over the points' own extent, so that a cell holds at most
    `capacity` points (more at one place, or where max_depth ends). Points without a place are dealt evenly to cells of their own, of about that size.
    """
    lost = points.filter(~placed()).count()
    rest = points.filter(~placed()).withColumn("cell", -1 - F.pmod(F.monotonically_increasing_id(), F.lit(max(1, -(-lost // capacity)))))
    if (found := _tree(points, capacity, max_depth)) is None:
        return rest
    # A number for each leaf: that of its first cell in the finest grid.
    first = lambda c: F.expr(f"shiftleft(_leaf.{c}, {max_depth} - _leaf.depth)")
    return found[0].withColumn("cell", first("cx") * (1 << max_depth) + first("cy")).drop("_leaf").unionByName(rest)


#: Boxes that are broadcast, at most.
FEW_BOXES = 1000


def dense_range_join(points: DataFrame, boxes: DataFrame, capacity: int = 1000, max_depth: int = 24) -> DataFrame:
    """J2 (and J11) for points of any density: as range_join(), but points meet boxes by leaves of A5's tree, which split where
    points are dense, so that no key has more than `capacity` points (but for those at one place). A box goes to the leaves that it meets.
    """
    _own_name(points, boxes)
    finite = points.filter(placed())
    if (found := _tree(points, capacity, max_depth)) is None:
        return finite.join(boxes, F.lit(False))
    dealt, leaves, (x0, y0, side) = found
    # The part of a box that lies within the points' extent, a little enlarged for rounding.
    slack = side * 1e-9
    low = {c: F.greatest(F.col(f"min_{c}") - slack, F.lit(a)) for c, a in (("x", x0), ("y", y0))}
    high = {c: F.least(F.col(f"max_{c}") + slack, F.lit(a + side)) for c, a in (("x", x0), ("y", y0))}
    b = _proper(boxes).filter((low["x"] <= high["x"]) & (low["y"] <= high["y"])).withColumn("_box", F.struct(*BOX))
    # Cells of the depth at which a box is at most as wide as a cell: four at most.
    wide = F.greatest(high["x"] - low["x"], high["y"] - low["y"], F.lit(side / (1 << max_depth)))
    b = b.withColumn("_depth", F.greatest(F.least(F.floor(F.log2(F.lit(side) / wide)), F.lit(max_depth)), F.lit(0)).cast("int"))
    number = lambda v, a: F.least(F.greatest(F.floor((v - a) / (side / F.pow(F.lit(2.0), F.col("_depth")))), F.lit(0)), F.pow(F.lit(2.0), F.col("_depth")) - 1).cast("long")
    span = lambda c, a: F.sequence(number(low[c], a), number(high[c], a))
    own = F.flatten(F.transform(span("x", x0), lambda x: F.transform(span("y", y0), lambda y: F.struct(F.col("_depth").alias("depth"), x.alias("cx"), y.alias("cy")))))
    # A leaf that a box meets is one of these cells or above one, or it lies below one.
    above = F.array_distinct(F.flatten(F.transform(own, lambda c: F.transform(F.sequence(F.lit(0), F.col("_depth")), lambda d: F.struct(d.alias("depth"), _up(c["cx"], F.col("_depth") - d).alias("cx"), _up(c["cy"], F.col("_depth") - d).alias("cy"))))))
    keyed = F.concat(F.transform(above, lambda c: F.struct(F.lit(False).alias("below"), c.alias("c"))), F.transform(own, lambda c: F.struct(F.lit(True).alias("below"), c.alias("c"))))
    asked = b.withColumn(CELL, F.explode(keyed))
    depths = [r["_depth"] for r in b.select("_depth").distinct().collect()]  # max_depth + 1 at most
    under = leaves.select("_leaf", F.explode(F.array(*[F.lit(x) for x in depths]).cast("array<int>")).alias("d")).filter("d < _leaf.depth")
    under = under.select("_leaf", F.struct(F.lit(True).alias("below"), F.struct("d", _up(F.col("_leaf.cx"), F.col("_leaf.depth") - F.col("d")), _up(F.col("_leaf.cy"), F.col("_leaf.depth") - F.col("d"))).cast("struct<depth:int,cx:bigint,cy:bigint>").alias("c")).alias(CELL))
    same = leaves.select("_leaf", F.struct(F.lit(False).alias("below"), F.col("_leaf").cast("struct<depth:int,cx:bigint,cy:bigint>").alias("c")).alias(CELL))
    # Few boxes are broadcast; the leaves are as many as there are places, so they never are.
    found = same.unionByName(under)
    few = len(boxes.select(F.lit(1)).head(FEW_BOXES + 1)) <= FEW_BOXES
    met = F.broadcast(asked).join(found, CELL) if few else asked.join(found.hint("merge"), CELL)
    # A leaf that lies below one of the box's cells may still be beside the box.
    edge = lambda c, a, i: (F.col(f"_leaf.c{c}") + i) * (side / F.pow(F.lit(2.0), F.col("_leaf.depth"))) + a
    beside = [(edge(c, a, 0) > high[c] + slack) | (edge(c, a, 1) < low[c] - slack) for c, a in (("x", x0), ("y", y0))]
    met = met.filter(~(beside[0] | beside[1])).drop(CELL, "_box", "_depth")
    return dealt.join(met, "_leaf").filter(in_box("x", "y", *BOX)).drop("_leaf").select(*points.columns, *boxes.columns)


def _up(c, levels) -> Column:
    """The number of a cell's ancestor, so many levels up."""
    return F.floor(c / F.pow(F.lit(2.0), levels)).cast("long")
