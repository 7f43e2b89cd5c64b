"""Column functions: predicates, projections and scalar formulas (F1 to F14). All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The default map.
BOUNDS = (0.0, 0.0, 1000.0, 1000.0)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def in_box(x, y, min_x, min_y, max_x, max_y) -> Column:
    """closed on all sides. Both bounds are tested, so NaN is never inside."""
    return _c(x).between(_c(min_x), _c(max_x)) & _c(y).between(_c(min_y), _c(max_y))


def boxes_meet(a, b) -> Column:
    """closed boxes (tuples of four columns) intersect; touching counts."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = [[_c(v) for v in t] for t in (a, b)]
    return (ax0 <= bx1) & (bx0 <= ax1) & (ay0 <= by1) & (by0 <= ay1)


def point_in_polygon(x, y, polygon) -> Column:
    """even-odd rule over array<struct<x,y>>; fewer than 3 vertices hold nothing. A point that is NaN is outside."""
    x, y, p = _c(x), _c(y), _c(polygon)
    n = F.size(p)

    def crosses(i):
        a, b = F.get(p, i), F.get(p, F.when(i == 0, n - 1).otherwise(i - 1))
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    odd = F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1
    return F.coalesce(F.when((n >= 3) & ~F.isnan(x) & ~F.isnan(y), odd), F.lit(False))


def dist2(ax, ay, bx, by) -> Column:
    """squared planar distance."""
    dx, dy = _c(ax) - _c(bx), _c(ay) - _c(by)
    return dx * dx + dy * dy


def dist(ax, ay, bx, by) -> Column:
    return F.sqrt(dist2(ax, ay, bx, by))


def grid_cell(x, y, bounds=BOUNDS, nx: int = 50, ny: int = 50, clamp: bool = True) -> Column:
    """struct(cx, cy); truncates and clamps to edge cells, or with clamp=False floors without limits."""
    x0, y0, x1, y1 = bounds
    out = []
    for v, low, high, n, name in ((_c(x), x0, x1, nx, "cx"), (_c(y), y0, y1, ny, "cy")):
        q = (v - low) / ((high - low) / n)
        out.append((F.greatest(F.lit(0), F.least(F.lit(n - 1), q.cast("int"))) if clamp else F.floor(q).cast("long")).alias(name))
    return F.struct(*out)


def quad_index(v, low: float, high: float, depth: int) -> Column:
    """Number of v's half-open slice of 2**depth equal ones; the upper bound belongs to the last. Exact where the slices' width is a power of two times a float without rounding; else the last bit may differ from repeated halving."""
    return F.least(F.floor((_c(v) - low) / ((high - low) / (1 << depth))), F.lit((1 << depth) - 1)).cast("long")


def quad_key(x, y, bounds=BOUNDS, depth: int = 8) -> Column:
    """path of quadrants from the root, 0 = NW, 1 = NE, 2 = SW, 3 = SE; north is the larger y, and a midpoint belongs to the upper and right side."""
    ix, iy = quad_index(x, bounds[0], bounds[2], depth), quad_index(y, bounds[1], bounds[3], depth)
    digit = lambda i: (1 - (F.shiftright(iy, depth - i) % 2)) * 2 + F.shiftright(ix, depth - i) % 2
    return F.concat_ws("", *[digit(i).cast("string") for i in range(1, depth + 1)])


def quad_code(x, y, bounds=BOUNDS, depth: int = 16) -> Column:
    """F7 as a number of 2 x depth bits: the digits of quad_key(), so that it sorts as they do. Points outside bounds have their nearest cell's."""
    ix, iy = (F.greatest(quad_index(v, low, high, depth), F.lit(0)) for v, low, high in ((x, bounds[0], bounds[2]), (y, bounds[1], bounds[3])))
    bit = lambda i, n: F.shiftleft(F.shiftright(i, n).bitwiseAND(F.lit(1)), 2 * n)
    out = F.lit(0).cast("long")
    for n in range(depth):
        out = out + bit(ix, n) + F.shiftleft(F.lit(1).cast("long"), 2 * n + 1) - F.shiftleft(bit(iy, n), 1)
    return out


def shard_id(c, n: int) -> Column:
    """F8."""
    return F.abs(_c(c)) % n


def viewport_box(w, h, cx, cy, scale) -> list[Column]:
    """min_x, min_y, max_x, max_y of what a screen of w x h pixels shows around (cx, cy)."""
    w, h, cx, cy, s = (_c(v) for v in (w, h, cx, cy, scale))
    return [(cx - w / 2 / s).alias("min_x"), (cy - h / 2 / s).alias("min_y"), (cx + w / 2 / s).alias("max_x"), (cy + h / 2 / s).alias("max_y")]


def to_screen(x, y, min_x, min_y, scale) -> list[Column]:
    """whole pixels, truncated."""
    return [((_c(v) - _c(low)) * _c(scale)).cast("int").alias(n) for v, low, n in ((x, min_x, "sx"), (y, min_y, "sy"))]


def on_screen(sx, sy, w, h) -> Column:
    """F11."""
    return (_c(sx) >= 0) & (_c(sx) < _c(w)) & (_c(sy) >= 0) & (_c(sy) < _c(h))


def to_world(sx, sy, min_x, min_y, scale) -> list[Column]:
    """F12."""
    return [(_c(s) / _c(scale) + _c(low)).alias(n) for s, low, n in ((sx, min_x, "x"), (sy, min_y, "y"))]


def vehicle_line(vehicle_id="vehicle_id", x="x", y="y") -> Column:
    """one line of text for a vehicle."""
    return F.format_string("Vehicle %d: (%.1f, %.1f)", vehicle_id, x, y)


def pick_line(vehicle_id="vehicle_id", x="x", y="y", distance="distance") -> Column:
    return F.format_string("Vehicle %d: (%.1f, %.1f) dist %.2f", vehicle_id, x, y, distance)


def relative_bar(df: DataFrame, value: str, width: int = 40) -> DataFrame:
    """adds `bar`, int(width * value / largest value) signs. The largest is one row, found with partial aggregates and broadcast."""
    most = df.agg(F.max(value).alias("_most"))
    n = F.coalesce(F.try_divide(F.col(value) * width, F.col("_most")).cast("int"), F.lit(0))
    return df.join(F.broadcast(most)).withColumn("bar", F.repeat(F.lit("="), n)).drop("_most")


def valid_point(x="x", y="y", bounds=BOUNDS) -> Column:
    return in_box(x, y, *bounds)


def validate_updates(df: DataFrame, bounds=BOUNDS) -> DataFrame:
    """Updates with an id and finite coordinates on the map; also on streams."""
    return df.filter(valid_point(bounds=bounds) & (F.col("vehicle_id") != F.lit(-(2**63))))


def rejected_updates(df: DataFrame, bounds=BOUNDS) -> DataFrame:
    """all others, with `reason`: nan_or_inf (null too), out_of_bounds or bad_id (null, or the smallest long, which has no absolute value)."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    no_id = F.col("vehicle_id").isNull() | (F.col("vehicle_id") == F.lit(-(2**63)))
    reason = F.when(bad("x") | bad("y"), "nan_or_inf").when(~valid_point(bounds=bounds), "out_of_bounds").when(no_id, "bad_id")
    return df.withColumn("reason", reason).filter("reason is not null")
