"""Aggregations (A1 to A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import shard_id
from ..plans.cut import cut

#: Parts of a range in one round of exact_quantiles.
SPLITS = 4096


def shard_counts(snapshot: DataFrame, n: int) -> DataFrame:
    """A1: points per shard, and their total under shard null."""
    return snapshot.rollup(shard_id("vehicle_id", n).alias("shard")).agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, value: str, group: str, ps: tuple) -> DataFrame:
    """(group, p, v): the smallest value whose rank is at least p times the group's number of values.

    Values are counted once; then each round cuts the range that holds the rank into SPLITS parts and
    goes on with one of them, so that no task ever holds the values of a group.
    """
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n")))
    of = counts.groupBy("g").agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    widest = of.agg(F.max(F.expr("high - low"))).first()[0]
    state = of.select("g", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.ceil(F.lit(p) * F.col("n")).cast("long").alias("rank")) for p in ps])).alias("q"), "low", "high").select("g", "q.*", "low", "high")
    while widest is not None and widest > 0:
        state = state.withColumn("width", F.expr(f"(high - low) div {SPLITS} + 1"))
        part = F.expr("(v - low) div width").alias("part")
        parts = counts.join(state, "g").filter("v between low and high").groupBy("g", "p", "rank", "low", "high", "width", part).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "p").orderBy("part"))  # SPLITS rows at most
        hit = parts.withColumn("upto", upto).filter("upto >= rank and upto - n < rank")
        at = F.col("low") + F.col("part") * F.col("width")
        state = cut(hit.select("g", "p", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), at.alias("low"), F.least(at + F.col("width") - 1, "high").alias("high")))
        widest = widest // SPLITS
    return state.select(F.col("g").alias(group), "p", F.col("low").alias("v"))


def latency_summary(df: DataFrame, value_ns: str = "ns", group: str = "grp", exact: bool = True) -> DataFrame:
    """A2: nearest-rank p50, p95, p99 and mean in ms, and count; exact=False uses sketches, whose size
    doesn't grow with the data. A null group is a group like others."""
    ps = (0.5, 0.95, 0.99)
    marked = df.withColumn(group, F.struct(F.col(group).alias("key"))) if exact else df  # a struct around null is equal to itself
    sums = [F.sum(value_ns).alias("total"), F.count(value_ns).alias("n")]
    if exact:
        q = exact_quantiles(marked, value_ns, group, ps).groupBy(group).agg(*[(F.max(F.when(F.col("p") == p, F.col("v"))) / 1e6).alias(f"p{round(p * 100)}") for p in ps])
        agg = marked.groupBy(group).agg(*sums).join(q, group, "left").withColumn(group, F.col(group)["key"])
    else:
        agg = df.groupBy(group).agg(*[(F.percentile_approx(value_ns, p, 10000) / 1e6).alias(f"p{round(p * 100)}") for p in ps], *sums)
    mean = F.col("total") / F.col("n") / 1e6
    return agg.select(group, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p95", "p99")], F.coalesce(F.when(F.col("n") > 0, mean), F.lit(0.0)).alias("mean"), "n")


#: Size of a sketch: for 800, ranks are off by less than SKETCH_ERROR of all rows, with a probability of 99 % for each quantile.
SKETCH_K, SKETCH_ERROR = 800, 0.01


def latency_sketches(df: DataFrame, value_ns: str = "ns", group: str = "grp", ts_ms: str = "ts_ms", shard: str | None = None, width_ms: int = 60_000, k: int = SKETCH_K) -> DataFrame:
    """A2 in parts that can be kept: one row for each group, shard and stretch of time with a KLL sketch as binary (null without values), sum and count."""
    at = (F.expr(f"{ts_ms} div {width_ms}") * width_ms).alias("window_ms")
    keys = [F.col(group), at, *([F.col(shard).alias("shard")] if shard else [])]
    value = F.col(value_ns).cast("long")
    return df.groupBy(*keys).agg(F.kll_sketch_agg_bigint(value, k).alias("sketch"), F.sum(value).alias("total"), F.count(value).alias("n"))


def summary_of_sketches(sketches: DataFrame, group: str = "grp", from_ms: int | None = None, to_ms: int | None = None, k: int = SKETCH_K) -> DataFrame:
    """A2 for any period [from_ms, to_ms) of whole stretches, from latency_sketches() merged: columns as latency_summary();
    quantiles' ranks are within SKETCH_ERROR, mean and count are exact."""
    some = sketches
    if from_ms is not None:
        some = some.filter(F.col("window_ms") >= from_ms)
    if to_ms is not None:
        some = some.filter(F.col("window_ms") < to_ms)
    every = some.groupBy(group).agg(F.kll_merge_agg_bigint(F.when(F.col("n") > 0, F.col("sketch")), k).alias("s"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    at = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("s", F.lit(p)) / 1e6).otherwise(0.0)
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n") / 1e6).otherwise(0.0)
    return every.select(group, at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), mean.alias("mean"), "n")


def throughput(df: DataFrame, ts_ms: str = "ts_ms", group: str = "grp") -> DataFrame:
    """A3: rows per second between the first and the last; null if they coincide."""
    seconds = (F.max(ts_ms) - F.min(ts_ms)) / 1000
    return df.groupBy(group).agg(F.try_divide(F.count("*"), seconds).alias("throughput"))


def update_rate(df: DataFrame, width: str = "1 second", n: int = 2, ts_ms: str = "ts_ms") -> DataFrame:
    """A4, T5: updates per shard and window; on a stream give it a watermark on `ts` first."""
    if "ts" not in df.columns:
        df = df.withColumn("ts", F.timestamp_millis(ts_ms))
    w = df.groupBy(F.window("ts", width).alias("w"), shard_id("vehicle_id", n).alias("shard")).agg(F.count("*").alias("n"))
    return w.select(F.unix_millis("w.start").alias("window_ms"), "shard", "n")


def summary_lines(df: DataFrame) -> DataFrame:
    """Columns name, throughput, p50, p95, p99, mean as formatted text."""
    return df.select("name", F.format_string("%.1f", "throughput").alias("throughput"), *[F.format_string("%.2f", c).alias(c) for c in ("p50", "p95", "p99", "mean")])
