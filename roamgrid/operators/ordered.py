"""The next row of each row by an order within keys, where a key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut

#: Rows of a key that are never cut up.
LEAST = 50_000


def sliced(df: DataFrame, key: str, by: str, limit: int | None = None) -> DataFrame | None:
    """df with `_slice`, numbers that rise with the number `by` within a key, so that a key's slice holds about `limit` rows (more
    only where they agree in `by`). None if no key has more than limit rows.

    The limit is at least a fixed share of all rows for each task, so that the keys to be cut up are few, whatever the
    input; their cuts are quantiles from sketches, and are broadcast.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if limit is None:
        total = counts.agg(F.sum("n")).first()[0] or 0
        limit = max(LEAST, total // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = counts.filter(F.col("n") > limit)
    most = hot.agg(F.max("n")).first()[0]
    if most is None:
        return None
    some = df.join(F.broadcast(hot.select(key)), key, "left_semi")
    # As many cuts as the largest key needs; of a smaller one's every so manieth is kept.
    n = -(-most // limit) + 1
    cuts = some.groupBy(key).agg(F.percentile_approx(by, [i / n for i in range(1, n)], 10 * n).alias("all"), F.count(F.lit(1)).alias("n"))
    step = F.greatest(F.floor(F.lit(n) / (F.ceil(F.col("n") / limit) + 1)), F.lit(1))
    cuts = cut(cuts.select(key, F.filter("all", lambda c, i: (i + 1) % step == 0).alias("_cuts")))
    return df.join(F.broadcast(cuts), key, "left").withColumn("_slice", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(by))), F.lit(0))).drop("_cuts")


def with_next(df: DataFrame, key: str, order: list[str], value: str, out: str, seq: str | None = None, limit: int | None = None) -> DataFrame:
    """df with `out`, the `value` of the next row by `order` within a key (null for the last), and with `seq`, its number from 1.

    order[0] is a number that isn't null. Keys with many rows are cut into slices by it; the first row of a slice is the next one of the
    last row of the slice before, and slices' sizes are added up: a row for each slice meets in a task, not the rows of the key.
    """
    cut_up = sliced(df, key, order[0], limit)
    if cut_up is None:
        w = Window.partitionBy(key).orderBy(*order)
        return df.withColumns({out: F.lead(value).over(w)} | ({seq: F.row_number().over(w)} if seq else {}))
    w = Window.partitionBy(key, "_slice").orderBy(*order)
    rows = cut(cut_up.withColumns({"_at": F.row_number().over(w), "_next": F.lead(value).over(w), "_last": F.lead(F.lit(1)).over(w).isNull()}))
    of_slice = rows.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_at") == 1, F.struct(value))).alias("_first"))
    along = Window.partitionBy(key).orderBy("_slice")
    of_slice = of_slice.withColumns({"_before": F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_onward": F.lead("_first").over(along)})
    joined = rows.join(of_slice.select(key, "_slice", "_before", "_onward"), [key, "_slice"])
    done = joined.withColumn(out, F.when(F.col("_last"), F.col("_onward")[value]).otherwise(F.col("_next")))
    if seq:
        done = done.withColumn(seq, (F.col("_before") + F.col("_at")).cast("int"))
    return done.select(*df.columns, out, *([seq] if seq else []))
