"""Mixing sources to target weights by Pfair windows and earliest deadline first.

Documents of a source are put in a seeded random order and cut into blocks of about `block_size`.
In an ideal mix all sources flow at once, each in proportion to its weight among those that aren't at
their end: when each has flowed `u` per weight, source s has flowed min(w_s u, n_s) of its n_s blocks,
and the sum of these is the slot number. Block j of s is released in the slot in which that flow
reaches j and is due when it reaches j + 1; every slot goes to the released block with the earliest
deadline. Then each source is less than one block away from the ideal mix at every slot, to its end.

Only the sources' totals are gathered. Blocks grow with the corpus beyond MAX_BLOCKS of them, so that
the table of blocks and slots is bounded; the driver makes it from the totals, and it is joined to
the documents, whose blocks follow from prefix sums.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents

#: Weights are whole numbers of this sum, about: over MAX_BLOCKS blocks their rounding is far below one block.
WEIGHTS = 10**9
BLOCK_SIZE = 16384
#: Blocks of all sources, about; above it blocks are larger.
MAX_BLOCKS = 65_536
#: Rows of a source that are ordered by one task, about.
BUCKET_ROWS = 2000
MAX_SOURCES = 10_000
#: Deadlines are compared as whole numbers, in units of the flow per weight.
UNIT = 10**18


def schedule(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) for all blocks, from the number of blocks and the whole weight of each source."""
    names = sorted(blocks)
    # Ends of sources in the order in which the flow reaches them; what has ended by then, and the weight that still flows.
    ends = sorted((Fraction(blocks[s], weights[s]), s) for s in names)
    at = [u for u, _ in ends]
    ended, flowing = [0], [sum(weights.values())]
    for _, s in ends:
        ended.append(ended[-1] + blocks[s])
        flowing.append(flowing[-1] - weights[s])

    def released(s: str, j: int) -> int:
        u = Fraction(j, weights[s])
        k = bisect_right(at, u)
        return ended[k] + flowing[k] * j // weights[s]

    waiting = [(released(s, 0), i) for i, s in enumerate(names)]
    heapify(waiting)
    ready, done, out = [], [0] * len(names), []
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            i = heappop(waiting)[1]
            heappush(ready, ((done[i] + 1) * UNIT // weights[names[i]], i))
        i = heappop(ready)[1]
        out.append((names[i], done[i], slot))
        done[i] += 1
        if done[i] < blocks[names[i]]:
            heappush(waiting, (released(names[i], done[i]), i))
    return out


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    tempering: float = 0.7,
    block_size: int = BLOCK_SIZE,
    seed: str = "0",
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "n_chars",
    carry: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, source, block (of its source, from 0), position (of the block
    in the mix, gapless from 0 over all blocks), or with carry=True all input columns (as _row)
    beside position and the order in the block.

    weights: target weight by source; None: each source's total size to the power `tempering`.
    Every row gets a place: a source that ends early leaves its share to the others in proportion.
    A null source is the source ''. Null and negative sizes count as 0. Rows are ordered in their
    source by md5(seed:id), then id; repeated rows are rows like others. A document lies in the
    block in which it starts, so a very long one uses up several blocks. Blocks are of block_size, or
    of the whole size over MAX_BLOCKS where that is more. Sources that `weights` leaves out raise a
    ValueError, as do weights that aren't positive and more than MAX_SOURCES. No rows in: no rows out.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    buckets = max(1, min(1 << 20, docs.count() // BUCKET_ROWS))
    d = docs.select(
        *([F.struct("*").alias("_row")] if carry else []),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long").alias("size"),
        key.alias("h"),
    ).withColumn("bucket", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long"))
    # Prefix sums in two levels, so that a source with a third of all rows is summed by many tasks.
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        weights = {s: max(1, n) ** tempering for s, n in totals.items()}
    if missing := sorted(s for s in totals if not weights.get(s, 0) > 0):
        raise ValueError(f"no weight for sources {missing[:5]}")
    if not totals:
        return d.select("doc_id", "source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("position"), *(["_row", F.lit(0).cast("long").alias("start")] if carry else []))
    whole = sum(weights[s] for s in sorted(totals))
    size = max(block_size, -(-sum(totals.values()) // MAX_BLOCKS))
    blocks = {s: max(1, -(-n // size)) for s, n in totals.items()}
    slots = schedule(blocks, {s: max(1, round(weights[s] / whole * WEIGHTS)) for s in totals})
    table = spark.createDataFrame(slots, "source string, block long, position long")  # MAX_BLOCKS + MAX_SOURCES rows at most
    last = spark.createDataFrame([(s, n - 1) for s, n in blocks.items()], "source string, last long")
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = d.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, ["source", "bucket"])
    placed = placed.join(F.broadcast(last), "source").withColumn("block", F.least(F.expr(f"(offset + inside) div {size}"), F.col("last")))
    out = placed.join(F.broadcast(table), ["source", "block"])
    return out.select("doc_id", "source", "block", "position", *(["_row", (F.col("offset") + F.col("inside")).alias("start")] if carry else []))


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs with the same columns and rows, dealt and sorted in the order of the mix, so that files
    written from it (and readers that go through them in order) follow the target weights."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mix(docs, carry=True, **options).repartitionByRange(n, "position", "start").sortWithinPartitions("position", "start").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, greatest(coalesce(n_chars, 0), 0) AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
z AS (SELECT greatest({BLOCK_SIZE}, (sum(total) + {MAX_BLOCKS - 1}) // {MAX_BLOCKS})::BIGINT AS b FROM t),
w AS (SELECT source, greatest(1, (total + b - 1) // b) AS n, b, power(greatest(total, 1)::DOUBLE, 0.7) AS w FROM t, z),
q AS (SELECT source, n, b, greatest(1, round_even(w / (SELECT sum(w) FROM w) * {WEIGHTS}, 0))::BIGINT AS q FROM w),
l AS (SELECT list(source ORDER BY source) AS ss, list(n ORDER BY source) AS ns, list(q ORDER BY source) AS ws, sum(n)::BIGINT AS slots FROM q),
e AS (
  SELECT 0::BIGINT AS k, ss, ns, ws, slots, list_transform(ns, lambda x: 0::BIGINT) AS nx, 0::BIGINT AS pick FROM l
  UNION ALL
  SELECT k + 1, ss, ns, ws, slots, list_transform(nx, lambda v, i: CASE WHEN i = p THEN v + 1 ELSE v END), p
  FROM (SELECT *, (list_min(list_filter(list_transform(ws, lambda x, i: CASE WHEN nx[i] < ns[i] AND list_sum(list_transform(ws, lambda y, r: least(y::HUGEINT * nx[i], ns[r]::HUGEINT * x))) < (k + 1)::HUGEINT * x
        THEN ((nx[i] + 1)::HUGEINT * {UNIT} // x) * 100000 + i END), lambda v: v IS NOT NULL)) % 100000)::BIGINT AS p FROM e WHERE k < slots)),
s AS (SELECT ss[pick] AS source, row_number() OVER (PARTITION BY pick ORDER BY k) - 1 AS block, k - 1 AS position FROM e WHERE k > 0),
b AS (
  SELECT doc_id, source, least(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // b, n - 1) AS block
  FROM d JOIN q USING (source))
SELECT doc_id, source, block, position FROM b JOIN s USING (source, block)
"""
