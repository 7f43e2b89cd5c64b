"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, partitions


def local_roots(a, b) -> dict[int, int]:
    """Smallest node reachable, for each node of the links (a, b)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def _stars(batches):
    """Links of a task to as few as keep its components: (node, its smallest)."""
    a, b = [], []
    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
        if len(a) > 2_000_000:
            roots = local_roots(a, b)
            a, b = list(roots), list(roots.values())
    roots = {x: r for x, r in local_roots(a, b).items() if x != r}
    yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], names=["a", "b"])


#: Links that a task takes of one node at least, before the node's links are split; otherwise a share of all.
LEAST_PART = 64


def _dealt(now: DataFrame, total: int, n: int) -> DataFrame:
    """Links by both ends, in n partitions. The links of a node with more than a part of them are split,
    and its link with its smallest neighbour goes to every part, so that all of them see it."""
    part = max(LEAST_PART, total // (8 * n))
    spread = now.select(F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("other")), F.struct(F.col("b").alias("k"), F.col("a").alias("other")))).alias("e")).select("e.*")
    counts = spread.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("low"))
    hubs = counts.filter(F.col("n") > part).select("k", "low", F.ceil(F.col("n") / part).cast("int").alias("parts"))  # 2 * total / part nodes at most
    salted = spread.join(F.broadcast(hubs), "k", "left").select("k", "other", F.coalesce(F.pmod(F.xxhash64("other"), "parts"), F.lit(0)).cast("int").alias("salt"))
    lowest = hubs.select("k", F.col("low").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    return salted.unionByName(lowest).repartition(n, "k", "salt").select(F.col("k").alias("a"), F.col("other").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, component): the smallest node reachable, for each node that isn't its
    component's smallest.

    Each round sends a link to the tasks of both its ends, and each task replaces its links by stars
    around its smallest nodes; that ends when nothing changes any more, which takes about the
    logarithm of the longest path. Links shrink to one for each node. No task takes all links of a hub.
    """
    n = partitions(links.sparkSession)
    kind = "a long, b long"
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = cut(links.select("a", "b").filter("a <> b").mapInArrow(_stars, kind).distinct())
    seen = mark(now)
    while True:
        now = cut(_dealt(now, seen[0], n).mapInArrow(_stars, kind).distinct())
        if (new := mark(now)) == seen:
            return now.toDF("node", "component")
        seen = new
