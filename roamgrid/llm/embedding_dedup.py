"""Embedding near-dedup by hierarchical navigable small-world graphs.

Equal vectors of a label are one point with a count. The points of a label are dealt over shards, a
graph is built for each, and blocks of the label's points query every shard of it. A task audits a
sample of its queries against all points of the shard and widens the beam until enough is found.
Links are verified by cosine in double precision; components are the union of links. Within a task
links become stars, so that a dense group never leaves a row for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, join_with_hot
from ._components import components
from ._hnsw import Graph

LEAST = 0.98
#: Points of a graph, and queries of a block, about.
SHARD, BLOCK = 8192, 8192
BEAM, AUDITED, RECALL = 32, 64, 0.995
_KEY = "label long, dim int, shard int"


def _points(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with what identifies their vector (null keys where it links with nothing), and one row per distinct vector."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    # Two hashes of all components and the label stand for the vector.
    rows = rows.withColumn("h1", F.when(F.col("fine"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64(F.reverse("v"), "label", F.lit(1))))
    points = rows.filter("fine").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    return rows, points.withColumn("dim", F.size("v"))


def _build(key: tuple, table: pa.Table) -> pa.Table:
    graph = Graph(*_unit(table), table.column("copies").to_numpy())
    return pa.table({"label": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([key[2].as_py()], pa.int32()), "graph": pa.array([graph.dump()], pa.binary())})


def _unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and points' ids; scaled first, so that squares neither vanish nor overflow."""
    v = np.array(table.column("v").combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True)), table.column("point").to_numpy()


def audited(graph: Graph, queries: np.ndarray, least: float = LEAST, beam: int = BEAM):
    """Blocks of links of the queries, with the beam widened until the recall of a sample is RECALL or the beam is the shard."""
    sample = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    there = np.count_nonzero(queries[sample] @ graph.vectors.T >= least)
    while beam < len(graph.vectors):
        if sum(len(q) for q, _ in graph.within(queries[sample], least, beam)) >= RECALL * there:
            break
        beam *= 2
    return graph.within(queries, least, beam)


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, where every node points to its smallest, with the links (a, b) added."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up


_FOUND = "kind int, a long, b long"


def _query(key: tuple, graphs: pa.Table, queries: pa.Table) -> pa.Table:
    """Kind 0: a point and how many vectors of other points it links with in this shard (b); kind 1: links, as stars."""
    vectors, points = _unit(queries)
    n = np.zeros(len(points), np.int64)
    loaded = [Graph.load(data) for data in graphs.column("graph").to_pylist()]
    nodes = np.unique(np.concatenate([points, *[g.ids for g in loaded]]))
    root, own = np.arange(len(nodes)), np.searchsorted(nodes, points)
    for graph in loaded:
        theirs = np.searchsorted(nodes, graph.ids)
        for q, node in audited(graph, vectors):
            # Verified again pair by pair, in double precision.
            ok = (np.einsum("ij,ij->i", vectors[q], graph.vectors[node]) >= LEAST) & (own[q] != theirs[node])
            q, node = q[ok], node[ok]
            n += np.bincount(q, graph.weights[node], minlength=len(n)).astype(np.int64)
            root = _union(root, own[q], theirs[node])
    led = np.flatnonzero(root != np.arange(len(nodes)))
    some = n > 0
    kind = np.r_[np.zeros(some.sum(), np.int32), np.ones(len(led), np.int32)]
    return pa.table({"kind": pa.array(kind), "a": pa.array(np.r_[points[some], nodes[led]], pa.int64()), "b": pa.array(np.r_[n[some], nodes[root[led]]], pa.int64())})


def link_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, label) to one row per row: vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null and their lengths are equal. A
    vector that is null, empty, zero or holds nulls or non-finite numbers links with nothing. Rows
    that repeat an id are vectors like others. A null id is never the smallest id unless alone. No
    rows in: no rows out. Other columns are ignored.
    """
    rows, points = _points(vectors)
    # Ids may be null or those of several vectors, so points have numbers of their own, which are written with them.
    points = cut(points.withColumn("point", F.monotonically_increasing_id()))
    sizes = points.groupBy("label", "dim").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    p = points.join(sizes, ["label", "dim"]).withColumn("h", F.col("h1"))
    dealt = p.withColumn("shard", F.pmod("h", "shards").cast("int"))
    graphs = dealt.select("label", "dim", "shard", "point", "copies", "v").groupBy("label", "dim", "shard").applyInArrow(_build, f"{_KEY}, graph binary")
    graphs = graphs.join(sizes, ["label", "dim"]).select("label", "dim", "shard", "graph", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = p.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.shiftright("h", 20), F.col("blocks")).cast("int").alias("block"), "point", "v")
    key = ["label", "dim", "shard", "block"]
    found = cut(graphs.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_query, _FOUND))
    counts = found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("n")).withColumnRenamed("a", "point")
    joined = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "point")
    known = points.select("h1", "h2", "point", "least", "copies").join(counts, "point", "left").join(joined, "point", "left")
    known = cut(known.withColumn("root", F.coalesce("component", "point")))
    lowest = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    known = join_with_hot(known, lowest, "root", "rows")
    known = known.select(F.concat_ws(":", "h1", "h2").alias("h"), "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    fine = rows.filter("fine").select("vec_id", F.concat_ws(":", "h1", "h2").alias("h"))
    out = join_with_hot(fine, known, "h", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
