"""Batched routing over node and edge tables.

Costs are searched for all sources at once. A graph of at most LOCAL_EDGES edges is sent to the tasks, each of
which searches for its sources; larger ones go by hops, in which only what the last hop improved is shuffled.
An overlay makes large graphs small: nodes are dealt to cells, each cell is searched once, and what remains
is the graph of the nodes at which paths enter cells.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import dist, to_screen
from ..plans.cut import cut, discard, remove, shared_dir
from .search import Graph
from .spatial import leaf_cells, placed, snap_to_node

#: Edges of a graph that is sent to tasks whole: some 24 MB. Hops after which bounds are made anew.
LOCAL_EDGES, BOUND_EVERY = 1_000_000, 6
#: Slack of lower bounds, for rounding.
SLACK = 1 - 1e-9


def out_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave nodes(node_id)."""
    return edges.join(nodes.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "weight")


def least_edges(edges: DataFrame) -> DataFrame:
    """The least of parallel edges, written; raises ValueError for weights that are negative or missing."""
    edges = cut(edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight"), F.count_if(F.expr("weight < 0 or weight is null or isnan(weight)")).alias("bad")))
    if not edges.filter("bad > 0").isEmpty():
        raise ValueError("negative or missing weights")
    return edges.drop("bad")


def distances(sources: DataFrame, edges: DataFrame, max_rounds: int = 10_000, goals: DataFrame | None = None, nodes: DataFrame | None = None, local_edges: int = LOCAL_EDGES, previous: bool = False) -> DataFrame:
    """(source, node, dist): least cost from each of sources(source) to each node that it reaches; with `previous`
    also prev, the predecessor that shortest_path_nodes() takes. Weights must not be negative or null.

    With goals(source, goal) and nodes the result is final for goals and for what lies on the way to them only. More
    than max_rounds hops raise an error. Graphs of more than local_edges edges are searched by hop_distances().
    """
    edges = least_edges(edges)
    wanted = sources.select("source").filter("source is not null").distinct()
    if edges.count() > local_edges:
        found = hop_distances(wanted, edges, max_rounds, goals, nodes)
        return with_previous(found, edges) if previous else found
    return local_distances(wanted, edges, max_rounds, previous)


def local_distances(sources: DataFrame, edges: DataFrame, max_rounds: int, previous: bool = False) -> DataFrame:
    """distances() for edges few enough to be sent to every task; each searches for the sources that it is dealt."""
    spark = sources.sparkSession
    table = edges.toArrow()  # at most LOCAL_EDGES rows
    graph = Graph(*[table.column(c).to_numpy() for c in ("src", "dst", "weight")])
    shared = spark.sparkContext.broadcast(graph)
    names = ["source", "node", "dist", *(["prev"] if previous else [])]

    def run(batches):
        g = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at, known = g.place(ids)
            # A source without edges reaches itself.
            lone = pa.array(ids[~known])
            yield pa.RecordBatch.from_arrays([lone, lone, pa.array(np.zeros(len(lone))), pa.nulls(len(lone), pa.int64())][: len(names)], names=names)
            at = at[known]
            for i in range(0, len(at), g.chunk()):
                some = at[i : i + g.chunk()]
                costs = g.costs(some, max_rounds)
                if costs is None:
                    none = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(1, pa.float64()), none][: len(names)], names=names)
                    return
                row, node = np.nonzero(np.isfinite(costs))
                out = [pa.array(g.ids[some[row]]), pa.array(g.ids[node]), pa.array(costs[row, node])]
                if previous:
                    prev = g.predecessors(some, costs)[row, node]
                    none = prev == np.iinfo(np.int64).max
                    out.append(pa.array(g.ids[np.where(none, 0, prev)], mask=none))
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "source long, node long, dist double" + (", prev long" if previous else "")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = cut(sources.repartition(tasks, "source").mapInArrow(run, schema))
    if not found.filter("dist is null").isEmpty():
        raise RuntimeError(f"costs still change after {max_rounds} hops")
    return found


def hop_distances(sources: DataFrame, edges: DataFrame, max_rounds: int, goals: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """distances() by hops. Costs go to a table in buckets by (source, node), which only grows: a hop shuffles what
    the one before improved, along edges, and compares it with the table where that lies.

    With goals, rows whose lower bound of the cost to any goal of their source exceeds the dearest of these goals' best known costs
    don't go on; bounds are made anew every BOUND_EVERY hops. The bound is the straight line to the box of the source's
    goals, times the least weight of an edge per length. A goal that isn't reached yet may cost anything, so its source goes on.
    """
    spark = sources.sparkSession
    near = None
    if goals is not None:
        # What a row needs for its bound: coordinates of its node, the box of its source's goals. Nodes without a place
        # have no line to them: where edges lead there, or none has a length, bounds are the costs so far.
        at = cut(nodes.filter(placed()).groupBy("node_id").agg(F.max(F.struct("x", "y")).alias("p")).select(F.col("node_id").alias("node"), "p.x", "p.y"))
        ends = lambda k, s: at.select(F.col("node").alias(k), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
        line = edges.join(ends("src", "a"), "src", "left").join(ends("dst", "b"), "dst", "left").withColumn("length", dist("ax", "ay", "bx", "by"))
        found = line.agg(F.min(F.expr("case when length > 0 then weight / length end")).alias("least"), F.count_if(F.col("length").isNull()).alias("lost")).first()
        per_length = 0.0 if found["lost"] or found["least"] is None else found["least"]
        corner = lambda c, none: F.coalesce(c, F.lit(none))
        goals = cut(goals.distinct())
        boxed = goals.join(at.withColumnRenamed("node", "goal"), "goal", "left").groupBy("source").agg(*[f(corner(c, none)).alias(f"{n}{c}") for c in "xy" for f, n, none in ((F.min, "low_", -float("inf")), (F.max, "high_", float("inf")))])
        boxed = cut(boxed)
        away = lambda c: F.coalesce(F.greatest(F.col(f"low_{c}") - F.col(c), F.col(c) - F.col(f"high_{c}"), F.lit(0.0)), F.lit(0.0))
        bound = F.col("dist") + SLACK * per_length * F.sqrt(away("x") * away("x") + away("y") * away("y"))
    name = f"costs_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(rows, hop):
        new = rows.select("source", "node", "dist", F.lit(hop).alias("hop"))
        new.write.mode("append").format("parquet").partitionBy("hop").bucketBy(parts, "source", "node").option("path", path).saveAsTable(name)

    best = lambda: spark.table(name).groupBy("source", "node").agg(F.min("dist").alias("old"))
    add(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist")), 0)
    try:
        for hop in range(1, max_rounds + 2):
            front = spark.table(name).filter(F.col("hop") == hop - 1).select("source", "node", "dist")
            if near is not None:
                line = front.join(at, "node", "left").join(near, "source", "left")
                front = line.filter(F.coalesce(bound <= F.col("most"), F.lit(False))).select("source", "node", "dist")
            moved = front.join(edges, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("dist"))
            better = moved.join(best(), ["source", "node"], "left").filter("old is null or dist < old")
            if hop > max_rounds:
                if better.isEmpty():
                    break
                raise RuntimeError(f"costs still change after {max_rounds} hops")
            add(better, hop)
            if spark.table(name).filter(F.col("hop") == hop).isEmpty():
                break
            if goals is not None and hop % BOUND_EVERY == 0:
                reached = goals.join(best().withColumnsRenamed({"node": "goal", "old": "cost"}), ["source", "goal"], "left")
                if near is not None:
                    discard(near)
                near = cut(boxed.join(reached.groupBy("source").agg(F.max(F.coalesce("cost", F.lit(float("inf")))).alias("most")), "source"))
        return cut(best().withColumnRenamed("old", "dist"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def shortest_path_cost(requests: DataFrame, nodes: DataFrame, edges: DataFrame, reached: DataFrame | None = None, capacity: int | None = None) -> DataFrame:
    """request_id, total_cost, found for requests(request_id, src, dst).

    The same node costs 0 even if unknown; unknown nodes, unreachable ones and nulls cost 0 with found = false. With
    `capacity` costs come from an overlay of cells of at most so many nodes; their sums are rounded in another order.
    """
    if reached is None:
        reached = overlay_costs(requests, nodes, edges, capacity) if capacity else reach(requests, nodes, edges)
    r = requests.select("request_id", "src", "dst").join(reached.select(F.col("source").alias("src"), F.col("node").alias("dst"), "dist"), ["src", "dst"], "left")
    same = F.coalesce(F.col("src") == F.col("dst"), F.lit(False))
    return r.select("request_id", F.when(same, 0.0).otherwise(F.coalesce("dist", F.lit(0.0))).alias("total_cost"), (same | F.col("dist").isNotNull()).alias("found"))


#: What a row of a cell's group says: an edge, or that node `a` is entered, is left, starts or ends paths, or a request from a to b.
_EDGE, _IN, _OUT, _START, _END, _PAIR = range(6)


def _search_cell(table: pa.Table) -> pa.Table:
    """(kind, a, b, cost) of one cell: from where paths enter or start to where they leave or end, and of requests within the cell."""
    kind, a, b = (table.column(c).to_numpy() for c in ("kind", "a", "b"))
    w, cell = table.column("w").to_numpy(), table.column("cell")[0].as_py()
    of = lambda k: np.unique(a[kind == k])
    link = kind == _EDGE
    graph = Graph(a[link], b[link], w[link], np.concatenate([a[~link], b[kind == _PAIR]]))
    enter, leave, start, end = (of(k) for k in (_IN, _OUT, _START, _END))
    pairs = np.unique(np.stack([a[kind == _PAIR], b[kind == _PAIR]]), axis=1)
    sources = np.union1d(enter, start)
    out: list = [[], [], [], []]
    for i in range(0, len(sources), graph.chunk()):
        some = sources[i : i + graph.chunk()]
        costs = graph.costs(graph.place(some)[0], len(graph.ids) + 1)

        def emit(k, froms, tos, costs=costs, some=some):
            row = np.flatnonzero(np.isin(some, froms))
            part = costs[np.ix_(row, graph.place(tos)[0])]
            r, c = np.nonzero(np.isfinite(part))
            for column, values in zip(out, (np.full(len(r), k), some[row[r]], tos[c], part[r, c]), strict=True):
                column.append(values)

        emit(_OUT, sources, leave)
        emit(_END, enter, end)
        own = np.isin(pairs[0], some)
        cost = costs[np.searchsorted(some, pairs[0][own]), graph.place(pairs[1][own])[0]]
        own_pairs, fine = pairs[:, own], np.isfinite(cost)
        for column, values in zip(out, (np.full(fine.sum(), _PAIR), own_pairs[0][fine], own_pairs[1][fine], cost[fine]), strict=True):
            column.append(values)
    arrays = [np.concatenate(c) if c else np.zeros(0) for c in out]
    kinds = (np.int32, np.int64, np.int64, np.float64)
    arrays = [x.astype(k) for x, k in zip(arrays, kinds, strict=True)]
    return pa.table([pa.array(np.full(len(arrays[0]), cell)), *map(pa.array, arrays)], names=["cell", "kind", "a", "b", "cost"])


def overlay_costs(requests: DataFrame, nodes: DataFrame, edges: DataFrame, capacity: int, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(source, node, dist) for the pairs of ends of requests(src, dst) that are connected, by an overlay.

    Nodes are dealt to cells of at most `capacity` nodes by their place (more only at one place). One task a cell
    searches it, without edges that leave it. The overlay's edges lead from where a path enters a cell to where it
    enters the next: the state of the search has a row for each source and entered node, not for each node.
    """
    near = least_edges(known_edges(nodes, edges))
    cell_of = cut(leaf_cells(nodes.groupBy("node_id").agg(F.max(F.struct("x", "y")).alias("p")).select("node_id", "p.x", "p.y"), capacity).select(F.col("node_id").alias("node"), "cell"))
    at = lambda key, name: cell_of.withColumnsRenamed({"node": key, "cell": name})
    pairs = requests.filter("src <> dst").select("src", "dst").distinct().join(at("src", "from"), "src").join(at("dst", "to"), "dst")
    pairs = cut(pairs)
    links = cut(near.join(at("src", "from"), "src").join(at("dst", "to"), "dst"))
    within, across = links.filter(F.col("from") == F.col("to")), links.filter(F.col("from") != F.col("to"))
    none = F.lit(None)
    says = lambda df, cell, kind, a, b=none, w=none: df.select(F.col(cell).alias("cell"), F.lit(kind).alias("kind"), F.col(a).alias("a"), b.cast("long").alias("b"), w.cast("double").alias("w"))
    rows = says(within, "from", _EDGE, "src", F.col("dst"), F.col("weight"))
    for df in (says(across, "to", _IN, "dst").distinct(), says(across, "from", _OUT, "src").distinct(), says(pairs, "from", _START, "src").distinct(), says(pairs, "to", _END, "dst").distinct(), says(pairs.filter(F.col("from") == F.col("to")), "from", _PAIR, "src", F.col("dst"))):
        rows = rows.unionByName(df)
    solved = cut(rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("b", "w")}).groupBy("cell").applyInArrow(_search_cell, "cell long, kind int, a long, b long, cost double"))
    leave = solved.filter(F.col("kind") == _OUT).select(F.col("a").alias("src"), F.col("b").alias("via"), "cost")
    onward = leave.join(across.select(F.col("src").alias("via"), F.col("dst"), "weight"), "via").groupBy("src", "dst").agg(F.min(F.col("cost") + F.col("weight")).alias("weight"))
    entered = distances(pairs.select(F.col("src").alias("source")).distinct(), onward, local_edges=local_edges)
    ends = solved.filter(F.col("kind") == _END).select(F.col("a").alias("node"), F.col("b").alias("dst"), "cost")
    # A request meets the nodes at which its goal's cell is entered. The source itself counts as such a node only if it is one.
    through = pairs.select("src", "dst").join(ends, "dst").join(entered.withColumnRenamed("source", "src"), ["src", "node"]).select("src", "dst", (F.col("dist") + F.col("cost")).alias("dist"))
    direct = solved.filter(F.col("kind") == _PAIR).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("cost").alias("dist"))
    return through.unionByName(direct).groupBy(F.col("src").alias("source"), F.col("dst").alias("node")).agg(F.min("dist").alias("dist"))


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def reach(requests: DataFrame, nodes: DataFrame, edges: DataFrame, previous: bool = False) -> DataFrame:
    """distances() from the sources of requests, final for their destinations and what lies on the way."""
    ids = nodes.select("node_id").distinct()
    goals = requests.filter("src <> dst").select(F.col("src").alias("source"), F.col("dst").alias("goal")).distinct()
    goals = goals.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "goal"), "goal", "left_semi")
    return distances(goals.select("source"), known_edges(nodes, edges), goals=goals, nodes=nodes, previous=previous)


def with_previous(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node, dist, prev) for (source, node, dist): the smallest predecessor on a best path, null for the source.

    A predecessor costs less than the node. Nodes that only edges of weight 0 reach at their cost get
    one of equal cost that has a predecessor already, so that no path runs in a circle.
    """
    near = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    ends = reached.select("source", F.col("node").alias("dst"), F.col("dist").alias("end"))
    tight = reached.join(near, F.col("node") == F.col("src")).join(ends, ["source", "dst"]).filter((F.col("dist") + F.col("weight") == F.col("end")) & (F.col("source") != F.col("dst")))
    tight = cut(tight.select("source", "src", F.col("dst").alias("node"), (F.col("dist") < F.col("end")).alias("less")))
    smallest = lambda df: df.groupBy("source", "node").agg(F.min("src").alias("prev"))
    before = cut(smallest(tight.filter("less")))
    level = tight.filter("not less").join(before, ["source", "node"], "left_anti")
    while not level.isEmpty():
        known = before.select("source", F.col("node").alias("src")).unionByName(reached.select("source", F.col("source").alias("src")).distinct())
        more = cut(smallest(level.join(known, ["source", "src"], "left_semi")))
        if more.isEmpty():
            break
        longer, rest = cut(before.unionByName(more)), cut(level.join(more, ["source", "node"], "left_anti"))
        discard(before, more)
        before, level = longer, rest
    return reached.select("source", "node", "dist").join(before, ["source", "node"], "left")


def shortest_path_nodes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """request_id, seq (from 0), node_id along each path; of equally good predecessors the smallest id.

    By pointer doubling: `up` has each node's ancestor 2**k steps back in its source's tree of predecessors. What is known of
    paths, the last 2**k nodes, is carried 2**k steps back at once, so that a path of n nodes takes log2(n) rounds.
    """
    if reached is None:
        reached = reach(requests, nodes, edges, previous=True)
    elif "prev" not in reached.columns:
        reached = with_previous(reached, known_edges(nodes, edges))
    up = cut(reached.filter("prev is not null").select("source", "node", F.col("prev").alias("up")))
    # One path for each pair of ends, whatever the number of requests.
    ends = requests.filter("src <> dst").select(F.col("src").alias("source"), F.col("dst").alias("node")).distinct()
    new = cut(ends.join(reached.select("source", "node"), ["source", "node"], "left_semi").select("source", F.col("node").alias("goal"), "node", F.lit(0).alias("back")))
    step, parts = 1, [new]
    while True:
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        new = cut(every.join(up, ["source", "node"]).select("source", "goal", F.col("up").alias("node"), (F.col("back") + step).alias("back")))
        if new.isEmpty():
            break
        parts.append(new)
        far = up.select("source", F.col("node").alias("low"), F.col("up").alias("node"))
        farther = cut(far.join(up, ["source", "node"]).select("source", F.col("low").alias("node"), "up"))
        discard(up)
        up = farther
        step *= 2
    discard(up, new)
    length = every.groupBy("source", "goal").agg(F.max("back").alias("length"))
    path = requests.select("request_id", F.col("src").alias("source"), F.col("dst").alias("goal")).join(length, ["source", "goal"]).join(every, ["source", "goal"])
    same = requests.filter("src = dst").select("request_id", F.lit(0).alias("seq"), F.col("src").alias("node_id"))
    return path.select("request_id", (F.col("length") - F.col("back")).alias("seq"), F.col("node").alias("node_id")).unionByName(same)


def route(requests: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """requests(request_id, x, y, dest_x, dest_y) to request_id, src, dst, total_cost, found; ends snap to the nearest nodes."""
    snap = lambda x, y, name: snap_to_node(requests.select(F.col("request_id").alias("query_id"), F.col(x).alias("x"), F.col(y).alias("y")), nodes).select(F.col("query_id").alias("request_id"), F.col("node_id").alias(name))
    ends = cut(snap("x", "y", "src").join(snap("dest_x", "dest_y", "dst"), "request_id"))
    cost = shortest_path_cost(ends.filter("src is not null and dst is not null"), nodes, edges)
    out = ends.join(cost, "request_id", "left")
    return out.select("request_id", "src", "dst", F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"), F.coalesce("found", F.lit(False)).alias("found"))


def route_segments(paths: DataFrame, nodes: DataFrame, viewport: tuple | None = None) -> DataFrame:
    """request_id, seq, ax, ay, bx, by of each step of paths(request_id, seq, node_id); with viewport (min_x, min_y, scale) in whole pixels."""
    steps = paths.withColumn("next", F.lead("node_id").over(Window.partitionBy("request_id").orderBy("seq"))).filter("next is not null")
    at = lambda s, k: nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    out = steps.join(at("a", "node_id"), "node_id").join(at("b", "next"), "next").select("request_id", "seq", "ax", "ay", "bx", "by")
    if viewport:
        x, y, scale = viewport
        pixel = {s: to_screen(f"{s}x", f"{s}y", F.lit(x), F.lit(y), F.lit(scale)) for s in "ab"}
        out = out.select("request_id", "seq", *[c.alias(f"{s}{n}") for s, cs in pixel.items() for n, c in zip("xy", cs, strict=True)])
    return out
