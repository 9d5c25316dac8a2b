"""Maximum flow, minimum cut and bipartite matching.

A flow is one sequential kernel per query, so many (source, sink) queries run side by side; the graph that it
sees is first cut to the nodes between source and sink. Matching goes by rounds of joins; a kernel
matches small components only.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans import Scratch
from .matching import maximum_matching
from .traversal import bfs

EPS = 1e-12
#: Up to so many pairs, or pairs of a component, are matched in one task, which is quicker there than forests; the matching is a maximum either way.
FEW_PAIRS = 400_000


def _max_flow(rows: list[tuple], source, sink) -> tuple[float, dict, set]:
    """Value, net flow by (u, v), and the residual's source side, by Dinic's layered augmentation."""
    room: dict = {source: {}, sink: {}}
    for u, v, c in rows:
        if u != v:
            room.setdefault(u, {})[v] = room.get(u, {}).get(v, 0.0) + c
            room.setdefault(v, {}).setdefault(u, 0.0)
    start = {u: dict(vs) for u, vs in room.items()}
    value = 0.0
    while True:
        depth, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > EPS and v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
        if sink not in depth:
            flow = {(u, v): start[u][v] - c for u, vs in room.items() for v, c in vs.items() if start[u][v] - c > EPS}
            return value, flow, set(depth)
        todo = {u: iter(list(vs)) for u, vs in room.items()}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(room[a][b] for a, b in zip(path, path[1:]))
                value += push
                for a, b in zip(path, path[1:]):
                    room[a][b] -= push
                    room[b][a] += push
                path = path[: next(i for i, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] <= EPS) + 1]
                continue
            step = next((v for v in todo[u] if room[u][v] > EPS and depth.get(v) == depth[u] + 1), None)
            if step is None:
                path.pop()
            else:
                path.append(step)


def between(graph: Graph, source, sink) -> DataFrame:
    """Capacities on ways from source to sink."""
    for node, what in ((source, "source"), (sink, "sink")):
        graph.ensure_node(node, what)
    if source == sink:
        raise ValueError("source and sink must differ")
    if not graph.edges.where("weight < 0").isEmpty():
        raise ValueError("capacities must not be negative")
    ahead = bfs(graph, source, with_order=False).select("id")
    caps = graph.oriented_capacities()
    return caps.join(ahead.withColumnRenamed("id", "src"), "src", "left_semi").withColumn("g", F.lit(0))


def _flow_rows(graph: Graph, source, sink) -> DataFrame:
    """kind (value, flow, side), u, v, amount."""
    kind = graph.nodes.schema["id"].dataType.simpleString()
    spark = graph.nodes.sparkSession
    caps = between(graph, source, sink).unionByName(spark.createDataFrame([(source, sink, 0.0, 0)], f"src {kind}, dst {kind}, capacity double, g int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        value, flow, side = _max_flow(list(zip(pdf.src.tolist(), pdf.dst.tolist(), pdf.capacity.tolist())), source, sink)
        rows = [("value", source, sink, value), *(("flow", u, v, f) for (u, v), f in flow.items()), *(("side", u, u, 0.0) for u in side)]
        return pd.DataFrame(rows, columns=["kind", "u", "v", "amount"])

    return caps.groupBy("g").applyInPandas(run, f"kind string, u {kind}, v {kind}, amount double")


def ford_fulkerson(graph: Graph, source, sink) -> tuple[DataFrame, DataFrame]:
    """(value, flow(u, v, flow)); flow is net, so it never passes a capacity even with edges both ways."""
    rows = _flow_rows(graph, source, sink)
    return rows.where("kind = 'value'").select(F.col("amount").alias("value")), rows.where("kind = 'flow'").select("u", "v", F.col("amount").alias("flow"))


def min_cut(graph: Graph, source, sink) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(value, cut(u, v, capacity), sides(id, side)); the source side is the smallest of all minimum cuts."""
    rows = _flow_rows(graph, source, sink)
    near = rows.where("kind = 'side'").select(F.col("u").alias("id"))
    sides = graph.nodes.select("id").join(near.withColumn("s", F.lit("source")), "id", "left").select("id", F.coalesce("s", F.lit("sink")).alias("side"))
    caps = graph.oriented_capacities().where(F.col("capacity") > EPS)
    cut = caps.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_anti").select(F.col("src").alias("u"), F.col("dst").alias("v"), "capacity")
    return cut.agg(F.coalesce(F.sum("capacity"), F.lit(0.0)).alias("value")), cut, sides


def matched(pairs: list[tuple], log: list[dict] | None = None) -> dict:
    """Partner of each left node: Hopcroft-Karp, phases of shortest alternating paths, without recursion.

    ``log`` takes a step for each node that a phase matches, and one for each phase.
    """
    near: dict = {}
    for a, b in sorted(pairs):
        near.setdefault(a, []).append(b)
    mate_l, mate_r, phase, size = {}, {}, 0, 0
    while True:
        depth = {a: 0 for a in near if a not in mate_l}
        queue, open_end = deque(depth), False
        while queue:
            a = queue.popleft()
            for b in near[a]:
                c = mate_r.get(b)
                if c is None:
                    open_end = True
                elif c not in depth:
                    depth[c] = depth[a] + 1
                    queue.append(c)
        if not open_end:
            return mate_l
        todo, phase = {a: iter(bs) for a, bs in near.items()}, phase + 1
        for root in [a for a in near if a not in mate_l]:
            path, via = [root], []
            while path:
                b = next((b for b in todo[path[-1]] if b not in mate_r or depth.get(mate_r[b]) == depth[path[-1]] + 1), None)
                if b is None:
                    path.pop()
                    if via:
                        via.pop()
                elif b in mate_r:
                    via.append(b)
                    path.append(mate_r[b])
                else:
                    for a, c in zip(path, [*via, b]):
                        mate_l[a], mate_r[c] = c, a
                    if log is not None:
                        log.append({"action": "match", "pair": [root, mate_l[root]], "phase": phase})
                    break
        if log is not None:
            log.append({"action": "phase", "phase": phase, "augmented": len(mate_l) - size, "matching_size": len(mate_l)})
        size = len(mate_l)


def hopcroft_karp(graph: Graph, left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right of a maximum matching between ``left(id)`` and ``right(id)``; other edges are ignored."""
    if not left.select("id").intersect(right.select("id")).isEmpty():
        raise ValueError("left and right must not overlap")
    scratch = Scratch(graph.nodes.sparkSession, "pairs")
    pairs = scratch.save(graph.bipartite_edges(left, right), "pairs")
    kind = pairs.schema["left"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(matched(list(zip(pdf.left.tolist(), pdf.right.tolist()))).items()), columns=["left", "right"])

    if pairs.count() > FEW_PAIRS:
        found = maximum_matching(pairs, FEW_PAIRS, run)
        scratch.drop("pairs")
        return found
    return pairs.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, f"left {kind}, right {kind}")


bipartite_matching = hopcroft_karp
