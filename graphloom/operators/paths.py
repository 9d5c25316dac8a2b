"""Shortest paths by relaxation rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans import Scratch


def _relax(seeds: DataFrame, edges: DataFrame, key: list[str], rounds: int | None, prune: Column | None = None) -> DataFrame:
    """``key`` + id, dist, pred for ``seeds(key, id, dist)``: only rows that improved last round are relaxed.

    With ``rounds`` set, an improvement in a later round means a negative cycle.
    """
    scratch = Scratch(seeds.sparkSession, "relax")
    kind = seeds.schema["id"].dataType.simpleString()
    every = scratch.save(seeds.select(*key, "id", "dist", F.lit(None).cast(kind).alias("pred"), F.lit(True).alias("moved")), "dist")
    edges = scratch.save(edges, "edges")
    n = 0
    while True:
        front = every.where("moved").select(*key, F.col("id").alias("src"), "dist")
        if prune is not None:
            front = front.where(prune)
        offer = front.join(edges, "src").select(*key, F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("d"), F.col("dist").alias("at"), "src")
        # Of equal offers the earliest settled tail wins: least distance, then least id.
        best = offer.groupBy(*key, "id").agg(F.min(F.struct("d", "at", "src")).alias("o"))
        both = every.join(best, [*key, "id"], "full")
        better = F.col("o").isNotNull() & (F.col("dist").isNull() | (F.col("o.d") < F.col("dist")))
        every = scratch.save(both.select(*key, "id", F.when(better, F.col("o.d")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("o.src")).otherwise(F.col("pred")).alias("pred"), better.alias("moved")), "dist")
        if every.where("moved").isEmpty():
            return every.drop("moved")
        n += 1
        if rounds is not None and n >= rounds:
            raise ValueError("the graph has a negative-weight cycle")


def _settled_preds(found: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Predecessors under the tie rule on final distances: among tight tails the least (dist, id)."""
    tails = found.select(*key, F.col("id").alias("src"), F.col("dist").alias("at"))
    tight = tails.join(edges, "src").join(found.select(*key, F.col("id").alias("dst"), "dist"), [*key, "dst"]).where("at + weight = dist and (at < dist)")
    best = tight.groupBy(*key, F.col("dst").alias("id")).agg(F.min(F.struct("at", "src")).alias("o"))
    return found.join(best, [*key, "id"], "left").select(*key, "id", "dist", F.coalesce("o.src", "pred").alias("pred"))


def _seed(graph: Graph, start) -> DataFrame:
    kind = graph.nodes.schema["id"].dataType.simpleString()
    return graph.nodes.sparkSession.createDataFrame([(start, 0.0)], f"id {kind}, dist double")


def _edges(graph: Graph) -> DataFrame:
    return graph.adjacency().select("src", "dst", "weight")


def dijkstra(graph: Graph, start) -> DataFrame:
    """id, dist, pred of all that ``start`` reaches; weights must not be negative."""
    graph.ensure_node(start, "start")
    graph.ensure_non_negative()
    return _settled_preds(_relax(_seed(graph, start), _edges(graph), [], None), _edges(graph), [])


def bellman_ford(graph: Graph, start) -> DataFrame:
    """id, dist, pred of all that ``start`` reaches; a negative cycle there is a ValueError."""
    graph.ensure_node(start, "start")
    return _relax(_seed(graph, start), _edges(graph), [], graph.num_nodes())


def _all_seeds(graph: Graph) -> DataFrame:
    return graph.nodes.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"))


def floyd_warshall(graph: Graph) -> DataFrame:
    """src, dst, dist of all reachable pairs by min-plus squaring; a negative cycle is a ValueError."""
    scratch = Scratch(graph.nodes.sparkSession, "pairs")
    pair = graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist")).unionAll(_edges(graph))
    pair = scratch.save(pair.groupBy("src", "dst").agg(F.min("dist").alias("dist")), "pair")
    nodes, steps = graph.num_nodes(), 1
    while True:
        if not pair.where("src = dst and dist < 0").isEmpty():
            raise ValueError("the graph has a negative-weight cycle")
        if steps >= nodes:
            return pair
        left = pair.select("src", F.col("dst").alias("k"), F.col("dist").alias("a"))
        right = pair.select(F.col("src").alias("k"), "dst", F.col("dist").alias("b"))
        fresh = scratch.save(left.join(right, "k").groupBy("src", "dst").agg(F.min(F.col("a") + F.col("b")).alias("dist")), "next")
        same = fresh.join(pair.withColumnRenamed("dist", "old"), ["src", "dst"], "left").where("old is null or dist < old").isEmpty()
        pair, steps = scratch.save(fresh, "pair"), steps * 2
        if same:
            steps = max(steps, nodes)


def potentials(graph: Graph) -> DataFrame:
    """id, h: distances from a virtual node with free edges to all; a negative cycle is a ValueError."""
    return _relax(graph.nodes.select("id", F.lit(0.0).alias("dist")), _edges(graph), [], graph.num_nodes() + 1).select("id", F.col("dist").alias("h"))


def johnsons(graph: Graph) -> DataFrame:
    """src, dst, dist of all reachable pairs: potentials, reweighting, then all sources relaxed at once."""
    scratch = Scratch(graph.nodes.sparkSession, "johnson")
    edges = scratch.save(_edges(graph), "edges")
    if graph.nodes.isEmpty():
        return graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    h = scratch.save(potentials(graph), "potentials")
    hs, hd = h.select(F.col("id").alias("src"), F.col("h").alias("hs")), h.select(F.col("id").alias("dst"), F.col("h").alias("hd"))
    moved = F.col("weight") + F.col("hs") - F.col("hd")
    shifted = edges.join(hs, "src").join(hd, "dst").select("src", "dst", F.when((moved < 0) & (moved >= -1e-9), 0.0).otherwise(moved).alias("weight"))
    found = _relax(_all_seeds(graph), shifted, ["source"], None)
    out = found.select(F.col("source").alias("src"), F.col("id").alias("dst"), "dist").join(hs, "src").join(hd, "dst")
    return out.select("src", "dst", (F.col("dist") - F.col("hs") + F.col("hd")).alias("dist"))


def euclidean_heuristic(graph: Graph, goal) -> DataFrame:
    """id, h: straight-line distance to ``goal``."""
    at = graph.coordinates()
    if not at.where("x is null or y is null").isEmpty():
        raise ValueError("a node has no coordinates")
    to = at.where(F.col("id") == F.lit(goal)).select(F.col("x").alias("gx"), F.col("y").alias("gy"))
    return at.join(F.broadcast(to)).select("id", F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy")).alias("h"))


def a_star(graph: Graph, start, goal, heuristic: DataFrame) -> DataFrame:
    """id, dist, pred of the nodes that can lie on a best path under ``heuristic(id, h)`` (admissible).

    Rounds relax only nodes whose distance and heuristic together do not pass the best known way to the goal.
    """
    graph.ensure_node(start, "start")
    graph.ensure_node(goal, "goal")
    graph.ensure_non_negative()
    scratch = Scratch(graph.nodes.sparkSession, "astar")
    edges, h = scratch.save(_edges(graph), "edges"), scratch.save(heuristic, "h")
    kind = graph.nodes.schema["id"].dataType.simpleString()
    every = scratch.save(_seed(graph, start).select("id", "dist", F.lit(None).cast(kind).alias("pred"), F.lit(True).alias("moved")), "dist")
    while True:
        best = every.where(F.col("id") == F.lit(goal)).agg(F.min("dist")).first()[0]
        bound = float("inf") if best is None else best
        front = every.where("moved").join(h, "id").where(F.col("dist") + F.col("h") <= F.lit(bound) + 1e-9).select(F.col("id").alias("src"), "dist")
        offer = front.join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("weight")).alias("d"), "dist", "src")).alias("o"))
        better = F.col("o").isNotNull() & (F.col("dist").isNull() | (F.col("o.d") < F.col("dist")))
        every = scratch.save(every.join(offer, "id", "full").select("id", F.when(better, F.col("o.d")).otherwise(F.col("dist")).alias("dist"), F.when(better, F.col("o.src")).otherwise(F.col("pred")).alias("pred"), better.alias("moved")), "dist")
        if every.where("moved").isEmpty():
            return every.drop("moved")


def reconstruct_path(found: DataFrame, start, end) -> DataFrame:
    """step, id from ``start`` to ``end`` along ``found(id, pred)``; no way there is a ValueError.

    Tables of ancestors 1, 2, 4, ... hops up come from joining each with itself; read from the longest hop down, they
    double the known part of the way in each round.
    """
    spark = found.sparkSession
    scratch = Scratch(spark, "way")
    kind = found.schema["id"].dataType.simpleString()
    # The way ends at the start, whatever its own predecessor is.
    hop = scratch.save(found.where(F.col("pred").isNotNull() & (F.col("id") != F.lit(start))).select("id", F.col("pred").alias("up")), "hop0")
    hops, longest = [hop], hop.count()
    while not hop.isEmpty() and 1 << len(hops) <= longest:
        hop = scratch.save(hop.join(hops[-1].select(F.col("id").alias("up"), F.col("up").alias("above")), "up").select("id", F.col("above").alias("up")), f"hop{len(hops)}")
        hops.append(hop)
    way = scratch.save(spark.createDataFrame([(end, 0)], f"id {kind}, off bigint"), "way")
    for k in range(len(hops) - 1, -1, -1):
        further = way.join(hops[k], "id").select(F.col("up").alias("id"), (F.col("off") + (1 << k)).alias("off"))
        way = scratch.save(way.unionByName(further), "way")
    last = way.where(F.col("id") == F.lit(start)).agg(F.min("off")).first()[0]
    if last is None:
        raise ValueError(f"No path from {start!r} to {end!r}")
    return way.where(F.col("off") <= last).select((F.lit(last) - F.col("off")).alias("step"), "id")
