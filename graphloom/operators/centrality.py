"""Centrality. Weights are ignored; undirected edges count both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans import Scratch


def pagerank(graph: Graph, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, int, list[float]]:
    """(scores(id, score), iterations, L1 change of each); the mass of nodes without out-edges is spread evenly."""
    if not 0 <= damping <= 1:
        raise ValueError("damping must be in [0, 1]")
    scratch = Scratch(graph.nodes.sparkSession, "pagerank")
    n = graph.num_nodes()
    if not n:
        return graph.nodes.select("id", F.lit(0.0).alias("score")), 0, []
    adj = graph.adjacency().select("src", "dst")
    out = adj.groupBy("src").agg(F.count("*").alias("out"))
    edges = scratch.save(adj.join(out, "src"), "edges")
    ranks = graph.nodes.select("id").join(out.withColumnRenamed("src", "id"), "id", "left").select("id", "out", F.lit(1.0 / n).alias("score"))
    ranks, history = scratch.save(ranks, "ranks"), []
    lost = ranks.where("out is null").agg(F.sum("score")).first()[0] or 0.0
    for _ in range(max_iterations):
        base = (1 - damping) / n + damping * lost / n
        got = ranks.select(F.col("id").alias("src"), "score").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") / F.col("out")).alias("got"))
        fresh = ranks.select("id", "out", F.col("score").alias("old")).join(got, "id", "left").select("id", "out", "old", (F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("score"))
        ranks = scratch.save(fresh, "ranks")
        moved, lost = ranks.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("score"))), F.lit(0.0))).first()
        history.append(moved)
        if moved < tolerance:
            break
    return ranks.select("id", "score"), len(history), history


def _distances(graph: Graph, scratch: Scratch) -> tuple[DataFrame, int]:
    """source, id, dist, paths for all sources at once, level by level."""
    adj = scratch.save(graph.adjacency().where("src != dst").select("src", "dst"), "adjacency")
    front = seen = scratch.save(graph.nodes.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")), "level0")
    level = 1
    while True:
        found = front.select("source", F.col("id").alias("src"), "paths").join(adj, "src").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        found = found.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(level).alias("dist"), "paths")
        front = scratch.save(found, f"level{level}")
        if front.isEmpty():
            return scratch.save(seen, "all"), level - 1
        seen, level = seen.unionByName(front), level + 1


def reached_counts(graph: Graph) -> DataFrame:
    """id, n: how many nodes each one reaches, itself included."""
    seen, _ = _distances(graph, Scratch(graph.nodes.sparkSession, "reached"))
    return seen.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))


def betweenness_centrality(graph: Graph) -> DataFrame:
    """id, score: Brandes' sums over all sources, normalised as for the graph's kind when it has over two nodes."""
    scratch = Scratch(graph.nodes.sparkSession, "betweenness")
    n = graph.num_nodes()
    seen, depth = _distances(graph, scratch)
    adj = graph.adjacency().where("src != dst").select("src", "dst")
    back = scratch.save(seen.where("dist = -1").select("source", "id", F.lit(0.0).alias("delta")), "delta-none")
    parts = [back]
    below = scratch.save(seen.where(F.col("dist") == depth).select("source", "id", "paths", F.lit(0.0).alias("delta")), f"delta{depth}")
    parts.append(below.select("source", "id", "delta"))
    for level in range(depth - 1, -1, -1):
        share = below.select("source", F.col("id").alias("dst"), ((1 + F.col("delta")) / F.col("paths")).alias("share")).join(adj, "dst").groupBy("source", F.col("src").alias("id")).agg(F.sum("share").alias("share"))
        own = seen.where(F.col("dist") == level).join(share, ["source", "id"], "left")
        below = scratch.save(own.select("source", "id", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("delta")), f"delta{level}")
        parts.append(below.select("source", "id", "delta"))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    total = total.where("source != id").groupBy("id").agg(F.sum("delta").alias("score"))
    scale = 1.0 if graph.directed else 0.5
    if n > 2:
        scale = 1.0 / ((n - 1) * (n - 2))
    return graph.nodes.select("id").join(total, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * scale).alias("score"))


def closeness_centrality(graph: Graph) -> DataFrame:
    """id, score over the nodes reached along out-edges, scaled by the share of the graph they are."""
    scratch = Scratch(graph.nodes.sparkSession, "closeness")
    n = graph.num_nodes()
    seen, _ = _distances(graph, scratch)
    sums = seen.groupBy(F.col("source").alias("id")).agg((F.count("*") - 1).alias("r"), F.sum("dist").alias("d"))
    score = F.when((F.col("d") > 0) & (F.lit(n) > 1), F.col("r") / F.lit(max(n - 1, 1)) * (F.col("r") / F.col("d"))).otherwise(0.0)
    return graph.nodes.select("id").join(sums, "id", "left").select("id", F.coalesce(score, F.lit(0.0)).alias("score"))


def eigenvector_centrality(graph: Graph, max_iterations: int = 100, tolerance: float = 1e-6) -> tuple[DataFrame, int, list[float]]:
    """(scores(id, score), iterations, L1 change of each) by power iteration over in-neighbours; it need not converge."""
    scratch = Scratch(graph.nodes.sparkSession, "eigenvector")
    n = graph.num_nodes()
    if not n:
        return graph.nodes.select("id", F.lit(0.0).alias("score")), 0, []
    edges = scratch.save(graph.adjacency().select("src", "dst"), "edges")
    score, history = scratch.save(graph.nodes.select("id", F.lit(1.0 / n**0.5).alias("score")), "score"), []
    for _ in range(max_iterations):
        got = edges.join(score.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("got"))
        fresh = scratch.save(score.join(got, "id", "left").select("id", F.col("score").alias("old"), F.coalesce("got", F.lit(0.0)).alias("got")), "fresh")
        norm = fresh.agg(F.sqrt(F.sum(F.col("got") * F.col("got")))).first()[0]
        if norm < 1e-18:
            history.append(0.0)
            return graph.nodes.select("id", F.lit(1.0 / n**0.5).alias("score")), len(history), history
        score = fresh.select("id", "old", (F.col("got") / F.lit(norm)).alias("score"))
        history.append(score.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0])
        if history[-1] < tolerance:
            break
    return score.select("id", "score"), len(history), history
