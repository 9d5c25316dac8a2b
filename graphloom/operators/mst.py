"""Minimum spanning trees by Boruvka rounds on the total order (weight, edge_pos), which makes the tree unique."""

from __future__ import annotations

import heapq
import time

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans import Scratch
from ..plans.ranking import with_positions
from .components import component_labels


def _tree(graph: Graph) -> DataFrame:
    graph.ensure_kind(False, "a spanning tree")
    graph = graph.ordered()
    scratch = Scratch(graph.nodes.sparkSession, "mst")
    label = scratch.save(graph.nodes.select("id", F.col("id").alias("c")), "label")
    edges = scratch.save(graph.edges.where("src != dst"), "edges")
    tree, turn = None, 0
    while True:
        ends = edges.join(label.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs != cd")
        edges = scratch.save(ends.select("src", "dst", "weight", "edge_pos", "cs", "cd"), "open")
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select("src", "dst", "weight", "edge_pos", F.col("cd").alias("cs"), F.col("cs").alias("cd")))
        pick = both.groupBy("cs").agg(F.min(F.struct("weight", "edge_pos", "src", "dst", "cd")).alias("e"))
        picked = scratch.save(pick.select("e.*", "cs").dropDuplicates(["edge_pos"]), f"picked{turn}")
        tree = picked if tree is None else tree.unionByName(picked)
        merged = component_labels(picked.select(F.col("cs").alias("src"), F.col("cd").alias("dst"))).withColumnRenamed("id", "c")
        label = scratch.save(label.join(merged, "c", "left").select("id", F.coalesce("component", "c").alias("c")), "label")
        edges, turn = scratch.save(edges.drop("cs", "cd"), "edges"), turn + 1
    if label.select("c").distinct().limit(2).count() > 1:
        raise ValueError("the graph is disconnected")
    none = graph.edges.where("false").select("weight", "edge_pos", "src", "dst")
    return tree.select("weight", "edge_pos", "src", "dst") if tree is not None else none


def kruskals(graph: Graph) -> DataFrame:
    """step, src, dst, weight, total: tree edges by weight, with the running total."""
    placed = with_positions(_tree(graph), [F.col("weight"), F.col("edge_pos")], "step")
    # The tree's edges are summed in chunks first, so that no task holds more than a chunk and the chunks' totals.
    chunk = F.floor(F.col("step") / 65536)
    sums = placed.groupBy(chunk.alias("k")).agg(F.sum("weight").alias("part"))
    before = sums.select("k", (F.sum("part").over(Window.orderBy("k")) - F.col("part")).alias("before"))
    run = F.sum("weight").over(Window.partitionBy("k").orderBy("step"))
    return placed.withColumn("k", chunk).join(F.broadcast(before), "k").select("step", "src", "dst", "weight", (run + F.col("before")).alias("total"))


def prims(graph: Graph, start=None) -> DataFrame:
    """step, src, dst, weight, total: the same tree in the order in which it grows from ``start``.

    Finding the tree is distributed; only its ``n - 1`` edges enter the sequential replay.
    """
    if start is None:
        first = graph.ordered().nodes.orderBy("node_pos").first()
        start = first["id"] if first else None
    else:
        graph.ensure_node(start, "start")
    kind = graph.nodes.schema["id"].dataType.simpleString()
    tree = _tree(graph).withColumn("g", F.lit(0))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for u, v, w in zip(pdf.src.tolist(), pdf.dst.tolist(), pdf.weight.tolist()):
            near.setdefault(u, []).append((w, u, v))
            near.setdefault(v, []).append((w, v, u))
        seen, heap, out, total = {start}, list(near.get(start, ())), [], 0.0
        heapq.heapify(heap)
        while heap:
            w, u, v = heapq.heappop(heap)
            if v not in seen:
                seen.add(v)
                total += w
                out.append((len(out), u, v, w, total))
                for e in near[v]:
                    heapq.heappush(heap, e)
        return pd.DataFrame(out, columns=["step", "src", "dst", "weight", "total"])

    return tree.groupBy("g").applyInPandas(grow, f"step bigint, src {kind}, dst {kind}, weight double, total double")


def compare_mst_algorithms(graph: Graph) -> DataFrame:
    """algorithm, weight, edges, time_ms, faster; both weights must agree to 1e-9."""
    rows = []
    for name, run in (("kruskals", kruskals), ("prims", prims)):
        began = time.perf_counter()
        r = run(graph).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
        rows.append([name, r["w"] or 0.0, r["n"], 1000 * (time.perf_counter() - began)])
    if abs(rows[0][1] - rows[1][1]) > 1e-9:
        raise AssertionError("the two trees differ in weight")
    best = min(rows, key=lambda r: r[3])[0]
    return graph.nodes.sparkSession.createDataFrame([(*r, best) for r in rows], "algorithm string, weight double, edges bigint, time_ms double, faster string")


class UnionFind:
    """Disjoint sets as labels: ``union`` adds pairs, ``find`` is a label and ``connected`` their equality."""

    def __init__(self, elements: DataFrame, pairs: DataFrame | None = None):
        self.elements, self.pairs = elements.select("id"), pairs

    def make_set(self, elements: DataFrame) -> UnionFind:
        return UnionFind(self.elements.unionByName(elements.select("id")).distinct(), self.pairs)

    def union(self, pairs: DataFrame) -> UnionFind:
        pairs = pairs.select("src", "dst")
        return UnionFind(self.elements, pairs if self.pairs is None else self.pairs.unionByName(pairs))

    def find(self) -> DataFrame:
        """id, label of every element, those that only pairs name among them."""
        if self.pairs is None:
            return self.elements.select("id", F.col("id").alias("label"))
        found = component_labels(self.pairs)
        return self.elements.join(found, "id", "full").select("id", F.coalesce("component", "id").alias("label"))

    def connected(self, pairs: DataFrame) -> DataFrame:
        label = self.find()
        both = pairs.join(label.select(F.col("id").alias("src"), F.col("label").alias("a")), "src", "left").join(label.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst", "left")
        return both.select("src", "dst", F.coalesce(F.col("a") == F.col("b"), F.col("src") == F.col("dst")).alias("connected"))
