"""Graphs of growing size on which run times are measured: edges grow with nodes, not with their square."""

from __future__ import annotations

from math import log

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.stats import sparse_probability
from ..graph import Graph
from ..operators.components import component_labels
from .generators import random_graph, random_weighted_graph

TRIES = 40
LOW, HIGH = 1.0, 10.0


def undirected(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    return random_graph(spark, n, sparse_probability(n), seed=seed)


def weighted(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    return random_weighted_graph(spark, n, sparse_probability(n), LOW, HIGH, seed)


def directed(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    return random_graph(spark, n, sparse_probability(n), directed=True, seed=seed)


def _in_one_piece(graph: Graph, n: int) -> bool:
    if graph.num_edges() < n - 1:
        return False
    labels = component_labels(graph.edges.select("src", "dst"))
    return labels.agg((F.count("*") == n) & (F.min("component") == F.max("component"))).first()[0] or n <= 1


def connected(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    """In one piece, as spanning trees need: other seeds are tried, a denser graph is the last resort."""
    p = max(sparse_probability(n, 8.0), min(0.4, 3 * log(n + 1) / max(n, 1)))
    for k in range(TRIES):
        graph = random_weighted_graph(spark, n, p, LOW, HIGH, seed + 1000 * k)
        if _in_one_piece(graph, n):
            return graph
    return random_weighted_graph(spark, n, min(0.5, 2 * p), LOW, HIGH, seed)


def flow_network(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    """Directed capacities from 0.25 to 5; never without an edge from two nodes on."""
    graph = random_graph(spark, n, sparse_probability(n, 5.0), directed=True, weighted=True, seed=seed)
    if n >= 2 and graph.num_edges() == 0:
        return graph.add_edges(spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, weight double"))
    return graph.scaled(F.greatest("weight", F.lit(0.05)) * 5)
