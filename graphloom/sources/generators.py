"""Generated graphs and datasets. Random choices hash the pair and the seed, so they do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph

# The karate club's edges, by smaller node, and the members of "Mr. Hi".
KARATE = """0: 1 2 3 4 5 6 7 8 10 11 12 13 17 19 21 31; 1: 2 3 7 13 17 19 21 30; 2: 3 7 8 9 13 27 28 32; 3: 7 12 13; 4: 6 10
5: 6 10 16; 6: 16; 8: 30 32 33; 9: 33; 13: 33; 14: 32 33; 15: 32 33; 18: 32 33; 19: 33; 20: 32 33; 22: 32 33; 23: 25 27 29 32 33
24: 25 27 31; 25: 31; 26: 29 33; 27: 33; 28: 31 33; 29: 32 33; 30: 32 33; 31: 32 33; 32: 33"""
MR_HI = {*range(9), *range(10, 14), 16, 17, 19, 21}


def _uniform(seed: int, *cols: Column) -> Column:
    """Uniform in [0, 1) from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / float(1 << 53)


def _pairs(spark: SparkSession, n: int, p: float, directed: bool, seed: int) -> DataFrame:
    """Each node's partners are drawn by geometric gaps, so the work is that of the edges and not of all pairs."""
    from math import log1p

    nodes = spark.range(n).withColumnRenamed("id", "src")
    if p <= 0 or n < 2:
        return nodes.where("false").select("src", F.col("src").alias("dst"))
    first = F.lit(0).cast("long") if directed else F.col("src") + 1
    span = n - first
    if p >= 1:
        drawn = nodes.select("src", F.explode(F.sequence(first, F.lit(n - 1).cast("long"))).alias("dst")) if directed else nodes.where(F.col("src") < n - 1).select("src", F.explode(F.sequence(first, F.lit(n - 1).cast("long"))).alias("dst"))
        return drawn.where("src != dst")
    # The expected number of gaps and twelve standard deviations and more: the chance that a node's gaps end before
    # its span, so that its last pairs are never drawn, is below 1e-30. Gaps beyond the span are cut off.
    most = (span * p + 12 * F.sqrt(span * p * (1 - p)) + 24).cast("int")
    tries = nodes.select("src", span.alias("span"), first.alias("first"), F.explode(F.sequence(F.lit(1), most)).alias("k"))
    gap = F.floor(F.log1p(-_uniform(seed, F.col("src"), F.col("k"))) / F.lit(log1p(-p))) + 1
    at = F.sum(gap).over(Window.partitionBy("src").orderBy("k"))
    return tries.withColumn("at", at).where("at <= span").select("src", (F.col("first") + F.col("at") - 1).alias("dst")).where("src != dst")


def random_graph(spark: SparkSession, n: int, p: float, directed: bool = False, weighted: bool = False, seed: int = 0) -> Graph:
    if n < 0:
        raise ValueError("n must not be negative")
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    pairs = _pairs(spark, n, p, directed, seed).withColumn("weight", _uniform(seed + 1, F.col("src"), F.col("dst")))
    return Graph.from_edges(pairs, directed, weighted, spark.range(n))


def random_weighted_graph(spark: SparkSession, n: int, edge_prob: float, min_weight: float = 1.0, max_weight: float = 10.0, seed: int = 0) -> Graph:
    if min_weight > max_weight:
        raise ValueError("min_weight must not pass max_weight")
    pairs = _pairs(spark, n, edge_prob, False, seed)
    pairs = pairs.withColumn("weight", F.lit(float(min_weight)) + F.lit(float(max_weight - min_weight)) * _uniform(seed + 1, F.col("src"), F.col("dst")))
    return Graph.from_edges(pairs, False, True, spark.range(n))


def grid_graph(spark: SparkSession, rows: int, cols: int) -> Graph:
    if rows < 1 or cols < 1:
        raise ValueError("rows and cols must be at least 1")
    at = spark.range(rows * cols)
    col, row = F.col("id") % cols, F.floor(F.col("id") / cols)
    nodes = at.select("id", col.cast("double").alias("x"), row.cast("double").alias("y"))
    ends = F.array_compact(F.array(F.when(col < cols - 1, F.col("id") + 1), F.when(row < rows - 1, F.col("id") + cols)))
    return Graph.from_edges(at.select(F.col("id").alias("src"), F.explode(ends).alias("dst")), False, False, nodes)


def karate_club(spark: SparkSession) -> Graph:
    edges = [(int(u), int(v)) for part in KARATE.replace("\n", ";").split(";") for u, vs in [part.split(":")] for v in vs.split()]
    club = [(v, v, {"club": "Mr. Hi" if v in MR_HI else "Officer"}) for v in range(34)]
    rows = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src bigint, dst bigint, pos bigint")
    return Graph.from_edges(rows, False, False, spark.createDataFrame(club, "id bigint, pos bigint, attrs map<string,string>"))


def generate(spark: SparkSession, kind: str = "random", directed: bool = False, weighted: bool = False, n: int = 12, p: float = 0.25, rows: int = 4, cols: int = 4, min_weight: float = 1.0, max_weight: float = 10.0, seed: int = 0) -> Graph:
    """By request; weights of a directed random graph are always in [0, 1)."""
    if kind == "grid":
        return grid_graph(spark, rows, cols)
    if kind != "random":
        raise ValueError(f"unknown graph type {kind!r}")
    return random_weighted_graph(spark, n, p, min_weight, max_weight, seed) if weighted and not directed else random_graph(spark, n, p, directed, weighted, seed)
