"""Connected components by alternating star contraction over an edge DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Scratch


def component_labels(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges(src, dst)``; component is the smallest id reachable.

    Each round links every vertex's larger neighbours to its smallest one, then its smaller neighbours,
    until the edges are stars; the number of rounds grows with the logarithm of the size. Sizes of shuffles
    shrink with the edge set; a vertex of high degree is pre-aggregated by the partial minimum and split by
    skew joins.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    big, small = F.greatest("src", "dst"), F.least("src", "dst")
    touched = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    star = scratch.save(edges.where(F.col("src") != F.col("dst")).select(big.alias("u"), small.alias("v")).distinct(), "star")
    mark = None
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = scratch.save(linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star")
        seen = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return touched.join(star.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
