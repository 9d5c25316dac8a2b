"""Maximum bipartite matching in rounds of joins, so that no task holds a large component.

A node of the smaller side is ``a``, one of the other side ``b``; free nodes have no partner yet.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Scratch
from .components import component_labels
from .traversal import _Levels


def maximum_matching(pairs: DataFrame, few: int = 0, run: Callable | None = None) -> DataFrame:
    """left, right of a maximum matching of ``pairs(left, right)``, a saved table whose sides share no id.

    A maximal matching comes first. Then, in phases, a forest grows from all free nodes of the smaller side along
    alternating paths, and each tree that comes to a free node of the other side turns one path over. A phase whose
    forest is whole and has no such tree proves that there is none; without free nodes on the smaller side none is needed.
    Components of up to ``few`` pairs leave the forests to ``run``, which matches (left, right) of one in a task.
    """
    scratch = Scratch(pairs.sparkSession, "matching")
    # Which side is called a decides about time only.
    n_left, n_right = pairs.agg(F.approx_count_distinct("left"), F.approx_count_distinct("right")).first()
    a, b = ("left", "right") if n_left <= n_right else ("right", "left")
    pairs = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    mates = _maximal(pairs, scratch)
    free = scratch.save(pairs.select("a").distinct().join(mates, "a", "left_anti"), "free")
    if few and not free.isEmpty():
        pairs, mates, free = _small_done(pairs, mates, free, few, run, (a, b), scratch)
    while not free.isEmpty():
        turned = _turned(pairs, mates, free)
        if turned is None:
            break
        mates = scratch.save(mates.join(turned, "a", "left_anti").unionByName(turned), "mates")
        free = scratch.save(free.join(turned, "a", "left_anti"), "free")
    scratch.keep("mates")
    return mates.select(F.col("a").alias(a), F.col("b").alias(b)).select("left", "right")


def _maximal(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b of a matching that no pair can join: each free a offers itself to one b by lot, which takes who has the fewest choices."""
    rest, taken = pairs, []
    while True:
        turn = len(taken)
        offers = rest.groupBy("a").agg(F.min_by("b", F.xxhash64("a", "b", F.lit(turn))).alias("b"), F.count("*").alias("choices"))
        new = scratch.save(offers.groupBy("b").agg(F.min_by("a", F.struct("choices", F.xxhash64("a", "b"))).alias("a")).select("a", "b"), f"taken{turn}")
        taken.append(new)
        if new.isEmpty():
            mates = scratch.save(reduce(DataFrame.unionByName, taken), "mates")
            scratch.drop("rest", *[f"taken{k}" for k in range(len(taken))])
            return mates
        rest = scratch.save(rest.join(new, "a", "left_anti").join(new.select("b"), "b", "left_anti"), "rest")


def _small_done(pairs: DataFrame, mates: DataFrame, free: DataFrame, few: int, run: Callable, names: tuple[str, str], scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pairs and free of the large components that can gain, and mates with the small ones matched; no other can gain."""
    label = component_labels(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = scratch.save(pairs.join(label.withColumnRenamed("id", "a"), "a"), "placed")
    spare = placed.join(mates.select("b"), "b", "left_anti").select("component").distinct()
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).join(spare, "component", "left_semi")
    sizes = scratch.save(sizes.join(placed.join(free, "a", "left_semi").select("component"), "component", "left_semi"), "sizes")
    kind = pairs.schema["a"].dataType.simpleString()
    small = placed.join(sizes.where(F.col("n") <= few), "component", "left_semi").select("component", F.col("a").alias(names[0]), F.col("b").alias(names[1]))
    matched = small.groupBy("component").applyInPandas(lambda pdf: run(pdf), f"left {kind}, right {kind}").select(F.col(names[0]).alias("a"), F.col(names[1]).alias("b"))
    matched = scratch.save(matched, "small")
    old = mates.join(small.select(F.col(names[0]).alias("a")), "a", "left_anti")
    mates = scratch.save(old.unionByName(matched), "mates")
    large = scratch.save(placed.join(sizes.where(F.col("n") > few), "component", "left_semi").select("a", "b"), "large")
    free = scratch.save(free.join(large, "a", "left_semi"), "free")
    scratch.drop("placed", "sizes", "small")
    return large, mates, free


def _turned(pairs: DataFrame, mates: DataFrame, free: DataFrame) -> DataFrame | None:
    """The new (a, b) along one path of each tree that found a free b; None if no tree did.

    A row of the forest is a b: the a it was reached from (``via``), that one's own partner (``via_b``, null for a
    root), the tree's root and its partner (``mate``, null if free). Trees share no node, so their paths cross nowhere.
    """
    spark = pairs.sparkSession
    kind = pairs.schema["a"].dataType.simpleString()
    scratch, ends = Scratch(spark, "ends"), {}
    forest, depth = _Levels(Scratch(spark, "forest"), spark.createDataFrame([], f"depth int, b {kind}, via {kind}, via_b {kind}, root {kind}, mate {kind}")), 0
    front = free.select("a", F.col("a").alias("root"), F.lit(None).cast(kind).alias("by"))
    while True:
        found = front.join(pairs, "a").join(forest.every().select("b"), "b", "left_anti")
        once = found.groupBy("b").agg(F.min_by(F.struct("a", "by", "root"), F.xxhash64("a", "b")).alias("x"))
        level = once.join(mates.select("b", F.col("a").alias("mate")), "b", "left")
        level = forest.add(level.select(F.lit(depth).alias("depth"), "b", F.col("x.a").alias("via"), F.col("x.by").alias("via_b"), F.col("x.root").alias("root"), "mate"))
        size, open_ends = level.agg(F.count("*"), F.count_if(F.col("mate").isNull())).first()
        front = level.where("mate is not null")
        if open_ends:
            ends[depth] = scratch.save(level.where("mate is null").groupBy("root").agg(F.min("b").alias("b")), f"end{depth}")
            front = front.join(ends[depth], "root", "left_anti")
        if size == open_ends:
            break
        front, depth = front.select(F.col("mate").alias("a"), "root", F.col("b").alias("by")), depth + 1
    if not ends:
        forest.scratch.keep()
        return None
    grown = scratch.save(forest.every().join(reduce(DataFrame.unionByName, ends.values()).select("root"), "root", "left_semi"), "grown")
    forest.scratch.keep()
    at = spark.createDataFrame([], f"b {kind}")
    paths = _Levels(Scratch(spark, "paths"), spark.createDataFrame([], f"a {kind}, b {kind}, via_b {kind}"))
    for k in range(max(ends), -1, -1):
        if k in ends:
            at = at.unionByName(ends[k].select("b"))
        step = paths.add(grown.where(F.col("depth") == k).join(at, "b").select(F.col("via").alias("a"), "b", "via_b"))
        at = step.where("via_b is not null").select(F.col("via_b").alias("b"))
    turned = paths.every().select("a", "b")
    scratch.keep()
    return turned
