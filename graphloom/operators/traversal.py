"""Traversal and connectivity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans import Scratch
from ..plans.ranking import with_positions
from .components import component_labels


def bfs(graph: Graph, start, with_order: bool = True) -> DataFrame:
    """id, dist and (with ``with_order``) ord, via: level by level, parents by visit order, children by place."""
    graph.ensure_node(start, "start")
    return _visits(graph.ordered(), start) if with_order else _hops(graph, start)


#: So many tables of levels are written as one, so that a plan never reads more than these.
MERGE_LEVELS = 16


class _Levels:
    """Tables of found rows, a few large ones and one for each recent level."""

    def __init__(self, scratch: Scratch, first: DataFrame):
        self.scratch, self.old, self.recent, self.n = scratch, [], [], 0
        self.add(first)

    def add(self, level: DataFrame) -> DataFrame:
        self.n += 1
        saved = self.scratch.save(level, f"level{self.n}")
        self.recent.append(saved)
        if len(self.recent) > MERGE_LEVELS:
            # The last two stay apart: the next levels are looked up in them.
            self.old, self.recent = [self.scratch.save(reduce(DataFrame.unionByName, [*self.old, *self.recent[:-2]]), "merged")], self.recent[-2:]
            self.scratch.drop(*[f"level{k}" for k in range(self.n - MERGE_LEVELS, self.n - 1)])
        return saved

    def every(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [*self.old, *self.recent])

    def last(self, n: int) -> DataFrame:
        """What the last ``n`` levels hold, or more."""
        return self.every() if len(self.recent) < n else reduce(DataFrame.unionByName, self.recent[-n:])


def _hops(graph: Graph, start) -> DataFrame:
    """id, dist. Only a directed edge can lead back by more than one level, so only then all levels are looked up."""
    spark = graph.nodes.sparkSession
    scratch = Scratch(spark, "hops")
    kind = graph.nodes.schema["id"].dataType.simpleString()
    adj = scratch.save(graph.adjacency().where("src != dst").select("src", "dst"), "adjacency")
    front = spark.createDataFrame([(start, 0)], f"id {kind}, dist bigint")
    levels, dist = _Levels(scratch, front), 0
    while not front.isEmpty():
        dist += 1
        found = front.select(F.col("id").alias("src")).join(adj, "src").select(F.col("dst").alias("id")).distinct()
        known = levels.every() if graph.directed else levels.last(2)
        front = levels.add(found.join(known.select("id"), "id", "left_anti").select("id", F.lit(dist).cast("long").alias("dist")))
    return levels.every()


def _visits(graph: Graph, start) -> DataFrame:
    spark = graph.nodes.sparkSession
    scratch = Scratch(spark, "bfs")
    kind = graph.nodes.schema["id"].dataType.simpleString()
    adj = scratch.save(graph.adjacency().select("src", "dst", "nbr_pos"), "adjacency")
    pos = graph.nodes.select("id", "node_pos")
    front = spark.createDataFrame([(start, 0, 0, None)], f"id {kind}, dist bigint, ord bigint, via {kind}")
    levels, dist, total = _Levels(scratch, front), 0, 1
    while True:
        dist += 1
        found = front.select(F.col("id").alias("src"), "ord").join(adj, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("ord", "nbr_pos", "src")).alias("by"))
        known = levels.every() if graph.directed else levels.last(2)
        found = found.join(known.select("id"), "id", "left_anti").join(pos, "id")
        found = with_positions(found, [F.col("by.ord"), F.col("by.nbr_pos"), F.col("node_pos")], "ord", total)
        front = levels.add(found.select("id", F.lit(dist).cast("long").alias("dist"), "ord", F.col("by.src").alias("via")))
        size = front.count()
        if not size:
            return levels.every()
        total += size


def kernel(graph: Graph, run: Callable, schema: str, values: DataFrame | None = None) -> DataFrame:
    """A sequential algorithm over one graph's adjacency in one task; many graphs would run side by side.

    For algorithms whose order of steps is their result; the graph, or the part of it, must fit in a task. ``run`` takes {node: {neighbour: weight}} in order, and {node: h} where ``values(id, h)`` is given.
    """
    graph = graph.ordered()
    adj = graph.adjacency().select(F.lit(1).alias("edge"), "src", "dst", "weight", F.col("nbr_pos").alias("pos"))
    nodes = graph.nodes.select(F.lit(0).alias("edge"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"), F.col("node_pos").alias("pos"))
    both = adj.unionByName(nodes)
    if values is not None:
        both = both.unionByName(values.select(F.lit(2).alias("edge"), F.col("id").alias("src"), F.col("id").alias("dst"), F.col("h").alias("weight"), F.lit(0).cast("long").alias("pos")))

    plain = values is None

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["edge", "pos"], kind="stable")
        near: dict = {v: {} for v in pdf.loc[pdf.edge == 0, "src"].tolist()}
        part = pdf[pdf.edge == 1]
        for u, v, w in zip(part.src.tolist(), part.dst.tolist(), part.weight.tolist()):
            near[u][v] = w
        if plain:
            return run(near)
        own = pdf[pdf.edge == 2]
        return run(near, dict(zip(own.src.tolist(), own.weight.tolist())))

    return both.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(call, schema)


def reached_part(graph: Graph, start) -> Graph:
    """The graph of the nodes that ``start`` reaches."""
    reach = bfs(graph, start, with_order=False).select("id")
    edges = graph.edges.join(reach.withColumnRenamed("id", "src"), "src", "left_semi").join(reach.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(graph.nodes.join(reach, "id", "left_semi"), edges, graph.directed, graph.weighted)


def dfs(graph: Graph, start) -> DataFrame:
    """id, ord, via in depth-first preorder. Only what ``start`` reaches enters the sequential kernel."""
    kind = graph.nodes.schema["id"].dataType.simpleString()

    def run(near):
        order, seen, stack = [], set(), [(start, None)]
        while stack:
            v, via = stack.pop()
            if v not in seen:
                seen.add(v)
                order.append((v, len(order), via))
                stack.extend((w, v) for w in reversed(near[v]) if w not in seen)
        return pd.DataFrame(order, columns=["id", "ord", "via"])

    return kernel(reached_part(graph, start), run, f"id {kind}, ord bigint, via {kind}")


dfs_iterative = dfs


def topological_levels(graph: Graph) -> DataFrame:
    """id, level (longest path from a source); an edge's head always lies above its tail."""
    graph.ensure_kind(True, "topological order")
    scratch = Scratch(graph.nodes.sparkSession, "topological")
    edges = scratch.save(graph.edges.select("src", "dst"), "edges")
    left = scratch.save(graph.nodes.select("id"), "left")
    levels, level, remaining = _Levels(scratch, left.where("false").withColumn("level", F.lit(0).cast("long"))), 0, left.count()
    while remaining:
        ready = left.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        ready = levels.add(ready.withColumn("level", F.lit(level).cast("long")))
        size = ready.count()
        if not size:
            raise ValueError("Graph contains a cycle")
        edges = scratch.save(edges.join(ready.select(F.col("id").alias("src")), "src", "left_anti"), "edges")
        left = scratch.save(left.join(ready.select("id"), "id", "left_anti"), "left")
        level, remaining = level + 1, remaining - size
    return levels.every()


def topological_sort(graph: Graph) -> DataFrame:
    """id, ord: a valid order, by level and then by place among the nodes."""
    graph = graph.ordered()
    levels = topological_levels(graph).join(graph.nodes.select("id", "node_pos"), "id")
    return with_positions(levels, [F.col("level"), F.col("node_pos")], "ord").select("id", "ord")


def connected_components(graph: Graph) -> DataFrame:
    """id, component: the smallest id that it is connected to."""
    graph.ensure_kind(False, "connected components")
    return _components(graph.nodes, graph.edges)


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    found = component_labels(edges.select("src", "dst"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def is_bipartite(graph: Graph) -> bool:
    """Whether two colours do.

    Undirected: every node is doubled, one copy for each colour, and edges join opposite copies; a graph is
    bipartite exactly when no node's two copies meet in one component. Directed edges are walked forwards only, from
    each node in order that no earlier one has reached, which starts with the first colour again; so the answer for a
    directed graph depends on the order of its nodes.
    """
    if graph.directed:
        return _forward_colours(graph.ordered())
    side = lambda c, k: F.concat(F.col(c).cast("string"), F.lit(f"|{k}"))
    e = graph.edges
    doubled = e.select(side("src", 0).alias("src"), side("dst", 1).alias("dst")).unionAll(e.select(side("src", 1), side("dst", 0)))
    comp = component_labels(doubled)
    name = F.regexp_replace("id", r"\|[01]$", "")
    return comp.groupBy(name.alias("v")).agg(F.count("*").alias("n"), F.count_distinct("component").alias("c")).where("n > 1 and c = 1").isEmpty()


def _forward_colours(graph: Graph) -> bool:
    """A node belongs to the first one that reaches it, and its colour is the parity of its hops from there."""
    scratch = Scratch(graph.nodes.sparkSession, "colours")
    edges = scratch.save(graph.edges.select("src", "dst"), "edges")
    by = scratch.save(graph.nodes.select("id", F.struct(F.col("node_pos").alias("root"), F.lit(0).alias("hops")).alias("by"), F.lit(True).alias("moved")), "by")
    while not by.where("moved").isEmpty():
        offer = by.where("moved").select(F.col("id").alias("src"), "by").join(edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(F.col("by.root").alias("root"), (F.col("by.hops") + 1).alias("hops"))).alias("o"))
        better = F.coalesce(F.col("o") < F.col("by"), F.lit(False))
        by = scratch.save(by.drop("moved").join(offer, "id", "left").select("id", F.when(better, F.col("o")).otherwise(F.col("by")).alias("by"), better.alias("moved")), "by")
    colour = (F.col("by.hops") % 2).alias("c")
    ends = edges.join(by.select(F.col("id").alias("src"), colour.alias("a")), "src").join(by.select(F.col("id").alias("dst"), colour.alias("b")), "dst")
    return ends.where("a = b").isEmpty()


def strongly_connected_components(graph: Graph) -> DataFrame:
    """id, component (the smallest id of it), by trimming and forward-backward colouring."""
    graph.ensure_kind(True, "strongly connected components")
    scratch = Scratch(graph.nodes.sparkSession, "scc")
    left = scratch.save(graph.nodes.select("id"), "left")
    edges = scratch.save(graph.edges.where("src != dst").select("src", "dst"), "edges")
    out, turn = None, 0
    while not left.isEmpty():
        ends = [edges.select(F.col(c).alias("id")).distinct() for c in ("src", "dst")]
        inner = left.join(ends[0], "id", "left_semi").join(ends[1], "id", "left_semi")
        lone = left.join(inner, "id", "left_anti").select("id", F.col("id").alias("component"))
        colour = scratch.save(inner.select("id", F.col("id").alias("c")), "colour")
        inner = scratch.save(inner, "inner")
        inside = scratch.save(edges.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"), "inside")
        while True:
            # The least id that reaches a node colours it.
            heard = inside.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("h"))
            fresh = scratch.save(colour.join(heard, "id", "left").select("id", F.least("c", "h").alias("c"), (F.col("h") < F.col("c")).alias("moved")), "fresh")
            moved = not fresh.where("moved").isEmpty()
            colour = scratch.save(fresh.select("id", "c"), "colour")
            if not moved:
                break
        same = scratch.save(inside.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst"), "same")
        back = front = scratch.save(colour.where("id = c"), "back0")
        step = 1
        while not front.isEmpty():
            reached = same.join(front.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            front = scratch.save(reached.join(back.select("id"), "id", "left_anti"), f"back{turn}-{step}")
            back, step = back.unionByName(front), step + 1
        done = scratch.save(lone.unionByName(back.select("id", F.col("c").alias("component"))), f"done{turn}")
        out = done if out is None else out.unionByName(done)
        left = scratch.save(left.join(done.select("id"), "id", "left_anti"), "left")
        edges = scratch.save(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"), "edges")
        turn += 1
    return out if out is not None else graph.nodes.select("id", F.col("id").alias("component"))


def _grown(scratch: Scratch, roots: DataFrame, adj: DataFrame) -> DataFrame:
    """id, parent, depth: breadth-first trees from ``roots(id)``, one for each component; a root is its own parent."""
    front, depth = roots.select("id", F.col("id").alias("parent"), F.lit(0).alias("depth")), 0
    levels = _Levels(scratch, front)
    while not front.isEmpty():
        depth += 1
        found = front.select(F.col("id").alias("src")).join(adj, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = levels.add(found.join(levels.last(2).select("id"), "id", "left_anti").select("id", "parent", F.lit(depth).alias("depth")))
    return levels.every()


def _forest(graph: Graph, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """id, parent, depth: a breadth-first forest of all components, rooted at their smallest ids.

    The component of the smallest id of all is grown at once; only what it leaves needs labels first.
    """
    spark = graph.nodes.sparkSession
    adj = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    first = scratch.save(_grown(Scratch(spark, "tree"), graph.nodes.agg(F.min("id").alias("id")).where("id is not null"), adj), "first")
    rest = scratch.save(graph.nodes.select("id").join(first.select("id"), "id", "left_anti"), "rest")
    if rest.isEmpty():
        return first
    inside = scratch.save(edges.join(rest.select(F.col("id").alias("src")), "src", "left_semi"), "inside")
    roots = _components(rest, inside).where("id = component")
    adj = inside.unionAll(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return scratch.save(first.unionByName(_grown(Scratch(spark, "trees"), roots, adj)).sortWithinPartitions("depth"), "forest")


def _over_subtrees(tree: DataFrame, deepest: int, how: dict[str, tuple[Callable, Callable]]) -> DataFrame:
    """``tree`` with each column of ``how`` (over the children's rows, with the own value) taken over whole subtrees, level by level."""
    levels, below = None, None
    for depth in range(deepest, -1, -1):
        at = tree.where(F.col("depth") == depth)
        if below is not None:
            got = below.groupBy(F.col("parent").alias("id")).agg(*[many(c).alias(f"below_{c}") for c, (many, _) in how.items()])
            at = at.join(got, "id", "left").select(*[F.coalesce(how[c][1](F.col(c), F.col(f"below_{c}")), F.col(c)).alias(c) if c in how else F.col(c) for c in tree.columns])
        if levels is None:
            levels = _Levels(Scratch(tree.sparkSession, "subtrees"), at)
            below = levels.recent[-1]
        else:
            below = levels.add(at)
    return levels.every()


def _preorder(tree: DataFrame, deepest: int, scratch: Scratch) -> DataFrame:
    """id, parent, depth, size (of the subtree), pre (place in a walk of its tree, children by id)."""
    sized = _over_subtrees(tree.withColumn("size", F.lit(1).cast("long")), deepest, {"size": (F.sum, lambda own, got: own + got)})
    before = F.sum("size").over(Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    placed = scratch.save(sized.where("depth > 0").withColumn("before", F.coalesce(before, F.lit(0))).sortWithinPartitions("depth"), "placed")
    levels = _Levels(Scratch(tree.sparkSession, "preorder"), sized.where("depth = 0").withColumn("pre", F.lit(0).cast("long")))
    above = levels.recent[-1]
    for depth in range(1, deepest + 1):
        at = placed.where(F.col("depth") == depth).join(above.select(F.col("id").alias("parent"), F.col("pre").alias("from")), "parent")
        above = levels.add(at.select("id", "parent", "depth", "size", (F.col("from") + 1 + F.col("before")).alias("pre")))
    return scratch.save(levels.every(), "preorder")


def _reaches(graph: Graph, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The forest with what each subtree reaches, and the edges outside the forest (Tarjan-Vishkin on a BFS forest).

    id, parent, depth, size, pre, low, high: the least and the largest ``pre`` in the subtree of ``id`` and at the other
    ends of its edges outside the forest. Each edge is read a few times, however deep the forest; rounds are its levels.
    """
    edges = graph.edges.where("src != dst").select("src", "dst")
    if graph.placed:
        edges = scratch.save(edges, "edges")
    tree = _forest(graph, scratch, edges)
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    tree = _preorder(tree, deepest, scratch)
    end = lambda c: tree.select(F.col("id").alias(c), F.col("pre").alias(f"pre_{c}"), F.col("parent").alias(f"up_{c}"))
    flat = edges.join(end("src"), "src").where("up_src != dst").select("src", "dst", "pre_src").join(end("dst"), "dst").where("up_dst != src")
    flat = scratch.save(flat.select("src", "dst", "pre_src", "pre_dst"), "flat")
    seen = flat.select(F.col("src").alias("id"), F.col("pre_dst").alias("far")).unionAll(flat.select("dst", "pre_src")).groupBy("id").agg(F.min("far").alias("low"), F.max("far").alias("high"))
    own = tree.join(seen, "id", "left").select(*tree.columns, F.least("pre", "low").alias("low"), F.greatest("pre", "high").alias("high"))
    own = scratch.save(own.sortWithinPartitions("depth"), "own")
    return _over_subtrees(own, deepest, {"low": (F.min, F.least), "high": (F.max, F.greatest)}), flat.select("src", "dst")


def find_bridges(graph: Graph) -> DataFrame:
    """src, dst (smaller id first) of edges whose loss splits their component: of the forest's, those that no edge spans."""
    graph.ensure_kind(False, "bridges")
    tree, _ = _reaches(graph, Scratch(graph.nodes.sparkSession, "bridges"))
    one = tree.where("depth > 0 and low >= pre and high < pre + size")
    return one.select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))


def find_articulation_points(graph: Graph) -> DataFrame:
    """id of nodes whose loss splits their component: those in two or more biconnected blocks.

    A forest's edge is named by its lower end. An edge outside the forest joins those above its ends, and one of the
    forest joins the next one up if its subtree reaches beyond that one's; what is joined is one block.
    """
    graph.ensure_kind(False, "articulation points")
    scratch = Scratch(graph.nodes.sparkSession, "blocks")
    tree, flat = _reaches(graph, scratch)
    over = tree.where("depth > 0").select(F.col("id").alias("parent"), F.col("pre").alias("first"), (F.col("pre") + F.col("size")).alias("end"))
    beyond = tree.select("id", "parent", "low", "high").join(over, "parent").where("low < first or high >= end")
    joined = component_labels(flat.unionByName(beyond.select(F.col("id").alias("src"), F.col("parent").alias("dst"))))
    named = tree.where("depth > 0").select("id", "parent").join(joined, "id", "left").select("id", "parent", F.coalesce("component", "id").alias("block"))
    ends = named.select("block", F.explode(F.array("id", "parent")).alias("id"))
    return ends.groupBy("id").agg(F.count_distinct("block").alias("n")).where("n > 1").select("id")
