"""The graph: two DataFrames and two flags.

``nodes``: id, node_pos, x, y, attrs. ``edges``: src, dst, weight, edge_pos, nbr_pos, a row for each edge of a
simple graph. Row order never matters: ``node_pos`` is the order of nodes, ``edge_pos`` that of edges listed node
by node, and ``nbr_pos`` that in which edges were made, which orders the neighbours of a node. Positions take global
sorts; a graph made with ``ordered=False`` leaves them null until :meth:`Graph.ordered` is asked for, which every
operator does whose result depends on them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import Scratch
from .plans.ranking import with_positions

ATTRS = "map<string,string>"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False
    weighted: bool = False
    placed: bool = True

    # Building

    @staticmethod
    def from_edges(rows: DataFrame, directed: bool = False, weighted: bool = False, nodes: DataFrame | None = None, ordered: bool = True) -> Graph:
        """A graph from ``rows(src, dst[, weight[, pos]])`` and optional ``nodes(id[, pos, x, y, attrs])``.

        A pair that comes again takes the last weight and keeps its first place; undirected pairs are the
        same either way round. Without ``pos`` columns, order is by id; then positions can wait (``ordered=False``).
        """
        cols = rows.columns
        if not ordered:
            if "pos" in cols or nodes is not None:
                raise ValueError("only graphs whose order is by id can wait for their positions")
            return Graph._unplaced(rows, directed, weighted)
        weight = F.col("weight").cast("double") if weighted and "weight" in cols else F.lit(1.0)
        rows = rows.select("src", "dst", F.coalesce(weight, F.lit(1.0)).alias("weight"), F.col("pos") if "pos" in cols else F.struct("src", "dst").alias("pos"))
        ends = rows.select(F.explode(F.array(F.struct(F.lit(1).alias("late"), "pos", F.lit(0).alias("side"), F.col("src").alias("id")), F.struct(F.lit(1).alias("late"), "pos", F.lit(1).alias("side"), F.col("dst").alias("id")))).alias("e")).select("e.id", F.struct("e.late", "e.pos", "e.side").alias("at"))
        if "pos" not in cols:
            ends = ends.select("id", F.struct(F.lit(1).alias("late"), F.col("id").alias("pos"), F.lit(0).alias("side")).alias("at"))
        named = ends.groupBy("id").agg(F.min("at").alias("at"))
        if nodes is not None:
            has = lambda c, kind: (F.col(c) if c in nodes.columns else F.lit(None)).cast(kind)
            first = F.col("pos") if "pos" in nodes.columns else F.col("id")
            listed = nodes.groupBy("id").agg(F.min(first).alias("given"), *[F.max_by(has(c, k), first).alias(c) for c, k in (("x", "double"), ("y", "double"), ("attrs", ATTRS))])
            named = named.join(listed, "id", "full")
        else:
            named = named.select("id", "at", F.lit(None).cast("long").alias("given"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(None).cast(ATTRS).alias("attrs"))
        named = with_positions(named, [F.col("given").asc_nulls_last(), F.col("at").asc_nulls_last(), F.col("id")], "node_pos")
        nodes_df = named.select("id", "node_pos", "x", "y", "attrs")
        a, b = F.col("src"), F.col("dst")
        key = [a, b] if directed else [F.least(a, b), F.greatest(a, b)]
        once = rows.groupBy(*[k.alias(n) for k, n in zip(key, ("p", "q"))]).agg(F.max_by("weight", "pos").alias("weight"), F.min(F.struct("pos", "src", "dst")).alias("first"))
        once = once.select(F.col("first.src").alias("src"), F.col("first.dst").alias("dst"), "weight", F.col("first.pos").alias("made"))
        pos = nodes_df.select("id", "node_pos")
        once = once.join(pos.select(F.col("id").alias("src"), F.col("node_pos").alias("ps")), "src").join(pos.select(F.col("id").alias("dst"), F.col("node_pos").alias("pd")), "dst")
        if not directed:
            swap = F.col("ps") > F.col("pd")
            once = once.select(F.when(swap, b).otherwise(a).alias("src"), F.when(swap, a).otherwise(b).alias("dst"), "weight", "made", F.least("ps", "pd").alias("ps"))
        placed = with_positions(once, [F.col("ps"), F.col("made")], "edge_pos")
        made = F.col("made").cast("long") if "pos" in cols else F.col("edge_pos")
        return Graph(nodes_df, placed.select("src", "dst", "weight", "edge_pos", made.alias("nbr_pos")), directed, weighted)

    @staticmethod
    def _unplaced(rows: DataFrame, directed: bool, weighted: bool) -> Graph:
        a, b = F.col("src"), F.col("dst")
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if weighted and "weight" in rows.columns else F.lit(1.0)
        # Of rows for one pair the last in order of (src, dst) has the weight, as when positions are given.
        key = [a, b] if directed else [F.least(a, b), F.greatest(a, b)]
        ends = [k.alias(n) for k, n in zip(key, ("p", "q"))]
        if weighted and "weight" in rows.columns:
            once = rows.select(*ends, F.struct("src", "dst").alias("pos"), weight.alias("weight")).groupBy("p", "q").agg(F.max_by("weight", "pos").alias("weight"))
        else:
            once = rows.select(*ends).distinct().withColumn("weight", weight)
        none = F.lit(None).cast("long")
        scratch = Scratch(rows.sparkSession, "graph")
        edges = scratch.save(once.select(F.col("p").alias("src"), F.col("q").alias("dst"), "weight"), "edges")
        ids = scratch.save(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "nodes")
        nodes = ids.select("id", none.alias("node_pos"), none.cast("double").alias("x"), none.cast("double").alias("y"), F.lit(None).cast(ATTRS).alias("attrs"))
        return Graph(nodes, edges.select("*", none.alias("edge_pos"), none.alias("nbr_pos")), directed, weighted, False)

    def ordered(self) -> Graph:
        """This graph with its positions."""
        if self.placed:
            return self
        return Graph.from_edges(self.edges.select("src", "dst", "weight"), self.directed, self.weighted, self.nodes.select("id", "x", "y", "attrs"))

    @staticmethod
    def of(spark: SparkSession, edges: Iterable, directed: bool = False, weighted: bool = False, nodes: Iterable | None = None) -> Graph:
        """From Python values: pairs or triples, and ids or (id, x, y)."""
        edges, nodes = [tuple(e) for e in edges], list(nodes) if nodes is not None else None
        if any(len(e) < 2 for e in edges):
            raise ValueError("an edge needs two ends")
        ids = [v for e in edges for v in e[:2]] + [n[0] if isinstance(n, tuple) else n for n in nodes or []]
        text = any(isinstance(v, str) for v in ids)
        kind, own = ("string", str) if text else ("bigint", int)
        at: dict = {}  # node: its coordinates, in order of nodes
        for n in nodes or []:
            at[own(n[0] if isinstance(n, tuple) else n)] = tuple(n[1:3]) if isinstance(n, tuple) else (None, None)
        made: dict = {}  # pair: place, ends as they came first, last weight
        for i, e in enumerate(edges):
            u, v = own(e[0]), own(e[1])
            for end in (u, v):
                at.setdefault(end, (None, None))
            pair = (u, v) if directed or u <= v else (v, u)
            made[pair] = (*made.get(pair, (i, u, v))[:3], float(e[2]) if weighted and len(e) > 2 else 1.0)
        pos = {n: k for k, n in enumerate(at)}
        turned = [(i, u, v, w) if directed or pos[u] <= pos[v] else (i, v, u, w) for i, u, v, w in made.values()]
        turned.sort(key=lambda e: (pos[e[1]], e[0]))
        nodes_df = spark.createDataFrame([(n, k, *map(lambda c: None if c is None else float(c), at[n]), None) for n, k in pos.items()], f"id {kind}, node_pos bigint, x double, y double, attrs {ATTRS}")
        return Graph(nodes_df, spark.createDataFrame([(u, v, w, k, i) for k, (i, u, v, w) in enumerate(turned)], f"src {kind}, dst {kind}, weight double, edge_pos bigint, nbr_pos bigint"), directed, weighted)

    # Changing

    def _rebuilt(self, more_edges: DataFrame | None = None, more_nodes: DataFrame | None = None) -> Graph:
        if not self.placed:
            return self.ordered()._rebuilt(more_edges, more_nodes)
        rows = self.edges.select("src", "dst", "weight", F.col("nbr_pos").alias("pos"))
        if more_edges is not None:
            weight = F.col("weight").cast("double") if "weight" in more_edges.columns else F.lit(1.0)
            pos = F.col("pos") if "pos" in more_edges.columns else F.monotonically_increasing_id()
            late = (self.edges.agg(F.max("nbr_pos")).first()[0] or 0) + 1
            rows = rows.unionByName(more_edges.select("src", "dst", weight.alias("weight"), (pos.cast("long") + F.lit(late)).alias("pos")))
        nodes = self.nodes.select("id", F.col("node_pos").alias("pos"), "x", "y", "attrs")
        if more_nodes is not None:
            nodes = nodes.unionByName(more_nodes.select("id", (F.lit(1 << 40) + F.monotonically_increasing_id()).alias("pos"), *[(F.col(c) if c in more_nodes.columns else F.lit(None)).cast(k).alias(c) for c, k in (("x", "double"), ("y", "double"), ("attrs", ATTRS))]))
            merged = nodes.groupBy("id").agg(
                F.min("pos").alias("pos"), F.max_by("x", F.when(F.col("x").isNotNull(), F.col("pos"))).alias("x"), F.max_by("y", F.when(F.col("y").isNotNull(), F.col("pos"))).alias("y"),
                F.array_sort(F.collect_list(F.struct("pos", F.map_entries("attrs").alias("entries")))).alias("all"),
            )
            entries = F.flatten(F.transform("all", lambda s: F.coalesce(s["entries"], F.array().cast("array<struct<key:string,value:string>>"))))
            last = F.aggregate(entries, F.create_map().cast(ATTRS), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))
            nodes = merged.select("id", "pos", "x", "y", last.alias("attrs"))
        return Graph.from_edges(rows, self.directed, self.weighted, nodes)

    def add_nodes(self, nodes: DataFrame) -> Graph:
        """Upserts ``nodes(id[, x, y, attrs])``; attributes merge, later ones win."""
        return self._rebuilt(more_nodes=nodes)

    def set_node_attr(self, node, key: str, value: str) -> Graph:
        spark = self.nodes.sparkSession
        kind = self.nodes.schema["id"].dataType.simpleString()
        return self.add_nodes(spark.createDataFrame([(node, {key: str(value)})], f"id {kind}, attrs {ATTRS}"))

    def add_edges(self, edges: DataFrame) -> Graph:
        return self._rebuilt(more_edges=edges)

    def with_flags(self, directed: bool, weighted: bool) -> Graph:
        """The same rows under other flags: pairs that come to be one edge merge, weights go where they do not count."""
        own = self.ordered()
        rows = own.edges.select("src", "dst", "weight", F.col("nbr_pos").alias("pos"))
        return Graph.from_edges(rows, directed, weighted, own.nodes.select("id", F.col("node_pos").alias("pos"), "x", "y", "attrs"))

    def remove_node(self, node) -> Graph:
        return replace(self, nodes=self.nodes.where(F.col("id") != F.lit(node)), edges=self.edges.where((F.col("src") != F.lit(node)) & (F.col("dst") != F.lit(node))))

    def remove_edge(self, u, v) -> Graph:
        hit = (F.col("src") == F.lit(u)) & (F.col("dst") == F.lit(v))
        if not self.directed:
            hit = hit | (F.col("src") == F.lit(v)) & (F.col("dst") == F.lit(u))
        return replace(self, edges=self.edges.where(~hit))

    # Reading

    def adjacency(self) -> DataFrame:
        """src, dst, weight, nbr_pos: directed edges as they are, undirected ones both ways, self-loops once."""
        e = self.edges.select("src", "dst", "weight", "nbr_pos")
        return e if self.directed else e.unionByName(e.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "nbr_pos"))

    def oriented_edges(self) -> DataFrame:
        """As :meth:`adjacency`, but undirected self-loops come twice."""
        e = self.edges.select("src", "dst", "weight")
        return e if self.directed else e.unionAll(e.select(F.col("dst"), F.col("src"), "weight"))

    def oriented_capacities(self) -> DataFrame:
        return self.oriented_edges().groupBy("src", "dst").agg(F.sum("weight").alias("capacity"))

    def bipartite_edges(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Edges between ``left(id)`` and ``right(id)`` as distinct (left, right); all others are left out."""
        side = left.select("id", F.lit(True).alias("l"), F.lit(False).alias("r")).unionAll(right.select("id", F.lit(False), F.lit(True)))
        side = side.groupBy("id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        ends = [side.select(F.col("id").alias(end), F.col("l").alias(f"{end}_l"), F.col("r").alias(f"{end}_r")) for end in ("src", "dst")]
        way = lambda a, b, also: F.when(F.col(f"{a}_l") & F.col(f"{b}_r") & also, F.struct(F.col(a).alias("left"), F.col(b).alias("right")))
        ways = F.array(way("src", "dst", F.lit(True)), way("dst", "src", F.col("src") != F.col("dst")))
        out = self.edges.select("src", "dst").join(ends[0], "src").join(ends[1], "dst").select(F.explode(F.array_compact(ways)).alias("e")).select("e.left", "e.right")
        # Only directed edges can give a pair twice.
        return out.distinct() if self.directed else out

    def neighbors(self, node) -> DataFrame:
        return self.adjacency().where(F.col("src") == F.lit(node)).select(F.col("dst").alias("id"), "weight")

    def node_attrs(self, node) -> DataFrame:
        """id and the whole map of attributes, empty where none are set; no row for a node that is not there."""
        return self.nodes.where(F.col("id") == F.lit(node)).select("id", F.coalesce("attrs", F.create_map().cast(ATTRS)).alias("attrs"))

    def node_attr(self, node, key: str, default: str | None = None) -> DataFrame:
        return self.nodes.where(F.col("id") == F.lit(node)).select("id", F.coalesce(F.try_element_at("attrs", F.lit(key)), F.lit(default)).alias("value"))

    def get_nodes(self) -> DataFrame:
        return self.ordered().nodes.orderBy("node_pos")

    def get_edges(self) -> DataFrame:
        return self.ordered().edges.orderBy("edge_pos")

    def num_nodes(self) -> int:
        return self.nodes.count()

    def num_edges(self) -> int:
        """Undirected: entries of the adjacency halved, so a lone self-loop counts nothing."""
        if self.directed:
            return self.edges.count()
        row = self.edges.agg(F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(2)).alias("n")).first()
        return (row["n"] or 0) // 2

    def coordinates(self) -> DataFrame:
        """id, x, y; from the columns, else from ``pos``, ``coords`` or ``xy`` written ``a,b`` in the attributes."""
        pair = F.split(F.regexp_replace(F.coalesce(*[F.try_element_at("attrs", F.lit(k)) for k in ("pos", "coords", "xy")]), r"[\[\]() ]", ""), ",")
        get = lambda own, i: F.coalesce(own, F.try_element_at(pair, F.lit(i)).cast("double"))
        return self.nodes.select("id", get(F.col("x"), 1).alias("x"), get(F.col("y"), 2).alias("y"))

    def to_networkx(self):
        """For validation by hand, where networkx is installed."""
        import networkx

        out = networkx.DiGraph() if self.directed else networkx.Graph()
        out.add_nodes_from((r["id"], r["attrs"] or {}) for r in self.nodes.orderBy("node_pos").toLocalIterator())
        out.add_weighted_edges_from((r["src"], r["dst"], r["weight"]) for r in self.edges.orderBy("edge_pos").toLocalIterator())
        return out

    def describe(self) -> str:
        return f"Graph({'directed' if self.directed else 'undirected'}, {'weighted' if self.weighted else 'unweighted'}, nodes={self.num_nodes()}, edges={self.num_edges()})"

    # Guards

    def ensure_node(self, node, what: str = "node") -> None:
        if node is None or self.nodes.where(F.col("id") == F.lit(node)).isEmpty():
            raise ValueError(f"{what} {node!r} is not in the graph")

    def ensure_new(self, node) -> None:
        if not self.nodes.where(F.col("id").cast("string") == F.lit(str(node))).isEmpty():
            raise ValueError(f"Node {node} already exists")

    def ensure_non_negative(self) -> None:
        if not self.edges.where("weight < 0").isEmpty():
            raise ValueError("negative edge weights are not allowed here")

    def ensure_kind(self, directed: bool, what: str) -> None:
        if self.directed != directed:
            raise ValueError(f"{what} needs {'a directed' if directed else 'an undirected'} graph")

    @staticmethod
    def entered_weight(weight: Column) -> Column:
        """The weight of an edge entered by hand: one for nothing, zero and what is no number."""
        own = weight.try_cast("double")
        return F.when(own.isNull() | F.isnan(own) | (own == 0), F.lit(1.0)).otherwise(own)

    def is_weighted(self) -> bool:
        return self.weighted and not self.edges.where("weight != 1").isEmpty()

    def scaled(self, weight: Column) -> Graph:
        return replace(self, edges=self.edges.withColumn("weight", weight), weighted=True)
