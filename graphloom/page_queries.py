"""Queries of requests, step logs, edits and graphs of known structure, and the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as base
from .graph import Graph
from .operators import mst, traces, traversal
from .requests import respond
from .sources import generators
from .sources import tables as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(run):
        QUERIES[run.__name__], ORACLE[run.__name__] = run, sql
        return run

    return add


def _body(spark: SparkSession, sf: str, sql: str = T.SURPLUS, directed: bool = True, **more) -> dict:
    """A request with the nations' graph, which a page can show."""
    rows = T.table_rows(spark, sf, sql).orderBy("src", "dst").collect()
    nodes = sorted({v for r in rows for v in (r["src"], r["dst"])})
    return {"nodes": nodes, "edges": [[r["src"], r["dst"], float(r["weight"])] for r in rows], "directed": directed, "weighted": True, **more}


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_HOPS = base._with(T.SURPLUS, base.DIRECTED, "few(id, dist) using key (id) as (select cast(0 as bigint), 0 union (select a.dst, min(f.dist + 1) from few f join adj a on a.src = f.id left join recurring.few r on r.id = a.dst where r.dist is null group by 1))")


@query(_HOPS + "select id, cast(dist as bigint) as dist, true as in_order from few")
def page_bfs(spark: SparkSession, sf: str) -> DataFrame:
    got = respond(spark, "/api/traversal/bfs", _body(spark, sf, start=0))
    dist = {int(v): d for v, d in got["distances"].items()}
    ordered = [dist[v] for v in got["order"]]
    return _table(spark, [(v, d, ordered == sorted(ordered) and len(ordered) == len(dist)) for v, d in dist.items()], "id bigint, dist bigint, in_order boolean")


_NEAR = base._with(T.SURPLUS, base.DIRECTED, base._NEAR_ONE, "p as (select n.id, min({'at': m.dist, 'src': m.id}) as o from near n join adj a on a.dst = n.id join near m on m.id = a.src and m.dist + a.weight = n.dist group by 1)")


@query(_NEAR + "select n.id, n.dist, n.dist as bellman_ford, o.src as pred from near n left join p on p.id = n.id")
def page_paths(spark: SparkSession, sf: str) -> DataFrame:
    body = _body(spark, sf, start=0)
    one, two = (respond(spark, f"/api/shortest-path/{name}", body) for name in ("dijkstra", "bellman-ford"))
    return _table(spark, [(int(v), d, two["distances"][v], one["predecessors"][v]) for v, d in one["distances"].items()], "id bigint, dist double, bellman_ford double, pred bigint")


@query(base._with(T.SURPLUS, base.DIRECTED, base.NODES, base.NEAR) + "select a.id as src, b.id as dst, near.dist as floyd_warshall, near.dist as johnsons from v a cross join v b left join near on near.src = a.id and near.dst = b.id")
def page_pairs(spark: SparkSession, sf: str) -> DataFrame:
    body = _body(spark, sf)
    one, two = (respond(spark, f"/api/shortest-path/{name}", body)["distances"] for name in ("floyd-warshall", "johnsons"))
    rows = [(int(u), int(v), d, two[u][v] if two[u][v] is None else round(two[u][v], 6)) for u, own in one.items() for v, d in own.items()]
    return _table(spark, rows, "src bigint, dst bigint, floyd_warshall double, johnsons double")


_SCORES = {"pagerank": "ranks", "closeness": "scores"}


@query("select p.id, round(p.score, 7) as pagerank, round(c.score, 7) as closeness from " + " join ".join(f"({base.ORACLE[n]}) {n[0]}" + (f" on {n[0]}.id = p.id" if n != "pagerank" else "") for n in _SCORES))
def page_scores(spark: SparkSession, sf: str) -> DataFrame:
    body = _body(spark, sf)
    found = {n: respond(spark, f"/api/centrality/{n}", body)[key] for n, key in _SCORES.items()}
    return _table(spark, [(int(v), *(round(found[n][v], 9) for n in _SCORES)) for v in found["pagerank"]], "id bigint, pagerank double, closeness double").select("id", *[F.round(n, 7).alias(n) for n in _SCORES])


@query(base.ORACLE["strongly_connected_components"])
def page_components(spark: SparkSession, sf: str) -> DataFrame:
    parts = respond(spark, "/api/traversal/scc", _body(spark, sf))["components"]
    return _table(spark, [(int(v), int(min(part))) for part in parts for v in part], "id bigint, component bigint")


_TREES = f"with t as ({base._TREE_SQL}) select a as algorithm, count(*) as edges, sum(weight) as weight from t cross join (select unnest(['kruskals', 'prims']) as a) group by 1"


@query(_TREES)
def page_trees(spark: SparkSession, sf: str) -> DataFrame:
    undirected = f"select least(src, dst) as src, greatest(src, dst) as dst, min(weight) as weight from ({T.TRADE}) t group by 1, 2"
    body = _body(spark, sf, undirected, directed=False)
    got = {name: respond(spark, f"/api/mst/{name}", body) for name in ("kruskals", "prims")}
    return _table(spark, [(name, len(r["edges"]), r["total_weight"]) for name, r in got.items()], "algorithm string, edges bigint, weight double")


@query(_TREES)
def compare_mst(spark: SparkSession, sf: str) -> DataFrame:
    return mst.compare_mst_algorithms(base._undirected(spark, sf, T.TRADE)).select("algorithm", "edges", "weight")


#: A binary tree of 511 nodes whose ids are dealt out anew; children come in order of their place.
_TREE_IDS = "with recursive t as (select i as k, (i * 37) % 511 as id, case when i > 0 then (((i - 1) // 2) * 37) % 511 end as via, (i - 1) // 2 as up from range(0, 511) r(i))"


def _heap(spark: SparkSession) -> Graph:
    rows = [((i - 1) // 2 * 37 % 511, i * 37 % 511, i) for i in range(1, 511)]
    return Graph.from_edges(spark.createDataFrame(rows, "src bigint, dst bigint, pos bigint"))


@query(_TREE_IDS + ", p(k, path) as (select cast(0 as bigint), '1' union all select t.k, p.path || cast(1 + (t.k - 1) % 2 as varchar) from p join t on t.up = p.k and t.k > 0) select t.id, t.k as bfs_ord, cast(len(path) - 1 as bigint) as dist, t.via, row_number() over (order by path) - 1 as dfs_ord, row_number() over (order by path) - 1 as iterative_ord, t.k as bfs_step, row_number() over (order by path) - 1 as dfs_step from t join p using (k)")
def tree_orders(spark: SparkSession, sf: str) -> DataFrame:
    g = _heap(spark)
    breadth = traversal.bfs(g, 0).select("id", F.col("ord").alias("bfs_ord"), "dist", "via")
    depth = traversal.dfs(g, 0).select("id", F.col("ord").alias("dfs_ord"))
    again = traversal.dfs_iterative(g, 0).select("id", F.col("ord").alias("iterative_ord"))

    def visits(trace: DataFrame, name: str) -> DataFrame:
        own = trace.where("action = 'visit'").select("step_no", F.get_json_object("step", "$.node").cast("bigint").alias("id"))
        from .plans.ranking import with_positions

        return with_positions(own, [F.col("step_no")], name).select("id", name)

    out = breadth.join(depth, "id").join(again, "id")
    return out.join(visits(traces.bfs(g, 0), "bfs_step"), "id").join(visits(traces.dfs(g, 0), "dfs_step"), "id")


@query(f"with e as ({T.SURPLUS}), v as (select distinct src as id from e union select dst from e), a as (select src, dst, weight from e where not (src = 1 or dst = 1) and not (src = 0 and dst = 2)), n as (select id as src, 100 + id % 3 as dst, 7 as weight from v where id <> 1) select src, dst, cast(weight as double) as weight from a union all select src, dst, cast(weight as double) from n")
def graph_edits(spark: SparkSession, sf: str) -> DataFrame:
    g = T.table_graph(spark, sf, T.SURPLUS, directed=True)
    more = g.nodes.where("id <> 1").select(F.col("id").alias("src"), (100 + F.col("id") % 3).alias("dst"), F.lit(7.0).alias("weight"))
    return g.remove_node(1).remove_edge(0, 2).add_edges(more).edges.select("src", "dst", "weight")


@query(f"with e as ({T.SURPLUS}), v as (select distinct src as id from e union select dst from e) select id, case when id = 3 then 'red' when id % 5 = 0 then 'blue' end as colour, case when id % 5 = 0 then 1 else 0 end + case when id = 3 then 1 else 0 end + case when id = 5 then 1 else 0 end as attributes from (select id from v union select 777)")
def node_values(spark: SparkSession, sf: str) -> DataFrame:
    g = T.table_graph(spark, sf, T.SURPLUS, directed=True)
    blue = g.nodes.where("id % 5 = 0").select("id", F.create_map(F.lit("colour"), F.lit("blue")).alias("attrs"))
    g = g.add_nodes(blue.unionByName(spark.createDataFrame([(777, {})], "id bigint, attrs map<string,string>"))).set_node_attr(3, "colour", "red").set_node_attr(5, "size", "9")
    return g.nodes.select("id", F.try_element_at("attrs", F.lit("colour")).alias("colour"), F.coalesce(F.size(F.map_keys("attrs")), F.lit(0)).alias("attributes")).withColumn("attributes", F.greatest("attributes", F.lit(0)))


@query("select kind, a.i as src, b.i as dst, cast(weight as double) as weight from (select unnest(['plain', 'weighted', 'directed']) as kind, unnest([1, 3, 1]) as weight) k, range(0, 40) a(i), range(0, 40) b(i) where a.i < b.i or (kind = 'directed' and a.i <> b.i)")
def complete_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Random graphs at certainty: every pair once, or both ways."""
    made = {"plain": generators.random_graph(spark, 40, 1.0), "weighted": generators.random_weighted_graph(spark, 40, 1.0, 3.0, 3.0, seed=5), "directed": generators.generate(spark, "random", directed=True, n=40, p=1.0)}
    parts = [g.edges.select(F.lit(kind).alias("kind"), "src", "dst", "weight") for kind, g in made.items()]
    none = generators.random_graph(spark, 40, 0.0).edges.select(F.lit("none").alias("kind"), "src", "dst", "weight")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(none)


@query("with g as (select i as id, i % 6 as c, i // 6 as r from range(0, 30) t(i)), e as (select id as src, id + 1 as dst from g where c < 5 union all select id, id + 6 from g where r < 4), o as (select src, dst from e union all select dst, src from e) select o.src, o.dst, cast(a.c as double) as x, cast(a.r as double) as y, (a.c + a.r) % 2 = 0 as left_side from o join g a on a.id = o.src")
def grid_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Each edge of a grid both ways, its tail's place, and whether it leaves the even side, which is one of two."""
    g = generators.grid_graph(spark, 5, 6)
    at = g.coordinates()
    even = (F.col("x") + F.col("y")) % 2 == 0
    left, right = at.where(even).select("id"), at.where(~even).select("id")
    across = g.bipartite_edges(left, right).select(F.col("left").alias("src"), F.col("right").alias("dst"), F.lit(True).alias("left_side"))
    back = g.bipartite_edges(right, left).select(F.col("left").alias("src"), F.col("right").alias("dst"), F.lit(False).alias("left_side"))
    both = g.oriented_edges().select("src", "dst").join(across.unionByName(back), ["src", "dst"])
    return both.join(at.withColumnRenamed("id", "src"), "src").select("src", "dst", "x", "y", "left_side")
