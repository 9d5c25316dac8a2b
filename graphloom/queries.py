"""Graph queries over the shared tables, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import present, stats
from .operators import centrality, flows, mst, paths, traversal
from .sources import generators
from .sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BOTH = "adj as (select src, dst, weight from e union all select dst, src, weight from e where src <> dst)"


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE[run.__name__] = sql
        return run

    return add


def _with(graph_sql: str, *ctes: str, recursive: bool = True) -> str:
    return f"with {'recursive ' if recursive else ''}e as ({graph_sql}), " + ", ".join(ctes) + " "


NODES = "v as (select src as id from e union select dst from e)"
#: Fewest hops of all pairs, by rounds that keep a row for each pair.
FEW = "few(src, dst, dist) using key (src, dst) as (select id, id, 0 from v union (select f.src, a.dst, min(f.dist + 1) from few f join adj a on a.src = f.dst left join recurring.few r on r.src = f.src and r.dst = a.dst where r.dist is null group by 1, 2))"
NEAR = "near(src, dst, dist) using key (src, dst) as (select id, id, cast(0 as double) from v union (select f.src, a.dst, min(f.dist + a.weight) from near f join adj a on a.src = f.dst left join recurring.near r on r.src = f.src and r.dst = a.dst where r.dist is null or f.dist + a.weight < r.dist group by 1, 2))"
DIRECTED = "adj as (select src, dst, weight from e)"


@query(_with(T.COPURCHASE, BOTH, "few(id, dist) using key (id) as (select cast(0 as bigint), 0 union (select a.dst, min(f.dist + 1) from few f join adj a on a.src = f.id left join recurring.few r on r.id = a.dst where r.dist is null group by 1))") + "select id, cast(dist as bigint) as dist from few")
def bfs_distances(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.bfs(T.table_graph(spark, sf, T.COPURCHASE), 0, with_order=False)


@query()
def bfs_order(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.bfs(generators.karate_club(spark), 0)


@query()
def dfs_order(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.dfs(T.table_graph(spark, sf, T.COPURCHASE), 0)


@query(_with(T.ORDER_CHAIN, NODES, "lv as (select id, 0 as level from v where id not in (select dst from e) union all select e.dst, l.level + 1 from lv l join e on e.src = l.id)") + "select id, cast(max(level) as bigint) as level from lv group by 1")
def topological_levels(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.topological_levels(T.table_graph(spark, sf, T.ORDER_CHAIN, directed=True))


@query(_with(T.ORDER_CHAIN, NODES, recursive=False) + "select count(*) as n, cast(0 as bigint) as low, count(*) - 1 as high, cast(0 as bigint) as bad from v")
def topological_sort_valid(spark: SparkSession, sf: str) -> DataFrame:
    g = T.table_graph(spark, sf, T.ORDER_CHAIN, directed=True)
    order = traversal.topological_sort(g)
    ends = g.edges.join(order.select(F.col("id").alias("src"), F.col("ord").alias("a")), "src").join(order.select(F.col("id").alias("dst"), F.col("ord").alias("b")), "dst")
    return order.agg(F.count("*").alias("n"), F.min("ord").alias("low"), F.max("ord").alias("high")).join(ends.agg(F.count_if(F.expr("a >= b")).alias("bad")))


#: The least id that each node is connected to, by rounds that keep a row for each node.
LABEL = "lab(id, c) using key (id) as (select id, id from v union (select a.dst, min(l.c) from lab l join adj a on a.src = l.id left join recurring.lab o on o.id = a.dst where l.c < o.c group by 1))"


def _two_colours(graph_sql: str) -> str:
    sides = "two(id, side) using key (id, side) as (select distinct c, 0 from lab union (select distinct a.dst, 1 - t.side from two t join adj a on a.src = t.id left join recurring.two o on o.id = a.dst and o.side = 1 - t.side where o.id is null))"
    return _with(graph_sql, BOTH, NODES, LABEL, sides) + "select count(*) = count(distinct id) as two from two"


@query(f"select (select two from ({_two_colours(T.SUPPLIER_PART)})) as g2, (select two from ({_two_colours(T.COPURCHASE)})) as g1")
def is_bipartite(spark: SparkSession, sf: str) -> DataFrame:
    two, one = traversal.is_bipartite(T.table_graph(spark, sf, T.SUPPLIER_PART)), traversal.is_bipartite(T.table_graph(spark, sf, T.COPURCHASE))
    return spark.createDataFrame([(two, one)], "g2 boolean, g1 boolean")


@query(_with(T.SUPPLIER_PART, BOTH, NODES, LABEL) + "select id, c as component from lab")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.connected_components(T.table_graph(spark, sf, T.SUPPLIER_PART))


@query(_with(T.SURPLUS, NODES, "r as (select id as a, id as b from v union select r.a, e.dst from r join e on e.src = r.b)") + "select x.a as id, min(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by 1")
def strongly_connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.strongly_connected_components(T.table_graph(spark, sf, T.SURPLUS, directed=True))


#: A bridge is a tree edge that no other edge spans. Every other edge has a 64-bit name; the names at a node's whole
#: subtree cancel out in pairs except those of edges that leave it.
_CUT_EDGE = _with(
    T.ORDER_PART, BOTH, NODES, LABEL, "few(id, dist) using key (id) as (select distinct c, 0 from lab union (select a.dst, min(f.dist + 1) from few f join adj a on a.src = f.id left join recurring.few r on r.id = a.dst where r.dist is null group by 1))",
    "up as (select f.id, min(g.id) as parent from few f join adj a on a.src = f.id join few g on g.id = a.dst and g.dist = f.dist - 1 group by 1)",
    "flat as (select e.src, e.dst, hash(e.src, e.dst) as name from e where not exists (select 1 from up where up.id = e.src and up.parent = e.dst) and not exists (select 1 from up where up.id = e.dst and up.parent = e.src))",
    "mark as (select id, bit_xor(name) as name from (select src as id, name from flat union all select dst, name from flat) group by 1)",
    "above(id, top) as (select id, id from mark union all select a.id, up.parent from above a join up on up.id = a.top)",
    "spans as (select top as id, bit_xor(name) as name from above join mark using (id) group by 1)",
)


@query(_CUT_EDGE + "select least(up.id, parent) as src, greatest(up.id, parent) as dst from up left join spans on spans.id = up.id where coalesce(name, 0) = 0")
def bridges(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.find_bridges(T.table_graph(spark, sf, T.ORDER_PART))


@query()
def articulation_points(spark: SparkSession, sf: str) -> DataFrame:
    return traversal.find_articulation_points(T.table_graph(spark, sf, T.ORDER_PART))


def _trade(spark: SparkSession, sf: str):
    return T.table_graph(spark, sf, T.SURPLUS, directed=True)


@query(_with(T.COPURCHASE, BOTH, "near(id, dist) using key (id) as (select cast(0 as bigint), cast(0 as double) union (select a.dst, min(f.dist + a.weight) from near f join adj a on a.src = f.id left join recurring.near r on r.id = a.dst where r.dist is null or f.dist + a.weight < r.dist group by 1))", "p as (select n.id, min({'at': m.dist, 'src': m.id}) as o from near n join adj a on a.dst = n.id join near m on m.id = a.src and m.dist + a.weight = n.dist group by 1)") + "select n.id, n.dist, o.src as pred from near n left join p on p.id = n.id")
def dijkstra(spark: SparkSession, sf: str) -> DataFrame:
    return paths.dijkstra(T.table_graph(spark, sf, T.COPURCHASE), 0)


@query(_with(T.ORDER_CHAIN, "s as (select min(src) as id from e)", "r as (select id, cast(0 as double) as dist, cast(null as bigint) as pred from s union all select e.dst, r.dist + e.weight, e.src from r join e on e.src = r.id)") + "select * from r")
def bellman_ford(spark: SparkSession, sf: str) -> DataFrame:
    g = T.table_graph(spark, sf, T.ORDER_CHAIN, directed=True)
    return paths.bellman_ford(g, g.edges.agg(F.min("src")).first()[0])


_PAIRS = _with(T.SURPLUS, DIRECTED, NODES, NEAR) + "select src, dst, dist from near"


@query(_PAIRS)
def floyd_warshall(spark: SparkSession, sf: str) -> DataFrame:
    return paths.floyd_warshall(_trade(spark, sf))


@query(_PAIRS)
def johnsons(spark: SparkSession, sf: str) -> DataFrame:
    return paths.johnsons(_trade(spark, sf)).select("src", "dst", F.round("dist", 6).alias("dist"))


_GRID = "select i as src, i + 1 as dst, 1 + i % 7 as weight from range(0, 144) t(i) where i % 12 < 11 union all select i, i + 12, 1 + i % 5 from range(0, 144) t(i) where i < 132"
_NEAR_ONE = "near(id, dist) using key (id) as (select cast(0 as bigint), cast(0 as double) union (select a.dst, min(f.dist + a.weight) from near f join adj a on a.src = f.id left join recurring.near r on r.id = a.dst where r.dist is null or f.dist + a.weight < r.dist group by 1))"


@query(_with(_GRID, BOTH, _NEAR_ONE) + "select cast(0 as bigint) as first, cast(143 as bigint) as last, dist as length, dist as walked, true as unbroken from near where id = 143")
def a_star_path(spark: SparkSession, sf: str) -> DataFrame:
    """Length of the best way over a weighted grid, and its steps' weights summed up along edges of the grid."""
    plain = generators.grid_graph(spark, 12, 12)
    weight = F.when(F.col("dst") == F.col("src") + 1, 1 + F.col("src") % 7).otherwise(1 + F.col("src") % 5).cast("double")
    g = plain.scaled(weight)
    found = paths.a_star(g, 0, 143, paths.euclidean_heuristic(g, 143))
    way = paths.reconstruct_path(found, 0, 143)
    steps = way.select("step", F.col("id").alias("src")).join(way.select((F.col("step") - 1).alias("step"), F.col("id").alias("dst")), "step").join(g.adjacency(), ["src", "dst"])
    ends = way.agg(F.min_by("id", "step").alias("first"), F.max_by("id", "step").alias("last"), F.count("*").alias("n"))
    walked = steps.agg(F.sum("weight").alias("walked"), F.count("*").alias("m"))
    length = found.where("id = 143").select(F.col("dist").alias("length"))
    return ends.join(length).join(walked).select("first", "last", "length", "walked", (F.col("m") == F.col("n") - 1).alias("unbroken"))


_TREE = _with(
    T.TRADE, "u as (select least(src, dst) as src, greatest(src, dst) as dst, min(weight) as weight from e group by 1, 2)", "k as (select *, row_number() over (order by weight, src, dst) as r from u)",
    "b as (select src as s, dst as d, r from k union all select dst, src, r from k)",
    "low(s, d, r) using key (s, d) as (select distinct s, s, cast(0 as bigint) from b union (select l.s, b.d, min(greatest(l.r, b.r)) from low l join b on b.s = l.d left join recurring.low o on o.s = l.s and o.d = b.d where o.r is null or greatest(l.r, b.r) < o.r group by 1, 2))",
)
_TREE_SQL = _TREE + "select k.src, k.dst, cast(k.weight as double) as weight from k join low on low.s = k.src and low.d = k.dst and low.r = k.r"


def _undirected(spark: SparkSession, sf: str, sql: str):
    rows = T.table_rows(spark, sf, sql)
    once = rows.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight"))
    return T.Graph.from_edges(once, False, True)


@query(_TREE_SQL)
def kruskals(spark: SparkSession, sf: str) -> DataFrame:
    return mst.kruskals(_undirected(spark, sf, T.TRADE)).select("src", "dst", "weight")


@query(_TREE_SQL)
def prims(spark: SparkSession, sf: str) -> DataFrame:
    return mst.prims(_undirected(spark, sf, T.TRADE)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")


@query(_with(T.ORDER_CHAIN, BOTH, NODES, LABEL) + "select p.src, p.src + 32 as dst, a.c = b.c as connected from (select distinct src from e) p join lab a on a.id = p.src join lab b on b.id = p.src + 32")
def union_find(spark: SparkSession, sf: str) -> DataFrame:
    pairs = T.table_rows(spark, sf, T.ORDER_CHAIN)
    sets = mst.UnionFind(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()).union(pairs)
    asked = pairs.select("src", (F.col("src") + 32).alias("dst")).distinct().join(sets.elements.select(F.col("id").alias("dst")), "dst")
    return sets.connected(asked.select("src", "dst"))


def _whole(spark: SparkSession, sf: str):
    return T.table_graph(spark, sf, T.TRADE, directed=True)


@query()
def max_flow(spark: SparkSession, sf: str) -> DataFrame:
    return flows.ford_fulkerson(_whole(spark, sf), 0, 11)[0]


@query()
def min_cut(spark: SparkSession, sf: str) -> DataFrame:
    return flows.min_cut(_whole(spark, sf), 0, 11)[0]


@query()
def max_flow_edges(spark: SparkSession, sf: str) -> DataFrame:
    return flows.ford_fulkerson(_whole(spark, sf), 0, 11)[1]


@query()
def hopcroft_karp(spark: SparkSession, sf: str) -> DataFrame:
    g = T.table_graph(spark, sf, T.ORDER_PART, weighted=False)
    return flows.hopcroft_karp(g, g.nodes.where("id >= 10000000"), g.nodes.where("id < 10000000"))


_RANKS = _with(
    T.SURPLUS, NODES, "o as (select src, count(*) as d from e group by 1)", "n as (select count(*) as n from v)",
    "r as (select 0 as i, id, 1.0::double / n as s, 1.0::double as moved from v, n union all (select i, id, s, sum(abs(s - old)) over () from (select x.i + 1 as i, v.id as id, any_value(x.s) filter (x.id = v.id) as old, 0.15 / any_value(n.n) + 0.85 * (any_value(x.lost) / any_value(n.n) + coalesce(sum(x.s / x.d) filter (x.dst = v.id), 0)) as s from v, n, (select r.i, r.id, r.s, r.moved, o.d, e.dst, (select coalesce(sum(z.s), 0) from r z left join o y on y.src = z.id where y.d is null) as lost from r left join o on o.src = r.id left join e on e.src = r.id) x where x.i < 100 and x.moved >= 1e-6 group by x.i, v.id)))",
)


@query(_RANKS + "select id, round(s, 9) as score from r where i = (select max(i) from r)")
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return centrality.pagerank(_trade(spark, sf))[0].select("id", F.round("score", 9).alias("score"))


@query(_with(T.SURPLUS, DIRECTED, NODES, FEW, "c as (select id as s, id as t, 0 as k, cast(1 as double) as n from v union all (select c.s, a.dst, c.k + 1, sum(c.n) from c join adj a on a.src = c.t join few f on f.src = c.s and f.dst = a.dst and f.dist = c.k + 1 group by 1, 2, 3))", "w as (select x.t as id, sum(x.n * y.n / z.n) as b from c x join c y on y.s = x.t join c z on z.s = x.s and z.t = y.t and z.k = x.k + y.k where x.s <> x.t and y.t <> x.t and x.s <> y.t group by 1)", "n as (select count(*) as n from v)") + "select v.id, round(coalesce(w.b, 0) / ((n - 1) * (n - 2)), 9) as score from v cross join n left join w on w.id = v.id")
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return centrality.betweenness_centrality(_trade(spark, sf)).select("id", F.round("score", 9).alias("score"))


@query(_with(T.SURPLUS, DIRECTED, NODES, FEW, "n as (select count(*) as n from v)") + "select src as id, round(coalesce((count(*) - 1) / (any_value(n) - 1) * ((count(*) - 1) / nullif(sum(dist), 0)), 0), 9) as score from few, n group by 1")
def closeness(spark: SparkSession, sf: str) -> DataFrame:
    return centrality.closeness_centrality(_trade(spark, sf)).select("id", F.round("score", 9).alias("score"))


_POWERS = _with(T.SURPLUS, NODES, "r as (select 0 as i, id, 1 / sqrt((select count(*) from v)) as s, 1.0::double as moved from v union all (select i, id, s, sum(abs(s - old)) over () from (select i, id, old, got / sqrt(sum(got * got) over ()) as s from (select any_value(r.i) + 1 as i, v.id as id, any_value(r.s) filter (r.id = v.id) as old, coalesce(sum(r.s) filter (e.dst = v.id), 0) as got from v, r left join e on e.src = r.id where r.i < 100 and r.moved >= 1e-6 group by v.id))))")


@query(_POWERS + "select id, round(s, 7) as score from r where i = (select max(i) from r)")
def eigenvector(spark: SparkSession, sf: str) -> DataFrame:
    return centrality.eigenvector_centrality(_trade(spark, sf))[0].select("id", F.round("score", 7).alias("score"))


@query(f"with e as ({T.COPURCHASE})" + " select src, dst, cast(weight as double) as weight from e")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return T.table_graph(spark, sf, T.COPURCHASE).edges.select("src", "dst", "weight")


@query(_with(T.COPURCHASE, BOTH, recursive=False) + "select dst as id, cast(weight as double) as weight from adj where src = 0")
def graph_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return T.table_graph(spark, sf, T.COPURCHASE).neighbors(0)


@query(_with(T.COPURCHASE, NODES, recursive=False) + "select (select count(*) from v) as nodes, (select count(*) from e) as edges, (select count(*) from v) - 1 as nodes_left, (select count(*) from e where src <> 0 and dst <> 0) as edges_left")
def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = T.table_graph(spark, sf, T.COPURCHASE)
    less = g.remove_node(0)
    return spark.createDataFrame([(g.num_nodes(), g.num_edges(), less.num_nodes(), less.num_edges())], "nodes bigint, edges bigint, nodes_left bigint, edges_left bigint")


@query(_with(T.COPURCHASE, recursive=False).rstrip(", ") + " select src, dst, cast(sum(weight) as double) as capacity from (select src, dst, weight from e union all select dst, src, weight from e) group by 1, 2")
def oriented_capacities(spark: SparkSession, sf: str) -> DataFrame:
    return T.table_graph(spark, sf, T.COPURCHASE).oriented_capacities()


@query("with g as (select i as id, i % 12 as c, i // 12 as r from range(0, 144) t(i)) select id as src, id + 1 as dst from g where c < 11 union all select id, id + 12 from g where r < 11")
def grid_graph(spark: SparkSession, sf: str) -> DataFrame:
    return generators.grid_graph(spark, 12, 12).edges.select("src", "dst")


@query()
def random_graph(spark: SparkSession, sf: str) -> DataFrame:
    return generators.random_weighted_graph(spark, 2000, 0.004, seed=7).edges


_POINTS = "select o_custkey + 2 as size, count(*) as edges, sum(o_totalprice) / 1000 as ms from orders group by 1"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return T.table_rows(spark, sf, _POINTS)


@query("select l_returnflag as size, avg(l_quantity) as mean, median(l_quantity) as median, round(stddev_pop(l_quantity), 6) as std, count(*) as reps, stddev_pop(l_quantity) > 0.3 * avg(l_quantity) as high_variance from lineitem group by 1")
def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    runs = T.table_rows(spark, sf, "select l_returnflag as size, l_quantity as ms, 1 as edges from lineitem")
    return stats.summarize_runs(runs).drop("edges").withColumn("std", F.round("std", 6))


@query(f"with p as ({_POINTS}), f as (select ms as t, unnest([{{'name': 'O(n)', 'f': size * 1.0}}, {{'name': 'O(n log n)', 'f': size * ln(size)}}, {{'name': 'O(V+E)', 'f': size + edges}}], recursive := true) from p), a as (select name, sum(f * t) / sum(f * f) as param from f group by 1) select name, round(any_value(param), 9) as param, round(sqrt(sum(pow(t - param * f, 2)) / count(*)), 6) as rmse from f join a using (name) group by 1")
def complexity_fit(spark: SparkSession, sf: str) -> DataFrame:
    fit = stats.fit_complexity_curve(_points(spark, sf), ["O(n)", "O(n log n)", "O(V+E)"])
    return fit.select("name", F.round("param", 9).alias("param"), F.round("rmse", 6).alias("rmse"))


@query(f"with p as ({_POINTS}) select round(regr_slope(ln(ms), ln(size)), 8) as exponent, round(regr_intercept(ln(ms), ln(size)), 8) as intercept from p")
def loglog_exponent(spark: SparkSession, sf: str) -> DataFrame:
    return stats.loglog_exponent(_points(spark, sf)).select(F.round("exponent", 8).alias("exponent"), F.round("intercept", 8).alias("intercept"))


@query(f"with p as ({_POINTS}) select round(regr_slope(ms, edges * log2(size)), 8) as slope, round(regr_intercept(ms, edges * log2(size)), 6) as intercept, round(regr_r2(ms, edges * log2(size)), 8) as r_squared, regr_r2(ms, edges * log2(size)) >= 0.9 as match from p")
def term_fit(spark: SparkSession, sf: str) -> DataFrame:
    fit = stats.fit_against_term(_points(spark, sf), stats.graph_terms(F.col("n"), F.col("m"))["O(E log V)"])
    return fit.select(F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r_squared", 8).alias("r_squared"), "match")


@query("with s as (select c_custkey as id, c_acctbal as score from customer) select cast(id as varchar) as id, round((score - (select min(score) from s)) / ((select max(score) from s) - (select min(score) from s)), 9) as score from s")
def normalize_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = T.table_rows(spark, sf, "select c_custkey as id, c_acctbal as score from customer")
    return present.normalize_scores(s).select("id", F.round("score", 9).alias("score"))


@query("select cast(row_number() over (order by c_acctbal desc, c_custkey) as int) as rank, cast(c_custkey as varchar) as id from customer qualify rank <= 10")
def top_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = T.table_rows(spark, sf, "select c_custkey as id, c_acctbal as score from customer")
    return present.ranked_lines(s, 10).select("rank", "id")


@query("with r as (select o_orderkey as step_no, o_custkey as id, case o_orderstatus when 'F' then 'visited' when 'O' then 'consider' else 'path' end as role, case o_orderstatus when 'F' then 30 when 'O' then 50 else 80 end as p from orders where o_orderkey <= 9000) select id, arg_max(role, p * 1000000 + step_no) as role from r group by 1")
def step_highlights(spark: SparkSession, sf: str) -> DataFrame:
    r = T.table_rows(spark, sf, "select o_orderkey as step_no, o_custkey as id, case o_orderstatus when 'F' then 'visited' when 'O' then 'consider' else 'path' end as role from orders")
    return present.highlights(r, 9000)
