"""Requests in, JSON-ready responses out: one function for each endpoint, without a server.

``respond(spark, "/api/traversal/bfs", {"edges": [[0, 1]], "start": 0})`` builds the graph, runs the operator and
its trace as Spark jobs, and brings the finished rows to the driver as one dictionary, as a page asks for it. For
graphs too large for a page, call the operators, whose results stay DataFrames. A bad request is a
:class:`RequestError` with the status a server would send. Ids are text throughout once one of them is text.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import centrality, flows, mst, paths, traces, traversal
from .plans import Scratch
from .sources import generators, json_io

ENDPOINTS: dict[str, Callable[[SparkSession, dict], dict]] = {}


class RequestError(ValueError):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def endpoint(path: str):
    def add(run):
        ENDPOINTS[path] = run
        return run

    return add


def respond(spark: SparkSession, path: str, body: dict | str | None = None) -> dict:
    if path not in ENDPOINTS:
        raise RequestError(404, f"no endpoint {path!r}")
    body = json.loads(body) if isinstance(body, str) else dict(body or {})
    try:
        return ENDPOINTS[path](spark, body)
    except RequestError:
        raise
    except ValueError as e:
        raise RequestError(400, str(e)) from e
    except AssertionError as e:
        raise RequestError(500, str(e)) from e


def _graph(spark: SparkSession, body: dict, **flags: bool) -> Graph:
    """The request's graph, written once, as every endpoint reads it several times."""
    if "edges" not in body:
        raise RequestError(422, "'edges' is required")
    g = json_io.graph_from_request(spark, body, **flags)
    scratch = Scratch(spark, "request")
    return Graph(scratch.save(g.nodes, "nodes"), scratch.save(g.edges, "edges"), g.directed, g.weighted)


def _own(graph: Graph, node):
    return str(node) if node is not None and graph.nodes.schema["id"].dataType.simpleString() == "string" else node


def _required(graph: Graph, body: dict, *names: str) -> list:
    """Values of the fields; a field may fall back on another, as in ``source/start``."""
    found = [next((body[k] for k in name.split("/") if body.get(k) is not None), None) for name in names]
    for name, value in zip(names, found):
        if value is None:
            raise RequestError(400, f"'{name.split('/')[0]}' is required")
    return [_own(graph, v) for v in found]


def _steps(trace: DataFrame) -> list[dict]:
    return [json.loads(r["step"]) for r in trace.orderBy("step_no").select("step").toLocalIterator()]


def _number(value):
    return None if value is None or math.isinf(value) or math.isnan(value) else value


def _rows(df: DataFrame, *order: str) -> list:
    return list((df.orderBy(*order) if order else df).toLocalIterator())


def _placed(graph: Graph, df: DataFrame) -> list:
    """Rows by the place of their node."""
    return _rows(df.join(graph.nodes.select("id", "node_pos"), "id"), "node_pos")


@endpoint("/health")
def health(spark, body):
    return {"status": "ok"}


# Traversal


@endpoint("/api/traversal/bfs")
def bfs(spark, body):
    g = _graph(spark, body)
    (start,) = _required(g, body, "start")
    seen = _rows(traversal.bfs(g, start), "ord")
    return {"distances": {str(r["id"]): r["dist"] for r in seen}, "order": [r["id"] for r in seen], "steps": _steps(traces.bfs(g, start))}


@endpoint("/api/traversal/dfs")
def dfs(spark, body):
    g = _graph(spark, body)
    (start,) = _required(g, body, "start")
    steps = _steps(traces.dfs(g, start))
    return {"order": [s["node"] for s in steps if s["action"] == "visit"], "steps": steps}


@endpoint("/api/traversal/scc")
def scc(spark, body):
    steps = _steps(traces.strongly_connected_components(_graph(spark, body, directed=True)))
    return {"components": [s["nodes"] for s in steps if s["action"] == "scc"], "steps": steps}


@endpoint("/api/traversal/bridges")
def bridges(spark, body):
    steps = _steps(traces.find_bridges(_graph(spark, body, directed=False)))
    return {"bridges": [s["edge"] for s in steps if s["action"] == "bridge"], "steps": steps}


@endpoint("/api/traversal/articulation-points")
def articulation_points(spark, body):
    steps = _steps(traces.find_articulation_points(_graph(spark, body, directed=False)))
    return {"articulation_points": list(dict.fromkeys(s["node"] for s in steps if s["action"] == "articulation_point")), "steps": steps}


# Shortest paths


def _single_source(spark, body, run, trace):
    g = _graph(spark, body, weighted=True)
    (start,) = _required(g, body, "start")
    found = Scratch(spark, "paths").save(run(g, start), "found")
    rows, path = _placed(g, found), None
    if body.get("goal") is not None:
        try:
            path = [r["id"] for r in _rows(paths.reconstruct_path(found, start, _own(g, body["goal"])), "step")]
        except ValueError:
            path = None
    return {"distances": {str(r["id"]): _number(r["dist"]) for r in rows}, "predecessors": {str(r["id"]): r["pred"] for r in rows}, "path": path, "steps": _steps(trace(g, start))}


@endpoint("/api/shortest-path/dijkstra")
def dijkstra(spark, body):
    return _single_source(spark, body, paths.dijkstra, traces.dijkstra)


@endpoint("/api/shortest-path/bellman-ford")
def bellman_ford(spark, body):
    return _single_source(spark, body, paths.bellman_ford, traces.bellman_ford)


@endpoint("/api/shortest-path/a-star")
def a_star(spark, body):
    g = _graph(spark, body, weighted=True)
    start, goal = _required(g, body, "start", "goal")
    h = paths.euclidean_heuristic(g, goal)
    found = Scratch(spark, "paths").save(paths.a_star(g, start, goal, h), "found")
    path = [r["id"] for r in _rows(paths.reconstruct_path(found, start, goal), "step")]
    rows = _placed(g, found)
    return {
        "distances": {str(r["id"]): _number(r["dist"]) for r in rows}, "predecessors": {str(r["id"]): r["pred"] for r in rows}, "path": path,
        "distance": next((_number(r["dist"]) for r in rows if r["id"] == goal), None), "steps": _steps(traces.a_star(g, start, goal, h)),
    }


def _all_pairs(spark, body, run, trace):
    g = _graph(spark, body, weighted=True)
    ids = [r["id"] for r in _rows(g.nodes, "node_pos")]
    dist = {(r["src"], r["dst"]): r["dist"] for r in _rows(run(g))}
    pair = None
    if body.get("start") is not None and body.get("goal") is not None:
        ends = _own(g, body["start"]), _own(g, body["goal"])
        for v in ends:
            g.ensure_node(v)
        pair = _number(dist.get(ends))
    return {"distances": {str(u): {str(v): _number(dist.get((u, v))) for v in ids} for u in ids}, "path_distance": pair, "steps": _steps(trace(g))}


@endpoint("/api/shortest-path/floyd-warshall")
def floyd_warshall(spark, body):
    return _all_pairs(spark, body, paths.floyd_warshall, traces.floyd_warshall)


@endpoint("/api/shortest-path/johnsons")
def johnsons(spark, body):
    return _all_pairs(spark, body, paths.johnsons, traces.johnsons)


# Spanning trees


def _tree(rows: DataFrame) -> dict:
    found = _rows(rows, "step")
    return {"edges": [{"u": r["src"], "v": r["dst"], "weight": r["weight"]} for r in found], "total_weight": found[-1]["total"] if found else 0.0}


@endpoint("/api/mst/kruskals")
def kruskals(spark, body):
    g = _graph(spark, body, directed=False, weighted=True)
    return {**_tree(mst.kruskals(g)), "steps": _steps(traces.kruskals(g))}


@endpoint("/api/mst/prims")
def prims(spark, body):
    g = _graph(spark, body, directed=False, weighted=True)
    start = _own(g, body.get("start"))
    return {**_tree(mst.prims(g, start)), "steps": _steps(traces.prims(g, start))}


@endpoint("/api/mst/compare")
def compare(spark, body):
    g = _graph(spark, body, directed=False, weighted=True)
    compared = Scratch(spark, "compare").save(mst.compare_mst_algorithms(g), "compared")
    took = {r["algorithm"]: r for r in _rows(compared)}
    steps = _steps(traces.comparison(g, compared))
    parts = {name: {**_tree(run(g)), "time_ms": took[name]["time_ms"], "steps": _steps(trace(g))} for name, run, trace in (("kruskals", mst.kruskals, traces.kruskals), ("prims", mst.prims, traces.prims))}
    return {**parts, "total_weight": parts["kruskals"]["total_weight"], "faster": steps[-1]["faster"], "note": steps[-1]["note"], "steps": steps}


# Flows and matching


@endpoint("/api/flows/max-flow")
def max_flow(spark, body):
    g = _graph(spark, body, directed=True, weighted=True)
    source, sink = _required(g, body, "source/start", "sink/goal")
    value, flow = flows.ford_fulkerson(g, source, sink)
    return {"max_flow": value.first()[0], "flow": [{"u": r["u"], "v": r["v"], "flow": r["flow"]} for r in _rows(flow, "u", "v")], "steps": _steps(traces.ford_fulkerson(g, source, sink))}


@endpoint("/api/flows/min-cut")
def min_cut(spark, body):
    g = _graph(spark, body, directed=True, weighted=True)
    source, sink = _required(g, body, "source/start", "sink/goal")
    value, cut, sides = flows.min_cut(g, source, sink)
    placed = _placed(g, sides)
    return {
        "cut_value": value.first()[0], "cut_edges": [{"u": r["u"], "v": r["v"], "capacity": r["capacity"]} for r in _rows(cut, "u", "v")],
        "source_side": [r["id"] for r in placed if r["side"] == "source"], "sink_side": [r["id"] for r in placed if r["side"] == "sink"], "steps": _steps(traces.min_cut(g, source, sink)),
    }


def _matching(spark, body, run, trace):
    g = _graph(spark, body, weighted=False)
    sides = []
    for name in ("left_nodes", "right_nodes"):
        if not body.get(name):
            raise RequestError(400, "'left_nodes' and 'right_nodes' are required")
        kind = g.nodes.schema["id"].dataType.simpleString()
        sides.append(spark.createDataFrame([(_own(g, v),) for v in dict.fromkeys(body[name])], f"id {kind}"))
    pairs = [{"left": r["left"], "right": r["right"]} for r in _rows(run(g, *sides), "left")]
    return {"matching": pairs, "size": len(pairs), "steps": _steps(trace(g, *sides))}


@endpoint("/api/flows/bipartite-matching")
def bipartite_matching(spark, body):
    return _matching(spark, body, flows.bipartite_matching, traces.bipartite_matching)


@endpoint("/api/flows/hopcroft-karp")
def hopcroft_karp(spark, body):
    return _matching(spark, body, flows.hopcroft_karp, traces.hopcroft_karp)


# Centrality


def _scores(g: Graph, scores: DataFrame) -> dict:
    return {str(r["id"]): r["score"] for r in _placed(g, scores)}


@endpoint("/api/centrality/pagerank")
def pagerank(spark, body):
    g = _graph(spark, body)
    ranks, rounds, history = centrality.pagerank(g, body.get("damping", 0.85), body.get("max_iterations", 100), body.get("tolerance", 1e-6))
    return {"ranks": _scores(g, ranks), "iterations": rounds, "convergence_history": history, "steps": _steps(traces.iterations(g, history))}


@endpoint("/api/centrality/eigenvector")
def eigenvector(spark, body):
    g = _graph(spark, body)
    scores, rounds, history = centrality.eigenvector_centrality(g, body.get("max_iterations", 100), body.get("tolerance", 1e-6))
    # A round whose vector vanishes ends the iteration without a step. Only then has a node without in-edges a score.
    lone = g.nodes.select("id").join(g.adjacency().select(F.col("dst").alias("id")), "id", "left_anti").join(scores, "id").where("score > 0")
    logged = history[:-1] if history and history[-1] == 0.0 and not lone.isEmpty() else history
    return {"scores": _scores(g, scores), "iterations": rounds, "convergence_history": history, "steps": _steps(traces.iterations(g, logged))}


@endpoint("/api/centrality/betweenness")
def betweenness(spark, body):
    g = _graph(spark, body)
    return {"scores": _scores(g, centrality.betweenness_centrality(g)), "steps": _steps(traces.betweenness_centrality(g))}


@endpoint("/api/centrality/closeness")
def closeness(spark, body):
    g = _graph(spark, body)
    return {"scores": _scores(g, centrality.closeness_centrality(g)), "steps": _steps(traces.closeness_centrality(g))}


# Graphs and stored results


@endpoint("/api/datasets/karate-club")
def karate_club(spark, body):
    return json.loads(json_io.serialize_graph(generators.karate_club(spark), "Zachary's Karate Club"))


@endpoint("/api/graphs/generate")
def generate(spark, body):
    limits = {"n": (1, 500, 12), "p": (0, 1, 0.25), "rows": (1, 50, 4), "cols": (1, 50, 4)}
    given = {k: body.get(k, usual) for k, (_, _, usual) in limits.items()}
    for k, (low, high, _) in limits.items():
        if not low <= given[k] <= high:
            raise RequestError(422, f"'{k}' must be from {low} to {high}")
    kind = body.get("type", "random")
    if kind not in ("random", "grid"):
        raise RequestError(400, "type must be 'random' or 'grid'")
    g = generators.generate(spark, kind, bool(body.get("directed")), bool(body.get("weighted")), min_weight=body.get("min_weight", 1.0), max_weight=body.get("max_weight", 10.0), seed=body.get("seed", 0), **given)
    name = f"Grid ({given['rows']}×{given['cols']})" if kind == "grid" else f"Random ER (n={given['n']}, p={given['p']})"
    return json.loads(json_io.serialize_graph(g, name))


@endpoint("/api/benchmarks/results")
def benchmark_results(spark, body):
    """The JSON object that the benchmark suite stored at the request's ``path``."""
    files = spark.read.text(body["path"], wholetext=True) if body.get("path") and _exists(spark, body["path"]) else None
    row = files.agg(F.first("value")).first() if files is not None else None
    if row is None or row[0] is None:
        raise RequestError(404, "no benchmark results found")
    try:
        return json.loads(row[0])
    except json.JSONDecodeError as e:
        raise RequestError(500, f"stored benchmark results are damaged: {e}") from e


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
