import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom import requests
from graphloom.functions import present
from graphloom.graph import Graph
from graphloom.operators import paths, traces, traversal
from graphloom.sources import generators, json_io

BODY = {"edges": [[0, 1, 2], [1, 2, 1], [2, 0, 5], [2, 3, 1]], "start": 0, "goal": 3, "source": 0, "sink": 3}


def steps(trace):
    rows = trace.orderBy("step_no").collect()
    assert [r["step_no"] for r in rows] == list(range(len(rows)))
    return [json.loads(r["step"]) for r in rows]


def short(found):
    return [tuple(v if not isinstance(v, list) else tuple(v) for v in s.values()) for s in found]


def drawn(nodes, edges, seed):
    rng = random.Random(seed)
    return [(0, 1), *(tuple(rng.sample(range(nodes), 2)) for _ in range(edges))]


@pytest.fixture(scope="module")
def square(spark):
    return Graph.of(spark, [(0, 1, 2), (1, 2, 1), (2, 0, 5), (2, 3, 1)], weighted=True)


def test_neighbours_come_in_the_order_of_their_edges(spark):
    g = Graph.of(spark, [(0, 5), (1, 2), (0, 2), (2, 7)])
    assert [r["id"] for r in g.adjacency().where("src = 2").orderBy("nbr_pos").select(F.col("dst").alias("id")).collect()] == [1, 0, 7]
    more = g.add_edges(spark.createDataFrame([(2, 9), (2, 8)], "src long, dst long").withColumn("pos", F.when(F.col("dst") == 9, 0).otherwise(1)))
    assert [r["dst"] for r in more.adjacency().where("src = 2").orderBy("nbr_pos").collect()] == [1, 0, 7, 9, 8]
    assert [s["node"] for s in steps(traces.bfs(more, 2)) if s["action"] == "visit"] == [2, 1, 0, 7, 9, 8, 5]


def test_breadth_and_depth_first(square):
    assert short(steps(traces.bfs(square, 0))) == [
        ("visit", 0, 0), ("visit", 1, 1, 0), ("visit", 2, 1, 0), ("skip", 0, 1), ("skip", 2, 1), ("skip", 1, 2), ("skip", 0, 2), ("visit", 3, 2, 2), ("skip", 2, 3),
    ]
    assert short(steps(traces.dfs(square, 0))) == [
        ("visit", 0), ("traverse", 0, 1), ("visit", 1), ("skip", 1, 0), ("traverse", 1, 2), ("visit", 2), ("skip", 2, 1), ("skip", 2, 0), ("traverse", 2, 3), ("visit", 3), ("skip", 3, 2), ("skip", 0, 2),
    ]
    assert short(steps(traces.dfs_iterative(square, 0)))[:3] == [("visit", 0), ("push", 0, 2), ("push", 0, 1)]


def test_traversal_orders_agree(spark):
    g = Graph.of(spark, drawn(20, 50, 11))
    order = [r["id"] for r in traversal.dfs(g, 0).orderBy("ord").collect()]
    assert order == [s["node"] for s in steps(traces.dfs(g, 0)) if s["action"] == "visit"] == [s["node"] for s in steps(traces.dfs_iterative(g, 0)) if s["action"] == "visit"]
    assert [s["node"] for s in steps(traces.bfs(g, 0)) if s["action"] == "visit"] == [r["id"] for r in traversal.bfs(g, 0).orderBy("ord").collect()]


def test_low_links_find_what_the_operators_find(spark):
    g = Graph.of(spark, drawn(24, 26, 5))
    assert {tuple(sorted(s["edge"])) for s in steps(traces.find_bridges(g)) if s["action"] == "bridge"} == {tuple(r) for r in traversal.find_bridges(g).collect()}
    assert {s["node"] for s in steps(traces.find_articulation_points(g)) if s["action"] == "articulation_point"} == {r["id"] for r in traversal.find_articulation_points(g).collect()}
    d = Graph.of(spark, drawn(18, 30, 5), directed=True)
    want = {}
    for r in traversal.strongly_connected_components(d).collect():
        want.setdefault(r["component"], set()).add(r["id"])
    assert {frozenset(s["nodes"]) for s in steps(traces.strongly_connected_components(d)) if s["action"] == "scc"} == {frozenset(c) for c in want.values()}


def test_shortest_path_steps(spark, square):
    assert short(steps(traces.dijkstra(square, 0))) == [("settle", 0, 0.0), ("relax", 0, 1, 2.0), ("relax", 0, 2, 5.0), ("settle", 1, 2.0), ("relax", 1, 2, 3.0), ("settle", 2, 3.0), ("relax", 2, 3, 4.0), ("settle", 3, 4.0)]
    assert short(steps(traces.bellman_ford(square, 0)))[:2] == [("relax", 0, 0, 1, 2.0), ("relax", 0, 0, 2, 5.0)]
    last = {s["node"]: s["distance"] for s in steps(traces.dijkstra(square, 0)) if s["action"] == "settle"}
    assert last == {r["id"]: r["dist"] for r in paths.dijkstra(square, 0).collect()}
    assert ("update", 0, 2, 1, 3.0) in short(steps(traces.floyd_warshall(square)))
    assert [s["action"] for s in steps(traces.johnsons(square))] == ["potentials_start", "potentials", *["dijkstra_source"] * 4]
    g = generators.grid_graph(spark, 4, 4)
    found = steps(traces.a_star(g, 0, 15, paths.euclidean_heuristic(g, 15)))
    assert found[-1]["node"] == 15 and found[-1]["distance"] == found[-1]["f"] == 6.0 and "f" in found[0]


def test_tree_steps(square):
    assert short(steps(traces.kruskals(square))) == [
        ("consider", (1, 2), 1.0), ("accept", (1, 2), 1.0, 1.0), ("consider", (2, 3), 1.0), ("accept", (2, 3), 1.0, 2.0), ("consider", (0, 1), 2.0), ("accept", (0, 1), 2.0, 4.0),
    ]
    assert short(steps(traces.prims(square))) == [("start", 0), ("add", (0, 1), 2.0, 1, 2.0), ("add", (1, 2), 1.0, 2, 3.0), ("add", (2, 3), 1.0, 3, 4.0)]


def test_rejected_edges(spark):
    g = Graph.of(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 9)], weighted=True)
    assert [s["action"] for s in steps(traces.kruskals(g))] == ["consider", "accept", "consider", "accept", "consider", "reject", "consider", "accept"]
    assert sum(s["action"] == "reject" for s in steps(traces.kruskals(g))) == 1


def test_highlights_follow_the_steps(square):
    trace = traces.kruskals(square)
    nodes, edges = present.step_roles(trace, 3)
    assert {r["id"]: r["role"] for r in present.highlights(nodes, 3).collect()} == {"1": "mst", "2": "current", "3": "current"}
    assert {(r["src"], r["dst"]): r["role"] for r in present.edge_highlights(edges, square.edges, False, 3).collect()} == {(1, 2): "mst", (2, 3): "mst"}
    lines = [r["line"] for r in present.summarize_steps(traces.dijkstra(square, 0)).orderBy("step_no").collect()]
    assert lines[:2] == ["settle: node 0", "relax: 0 → 1"]


def test_endpoints_answer(spark):
    ask = lambda path, body=BODY: requests.respond(spark, path, body)
    assert ask("/health") == {"status": "ok"} and len(requests.ENDPOINTS) == 25
    assert ask("/api/traversal/bfs")["distances"] == {"0": 0, "1": 1, "2": 1, "3": 2}
    assert ask("/api/shortest-path/dijkstra")["path"] == [0, 1, 2, 3]
    assert ask("/api/shortest-path/floyd-warshall")["path_distance"] == 4.0
    assert ask("/api/mst/kruskals")["total_weight"] == 4.0
    cut = ask("/api/flows/min-cut")
    assert cut["cut_value"] == sum(e["capacity"] for e in cut["cut_edges"]) == 1.0 and cut["source_side"] == [0, 1]
    found = ask("/api/flows/hopcroft-karp", {"edges": [[0, 10], [0, 11], [1, 10]], "left_nodes": [0, 1], "right_nodes": [10, 11]})
    assert found["size"] == 2 and found["steps"][-1]["matching_size"] == 2
    assert ask("/api/graphs/generate", {"type": "grid", "rows": 2, "cols": 3})["num_edges"] == 7


def test_bad_requests(spark, tmp_path):
    for path, body, status in [("/api/traversal/bfs", {"edges": [[0, 1]]}, 400), ("/api/traversal/bfs", {"edges": [[0, 1]], "start": 7}, 400), ("/none", {}, 404), ("/api/graphs/generate", {"type": "x"}, 400), ("/api/benchmarks/results", {"path": str(tmp_path / "no.json")}, 404)]:
        with pytest.raises(requests.RequestError) as e:
            requests.respond(spark, path, body)
        assert e.value.status == status
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(requests.RequestError) as e:
        requests.respond(spark, "/api/benchmarks/results", {"path": str(tmp_path / "bad.json")})
    assert e.value.status == 500


def test_text_ids_round_trip(spark):
    g = json_io.graph_from_request(spark, {"edges": [["a", "b", 2], ["b", 3]], "weighted": True})
    back = json_io.page_graph(spark, json_io.serialize_graph(g, "g"))
    assert [tuple(r) for r in back.get_edges().select("src", "dst", "weight").collect()] == [("a", "b", 2.0), ("b", "3", 1.0)]
