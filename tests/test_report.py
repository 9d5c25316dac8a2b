import json

from graphloom.functions import report, stats


def described(spark, *cases):
    rows = [(name, json.dumps(response)) for name, response in cases]
    found = {}
    for r in report.result_lines(spark.createDataFrame(rows, "algorithm string, response string")).orderBy("line_no").collect():
        found.setdefault(r["algorithm"], (r["title"], []))[1].append(r["line"])
    return found


def test_results_in_words(spark):
    edge = {"u": 0, "v": 1, "weight": 2.5}
    got = described(
        spark, ("bfs", {"order": [0, 2, 1]}), ("dfs", {"order": []}), ("scc", {"components": [[i] for i in range(8)]}), ("bridges", {"bridges": [[0, 1], [2, 3]]}), ("articulation", {"articulation_points": []}),
        ("dijkstra", {"path": [0, 2], "distances": {"0": 0.0, "2": 1.25}}), ("bellman-ford", {"path": None, "distances": {"10": 3, "9": -1.5, "x": 0.12345}}), ("a-star", {"path": ["a", "b"], "distance": 4.0}),
        ("johnsons", {"path_distance": None}), ("floyd-warshall", {"path_distance": 7.0, "distances": {"0": {"1": 7.0}}}), ("prims", {"edges": [edge], "total_weight": 2.5}),
        ("mst-compare", {"total_weight": 2.5, "kruskals": {"time_ms": 1.0, "edges": [edge]}, "prims": {"time_ms": 2.0, "edges": []}, "faster": "kruskals"}),
        ("max-flow", {"max_flow": 0.0, "flow": []}), ("min-cut", {"cut_value": 5, "source_side": [0], "sink_side": [], "cut_edges": [{"u": 0, "v": 1, "capacity": 5.0}, {"u": 0, "v": 2}]}),
        ("hopcroft-karp", {"size": 1, "matching": [{"left": 0, "right": "r"}]}), ("pagerank", {"iterations": 3, "ranks": {"10": 0.25, "9": 0.25, "b": 0.5}}), ("closeness", {"scores": {}}), ("other", {"k": 1}),
    )
    assert got["bfs"] == ("BFS complete", ["Visit order: 0 → 2 → 1", "Reachable nodes: 3"]) and got["dfs"][1] == ["Visit order: —"]
    assert got["scc"][1][:2] == ["Components: 8", "  C1: {0}"] and len(got["scc"][1]) == 7
    assert got["bridges"][1] == ["Count: 2", "Edges: 0–1, 2–3"] and got["articulation"][1] == ["Nodes: none"]
    assert got["dijkstra"] == ("Shortest path", ["Path: 0 → 2", "Total distance: 1.25"]) and got["a-star"] == ("A* shortest path", ["Path: a → b", "Total distance: 4"])
    assert got["bellman-ford"] == ("Shortest distances from start", ["No goal selected — distances to every reachable node:", "9: -1.5", "10: 3", "x: 0.1235"])
    assert got["johnsons"][1] == ["All-pairs distance matrix computed"] and got["floyd-warshall"][1] == ["Selected pair distance: 7"]
    assert got["prims"][1] == ["Total weight: 2.5", "MST edges (1):", "0 – 1  (weight 2.5)"]
    assert got["mst-compare"][1] == ["Shared total weight: 2.5", "Kruskal's: 1 ms · 0–1 (2.5)", "Prim's: 2 ms · —", "Faster: kruskals"]
    assert got["max-flow"][1] == ["Max flow value: 0"] and got["min-cut"][1] == ["Cut value: 5", "Source side: {0}", "Sink side: {—}", "Cut edges (2):", "0 → 1  (cap 5)", "0 → 2"]
    assert got["hopcroft-karp"][1] == ["Matching size: 1", "Matched pairs (1):", "0 – r"]
    assert got["pagerank"][1] == ["Converged in 3 iterations", "Ranks (highest → lowest):", "1. node b: 0.5", "2. node 9: 0.25", "3. node 10: 0.25"]
    assert got["closeness"][1] == ["Scores (highest → lowest):", "No scores"] and got["other"] == ("Result", ['{"k": 1}'])


def test_run_times_in_words(spark):
    samples = spark.createDataFrame([(10, 20, 0, 1.0), (10, 20, 1, 3.0), (20, 40, 0, 4.0), (20, 40, 1, 4.0)], "size long, edges long, rep int, ms double")
    lines = [r["line"] for r in report.run_lines(stats.summarize_runs(samples)).orderBy("size").collect()]
    assert lines[0] == "  n=   10  edges=    20  mean=   2.000 ms  median=   2.000 ms  std=  1.000 ms  ** high variance (std=50% of mean), consider re-running **"
    assert lines[1] == "  n=   20  edges=    40  mean=   4.000 ms  median=   4.000 ms  std=  0.000 ms"
    points = spark.createDataFrame([(n, 2 * n, float(n)) for n in (10, 20, 40)], "size long, edges long, ms double")
    from pyspark.sql import functions as F

    line = report.fit_line("bfs", stats.loglog_exponent(points), "(V+E)", stats.fit_against_term(points, F.col("n") + F.col("m"))).first()["line"]
    assert line == "bfs: fit vs n = O(n^1.00) [MISLEADING], fit vs (V+E) = R^2=1.00 [MATCH]"


def test_edge_is_found_either_way(spark):
    edges = spark.createDataFrame([(0, 1, 1.0, 5), (1, 0, 2.0, 3), (2, 0, 1.0, 4)], "src long, dst long, weight double, edge_pos long")
    assert report.find_edge(edges, 0, 1).first()["edge_pos"] == 3 and report.find_edge(edges, "0", 1, True).first()["edge_pos"] == 5
    assert report.find_edge(edges, 0, 2, True).first() is None and report.find_edge(edges, 0, 2).first()["edge_pos"] == 4


def test_workloads(spark):
    from graphloom.operators import mst
    from graphloom.sources import workloads

    tree = mst.kruskals(workloads.connected(spark, 24, 3)).collect()
    assert len(tree) == 23
    net = workloads.flow_network(spark, 20, 1)
    assert net.directed and net.weighted and all(0.25 <= r["weight"] <= 5 for r in net.edges.collect())
    assert workloads.directed(spark, 12).directed and not workloads.undirected(spark, 12).directed and workloads.undirected(spark, 1).num_edges() == 0
    assert all(1 <= r["weight"] <= 10 for r in workloads.weighted(spark, 12).edges.collect())
