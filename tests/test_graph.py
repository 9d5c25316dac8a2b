import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import present, stats
from graphloom.graph import Graph
from graphloom.operators import centrality, flows, matching, mst, paths, traversal
from graphloom.plans import Scratch
from graphloom.sources import generators, json_io


@pytest.fixture(scope="module")
def karate(spark):
    return generators.karate_club(spark)


def ids(df):
    return {r["id"] for r in df.collect()}


def test_last_weight_and_first_place(spark):
    g = Graph.of(spark, [(0, 1, 2.0), (1, 2, 1.0), (1, 0, 5.0)], weighted=True)
    assert [(r.src, r.dst, r.weight) for r in g.get_edges().collect()] == [(0, 1, 5.0), (1, 2, 1.0)]


def test_self_loop_counts_nothing(spark):
    g = Graph.of(spark, [(0, 0)])
    assert g.edges.count() == 1 and g.num_edges() == 0 and not traversal.is_bipartite(g)


def test_changes(spark):
    g = Graph.of(spark, [(0, 1), (1, 2), (2, 0)], nodes=[0, 1, 2, 7])
    assert g.remove_node(1).num_edges() == 1 and g.remove_edge(1, 0).num_edges() == 2 and g.num_nodes() == 4
    more = g.set_node_attr(7, "kind", "a").set_node_attr(7, "size", "b").set_node_attr(9, "kind", "c")
    assert more.num_nodes() == 5 and more.node_attr(7, "kind").first()["value"] == "a" and more.node_attr(7, "none", "z").first()["value"] == "z"


def test_karate_traversal(spark, karate):
    levels = {r["dist"]: r["n"] for r in traversal.bfs(karate, 0).groupBy("dist").agg(F.count("*").alias("n")).collect()}
    assert levels == {0: 1, 1: 16, 2: 9, 3: 8}
    assert [(r.src, r.dst) for r in traversal.find_bridges(karate).collect()] == [(0, 11)]
    assert ids(traversal.find_articulation_points(karate)) == {0}
    assert sorted(r["ord"] for r in traversal.dfs(karate, 0).collect()) == list(range(34))


def test_levels_beyond_a_merge(spark, monkeypatch):
    monkeypatch.setattr(traversal, "MERGE_LEVELS", 3)
    way = Graph.of(spark, [(k, k + 1) for k in range(9)])
    assert sorted((r["id"], r["dist"]) for r in traversal.bfs(way, 0, with_order=False).collect()) == [(k, k) for k in range(10)]


def _parts(nodes, edges):
    of = {v: v for v in nodes}

    def root(v):
        while of[v] != v:
            v = of[v]
        return v

    for a, b in edges:
        of[root(a)] = root(b)
    return len({root(v) for v in nodes})


def test_bridges_and_cut_nodes_against_removal(spark, monkeypatch):
    """Many small random graphs side by side, as one; no step of it may keep a row for each edge and level."""
    draw, edges, bridges, cuts = random.Random(5), [], set(), set()
    for base in range(0, 600, 12):
        nodes = set(range(base, base + 12))
        own = sorted({tuple(sorted(draw.sample(sorted(nodes), 2))) for _ in range(draw.choice([8, 11, 13, 15]))})
        n = _parts(nodes, own)
        bridges |= {e for e in own if _parts(nodes, [x for x in own if x != e]) > n}
        cuts |= {v for v in nodes if _parts(nodes - {v}, [x for x in own if v not in x]) > n}
        edges += own
    names, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: names.append(name) or save(self, df, name))
    g = Graph.of(spark, [*edges, (3, 3)], nodes=list(range(600)))
    found = traversal.find_bridges(g).collect()
    assert len(found) == len(bridges) and {(r.src, r.dst) for r in found} == bridges
    assert not any(n.startswith(("at", "walk")) for n in names)
    assert ids(traversal.find_articulation_points(g)) == cuts


def test_karate_centrality(spark, karate):
    ranks, rounds, _ = centrality.pagerank(karate)
    top = {r["id"]: r["score"] for r in ranks.collect()}
    assert rounds == 30 and top[33] == pytest.approx(0.100919, abs=1e-5) and sum(top.values()) == pytest.approx(1, abs=1e-6)
    assert {r["id"]: r["score"] for r in centrality.betweenness_centrality(karate).collect()}[0] == pytest.approx(0.437635, abs=1e-6)
    assert {r["id"]: r["score"] for r in centrality.closeness_centrality(karate).collect()}[0] == pytest.approx(0.568966, abs=1e-6)


def test_eigenvector_need_not_converge(spark):
    scores, rounds, history = centrality.eigenvector_centrality(Graph.of(spark, [(0, 1), (1, 2)]), max_iterations=6)
    assert rounds == 6 and history[-1] == pytest.approx(0.57735, abs=1e-4) or len(history) == 6


def test_flow_and_cut(spark):
    g = Graph.of(spark, [(0, 1, 3), (0, 2, 2), (1, 2, 5), (1, 3, 2), (2, 3, 3)], directed=True, weighted=True)
    value, flow = flows.ford_fulkerson(g, 0, 3)
    assert value.first()[0] == 5 and flow.where("u = 0").agg(F.sum("flow")).first()[0] == 5
    cut, _, sides = flows.min_cut(g, 0, 3)
    assert cut.first()[0] == 5 and {r["id"]: r["side"] for r in sides.collect()}[3] == "sink"
    with pytest.raises(ValueError):
        flows.ford_fulkerson(g, 0, 0)


def test_matching(spark):
    g = Graph.of(spark, [(0, 10), (0, 11), (1, 10), (2, 11), (2, 12)])
    left, right = g.nodes.where("id < 10"), g.nodes.where("id >= 10")
    assert flows.hopcroft_karp(g, left, right).count() == 3


def _matching_size(pairs):
    """Kuhn's augmenting paths."""
    near, mate = {}, {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)

    def found(a, seen):
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in mate or found(mate[b], seen):
                    mate[b] = a
                    return True
        return False

    return sum(found(a, set()) for a in near)


@pytest.mark.parametrize("n_left,n_right,turned", [(60, 60, False), (90, 50, True)])
def test_matching_without_a_task_for_a_component(spark, monkeypatch, n_left, n_right, turned):
    """A sparse random graph and a star; text ids, edges either way round."""
    draw = random.Random(n_left)
    pairs = {(f"l{draw.randrange(n_left)}", f"r{draw.randrange(n_right)}") for _ in range(130)} | {(f"ls{k}", "rs") for k in range(9)}
    g = Graph.of(spark, [*(p[::-1] if turned else p for p in sorted(pairs)), ("l0", "l1"), ("q", "r0")])
    monkeypatch.setattr(flows, "FEW_PAIRS", 0)
    monkeypatch.setattr(flows, "matched", None)
    found = [(r.left, r.right) for r in flows.hopcroft_karp(g, g.nodes.where("id like 'l%'"), g.nodes.where("id like 'r%'")).collect()]
    assert set(found) <= pairs and len({a for a, _ in found}) == len({b for _, b in found}) == len(found) == _matching_size(sorted(pairs))


def test_matching_turns_long_paths(spark, monkeypatch):
    """From a matching with a hole at each end of a path, nine levels lead to the whole one; a second path has no way out."""
    rows = [(k, 100 + k) for k in range(9)] + [(k + 1, 100 + k) for k in range(8)] + [(50, 150), (51, 150), (52, 152)]
    start = [(100 + k, k + 1) for k in range(8)] + [(150, 51), (152, 52)]
    monkeypatch.setattr(matching, "_maximal", lambda pairs, scratch: scratch.save(spark.createDataFrame([p[:: 1 if pairs.first()["a"] >= 100 else -1] for p in start], "a bigint, b bigint"), "mates"))
    monkeypatch.setattr(traversal, "MERGE_LEVELS", 3)
    found = {(r.left, r.right) for r in matching.maximum_matching(spark.createDataFrame(rows, "left bigint, right bigint")).collect()}
    assert {p for p in found if p[0] < 50} == {(k, 100 + k) for k in range(9)} and len(found) == 11 and found <= set(rows)


def test_matching_of_small_and_large_components(spark, monkeypatch):
    """From a start with a hole at each end of three paths, those of five pairs go to a task each, one of nine to forests."""
    whole = [(10 * c + k, 1000 + 10 * c + k) for c, n in enumerate((3, 5, 3)) for k in range(n)]
    start = [(u + 1, v) for u, v in whole if (u + 1, v + 1) in whole]
    pairs = spark.createDataFrame(whole + start, "left bigint, right bigint")
    monkeypatch.setattr(matching, "_maximal", lambda pairs, scratch: scratch.save(spark.createDataFrame([p[:: 1 if pairs.first()["a"] < 1000 else -1] for p in start], "a bigint, b bigint"), "mates"))
    grown, turned = [], matching._turned
    monkeypatch.setattr(matching, "_turned", lambda pairs, mates, free: grown.append(pairs.count()) or turned(pairs, mates, free))

    def run(pdf):
        assert len(pdf) == 5
        return pdf.assign(own=pdf.right - pdf.left).query("own == 1000")[["left", "right"]]

    assert {(r.left, r.right) for r in matching.maximum_matching(pairs, 5, run).collect()} == set(whole) and set(grown) == {9}


def test_pairs_of_overlapping_sides(spark):
    for directed in (False, True):
        g = Graph.of(spark, [(0, 1), (1, 0), (1, 1), (1, 2)], directed=directed)
        got = sorted(map(tuple, g.bipartite_edges(g.nodes.where("id < 2"), g.nodes.where("id > 0")).collect()))
        assert got == [(0, 1), (1, 1), (1, 2)]


def test_spanning_trees(spark):
    g = Graph.of(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1), (0, 2, 1), (1, 3, 5)], weighted=True)
    both = mst.compare_mst_algorithms(g).collect()
    assert {r["weight"] for r in both} == {3.0} and {r["edges"] for r in both} == {3}
    with pytest.raises(ValueError, match="disconnected"):
        mst.kruskals(Graph.of(spark, [(0, 1, 1), (2, 3, 1)], weighted=True))
    with pytest.raises(ValueError, match="undirected"):
        mst.kruskals(Graph.of(spark, [(0, 1, 1)], directed=True))


def test_negative_cycle_and_no_path(spark):
    g = Graph.of(spark, [(0, 1, 1), (1, 2, -3), (2, 0, 1), (2, 3, 2)], directed=True, weighted=True)
    for run in (lambda: paths.bellman_ford(g, 0), lambda: paths.floyd_warshall(g), lambda: paths.johnsons(g)):
        with pytest.raises(ValueError, match="negative"):
            run()
    lone = Graph.of(spark, [], nodes=list(range(6)))
    found = paths.dijkstra(lone, 0)
    assert [(r["id"], r["dist"]) for r in found.collect()] == [(0, 0.0)]
    with pytest.raises(ValueError, match="No path"):
        paths.reconstruct_path(found, 0, 3)


def test_cycle_has_no_topological_order(spark):
    with pytest.raises(ValueError, match="cycle"):
        traversal.topological_sort(Graph.of(spark, [(0, 1), (1, 0)], directed=True))


def test_union_find(spark):
    sets = mst.UnionFind(spark.range(5)).union(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    assert {r["id"]: r["label"] for r in sets.find().collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_request_and_serialization(spark):
    g = json_io.graph_from_request(spark, {"edges": [[0, 1], [1, 2, 4]], "nodes": [5], "weighted": True, "coordinates": {"0": [1, 2]}})
    assert g.num_nodes() == 4 and [r["id"] for r in g.get_nodes().collect()][0] == 5
    assert '"num_edges": 2' in json_io.serialize_graph(g, "g")
    with pytest.raises(ValueError):
        json_io.graph_from_request(spark, {"edges": [[1]]})


def test_generators(spark):
    g = generators.random_graph(spark, 300, 0.05, seed=3)
    n, expected = g.num_edges(), 300 * 299 / 2 * 0.05
    assert abs(n - expected) < 6 * math.sqrt(expected) and generators.random_graph(spark, 300, 0.05, seed=3).num_edges() == n
    assert generators.random_graph(spark, 6, 1.0, directed=True).num_edges() == 30
    with pytest.raises(ValueError):
        generators.random_graph(spark, 3, 1.5)


def test_claims(spark):
    points = spark.createDataFrame([(n, 3 * n, 0.5 * n) for n in (50, 100, 200, 400)], "size long, edges long, ms double")
    fits = stats.fit_complexity_curve(points, ["O(n)", "O(n^2)"])
    assert stats.evaluate_claim(fits, "O(n)").first()["match"] and not stats.evaluate_claim(fits, "O(n^2)").first()["match"]
    assert stats.fit_against_term(points, F.col("n") + F.col("m")).first()["match"]


def test_present(spark):
    s = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("10", 3.0), ("9", 3.0)], "id string, score double")
    assert [r["id"] for r in present.ranked_lines(s, 3).orderBy("rank").collect()] == ["9", "10", "b"]
    assert {r["id"]: r["score"] for r in present.normalize_scores(s).collect()}["a"] == 0.0


def test_flow_and_tree_of_the_whole_trade_graph(spark):
    from graphloom import queries as Q
    from graphloom.sources import tables as T

    sf = "/root/testdata/sf0.01"
    capacity = {(r.src, r.dst): r.weight for r in T.table_rows(spark, sf, T.TRADE).collect()}
    nodes = {n for e in capacity for n in e}
    assert len(nodes) == 25
    left, reached = dict(capacity), 0
    while True:
        seen, queue = {0: None}, [0]
        for a in queue:
            for b in nodes - seen.keys():
                if left.get((a, b), 0) > 0:
                    seen[b] = a
                    queue.append(b)
        if 11 not in seen:
            break
        path, b = [], 11
        while b:
            path.append((seen[b], b))
            b = seen[b]
        step = min(left[e] for e in path)
        for a, b in path:
            left[a, b] -= step
            left[b, a] = left.get((b, a), 0) + step
        reached += step
    assert reached == sum(w for (a, b), w in capacity.items() if a in seen and b not in seen)
    assert Q.QUERIES["max_flow"](spark, sf).first()[0] == Q.QUERIES["min_cut"](spark, sf).first()[0] == reached
    weight = {}
    for (a, b), w in capacity.items():
        weight[min(a, b), max(a, b)] = min(w, weight.get((min(a, b), max(a, b)), w))
    root, want = {n: n for n in nodes}, set()
    for (a, b), w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
        if root[a] != root[b]:
            want.add((a, b, w))
            old, new = root[b], root[a]
            root = {n: new if r == old else r for n, r in root.items()}
    for name in ("kruskals", "prims"):
        assert {tuple(r) for r in Q.QUERIES[name](spark, sf).collect()} == want


def test_entered_by_hand(spark):
    rows = spark.createDataFrame([(" 12 ", "0", "none"), ("-3", "x", "left"), ("a1", "2.5", "right"), (None, None, "none")], "t string, w string, side string")
    got = rows.select(present.coerce_id(F.col("t")).alias("id"), Graph.entered_weight(F.col("w")).alias("w"), present.next_side(F.col("side")).alias("side")).collect()
    assert [(r.id.number, r.id.text, r.w, r.side) for r in got] == [(12, None, 1.0, "left"), (-3, None, 1.0, "right"), (None, "a1", 2.5, "none"), (None, None, 1.0, "left")]
    g = Graph.of(spark, [(0, 1, 2.0), (1, 0, 5.0)], directed=True, weighted=True)
    assert [(r.src, r.dst, r.weight) for r in g.with_flags(False, True).edges.collect()] == [(0, 1, 5.0)]
    assert {r.weight for r in g.with_flags(True, False).edges.collect()} == {1.0}
    with pytest.raises(ValueError):
        g.ensure_new("1")
    g.ensure_new(2)


def test_directed_colouring_walks_forwards_in_order(spark):
    assert not traversal.is_bipartite(Graph.of(spark, [(1, 0)], directed=True, nodes=[0, 1]))
    assert traversal.is_bipartite(Graph.of(spark, [(0, 1)], directed=True, nodes=[0, 1]))


def test_positions_on_demand_are_the_usual_ones(spark):
    rows = spark.createDataFrame([(3, 1, 2.0), (0, 3, 1.0), (1, 3, 9.0), (2, 2, 4.0)], "src long, dst long, weight double")
    usual, late = Graph.from_edges(rows, False, True), Graph.from_edges(rows, False, True, ordered=False)
    assert sorted(map(tuple, late.ordered().edges.collect())) == sorted(map(tuple, usual.edges.collect()))
    assert {(r.src, r.dst, r.weight) for r in late.edges.collect()} == {(0, 3, 1.0), (1, 3, 2.0), (2, 2, 4.0)}
