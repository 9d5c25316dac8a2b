"""Step traces: the log of what an algorithm does, as ``(step_no, action, step)`` rows; ``step`` is one JSON object.

Traces of level-wise, greedy and per-source algorithms are derived from the distributed results by joins and ranks.
Traces of inherently sequential ones (depth-first search, in-place relaxation, augmenting paths) come from a kernel
in one task for the graph, as such a log is only read for graphs that a page shows.
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans import Scratch
from ..plans.ranking import with_positions
from . import centrality as central
from . import flows, mst, paths, traversal

STEP = "step_no bigint, action string, step string"


def _step(action: str, **fields: Column) -> Column:
    """One step as a struct of its action and JSON text; null fields are left out."""
    return F.struct(F.lit(action).alias("action"), F.to_json(F.struct(F.lit(action).alias("action"), *[v.alias(k) for k, v in fields.items()])).alias("step"))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(order..., s)`` as a trace in that order."""
    return with_positions(rows, [F.col(c) for c in order], "step_no").select("step_no", "s.action", "s.step")


def _logged(steps: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([(i, s["action"], json.dumps(s)) for i, s in enumerate(steps)], columns=["step_no", "action", "step"])


def _by_kernel(graph: Graph, run: Callable[[dict], list[dict]]) -> DataFrame:
    return traversal.kernel(graph, lambda near: _logged(run(near)), STEP)


def flatten(*traces: DataFrame) -> DataFrame:
    """Traces one after another, numbered anew."""
    parts = [t.select(F.lit(i).alias("part"), F.col("step_no").alias("at"), F.struct("action", "step").alias("s")) for i, t in enumerate(traces)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return _numbered(every, ["part", "at"])


# Traversal


def bfs(graph: Graph, start) -> DataFrame:
    """visit(node, distance, via), skip(node, from): each visited node in turn looks at its neighbours."""
    graph = graph.ordered()
    seen = traversal.bfs(graph, start)
    tail = seen.select(F.col("id").alias("src"), "ord")
    head = seen.select(F.col("id").alias("dst"), "dist", "via")
    looks = tail.join(graph.adjacency(), "src").join(head, "dst")
    step = F.when(F.col("via") == F.col("src"), _step("visit", node=F.col("dst"), distance=F.col("dist"), via=F.col("src"))).otherwise(_step("skip", **{"node": F.col("dst"), "from": F.col("src")}))
    first = seen.where("ord = 0").select(F.lit(-1).cast("long").alias("ord"), F.lit(-1).cast("long").alias("nbr_pos"), _step("visit", node=F.col("id"), distance=F.col("dist")).alias("s"))
    return _numbered(first.unionByName(looks.select("ord", "nbr_pos", step.alias("s"))), ["ord", "nbr_pos"])


def _walk(near: dict, roots: list) -> Iterator[tuple]:
    """Depth-first events: (in|out, node, its parent), (down|up, u, v) round a tree edge, (seen, u, v) otherwise."""
    via: dict = {}
    for root in roots:
        if root in via:
            continue
        via[root] = None
        yield "in", root, None
        trail = [(root, iter(near[root]))]
        while trail:
            u, rest = trail[-1]
            for v in rest:
                if v not in via:
                    via[v] = u
                    yield "down", u, v
                    yield "in", v, u
                    trail.append((v, iter(near[v])))
                    break
                yield "seen", u, v
            else:
                trail.pop()
                yield "out", u, via[u]
                if via[u] is not None:
                    yield "up", via[u], u


def dfs(graph: Graph, start) -> DataFrame:
    """visit(node), traverse(from, to), skip(from, to)."""

    def run(near):
        named = {"in": lambda u, _: {"action": "visit", "node": u}, "down": lambda u, v: {"action": "traverse", "from": u, "to": v}, "seen": lambda u, v: {"action": "skip", "from": u, "to": v}}
        return [named[e](u, v) for e, u, v in _walk(near, [start]) if e in named]

    return _by_kernel(traversal.reached_part(graph, start), run)


def dfs_iterative(graph: Graph, start) -> DataFrame:
    """visit(node), push(from, to): neighbours are pushed last first."""

    def run(near):
        steps, seen, stack = [], set(), [start]
        while stack:
            u = stack.pop()
            if u in seen:
                continue
            seen.add(u)
            fresh = [v for v in reversed(near[u]) if v not in seen]
            stack += fresh
            steps += [{"action": "visit", "node": u}, *({"action": "push", "from": u, "to": v} for v in fresh)]
        return steps

    return _by_kernel(traversal.reached_part(graph, start), run)


def _low_links(near: dict, on_up: Callable, counts_back: Callable, on_out: Callable = lambda *_: ()) -> list[dict]:
    """The steps of a low-link search; the callbacks add those of one algorithm, from (u, v, via, disc, low)."""
    steps, disc, low, via = [], {}, {}, {}
    for event, u, v in _walk(near, list(near)):
        if event == "in":
            disc[u] = low[u] = len(disc)
            via[u] = v
            steps.append({"action": "discover", "node": u, "disc": disc[u], "low": low[u]})
        elif event == "down":
            steps.append({"action": "traverse", "from": u, "to": v})
        elif event == "up":
            low[u] = min(low[u], low[v])
            steps.append({"action": "update_low", "node": u, "low": low[u], "via": v})
            steps += on_up(u, v, via, disc, low)
        elif event == "seen" and counts_back(u, v, via):
            low[u] = min(low[u], disc[v])
            steps.append({"action": "back_edge", "from": u, "to": v, "low": low[u]})
        elif event == "out":
            steps += on_out(u, disc, low)
    return steps


def strongly_connected_components(graph: Graph) -> DataFrame:
    """discover(node, disc, low), traverse, update_low(node, low, via), back_edge(from, to, low), scc(nodes)."""
    graph.ensure_kind(True, "strongly connected components")

    def run(near):
        closed, opened = set(), []

        def out(u, disc, low):
            opened.append(u)
            if low[u] < disc[u]:
                return []
            # What finished since ``u`` was discovered, and is in no component yet, belongs to ``u``; the latest comes first.
            nodes = []
            while opened and disc[opened[-1]] >= disc[u]:
                nodes.append(opened.pop())
            closed.update(nodes)
            return [{"action": "scc", "nodes": sorted(nodes, key=disc.get, reverse=True)}]

        return _low_links(near, lambda *_: [], lambda u, v, via: v not in closed, out)

    return _by_kernel(graph, run)


def find_bridges(graph: Graph) -> DataFrame:
    """The low-link steps and bridge(edge)."""
    graph.ensure_kind(False, "bridges")
    found = lambda u, v, via, disc, low: [{"action": "bridge", "edge": [u, v]}] if low[v] > disc[u] else []
    return _by_kernel(graph, lambda near: _low_links(near, found, lambda u, v, via: v != via[u]))


def find_articulation_points(graph: Graph) -> DataFrame:
    """The low-link steps and articulation_point(node, reason, child)."""
    graph.ensure_kind(False, "articulation points")

    def run(near):
        branches: dict = {}

        def found(u, v, via, disc, low):
            branches[u] = branches.get(u, 0) + 1
            if via[u] is None:
                return [{"action": "articulation_point", "node": u, "reason": "root_with_multiple_children"}] if branches[u] > 1 else []
            return [{"action": "articulation_point", "node": u, "reason": "low_link", "child": v}] if low[v] >= disc[u] else []

        return _low_links(near, found, lambda u, v, via: v != via[u])

    return _by_kernel(graph, run)


# Shortest paths


def _best_first(near: dict, start, goal, h: dict | None) -> list[dict]:
    """settle and relax steps; with a heuristic the queue orders by f, and steps carry it."""
    extra = (lambda v, d: {"f": d + h[v]}) if h else (lambda v, d: {})
    rank = lambda v, d: d + h[v] if h else d
    best, done, steps, queue = {start: 0.0}, set(), [], [(rank(start, 0.0), 0.0, start)]
    while queue:
        _, d, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        steps.append({"action": "settle", "node": u, "distance": d, **extra(u, d)})
        if goal is not None and u == goal:
            break
        for v, w in near[u].items():
            if v not in done and d + w < best.get(v, float("inf")):
                best[v] = d + w
                heapq.heappush(queue, (rank(v, d + w), d + w, v))
                steps.append({"action": "relax", "from": u, "to": v, "distance": d + w, **extra(v, d + w)})
    return steps


def dijkstra(graph: Graph, start) -> DataFrame:
    """settle(node, distance), relax(from, to, distance)."""
    graph.ensure_node(start, "start")
    graph.ensure_non_negative()
    return _by_kernel(traversal.reached_part(graph, start), lambda near: _best_first(near, start, None, None))


def a_star(graph: Graph, start, goal, heuristic: DataFrame) -> DataFrame:
    """settle(node, distance, f), relax(from, to, distance, f) up to the goal, under ``heuristic(id, h)``."""
    graph.ensure_node(start, "start")
    graph.ensure_node(goal, "goal")
    graph.ensure_non_negative()
    part = traversal.reached_part(graph, start)
    # The heuristic travels with the nodes, in place of their unused weight.
    guess = part.nodes.select("id").join(heuristic.select("id", "h"), "id")
    return traversal.kernel(part, lambda near, h: _logged(_best_first(near, start, goal, h)), STEP, guess)


def bellman_ford(graph: Graph, start) -> DataFrame:
    """relax(iteration, from, to, distance): passes over all edges in their order, until one changes nothing."""
    graph = graph.ordered()
    graph.ensure_node(start, "start")
    turns = graph.edges.select("src", "dst", "weight", "edge_pos", F.lit(0).alias("side"))
    if not graph.directed:
        turns = turns.unionAll(graph.edges.select("dst", "src", "weight", "edge_pos", F.lit(1)))
    nodes = graph.num_nodes()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["edge_pos", "side"])
        edges = list(zip(pdf.src.tolist(), pdf.dst.tolist(), pdf.weight.tolist()))
        dist, steps, far = {start: 0.0}, [], float("inf")
        for turn in range(nodes):
            before = len(steps)
            for u, v, w in edges:
                if u in dist and dist[u] + w < dist.get(v, far):
                    if turn == nodes - 1:
                        raise ValueError("the graph has a negative-weight cycle")
                    dist[v] = dist[u] + w
                    steps.append({"action": "relax", "iteration": turn, "from": u, "to": v, "distance": dist[v]})
            if len(steps) == before:
                break
        return _logged(steps)

    return turns.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, STEP)


def floyd_warshall(graph: Graph) -> DataFrame:
    """update(i, j, via, distance): every node in turn as the middle of every pair."""

    def run(near):
        far, steps = float("inf"), []
        dist = {u: {u: min(0.0, row.get(u, 0.0)), **{v: w for v, w in row.items() if v != u}} for u, row in near.items()}
        for k in near:
            for i in near:
                if k not in dist[i]:
                    continue
                leg = dist[i][k]
                for j in near:
                    way = leg + dist[k].get(j, far)
                    if way < dist[i].get(j, far):
                        dist[i][j] = way
                        steps.append({"action": "update", "i": i, "j": j, "via": k, "distance": way})
        return steps

    return _by_kernel(graph, run)


def johnsons(graph: Graph) -> DataFrame:
    """potentials_start(source), potentials(h), dijkstra_source(source, reachable) for every node."""
    graph = graph.ordered()
    h = graph.nodes.select("id", "node_pos").join(paths.potentials(graph), "id")
    text = h.groupBy().agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("node_pos", "id", "h"))), lambda x: F.struct(x["id"].cast("string"), x["h"]))).alias("h"))
    reach = paths.johnsons(graph).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).join(graph.nodes.select("id", "node_pos"), "id")
    one = graph.nodes.sparkSession.range(1).where(F.lit(not graph.nodes.isEmpty()))
    rows = one.select(F.lit(-2).cast("long").alias("at"), _step("potentials_start", source=F.lit("virtual")).alias("s"))
    rows = rows.unionByName(text.where(F.size("h") > 0).select(F.lit(-1).cast("long").alias("at"), _step("potentials", h=F.col("h")).alias("s")))
    return _numbered(rows.unionByName(reach.select(F.col("node_pos").alias("at"), _step("dijkstra_source", source=F.col("id"), reachable=F.col("n")).alias("s"))), ["at"])


# Spanning trees


def kruskals(graph: Graph) -> DataFrame:
    """consider(edge, weight), then accept(edge, weight, total) or reject(edge, weight, reason), up to the last tree edge."""
    graph = graph.ordered()
    scratch = Scratch(graph.nodes.sparkSession, "kruskal-steps")
    tree = scratch.save(mst.kruskals(graph).select("src", "dst", "total", F.lit(True).alias("taken")), "tree")
    rows = with_positions(graph.edges.join(tree, ["src", "dst"], "left"), [F.col("weight"), F.col("edge_pos")], "at")
    last = rows.where("taken").agg(F.max("at")).first()[0]
    if last is not None:
        rows = rows.where(F.col("at") <= last)
    edge = F.array("src", "dst")
    judged = F.when(F.col("taken"), _step("accept", edge=edge, weight=F.col("weight"), total=F.col("total"))).otherwise(_step("reject", edge=edge, weight=F.col("weight"), reason=F.lit("cycle")))
    both = F.explode(F.array(F.struct(F.lit(0).alias("half"), _step("consider", edge=edge, weight=F.col("weight")).alias("s")), F.struct(F.lit(1).alias("half"), judged.alias("s"))))
    return _numbered(rows.select("at", both.alias("e")).select("at", "e.*"), ["at", "half"])


def prims(graph: Graph, start=None) -> DataFrame:
    """start(node), add(edge, weight, node, total), skip(edge, weight, reason) as the tree grows from ``start``."""
    graph.ensure_kind(False, "a spanning tree")
    if start is not None:
        graph.ensure_node(start, "start")

    def run(near):
        root = next(iter(near)) if start is None else start
        steps, inside, total = [{"action": "start", "node": root}], {root}, 0.0
        queue = [(w, root, v) for v, w in near[root].items()]
        heapq.heapify(queue)
        while queue and len(inside) < len(near):
            w, u, v = heapq.heappop(queue)
            if v in inside:
                steps.append({"action": "skip", "edge": [u, v], "weight": w, "reason": "already_in_tree"})
                continue
            inside.add(v)
            total += w
            steps.append({"action": "add", "edge": [u, v], "weight": w, "node": v, "total": total})
            for x, c in near[v].items():
                if x not in inside:
                    heapq.heappush(queue, (c, v, x))
        if len(inside) < len(near):
            raise ValueError("the graph is disconnected")
        return steps

    return _by_kernel(graph, run)


def comparison(graph: Graph, compared: DataFrame) -> DataFrame:
    """compare_kruskals_done(time_ms), compare_prims_done(time_ms), compare_result(faster, note) of ``compared``."""
    own = compared.withColumn("at", F.when(F.col("algorithm") == "kruskals", 0).otherwise(1))
    done = own.select("at", F.when(F.col("at") == 0, _step("compare_kruskals_done", time_ms=F.col("time_ms"))).otherwise(_step("compare_prims_done", time_ms=F.col("time_ms"))).alias("s"))
    note = F.concat(F.col("faster"), F.lit(f" was faster on this graph (|V|={graph.num_nodes()}, |E|={graph.num_edges()})."))
    return _numbered(done.unionByName(own.where("at = 0").select(F.lit(2).alias("at"), _step("compare_result", faster=F.col("faster"), note=note).alias("s"))), ["at"])


# Flows and matching


def _augmentations(caps: list[tuple], source, sink) -> list[dict]:
    """augment steps of shortest augmenting paths."""
    room: dict = {source: {}, sink: {}}
    for u, v, c in caps:
        if u != v:
            room.setdefault(u, {})[v] = room.get(u, {}).get(v, 0.0) + c
            room.setdefault(v, {}).setdefault(u, 0.0)
    steps, total = [], 0.0
    while True:
        via, queue = {source: None}, deque([source])
        while queue and sink not in via:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > flows.EPS and v not in via:
                    via[v] = u
                    queue.append(v)
        if sink not in via:
            return steps
        back = [sink]
        while via[back[-1]] is not None:
            back.append(via[back[-1]])
        path = [[back[i], back[i - 1]] for i in range(len(back) - 1, 0, -1)]
        push = min(room[u][v] for u, v in path)
        total += push
        for u, v in path:
            room[u][v] -= push
            room[v][u] += push
        left = [{"from": u, "to": v, "residual_forward": room[u][v], "residual_backward": room[v][u]} for u, v in path]
        steps.append({"action": "augment", "iteration": len(steps) + 1, "path": path, "bottleneck": push, "flow_so_far": total, "residual_updates": left})


def ford_fulkerson(graph: Graph, source, sink) -> DataFrame:
    """augment(iteration, path, bottleneck, flow_so_far, residual_updates)."""
    caps = flows.between(graph, source, sink)
    run = lambda pdf: _logged(_augmentations(list(zip(*(pdf.sort_values(["src", "dst"])[c].tolist() for c in ("src", "dst", "capacity")))), source, sink))
    return caps.groupBy("g").applyInPandas(run, STEP)


def min_cut(graph: Graph, source, sink) -> DataFrame:
    """The augment steps, source_side(nodes), sink_side(nodes), cut_edge(edge, capacity)."""
    graph = graph.ordered()
    scratch = Scratch(graph.nodes.sparkSession, "cut-steps")
    _, cut, sides = flows.min_cut(graph, source, sink)
    cut, sides = scratch.save(cut, "cut"), scratch.save(sides.join(graph.nodes.select("id", "node_pos"), "id"), "sides")
    listed = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("node_pos", "id")))), lambda x: x["id"])
    both = sides.agg(listed("source").alias("a"), listed("sink").alias("b"))
    kind = graph.nodes.schema["id"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    rows = both.select(F.explode(F.array(F.struct(F.lit(0).alias("at"), _step("source_side", nodes=F.col("a")).alias("s")), F.struct(F.lit(1).alias("at"), _step("sink_side", nodes=F.col("b")).alias("s")))).alias("e")).select("e.*", none.alias("u"), none.alias("v"))
    rows = rows.unionByName(cut.select(F.lit(2).alias("at"), _step("cut_edge", edge=F.array("u", "v"), capacity=F.col("capacity")).alias("s"), "u", "v"))
    return flatten(ford_fulkerson(graph, source, sink), _numbered(rows, ["at", "u", "v"]))


def bipartite_matching(graph: Graph, left: DataFrame, right: DataFrame) -> DataFrame:
    """build_flow_network(left, right), match(pair)."""
    pairs = flows.bipartite_matching(graph, left, right)
    kind = graph.nodes.schema["id"].dataType.simpleString()
    sides = left.agg(F.array_sort(F.collect_list("id")).alias("l")).join(right.agg(F.array_sort(F.collect_list("id")).alias("r")))
    rows = sides.select(F.lit(0).alias("at"), F.lit(None).cast(kind).alias("left"), _step("build_flow_network", left=F.col("l"), right=F.col("r")).alias("s"))
    return _numbered(rows.unionByName(pairs.select(F.lit(1).alias("at"), "left", _step("match", pair=F.array("left", "right")).alias("s"))), ["at", "left"])


def hopcroft_karp(graph: Graph, left: DataFrame, right: DataFrame) -> DataFrame:
    """match(pair, phase) and phase(phase, augmented, matching_size), over all components at once."""
    pairs = graph.bipartite_edges(left, right).withColumn("g", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        steps: list[dict] = []
        flows.matched(list(zip(pdf.left.tolist(), pdf.right.tolist())), steps)
        return _logged(steps)

    return pairs.groupBy("g").applyInPandas(run, STEP)


# Centrality


def iterations(graph: Graph, history: list[float]) -> DataFrame:
    """iteration(iteration, l1_delta) of a power iteration's history."""
    rows = [(i, "iteration", json.dumps({"action": "iteration", "iteration": i + 1, "l1_delta": d})) for i, d in enumerate(history)]
    return graph.nodes.sparkSession.createDataFrame(rows, STEP)


def betweenness_centrality(graph: Graph) -> DataFrame:
    """source_done(source, reached) for every node."""
    graph = graph.ordered()
    reach = central.reached_counts(graph).join(graph.nodes.select("id", "node_pos"), "id")
    return _numbered(reach.select("node_pos", _step("source_done", source=F.col("id"), reached=F.col("n")).alias("s")), ["node_pos"])


def closeness_centrality(graph: Graph) -> DataFrame:
    """node_closeness(node, reachable, score) for every node."""
    graph = graph.ordered()
    rows = central.closeness_centrality(graph).join(central.reached_counts(graph), "id").join(graph.nodes.select("id", "node_pos"), "id")
    return _numbered(rows.select("node_pos", _step("node_closeness", node=F.col("id"), reachable=F.col("n") - 1, score=F.col("score")).alias("s")), ["node_pos"])


def count_augmenting_paths(trace: DataFrame) -> DataFrame:
    return trace.agg(F.count_if(F.col("action") == "augment").alias("paths"))
