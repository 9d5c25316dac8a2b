"""What a page shows of a result: ids, score scales, ranked lines, highlights of a step trace."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How roles outrank each other.
ROLE_PRIORITY = {"current": 100, "source_side": 85, "sink_side": 85, "path": 80, "mst": 75, "flow": 70, "result": 70, "matched": 65, "consider": 50, "visited": 30, "rejected": 10}


def coerce_id(text: Column) -> Column:
    """(number, text): digits as a number, anything else as the trimmed text; both null for a null."""
    own = F.trim(text)
    digits = own.rlike(r"^-?\d+$")
    return F.struct(F.when(digits, own.try_cast("bigint")).alias("number"), F.when(~digits, own).alias("text"))


def next_side(side: Column) -> Column:
    """The side that a node is on after its turn: none, left, right, none."""
    return F.when(side == "left", "right").when(side == "right", "none").otherwise("left")


def parse_ids(text: Column) -> Column:
    """The parts of a list that blanks and commas divide."""
    return F.filter(F.split(text, r"[\s,]+"), lambda x: x != "")


def circle_coordinates(nodes: DataFrame, n: int, radius: float = 100.0) -> DataFrame:
    angle = F.col("node_pos") * F.lit(2 * math.pi / max(n, 1))
    return nodes.select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def finite_scores(scores: DataFrame) -> DataFrame:
    s = F.col("score").cast("double")
    return scores.where(F.col("id").isNotNull() & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))).select(F.col("id").cast("string").alias("id"), s.alias("score"))


def normalize_scores(scores: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1]; 0.5 where they do not differ."""
    own = finite_scores(scores)
    ends = own.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return own.join(F.broadcast(ends)).select("id", F.when(span > 1e-12, (F.col("score") - F.col("lo")) / span).otherwise(0.5).alias("score"))


def score_style(t: Column) -> tuple[Column, Column]:
    """Size and colour for a scaled score."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(t, F.lit(0.0)), F.lit(0.0))))
    channel = lambda a, b: F.floor(a + u * u * (b - a) + 0.5).cast("int")
    return 8 + u * 36, F.format_string("rgb(%d, %d, %d)", channel(45, 232), channel(70, 186), channel(110, 64))


def format_number(v: Column) -> Column:
    """Whole numbers plainly, others with up to four places; null for null."""
    whole = v == F.floor(v)
    return F.when(whole, F.floor(v).cast("string")).when(v.isNotNull(), F.regexp_replace(F.format_string("%.4f", v), r"\.?0+$", ""))


def format_weight(v: Column) -> Column:
    """Whole numbers plainly, others with two places."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(F.format_string("%.2f", v))


def format_score(v: Column) -> Column:
    """Four places; a dash for what is no finite number."""
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit("—")).otherwise(F.format_string("%.4f", v))


def ranked_lines(scores: DataFrame, top: int) -> DataFrame:
    """rank, id, line of the ``top`` best scores; ties by id, numbers before text."""
    s = finite_scores(scores).withColumn("number", F.col("id").try_cast("long"))
    best = s.orderBy(F.desc("score"), F.col("number").asc_nulls_last(), "id").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.col("number").asc_nulls_last(), "id"))
    return best.withColumn("rank", rank).select("rank", "id", F.format_string("%d. node %s: %s", "rank", "id", format_number(F.col("score"))).alias("line"))


def highlights(roles: DataFrame, upto: int) -> DataFrame:
    """id, role after step ``upto`` of ``roles(step_no, id, role)``: highest priority, the later of equals."""
    table = F.create_map(*[F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv])
    seen = roles.where(F.col("step_no") <= upto)
    return seen.groupBy("id").agg(F.max_by("role", F.struct(F.coalesce(table[F.col("role")], F.lit(0)).alias("p"), F.col("step_no").alias("s"))).alias("role"))


#: Fields of a step that name nodes or edges; ids are kept as text.
STEP_FIELDS = (
    "action string, node string, via string, source string, `from` string, `to` string, i string, j string, edge array<string>, pair array<string>, nodes array<string>, "
    "path array<array<string>>, left array<string>, right array<string>, bottleneck string, flow_so_far string, phase string, augmented string, matching_size string, capacity string, l1_delta double"
)


def step_fields(trace: DataFrame) -> DataFrame:
    """``trace(step_no, step)`` with the fields of its steps as columns."""
    return trace.select("step_no", F.from_json("step", STEP_FIELDS).alias("s")).select("step_no", "s.*")


def step_roles(trace: DataFrame, upto: int) -> tuple[DataFrame, DataFrame]:
    """(roles(step_no, id, role), roles(step_no, src, dst, role)) of nodes and edges in the steps to ``upto``.

    The step ``upto`` also makes what it works on ``current``.
    """
    s = step_fields(trace.where(F.col("step_no") <= upto))
    action, node = F.col("action"), F.coalesce("node", "source")
    is_a = lambda *names: action.isin(*names)
    on = lambda column, role: F.when(column.isNotNull(), F.array(F.struct(column.alias("id"), F.lit(role).alias("role"))))
    every = lambda column, role: F.transform(column, lambda v: F.struct(v.alias("id"), F.lit(role).alias("role")))
    real = F.filter("path", lambda e: ~(e[0].contains("__") | e[1].contains("__")))
    link = lambda a, b, role: F.when(a.isNotNull() & b.isNotNull(), F.array(F.struct(a.alias("src"), b.alias("dst"), F.lit(role).alias("role"))))
    pair = lambda column, role: link(F.get(column, F.lit(0)), F.get(column, F.lit(1)), role)
    joined = lambda *parts: F.flatten(F.array_compact(F.array(*parts)))
    tail, head = F.col("from"), F.col("to")
    nodes = (
        F.when(is_a("visit", "discover", "settle", "start", "node_closeness", "source_done"), on(node, "visited"))
        .when(is_a("traverse", "push", "relax"), joined(on(F.coalesce(tail, "node"), "visited"), on(head, "visited")))
        .when(is_a("skip"), joined(on(F.col("node"), "visited"), every(F.col("edge"), "visited")))
        .when(is_a("consider"), every(F.col("edge"), "consider"))
        .when(is_a("accept", "add"), joined(every(F.col("edge"), "mst"), on(F.col("node"), "mst")))
        .when(is_a("reject"), every(F.col("edge"), "visited"))
        .when(is_a("bridge", "cut_edge"), every(F.col("edge"), "result"))
        .when(is_a("articulation_point"), on(F.col("node"), "result"))
        .when(is_a("scc"), every(F.col("nodes"), "result"))
        .when(is_a("augment"), every(F.flatten(real), "path"))
        .when(is_a("match"), every(F.col("pair"), "matched"))
        .when(is_a("source_side", "reachable_set"), every(F.col("nodes"), "source_side"))
        .when(is_a("sink_side"), every(F.col("nodes"), "sink_side"))
        .when(is_a("update"), joined(on(F.col("i"), "visited"), on(F.col("j"), "visited"), on(F.col("via"), "visited")))
        .otherwise(on(F.col("node"), "visited"))
    )
    edges = (
        F.when(is_a("visit", "discover", "settle", "start", "node_closeness", "source_done"), link(F.col("via"), F.col("node"), "visited"))
        .when(is_a("skip"), joined(link(tail, F.coalesce(head, "node"), "rejected"), pair("edge", "rejected")))
        .when(is_a("consider"), pair("edge", "consider")).when(is_a("accept", "add"), pair("edge", "mst")).when(is_a("reject"), pair("edge", "rejected"))
        .when(is_a("bridge", "cut_edge"), pair("edge", "result"))
        .when(is_a("augment"), F.transform(real, lambda e: F.struct(e[0].alias("src"), e[1].alias("dst"), F.lit("flow").alias("role"))))
        .when(is_a("match"), pair("pair", "path"))
        .when(~is_a("articulation_point", "scc", "source_side", "reachable_set", "sink_side", "update"), link(tail, head, "visited"))
    )
    ends = F.element_at(real, -1)
    now_nodes = (
        F.when(is_a("visit", "discover", "settle", "start"), on(F.col("node"), "current"))
        .when(is_a("traverse", "relax", "push"), on(F.coalesce(head, "node"), "current"))
        .when(is_a("consider", "accept", "add", "cut_edge"), every(F.col("edge"), "current"))
        .when(is_a("augment") & (F.size(real) > 0), on(ends[1], "current"))
        .when(is_a("match"), every(F.col("pair"), "current"))
    )
    now_edges = F.when(is_a("traverse", "relax", "push"), link(tail, head, "current")).when(is_a("consider"), pair("edge", "current"))
    last = s.agg(F.max("step_no")).first()[0]
    here = lambda column: F.when(F.col("step_no") == F.lit(last), column)
    out = [s.select("step_no", F.explode(joined(main, here(now))).alias("r")).select("step_no", "r.*") for main, now in ((nodes, now_nodes), (edges, now_edges))]
    return out[0], out[1]


def edge_highlights(roles: DataFrame, edges: DataFrame, directed: bool, upto: int) -> DataFrame:
    """src, dst, role of ``edges(src, dst)`` after step ``upto``; an undirected edge is met from both sides."""
    own = edges.select("src", "dst", F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))
    ways = own if directed else own.unionByName(own.where("a != b").select("src", "dst", F.col("b").alias("a"), F.col("a").alias("b")))
    met = roles.select("step_no", F.col("src").alias("a"), F.col("dst").alias("b"), "role").join(ways, ["a", "b"])
    return highlights(met.select("step_no", F.struct("src", "dst").alias("id"), "role"), upto).select("id.*", "role")


def summarize_steps(trace: DataFrame) -> DataFrame:
    """step_no, line: a step in words."""
    s = step_fields(trace)
    c, text = F.col, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = lambda name: F.coalesce(c(name), F.lit("—"))
    real = F.array_join(F.transform(F.filter("path", lambda e: ~(e[0].contains("__") | e[1].contains("__"))), lambda e: F.concat(e[0], F.lit("→"), e[1])), ", ")
    shown = lambda name: F.array_join(F.coalesce(c(name), F.array().cast("array<string>")), ", ")
    line = (
        F.when(c("action") == "augment", text("augment: bottleneck ", none("bottleneck"), "; flow ", none("flow_so_far"), "; path [", F.when(F.length(real) > 0, real).otherwise("—"), "]"))
        .when((c("action") == "match") & c("pair").isNotNull(), text("match: ", c("pair")[0], " – ", c("pair")[1], F.when(c("phase").isNotNull(), text(" (phase ", c("phase"), ")")).otherwise("")))
        .when((c("action") == "cut_edge") & c("edge").isNotNull(), text("cut edge: ", c("edge")[0], " → ", c("edge")[1], " (cap ", none("capacity"), ")"))
        .when(c("action").isin("source_side", "sink_side", "reachable_set") & c("nodes").isNotNull(), text(c("action"), ": {", shown("nodes"), "}"))
        .when(c("action") == "phase", text("phase ", none("phase"), ": +", F.coalesce(c("augmented"), F.lit("0")), " matches (size ", none("matching_size"), ")"))
        .when(c("action") == "build_flow_network", text("build flow network: L={", shown("left"), "} R={", shown("right"), "}"))
        .when(c("node").isNotNull() & c("from").isNull(), text(c("action"), ": node ", c("node")))
        .when(c("from").isNotNull() & c("to").isNotNull(), text(c("action"), ": ", c("from"), " → ", c("to")))
        .when(c("edge").isNotNull(), text(c("action"), ": edge ", c("edge")[0], "–", c("edge")[1]))
        .when(c("l1_delta").isNotNull(), text(c("action"), ": L1 Δ=", F.regexp_replace(F.format_string("%.2e", c("l1_delta")), "e([+-])0", "e$1")))
        .otherwise(c("action"))
    )
    return s.select("step_no", line.alias("line"))


def without_synthetic(rows: DataFrame, column: str = "id") -> DataFrame:
    return rows.where(~F.col(column).cast("string").contains("__"))


def split_evenly(nodes: DataFrame, n: int) -> DataFrame:
    """id, side: the first half of the nodes (rounded up) on the left."""
    return nodes.select("id", F.when(F.col("node_pos") < (n + 1) // 2, "left").otherwise("right").alias("side"))


def attached_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    own = nodes.select("id")
    return edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def convergence_rows(history: Column) -> Column:
    """(iteration, delta) structs, from one on."""
    return F.transform(history, lambda d, i: F.struct((i + 1).alias("iteration"), d.alias("delta")))
