"""Chat formatting with linked tool calls, in DataFrame operations only.

An assistant message may be a JSON object with ``tool_calls`` (each with ``id``, ``name``, ``arguments`` and
optionally ``depends_on``, ids of calls whose results it uses); a tool message is a JSON object with
``tool_call_id``. Calls and results are joined by conversation and identifier. The order is topological: a
call stands one level above the results it depends on, a result one above its call; within a level rows go
by turn and place. Arguments are checked against a schema table, and every item is written as canonical JSON
(sorted keys, no blanks, numbers as Spark's variant prints them).

Each message, call and result is a row of its own with its order key, so a conversation of any length never
meets in one task. A table of messages gives a row for each message and, after them in order, each call in it.

Odd input: null or other text is an ordinary message; a second call of an identifier, in order of turn (null
first) and place, is ``duplicate id`` and gets no results; rows that repeat a message are kept, their calls share
turn and place and are told alike; results without a call and calls without a result are told; calls in a
cycle, and calls that need them, have no level; rows with a null ``conv_id`` belong to no conversation: their calls
are ``no conversation``, their results ordinary messages; arguments that are no JSON stay as a string; very long
texts are rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import Scratch

#: (tool, argument, JSON type, required)
DEFAULT_SCHEMAS = [
    ("search", "query", "string", True), ("search", "limit", "integer", False), ("fetch", "url", "string", True), ("fetch", "timeout", "number", False),
    ("calculate", "expression", "string", True), ("run_code", "language", "string", True), ("run_code", "code", "string", True), ("run_code", "arguments", "array", False),
    ("lookup", "key", "string", True), ("lookup", "options", "object", False), ("lookup", "strict", "boolean", False),
]


def _type_fits(kind: Column, wanted: Column) -> Column:
    whole = kind.rlike(r"^BIGINT$|^DECIMAL\(\d+,0\)$")
    return (
        F.when(wanted == "integer", whole).when(wanted == "number", kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")).when(wanted == "string", kind == "STRING")
        .when(wanted == "boolean", kind == "BOOLEAN").when(wanted == "array", kind.startswith("ARRAY")).when(wanted == "object", kind.startswith("OBJECT"))
        .when(wanted == "null", kind == "VOID").otherwise(F.lit(True))
    )


#: Weights on a cycle double in each round; more than any path has.
ENDLESS = 1 << 60


def _levels(calls: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level): twice the longest chain of calls that one needs; null where that meets a cycle.

    Edges lead to what a call needs, or to the ground (null) from calls that need nothing. In each round an edge to a
    call with one edge only goes on along that, and parallel edges become the longest one. Chains, and nets that fold
    into chains, so halve each round; in any other net at least the calls above those at the ground come down to it.
    """
    key = ["conv_id", "call_id"]
    known = calls.select(*key).distinct()
    edges = scratch.save(edges.join(known.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi").distinct(), "edges")
    if edges.isEmpty():
        return known.withColumn("level", F.lit(0).cast("long"))
    lone = known.join(edges, key, "left_anti").select(*key, F.lit(None).cast("string").alias("needs"), F.lit(0).cast("long").alias("far"))
    net = scratch.save(edges.select(*key, "needs", F.lit(2).cast("long").alias("far")).unionByName(lone), "net")
    grounded = -1
    while True:
        single = net.groupBy(*key).agg(F.count("*").alias("n"), F.first("needs").alias("on"), F.first("far").alias("more")).where("n = 1")
        single = scratch.save(single.select("conv_id", F.col("call_id").alias("needs"), "on", "more"), "single")
        now = single.where("on is null").count()
        if now == grounded:
            levels = single.where("on is null").select("conv_id", F.col("needs").alias("call_id"), F.col("more").alias("level"))
            return known.join(levels, key, "left")
        grounded = now
        moved = net.join(single, ["conv_id", "needs"], "left")
        further = F.col("more").isNotNull()
        moved = moved.select(*key, F.when(further, F.col("on")).otherwise(F.col("needs")).alias("needs"), F.least(F.col("far") + F.coalesce("more", F.lit(0)), F.lit(ENDLESS)).alias("far"))
        net = scratch.save(moved.groupBy(*key, "needs").agg(F.max("far").alias("far")), "net")


def link_tool_calls(conversations: DataFrame, schemas: list[tuple[str, str, str, bool]] = DEFAULT_SCHEMAS) -> DataFrame:
    """One row for each message, call and result, with its order key (topo_level, turn, place)."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "calls")
    base = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    likely = F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^\s*\{")
    parsed = base.withColumn("body", F.when(likely, F.try_parse_json("text")))
    part = lambda path, kind, c="body": F.try_variant_get(F.col(c), path, kind)

    listed = parsed.where(F.col("role") == "assistant").select("conv_id", "turn", F.posexplode(part("$.tool_calls", "array<variant>")).alias("place", "call"))
    raw = part("$.arguments", "variant", "call")
    calls = listed.select(
        "conv_id", "turn", "place", part("$.id", "string", "call").alias("call_id"), part("$.name", "string", "call").alias("name"),
        F.when(F.schema_of_variant(raw) == "STRING", F.coalesce(F.try_parse_json(part("$.arguments", "string", "call")), raw)).otherwise(raw).alias("arguments"),
        part("$.depends_on", "array<string>", "call").alias("needs"),
    )
    calls = scratch.save(_judged(calls, schemas).withColumn("arguments", F.to_json("arguments")), "calls")
    results = parsed.where((F.col("role") == "tool") & F.col("conv_id").isNotNull()).select("conv_id", "turn", F.lit(0).alias("place"), part("$.tool_call_id", "string").alias("call_id"), F.to_json("body").alias("canonical")).where("call_id is not null")

    linkable = calls.where("conv_id is not null and call_id is not null")
    firsts = linkable.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place")).alias("first"), F.min_by("name", F.struct("turn", "place")).alias("any_name"))
    edges = linkable.select("conv_id", "call_id", F.explode("needs").alias("needs"))
    levels = _levels(linkable, edges, scratch)
    heads = scratch.save(firsts.join(levels, ["conv_id", "call_id"]), "heads")

    answered = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    full = calls.join(heads.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(answered.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    full = full.withColumn("own", F.col("first.turn").eqNullSafe(F.col("turn")) & (F.col("first.place") == F.col("place")))
    told = F.array_compact(F.array(
        F.when(F.col("conv_id").isNull(), F.lit("no conversation")), F.when(F.col("call_id").isNull(), F.lit("no id")), F.when(F.col("first").isNotNull() & ~F.col("own"), F.lit("duplicate id")),
        F.when(F.col("first").isNotNull() & F.col("level").isNull(), F.lit("cycle")), F.when(F.col("answers").isNull(), F.lit("no result")),
    ))
    call_json = F.to_json(F.try_parse_json(F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name"), {"ignoreNullFields": "false"})))
    call_rows = full.select(
        "conv_id", "turn", "place", F.lit("call").alias("kind"), "call_id", "name", (F.coalesce("own", F.lit(False)) & F.col("answers").isNotNull()).alias("linked"),
        (F.size("errors") == 0).alias("valid"), F.array_sort(F.concat(told, F.col("errors"))).alias("errors"),
        F.col("level").cast("int").alias("topo_level"), call_json.alias("canonical"),
    )
    result_rows = results.join(heads.hint("shuffle_hash"), ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", "place", F.lit("result").alias("kind"), "call_id", F.col("any_name").alias("name"), F.col("first").isNotNull().alias("linked"), F.lit(True).alias("valid"),
        F.when(F.col("first").isNull(), F.array(F.lit("no call"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.col("level") + 1).cast("int").alias("topo_level"), "canonical",
    )
    is_result = F.coalesce((F.col("role") == "tool") & part("$.tool_call_id", "string").isNotNull() & F.col("conv_id").isNotNull(), F.lit(False))
    plain = parsed.where(~is_result)
    words = F.when((F.col("role") == "assistant") & part("$.tool_calls", "array<variant>").isNotNull(), part("$.content", "string")).otherwise(F.col("text"))
    message_rows = plain.select(
        "conv_id", "turn", F.lit(-1).alias("place"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"),
        F.lit(False).alias("linked"), F.lit(True).alias("valid"), F.array().cast("array<string>").alias("errors"), F.lit(0).alias("topo_level"),
        F.to_json(F.struct(words.alias("content"), "role"), {"ignoreNullFields": "false"}).alias("canonical"),
    )
    rows = message_rows.unionByName(call_rows).unionByName(result_rows)
    return rows.withColumn("errors", F.array_join("errors", "; "))


def _judged(calls: DataFrame, schemas: list[tuple[str, str, str, bool]]) -> DataFrame:
    """``calls`` with the errors of their arguments against their tool's schema, judged row by row.

    The schemas are the caller's list, so their table is small and shared.
    """
    table = calls.sparkSession.createDataFrame(list(schemas), "name string, argument string, wanted string, required boolean")
    tools = table.groupBy("name").agg(F.map_from_entries(F.collect_set(F.struct("argument", "wanted"))).alias("known"), F.collect_set(F.when(F.col("required"), F.col("argument"))).alias("needed"))
    none = F.array().cast("array<string>")
    values = F.when(F.schema_of_variant("arguments").startswith("OBJECT"), F.try_variant_get("arguments", "$", "map<string,variant>"))
    given = F.transform(F.map_entries("values"), lambda e: F.struct(e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("kind")))
    out = calls.join(F.broadcast(tools), "name", "left").withColumn("values", values).withColumn("given", given).withColumn("keys", F.map_keys("values"))
    whole = F.array_compact(F.array(F.when(F.col("known").isNull(), F.lit("unknown tool")), F.when(F.col("known").isNotNull() & F.col("values").isNull(), F.lit("arguments are no object"))))
    missing = F.transform(F.array_except("needed", F.coalesce("keys", none)), lambda a: F.concat(F.lit("missing "), a))
    extra = F.transform(F.array_except("keys", F.map_keys("known")), lambda a: F.concat(F.lit("unknown "), a))
    wanted = lambda e: F.try_element_at(F.col("known"), e["key"])
    wrong = F.transform(F.filter("given", lambda e: wanted(e).isNotNull() & ~_type_fits(e["kind"], wanted(e))), lambda e: F.concat(F.lit("not a "), wanted(e), F.lit(": "), e["key"]))
    errors = F.concat(whole, *[F.coalesce(x, none) for x in (missing, extra, wrong)])
    return out.select(*calls.columns, errors.alias("errors"))
