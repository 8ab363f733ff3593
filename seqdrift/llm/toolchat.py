"""Tool-call linking and canonical chat serialisation."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqdrift.llm.common import settle

#: Argument schemas by tool: required names, and the JSON type of each known name.
SCHEMAS: dict[str, dict] = {
    "search": {"required": ["query"], "types": {"query": "string", "limit": "integer"}},
    "calculate": {"required": ["expression"], "types": {"expression": "string"}},
    "weather": {"required": ["city"], "types": {"city": "string", "days": "integer"}},
}
#: A conversation with at most this many dependencies may be ordered in one row.
LOCAL_EDGES = 2000
_NO_TURN = -(1 << 63)
_VARIANT_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}
_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant,depends_on:array<string>>>>"
_RESULT = "struct<tool_call_id:string>"


def validate(name: Column, arguments: Column, schemas: Mapping[str, dict]) -> Column:
    """'ok', or the first reason against a call's arguments."""
    verdict = F.lit("unknown tool")
    for tool, schema in sorted(schemas.items()):
        checks = F.when(arguments.isNull(), "no arguments")
        for key in schema.get("required", []):
            checks = checks.when(F.try_variant_get(arguments, f"$.{key}", "string").isNull(), f"missing {key}")
        for key, kind in sorted(schema.get("types", {}).items()):
            found = F.schema_of_variant(F.try_variant_get(arguments, f"$.{key}", "variant"))
            base = F.regexp_extract(found, "^([A-Z]+)", 1)
            checks = checks.when(found.isNotNull() & ~base.isin(_VARIANT_TYPES[kind]), f"{key} is not {kind}")
        verdict = F.when(name == tool, checks.otherwise("ok")).otherwise(verdict)
    return verdict


def _peeled(edges: Column, base: int) -> Column:
    """Levels of one conversation's edges (node, on, turn, on_turn, open), an array of (node, level, turn).

    Each step takes away the nodes without an open dependency, as a round of ``_levels`` does for all conversations.
    """

    def only(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]  # a lambda's argument is evaluated once

    def step(state: Column, _: Column) -> Column:
        left = state["left"]
        waiting = F.transform(F.filter(left, lambda e: e["open"]), lambda e: e["node"])
        ready = F.array_except(F.transform(left, lambda e: e["node"]), waiting)

        def take(node: Column) -> Column:
            turns = F.transform(F.filter(left, lambda e: e["node"] == node), lambda e: F.greatest(e["turn"], e["on_turn"]))
            return F.struct(node.alias("node"), state["level"].alias("level"), F.array_max(turns).alias("turn"))

        def close(gone: Column) -> Column:
            names = F.transform(gone, lambda g: g["node"])

            def edge(e: Column) -> Column:
                closed = F.filter(gone, lambda g: g["node"] == e["on"])
                turn = F.when(F.size(closed) > 0, closed[0]["turn"]).otherwise(e["on_turn"])
                return F.struct(e["node"].alias("node"), e["on"].alias("on"), e["turn"].alias("turn"), turn.alias("on_turn"), (e["open"] & (F.size(closed) == 0)).alias("open"))

            rest = F.transform(F.filter(left, lambda e: ~F.array_contains(names, e["node"])), edge)
            return F.struct(rest.alias("left"), F.concat(state["done"], gone).alias("done"), (state["level"] + 1).alias("level"))

        return only(ready, lambda r: F.when(F.size(r) == 0, state).otherwise(only(F.transform(r, take), close)))

    done = F.array().cast("array<struct<node:string,level:int,turn:bigint>>")
    start = F.struct(edges.alias("left"), done.alias("done"), F.lit(base).alias("level"))

    def finish(state: Column) -> Column:
        cyclic = F.transform(F.array_distinct(F.transform(state["left"], lambda e: e["node"])), lambda n: F.struct(n.alias("node"), F.lit(-1).alias("level"), F.lit(None).cast("long").alias("turn")))
        return F.concat(state["done"], cyclic)

    return F.aggregate(F.sequence(F.lit(1), F.size(edges)), start, step, finish)


def _levels(edges: DataFrame, rounds: int) -> DataFrame:
    """(conv_id, node, level, turn) of every node that depends on another, from edges (conv_id, node, on, turn, on_turn).

    ``level`` is the longest chain below the node, -1 if that meets a cycle; ``turn`` is the latest turn of the node and
    all below it. Each round takes away the nodes without an open dependency. After ``rounds`` rounds, none by default,
    conversations of at most ``LOCAL_EDGES`` edges are finished one by one; larger ones go on by rounds until no node can
    be taken away.
    """
    edges = edges.withColumns({c: F.coalesce(c, F.lit(_NO_TURN)) for c in ("turn", "on_turn")})
    has = edges.select("conv_id", F.col("node").alias("on")).distinct().withColumn("has", F.lit(True))
    state = settle(edges.join(has, ["conv_id", "on"], "left").withColumn("open", F.coalesce("has", F.lit(False))).drop("has"))
    found, level = [], 0
    while not state.isEmpty():
        level += 1
        if level == rounds + 1:
            small = state.groupBy("conv_id").count().where(F.col("count") <= LOCAL_EDGES).select("conv_id")
            local = state.join(small, "conv_id", "left_semi").groupBy("conv_id").agg(F.collect_list(F.struct("node", "on", "turn", "on_turn", "open")).alias("edges"))
            peeled = local.select("conv_id", F.explode(_peeled(F.col("edges"), level)).alias("p"))
            found.append(settle(peeled.select("conv_id", "p.node", "p.level", "p.turn")))
            state = settle(state.join(small, "conv_id", "left_anti"))
            if state.isEmpty():
                break
        nodes = state.groupBy("conv_id", "node").agg(F.max("open").alias("open"), F.max(F.greatest("turn", F.when(~F.col("open"), F.col("on_turn")))).alias("turn"))
        gone = settle(nodes.where(~F.col("open")).select("conv_id", "node", F.lit(level).alias("level"), "turn"))
        if gone.isEmpty():  # each node that is left has an open dependency: a cycle, or a chain that ends in one
            found.append(nodes.select("conv_id", "node", F.lit(-1).alias("level"), "turn"))
            break
        found.append(gone)
        if len(found) > 32:
            found = [settle(reduce(DataFrame.unionByName, found))]
        closed = gone.select("conv_id", F.col("node").alias("on"), F.col("turn").alias("closed"))
        state = state.join(gone.select("conv_id", "node"), ["conv_id", "node"], "left_anti").join(closed, ["conv_id", "on"], "left")
        state = settle(state.withColumns({"open": F.col("open") & F.col("closed").isNull(), "on_turn": F.coalesce("closed", "on_turn")}).drop("closed"))
    if not found:
        return edges.sparkSession.createDataFrame([], "conv_id long, node string, level int, turn long")
    return settle(reduce(DataFrame.unionByName, found).withColumn("turn", F.nullif("turn", F.lit(_NO_TURN))))


def _order(calls: DataFrame, made: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(calls, messages): (conv_id, call_id, depth, step, at) and (conv_id, turn, text, step, at, order).

    ``depth`` counts calls below a call; ``step`` and ``at`` are the place and turn of its result, or of the message.
    Results depend on their message and on the results their call depends on; a message depends on the results that its
    calls depend on, unless those calls are its own. ``order`` lists a message's calls after those they depend on.
    """
    first = made.select("conv_id", "call_id", F.col("first.turn").alias("turn"), F.col("first.text").alias("text"))
    on = first.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"), F.col("text").alias("on_text"))
    needs = calls.select("conv_id", "call_id", "turn", "text", F.explode("depends_on").alias("on")).distinct()
    needs = settle(needs.join(on, ["conv_id", "on"]))
    own = first.select("conv_id", "call_id", F.col("turn").alias("made_at"))
    plain = needs.join(own, ["conv_id", "call_id"]).select("conv_id", F.col("call_id").alias("node"), "on", F.col("made_at").alias("turn"), "on_turn").distinct()
    depths = _levels(plain, rounds)

    linked = needs.select("conv_id").distinct()  # only these conversations have an order to find

    def message(turn: str, text: str) -> Column:
        return F.concat(F.lit("m"), F.coalesce(F.col(turn).cast("string"), F.lit("")), F.lit("/"), F.sha2(text, 256))

    result = F.concat(F.lit("r"), F.col("call_id"))
    sent = first.join(linked, "conv_id", "left_semi").select("conv_id", result.alias("node"), message("turn", "text").alias("on"), "turn", F.col("turn").alias("on_turn"))
    chained = plain.select("conv_id", F.concat(F.lit("r"), "node").alias("node"), F.concat(F.lit("r"), "on").alias("on"), "turn", "on_turn")
    other = ~(F.col("turn").eqNullSafe(F.col("on_turn")) & (F.col("text") == F.col("on_text")))
    asked = needs.where(other).select("conv_id", message("turn", "text").alias("node"), F.concat(F.lit("r"), "on").alias("on"), "turn", "on_turn")
    places = _levels(sent.unionByName(chained).unionByName(asked).distinct(), rounds)
    place = places.select("conv_id", "node", F.when(F.col("level") >= 0, F.col("level") + 1).alias("step"), F.when(F.col("level") >= 0, F.col("turn")).alias("at"))

    found = first.join(depths.select("conv_id", F.col("node").alias("call_id"), F.col("level").alias("depth")), ["conv_id", "call_id"], "left")
    found = found.withColumn("node", result).join(place, ["conv_id", "node"], "left").select("conv_id", "call_id", F.coalesce("depth", F.lit(0)).alias("depth"), "step", "at")
    # In a message, a call's depth sorts it after those it depends on; calls on a cycle come last, as given.
    inside = calls.join(linked, "conv_id", "left_semi").join(found.select("conv_id", "call_id", "depth"), ["conv_id", "call_id"])
    key = F.struct((F.col("depth") < 0).alias("cyclic"), "depth", "place", "call_id")
    messages = inside.groupBy("conv_id", "turn", "text").agg(F.array_sort(F.collect_set(key)).alias("sorted"), F.max("depth").alias("deep"), F.min("depth").alias("least"))
    ids = F.transform("sorted", lambda x: x["call_id"])
    messages = messages.withColumn("order", F.when((F.size("sorted") > 1) & ((F.col("deep") > 0) | (F.col("least") < 0)), ids))
    messages = messages.withColumn("node", message("turn", "text")).join(place, ["conv_id", "node"], "left")
    return found, messages.select("conv_id", "turn", "text", "step", "at", "order")


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, dict] = SCHEMAS, rounds: int = 0) -> DataFrame:
    """One row per message, with its tool calls linked to their results, in an order that puts calls first.

    An assistant text that is a JSON object with ``tool_calls`` makes calls (id, name, arguments, depends_on); a text of
    role ``tool`` with ``tool_call_id`` is a result. Calls and results are joined by (conv_id, id). ``order_turn`` and
    ``order_step`` sort a conversation topologically: a result never comes before its call, and messages with calls
    follow the calls they depend on, and their results. ``line`` is the message as canonical JSON (sorted keys, no
    spaces, null fields left out); where calls of a message depend on others, its ``order`` lists the message's calls
    topologically. Chains may be of any length. What is on or behind a cycle, of calls or of whole messages, keeps its
    turn's order.

    Repeated ids: the earliest call counts, for its name and verdict; it depends on all that its copies depend on. A result without a call has status ``orphan``; a message without calls has
    status ``plain``; other JSON or broken JSON is plain text. Nulls stay null; repeated messages stay repeated; no rows are
    gathered per conversation, and dependencies only up to ``LOCAL_EDGES``, so one may hold any share of the rows.
    """
    base = messages.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    looks = F.col("text").rlike(r"^\s*\{")
    body = F.when(looks, F.expr("try_parse_json(text)"))
    parsed = base.withColumns(
        {
            "calls": F.when(F.col("role") == "assistant", F.expr(f"from_json(case when text rlike '^\\\\s*\\\\{{' then text end, '{_CALLS}').tool_calls")),
            "answers": F.when(F.col("role") == "tool", F.expr(f"from_json(case when text rlike '^\\\\s*\\\\{{' then text end, '{_RESULT}').tool_call_id")),
            "body": body,
        }
    )
    calls = parsed.where(F.size("calls") > 0).select("conv_id", "turn", "text", F.posexplode("calls").alias("place", "call"))
    calls = calls.select("conv_id", "turn", "text", "place", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.depends_on").alias("depends_on"), validate(F.col("call.name"), F.col("call.arguments"), schemas).alias("verdict")).where("call_id is not null")
    # One row an id however many repeat it, so the join cannot multiply messages.
    made = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "verdict", "text")).alias("first"))
    if not calls.where(F.size("depends_on") > 0).isEmpty():
        found, order = _order(calls, made, rounds)
        made = made.join(found, ["conv_id", "call_id"], "left")
    else:
        made, order = made.withColumns({"depth": F.lit(0), "step": F.lit(None).cast("int"), "at": F.lit(None).cast("long")}), None
    made = made.select("conv_id", F.col("call_id").alias("answers"), F.col("first.turn").alias("call_turn"), F.col("first.name").alias("call_name"), F.col("first.verdict").alias("verdict"), F.coalesce("depth", F.lit(0)).alias("depth"), "step", "at")
    linked = parsed.where("answers is not null").join(made, ["conv_id", "answers"], "left")
    rest = parsed.where("answers is null").withColumns({"call_turn": F.lit(None).cast("long"), "call_name": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), "depth": F.lit(0), "step": F.lit(None).cast("int"), "at": F.lit(None).cast("long")})
    nothing = {"order": F.lit(None).cast("array<string>")}
    if order is None:
        rest = rest.withColumns(nothing)
    else:
        makes = F.coalesce(F.size("calls") > 0, F.lit(False))
        placed = rest.where(makes).drop("step", "at").alias("r").join(order.alias("o"), F.expr("r.conv_id = o.conv_id AND r.turn <=> o.turn AND r.text = o.text"), "left").select("r.*", "o.step", "o.at", "o.order")
        rest = rest.where(~makes).withColumns(nothing).unionByName(placed)
    linked = linked.withColumns(nothing)
    rows = linked.unionByName(rest)
    n_calls = F.when(F.size("calls") > 0, F.size("calls")).otherwise(0).cast("long")
    status = (
        F.when(F.col("answers").isNotNull() & F.col("call_turn").isNull(), "orphan")
        .when(F.col("answers").isNotNull() & (F.col("depth") < 0), "cycle")
        .when(F.col("answers").isNotNull(), F.concat(F.lit("result: "), F.col("verdict")))
        .when(n_calls > 0, "call")
        .otherwise("plain")
    )
    verdicts = F.transform("calls", lambda c: validate(c["name"], c["arguments"], schemas))
    canonical = F.coalesce(F.when(n_calls > 0, F.to_json("body")).when(F.col("answers").isNotNull(), F.to_json("body")), F.col("text"))
    line = F.to_json(F.struct(F.col("answers").alias("answers"), F.when(n_calls > 0, verdicts).alias("checks"), canonical.alias("content"), "conv_id", "order", "role", "turn"))
    return rows.select(
        "conv_id",
        "turn",
        "role",
        n_calls.alias("n_calls"),
        status.alias("status"),
        F.greatest("turn", "call_turn", "at").alias("order_turn"),
        F.coalesce("step", F.when(F.col("answers").isNotNull(), 2).when(n_calls > 0, 1).otherwise(0)).cast("int").alias("order_step"),
        line.alias("line"),
    )
