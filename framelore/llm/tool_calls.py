"""Chat formatting with linked tool calls.

Events of conversations are messages, tool calls and tool results. Calls and results are joined by identifier; calls are
ordered topologically by what they need; arguments are checked against the tool's schema; every event becomes one line of
canonical JSON (keys in order at every depth, no white space). All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialise, table

SLICE_TURNS = 1024
#: Calls of a conversation that one expression folds.
BLOCK_CALLS = 1024


@dataclass(frozen=True)
class Parameter:
    """A tool's parameter; kind: string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = True


#: Spark's names for the JSON kinds, as patterns of schema_of_variant.
_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(text))
    return whole.substr(F.lit(2), F.length(whole) - 2)


def argument_errors(schemas: dict[str, list[Parameter]]) -> Column:
    """Errors of a call's arguments (column ``parsed``, a variant) under the schema of its name, in order."""
    checks = [F.when(F.col("parsed").isNull(), F.lit("not_json")), F.when(~F.col("name").isin(list(schemas)) | F.col("name").isNull(), F.lit("unknown_tool"))]
    for tool, parameters in schemas.items():
        here = (F.col("name") == tool) & F.col("parsed").isNotNull()
        for p in parameters:
            value = F.try_variant_get("parsed", F.lit(f"$.{p.name}").cast("string"), "variant")
            kind = F.schema_of_variant(value)
            absent = value.isNull() | (kind == "VOID")
            if p.required:
                checks.append(F.when(here & absent, F.lit(f"missing:{p.name}")))
            checks.append(F.when(here & ~absent & ~kind.rlike(f"^({_KINDS[p.kind]})$"), F.lit(f"type:{p.name}")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def levels(calls: DataFrame) -> DataFrame:
    """``calls``: conv_id, call_id, turn, needs (array of call ids). Returns conv_id, call_id, level, cyclic, missing.

    A call's level is the length of the longest chain of needs behind it, so levels are a topological order. Needs that name no
    call of the conversation are ignored, and reported in missing. Calls on or behind a cycle get the number of the
    conversation's calls, so they come after all others. Calls of the same id count as one, with the needs of all.

    A need that the call's latest need has too takes no part, as the way by that one is longer: a call that needs all before it
    is left with one. Calls with one need point at it; doubling the pointers brings each to the first call behind it that has none or several, in
    as many rounds as the logarithm of the longest chain. Only those others are then settled block by block: BLOCK_CALLS of them in
    a row of turns are folded in one expression, so a round settles all levels of a block that lead to settled calls by way of
    earlier turns, and there are about as many rounds as blocks that need each other in one conversation.
    """
    key = ["conv_id", "call_id"]
    known = calls.groupBy(*key).agg(F.min("turn").alias("at"))
    needs = calls.select(*key, F.explode("needs").alias("need")).distinct()
    edges = materialise(needs.join(known.select("conv_id", F.col("call_id").alias("need"), F.struct("at", "call_id").alias("there")), ["conv_id", "need"], "left"))
    placed = known
    known = known.select(*key)
    latest = edges.where("there is not null").groupBy(*key).agg(F.max("there")["call_id"].alias("latest"))
    also = edges.where("there is not null").select("conv_id", F.col("call_id").alias("latest"), "need", F.lit(True).alias("covered"))
    reduced = edges.where("there is not null").join(latest, key).join(also, ["conv_id", "latest", "need"], "left").where("covered is null or need = latest")
    inner = materialise(reduced.select(*key, "need"))
    degree = inner.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("ptr"))

    pointers = materialise(degree.where("n = 1").select(*key, "ptr", F.lit(1).cast("long").alias("dist"), F.lit(False).alias("found")))
    left = pointers.count()
    while left:
        far = pointers.select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"))
        met = pointers.join(far, ["conv_id", "ptr"], "left")
        doubled = materialise(met.select(*key, F.coalesce("ptr2", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.col("ptr2").isNull().alias("found")))
        discard(pointers)
        pointers, before, left = doubled, left, doubled.where("not found").count()
        if left == before:  # what is left runs in circles
            break

    # The others, with needs carried along the pointers; a need that leads into a circle never settles.
    end = pointers.select("conv_id", F.col("call_id").alias("need"), F.when(F.col("found"), F.col("ptr")).alias("ptr"), "dist", F.lit(True).alias("pointed"))
    several = inner.join(degree.where("n > 1").select(*key), key, "left_semi").join(end, ["conv_id", "need"], "left").join(placed, key)
    open_edges = materialise(several.select(*key, "at", F.when(F.col("pointed"), F.col("ptr")).otherwise(F.col("need")).alias("need"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist")))
    settled = materialise(known.join(degree.select(*key), key, "left_anti").withColumn("level", F.lit(0).cast("long")))
    parts = [settled]
    while not open_edges.isEmpty():
        ready = materialise(_settled_in_blocks(open_edges, settled))
        if ready.isEmpty():
            discard(ready)
            break
        fewer = materialise(open_edges.join(ready, key, "left_anti"))
        discard(open_edges)
        parts.append(ready)
        open_edges, settled = fewer, settled.union(ready)

    along = pointers.where("found").join(settled.select("conv_id", F.col("call_id").alias("ptr"), "level"), ["conv_id", "ptr"]).select(*key, (F.col("level") + F.col("dist")).alias("level"))
    size = known.groupBy("conv_id").agg(F.count("*").alias("calls"))
    missing = edges.where("there is null").select(*key).distinct().withColumn("missing", F.lit(True))
    out = known.join(settled.union(along), key, "left").join(size, "conv_id").join(missing, key, "left")
    return out.select(*key, F.coalesce("level", "calls").cast("int").alias("level"), F.col("level").isNull().alias("cyclic"), F.coalesce("missing", F.lit(False)).alias("missing"))


def _settled_in_blocks(edges: DataFrame, settled: DataFrame) -> DataFrame:
    """Levels of calls whose needs are settled, or are settled earlier in their block. ``edges``: conv_id, call_id, at, need, dist."""
    key = ["conv_id", "call_id"]
    have = settled.select("conv_id", F.col("call_id").alias("need"), "level")
    behind = F.collect_list(F.struct("need", "dist", "level")).alias("behind")
    calls = edges.join(have, ["conv_id", "need"], "left").groupBy(*key).agg(F.min("at").alias("at"), behind)
    turns = F.coalesce(F.floor(F.col("at") / SLICE_TURNS), F.lit(-1))
    number = F.row_number().over(W.partitionBy("conv_id", "turns").orderBy("at", "call_id"))
    blocks = calls.withColumn("turns", turns).withColumn("block", F.floor((number - 1) / BLOCK_CALLS)).groupBy("conv_id", "turns", "block")
    ordered = blocks.agg(F.array_sort(F.collect_list(F.struct("at", "call_id", "behind"))).alias("calls"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))

    def folded(found: Column, call: Column) -> Column:
        levels_behind = F.transform(call["behind"], lambda n: F.coalesce(n["level"], F.try_element_at(found, n["need"])) + n["dist"])
        level = F.when(F.forall(levels_behind, lambda x: x.isNotNull()), F.array_max(levels_behind))
        return F.when(level.isNull(), found).otherwise(F.map_concat(found, F.create_map(call["call_id"], level)))

    found = ordered.select("conv_id", F.explode(F.aggregate("calls", none, folded)).alias("call_id", "level"))
    return found.select(*key, "level")


EVENT = ["conv_id", "turn", "kind", "role", "call_id", "name", "arguments", "content", "needs"]


def format_chats(events: DataFrame, schemas: dict[str, list[Parameter]]) -> DataFrame:
    """``events``: conv_id, turn, kind (message, call, result), role, call_id, name, arguments (JSON), content, needs.

    Returns per event: conv_id, position (from 1 in its conversation, topological), turn, kind, call_id, level, linked,
    errors (joined by commas), json. A call is linked if a result has its id, a result if a call has; messages have no link.
    Calls that share an id are reported as duplicate_id and link alike. Results without a call keep level 0. Arguments that are
    no JSON become null. Repeated rows stay; null content and names give JSON nulls. Events without a conv_id link with nothing
    and are numbered together. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    key = ["conv_id", "call_id"]
    events = events.select(*EVENT)
    calls = events.where("kind = 'call' and call_id is not null and conv_id is not null")
    by_id = calls.groupBy(*key).agg(F.count("*").alias("n_calls"), F.min("turn").alias("call_turn"))
    results = events.where("kind = 'result' and call_id is not null and conv_id is not null").groupBy(*key).agg(F.count("*").alias("n_results"))
    ids = materialise(by_id.join(levels(calls), key).join(results, key, "full_outer"))

    linked = events.join(ids, key, "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    linked = linked.withColumn("parsed", F.when(is_call, F.try_parse_json("arguments")))
    own = F.array(
        F.when(F.col("n_calls") > 1, F.lit("duplicate_id")),
        F.when(F.col("missing"), F.lit("missing_need")),
        F.when(F.col("cyclic"), F.lit("cycle")),
        F.when(is_call & F.col("n_results").isNull(), F.lit("no_result")),
    )
    errors = F.when(is_call, F.concat(argument_errors(schemas), F.filter(own, lambda x: x.isNotNull()))).when(is_result & F.col("n_calls").isNull(), F.array(F.lit("no_call"))).otherwise(F.array().cast("array<string>"))
    null = F.lit("null")
    call = F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), null), F.lit(',"id":'), F.coalesce(quoted(F.col("call_id")), null), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), null), F.lit(',"role":"assistant","type":"call"}'))
    content = F.coalesce(quoted(F.col("content")), null)
    result = F.concat(F.lit('{"content":'), content, F.lit(',"id":'), F.coalesce(quoted(F.col("call_id")), null), F.lit(',"role":"tool","type":"result"}'))
    message = F.concat(F.lit('{"content":'), content, F.lit(',"role":'), F.coalesce(quoted(F.col("role")), null), F.lit(',"type":"message"}'))
    rows = linked.select(
        "conv_id", "turn", "kind", "call_id",
        F.coalesce("level", F.lit(0)).alias("level"),
        F.coalesce("call_turn", "turn").alias("at"),
        F.when(is_call, F.col("n_results").isNotNull()).when(is_result, F.col("n_calls").isNotNull()).alias("linked"),
        F.array_join(errors, ",").alias("errors"),
        F.when(is_call, call).when(is_result, result).otherwise(message).alias("json"),
    ).withColumn("slice", F.floor(F.coalesce("at", F.lit(0)) / SLICE_TURNS))
    # A long conversation is numbered slice by slice: its slices' counts give each slice's first position.
    part = ["conv_id", "level", "slice"]
    before = W.partitionBy("conv_id").orderBy("level", "slice").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*part).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(W.partitionBy(*part).orderBy("at", F.col("kind") == "result", "turn", "json"))
    same = F.expr("a.conv_id <=> b.conv_id and a.level = b.level and a.slice = b.slice")
    numbered = rows.withColumn("rank", rank).alias("a").join(counts.alias("b"), same)
    return numbered.select("a.conv_id", (F.col("before") + F.col("rank")).alias("position"), "turn", "kind", "call_id", "a.level", "linked", "errors", "json")


#: The tools that user turns of ``conversations`` call, by their reading below; a third one, note, is unknown.
TOOLS = {
    "reply": [Parameter("prompt", "string"), Parameter("turn", "integer"), Parameter("style", "string", required=False)],
    "search": [Parameter("query", "string"), Parameter("limit", "integer", required=False)],
}


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Plain conversations read as tool use: a user turn calls a tool, the assistant's next turn is the result.

    Every other role, a null one too, is a message. ``conversations`` holds no tool calls, so numbers decide what the calls look
    like, and all that can go wrong does: with k = 3 conv_id + turn, tools come by k mod 5; calls need those two and four turns
    before, some the next one (a circle, or nothing) or one that isn't there; some repeat an id, and some arguments are broken,
    of a wrong type or missing. Some results answer no call.
    """
    turn = F.col("turn")
    k = F.col("conv_id") * 3 + turn
    name = lambda at: F.concat(F.col("conv_id").cast("string"), F.lit(":"), at.cast("string"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    text = F.coalesce(quoted(F.col("text")), F.lit("null"))
    tool = F.when(k % 5 == 0, "search").when(k % 5 == 1, "note").otherwise("reply")
    limit = F.when(turn % 4 == 0, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).otherwise(turn.cast("string"))
    search = F.concat(F.lit("{"), F.when(k % 19 == 1, "").otherwise(F.concat(F.lit('"query":'), text, F.lit(", "))), F.lit('"limit":'), limit, F.lit("}"))
    reply = F.concat(F.lit('{"turn":'), F.coalesce(turn.cast("string"), F.lit("null")), F.lit(',"prompt":'), text, F.lit("}"))
    again = (k % 13 == 5) & (turn >= 2)
    needs = [F.when((turn >= 2) & ~again, name(turn - 2)), F.when(turn >= 4, name(turn - 4)), F.when(F.col("conv_id") % 7 == 3, name(turn + 2)), F.when(k % 11 == 4, F.lit("nowhere"))]
    return conversations.select(
        "conv_id", "turn",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        "role",
        F.when(user, F.when(again, name(turn - 2)).otherwise(name(turn))).when(assistant, F.when(k % 23 == 7, "none").otherwise(name(turn - 1))).alias("call_id"),
        F.when(user, tool).alias("name"),
        F.when(user, F.when(k % 17 == 2, "{broken").when(tool == "search", search).otherwise(reply)).alias("arguments"),
        F.col("text").alias("content"),
        F.when(user, F.filter(F.array(*needs), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")).alias("needs"),
    )


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = conversation_events(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return format_chats(events, TOOLS)


SQL = """
WITH RECURSIVE c AS (SELECT *, conv_id * 3 + turn AS k, CAST(conv_id AS VARCHAR) || ':' AS p FROM conversations),
e AS (
  SELECT conv_id, turn, role, text, k, p, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN p || CASE WHEN k % 13 = 5 AND turn >= 2 THEN turn - 2 ELSE turn END WHEN 'assistant' THEN CASE WHEN k % 23 = 7 THEN 'none' ELSE p || (turn - 1) END END AS call_id,
    CASE k % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'note' ELSE 'reply' END AS tool
  FROM c),
ids AS (SELECT conv_id, call_id, count(*) AS n_calls, min(turn) AS call_turn FROM e WHERE kind = 'call' GROUP BY conv_id, call_id),
needs AS (
  SELECT conv_id, call_id, p || (turn - 2) AS need FROM e WHERE kind = 'call' AND turn >= 2 AND k % 13 <> 5
  UNION SELECT conv_id, call_id, p || (turn - 4) FROM e WHERE kind = 'call' AND turn >= 4
  UNION SELECT conv_id, call_id, p || (turn + 2) FROM e WHERE kind = 'call' AND conv_id % 7 = 3
  UNION SELECT conv_id, call_id, 'nowhere' FROM e WHERE kind = 'call' AND k % 11 = 4),
missing AS (SELECT DISTINCT conv_id, call_id FROM needs WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.conv_id = needs.conv_id AND ids.call_id = needs.need)),
size AS (SELECT conv_id, count(*) AS calls FROM ids GROUP BY conv_id),
paths AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) AS depth FROM ids
  UNION
  SELECT needs.conv_id, needs.call_id, depth + 1 FROM paths JOIN needs ON needs.conv_id = paths.conv_id AND needs.need = paths.call_id JOIN size ON size.conv_id = paths.conv_id WHERE depth < calls),
level AS (SELECT paths.conv_id, call_id, max(depth) AS level, max(depth) = min(calls) AS cyclic FROM paths JOIN size ON size.conv_id = paths.conv_id GROUP BY paths.conv_id, call_id),
results AS (SELECT conv_id, call_id, count(*) AS n_results FROM e WHERE kind = 'result' GROUP BY conv_id, call_id),
f AS (
  SELECT e.*, n_calls, n_results, call_turn, level, cyclic, missing.call_id IS NOT NULL AS missing, kind = 'call' AND k % 17 = 2 AS broken, tool = 'search' AS search, k % 19 = 1 AS no_query, turn % 4 = 0 AS as_text
  FROM e LEFT JOIN ids USING (conv_id, call_id) LEFT JOIN level USING (conv_id, call_id) LEFT JOIN results USING (conv_id, call_id) LEFT JOIN missing ON missing.conv_id = e.conv_id AND missing.call_id = e.call_id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 0), coalesce(call_turn, turn), kind = 'result', turn) AS position, turn, kind, call_id, CAST(coalesce(level, 0) AS INTEGER) AS level,
  CASE kind WHEN 'call' THEN n_results IS NOT NULL WHEN 'result' THEN n_calls IS NOT NULL END AS linked,
  CASE kind WHEN 'call' THEN concat_ws(',', CASE WHEN broken THEN 'not_json' END, CASE WHEN tool = 'note' THEN 'unknown_tool' END,
    CASE WHEN tool = 'reply' AND NOT broken AND text IS NULL THEN 'missing:prompt' END,
    CASE WHEN search AND NOT broken AND (no_query OR text IS NULL) THEN 'missing:query' END, CASE WHEN search AND NOT broken AND as_text THEN 'type:limit' END,
    CASE WHEN n_calls > 1 THEN 'duplicate_id' END, CASE WHEN missing THEN 'missing_need' END, CASE WHEN cyclic THEN 'cycle' END, CASE WHEN n_results IS NULL THEN 'no_result' END)
    WHEN 'result' THEN CASE WHEN n_calls IS NULL THEN 'no_call' ELSE '' END ELSE '' END AS errors,
  CASE kind
    WHEN 'call' THEN '{"arguments":' || CASE WHEN broken THEN 'null' WHEN search THEN '{"limit":' || CASE WHEN as_text THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END || CASE WHEN no_query THEN '' ELSE ',"query":' || CAST(to_json(text) AS VARCHAR) END || '}'
      ELSE '{"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}' END || ',"id":"' || call_id || '","name":"' || tool || '","role":"assistant","type":"call"}'
    WHEN 'result' THEN '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":"' || call_id || '","role":"tool","type":"result"}'
    ELSE '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '","type":"message"}' END AS json
FROM f
"""
