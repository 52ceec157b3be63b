"""Operator 10: tool-call linking, with DataFrame functions only.

Calls and results meet in a hash join on the call's identifier. A call may name the earlier call whose
result it uses, its parent; its level, the number of calls before it on that path, orders calls
topologically and is found by pointer doubling, in as many joins as the logarithm of the longest path.
Arguments are validated against schemas and written as canonical JSON: members sorted by name, no space
between tokens, only the escapes that JSON needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import materialise, table

#: JSON types of schemas and the types of variants that are of them. Fixed values.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}
#: Schemas (name, argument, type, required) of the calls that `conversations` stand for.
SCHEMAS = (("ask", "text", "string", True), ("ask", "turn", "integer", True), ("ask", "first", "boolean", False))


def quoted(text: Column) -> Column:
    """A string as a JSON string, null as null."""
    raw = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(raw, F.lit(6), F.length(raw) - 6))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of every identifier in (call_id, parent_id); the level is null on a cycle and below one.

    A parent that is no call counts as none. Where rows repeat an identifier, its smallest parent counts.
    """
    named = materialise(calls.where("call_id is not null").groupBy("call_id").agg(F.min("parent_id").alias("parent_id")))
    known = named.select(F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    now = materialise(named.join(known, "parent_id", "left").select("call_id", F.when(F.col("known"), F.col("parent_id")).alias("above"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("level")))
    left = now.where("above is not null").count()
    while left:
        jump = now.select(F.col("call_id").alias("above"), F.col("above").alias("next"), F.col("level").alias("more"))
        now = materialise(now.join(jump, "above", "left").select("call_id", F.col("next").alias("above"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        left, before = now.where("above is not null").count(), left
        if left == before:  # on a path each round settles some call, so what is left hangs on cycles
            break
    return now.select("call_id", F.when(F.col("above").isNull(), F.col("level")).alias("level"))


def written(rows: DataFrame) -> DataFrame:
    """The rows that `link_tool_calls` returns, of the same with canonical arguments, content and contents."""
    number = F.coalesce(F.col("level").cast("string"), F.lit("null"))
    several = F.when(F.col("n_results") > 1, F.concat(F.lit(',"results":['), F.array_join(F.transform("contents", lambda x: quoted(x["content"])), ","), F.lit("]"))).otherwise("")
    json = F.concat(F.lit('{"arguments":'), F.col("canonical"), F.lit(',"call_id":'), quoted(F.col("call_id")), F.lit(',"level":'), number, F.lit(',"name":'), quoted(F.col("name")), F.lit(',"parent_id":'), quoted(F.col("parent_id")), F.lit(',"result":'), quoted(F.col("content")), several, F.lit("}"))
    return rows.select("call_id", "parent_id", "name", "level", "linked", "n_results", "errors", json.alias("json"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, unnamed: bool = False) -> DataFrame:
    """Link calls (call_id, parent_id, name, arguments as JSON) with results (call_id, content).

    ``schemas`` has a row (name, argument, type, required) for each argument of a tool. Returns one row for
    each call: call_id, parent_id, name, level, linked, n_results, errors (sorted) and json, and one for each
    identifier that has results but no call, with name and level null. errors: `unknown tool`, `not an object`
    (also null and malformed arguments), `missing x`, `type x`, `unknown x`. Of several results of a call, the
    smallest content is the json's `result`, and its `results` has all, sorted; a null content is a result.
    Calls without identifier link with nothing and have level 0; calls that repeat one share its results and
    level. Results without identifier are left out, or, with ``unnamed``, a row each. Further columns of the
    inputs are ignored; empty inputs give empty results.
    """
    calls = calls.select("call_id", "parent_id", "name", "arguments")
    found = results.where("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min("content").alias("content"), F.sort_array(F.collect_list(F.struct("content"))).alias("contents"))  # as many as a call has results
    tools = schemas.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("argument", "type", "required"))).alias("wanted"))  # as many as a tool has arguments
    linked = calls.join(levels(calls), "call_id", "left").join(found.hint("shuffle_hash"), "call_id", "left").join(tools, "name", "left")

    value = F.try_parse_json("arguments")
    given = F.try_variant_get(value, "$", "map<string,variant>")
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])

    def problem(w: Column) -> Column:
        own = F.schema_of_variant(F.try_element_at("given", w["argument"]))
        absent = ~F.array_contains(F.map_keys("given"), w["argument"])
        return F.when(absent & w["required"], F.concat(F.lit("missing "), w["argument"])).when(~absent & ~F.rlike(F.coalesce(own, F.lit("VOID")), F.concat(F.lit("^("), kind[w["type"]], F.lit(")"))), F.concat(F.lit("type "), w["argument"]))

    extra = F.transform(F.array_except(F.map_keys("given"), F.transform("wanted", lambda w: w["argument"])), lambda k: F.concat(F.lit("unknown "), k))
    errors = F.when(F.col("wanted").isNull(), F.array(F.lit("unknown tool"))).when(F.col("given").isNull(), F.array(F.lit("not an object"))).otherwise(F.sort_array(F.concat(F.filter(F.transform("wanted", problem), lambda x: x.isNotNull()), extra)))
    rows = linked.withColumn("given", given).withColumn("errors", errors).withColumn("canonical", F.coalesce(F.to_json(value), F.lit("null"))).withColumn("linked", F.col("n_results").isNotNull())
    rows = rows.withColumn("level", F.when(F.col("call_id").isNull(), 0).otherwise(F.col("level")))
    lone = found.join(calls.select("call_id").where("call_id is not null").distinct(), "call_id", "left_anti")
    if unnamed:
        lone = lone.unionByName(results.where("call_id is null").select("call_id", F.lit(1).cast("long").alias("n_results"), "content", F.array(F.struct("content")).alias("contents")))
    orphans = lone.select(
        "call_id", F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("level"), F.lit(False).alias("linked"), "n_results", F.array(F.lit("no call")).alias("errors"), F.lit("null").alias("canonical"), "content", "contents",
    )
    every = rows.select("call_id", "parent_id", "name", "level", "linked", F.coalesce("n_results", F.lit(0)).alias("n_results"), "errors", "canonical", "content", "contents").unionByName(orphans)
    return written(every)


def turn_id(turn: Column) -> Column:
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))


def calls_and_results(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as tool calls: a user's turn calls `ask`, an assistant's turn is the result of the call one turn before.

    The identifier is conversation and turn. A call's parent is the call two turns before it. The first call of
    a conversation is its first user turn, whatever stands before it. Turns of other roles are neither: see
    `messages`.
    """
    turn, ask = F.col("turn"), F.when(F.col("role") == "user", "ask")  # no constant, so that the join with the schemas is an equi-join
    users = conversations.where("role = 'user'")
    opening = users.groupBy("conv_id").agg(F.min("turn").alias("opening"))
    arguments = F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("text"), F.coalesce(turn == F.col("opening"), F.lit(False)).alias("first")))
    calls = users.join(opening, "conv_id", "left").select(turn_id(turn).alias("call_id"), turn_id(turn - 2).alias("parent_id"), ask.alias("name"), arguments.alias("arguments"))
    return calls, conversations.where("role = 'assistant'").select(turn_id(turn - 1).alias("call_id"), F.col("text").alias("content"))


def messages(conversations: DataFrame) -> DataFrame:
    """Turns that neither call nor answer (of system, unknown and null roles) as rows of `link_tool_calls`.

    Their name is `message`, with role, text and turn as arguments; they have no level and link with nothing.
    """
    rows = conversations.where("role is null or role not in ('user', 'assistant')")
    arguments = F.to_json(F.parse_json(F.to_json(F.struct("role", "text", "turn"))))
    none = F.lit(None).cast("string")
    return written(rows.select(
        turn_id(F.col("turn")).alias("call_id"), none.alias("parent_id"), F.lit("message").alias("name"), F.lit(None).cast("long").alias("level"), F.lit(False).alias("linked"), F.lit(0).cast("long").alias("n_results"),
        F.array().cast("array<string>").alias("errors"), arguments.alias("canonical"), none.alias("content"), F.array(F.struct(none.alias("content"))).alias("contents"),
    ))


def every_turn(conversations: DataFrame, schemas: DataFrame) -> DataFrame:
    """All turns: calls with their results, results without call or identifier, and messages."""
    calls, results = calls_and_results(conversations)
    return link_tool_calls(calls, results, schemas, unnamed=True).unionByName(messages(conversations))


def _schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEMAS, "name string, argument string, type string, required boolean")


def op10_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_turn(table(spark, sf_dir, "conversations"), _schemas(spark)).withColumn("errors", F.array_join("errors", ", "))


OP10_SQL = r"""
WITH RECURSIVE t AS (
  SELECT *, conv_id::VARCHAR || ':' || turn::VARCHAR AS own, conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS asked,
    min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS opening
  FROM conversations
), c AS (
  SELECT own AS call_id, conv_id::VARCHAR || ':' || (turn - 2)::VARCHAR AS parent_id, turn, text, conv_id IS NOT NULL AND coalesce(turn = opening, false) AS opens FROM t WHERE role = 'user'
), k AS (
  SELECT call_id, min(parent_id) AS parent_id FROM c WHERE call_id IS NOT NULL GROUP BY 1
), l AS (
  SELECT k.call_id, 0::BIGINT AS level FROM k LEFT JOIN k AS p ON k.parent_id = p.call_id WHERE p.call_id IS NULL
  UNION ALL
  SELECT k.call_id, l.level + 1 FROM l JOIN k ON k.parent_id = l.call_id
), r AS (
  SELECT asked AS call_id, count(*) AS n_results, min(text) AS content, list(text ORDER BY text NULLS FIRST) AS contents FROM t WHERE role = 'assistant' AND asked IS NOT NULL GROUP BY 1
), e AS (
  SELECT c.call_id, c.parent_id, 'ask' AS name, CASE WHEN c.call_id IS NULL THEN 0 ELSE l.level END AS level, r.call_id IS NOT NULL AS linked, coalesce(r.n_results, 0) AS n_results,
    concat_ws(', ', CASE WHEN c.text IS NULL THEN 'missing text' END, CASE WHEN c.turn IS NULL THEN 'missing turn' END) AS errors,
    concat('{"first":', c.opens, CASE WHEN c.text IS NOT NULL THEN concat(',"text":', to_json(c.text)) END, CASE WHEN c.turn IS NOT NULL THEN concat(',"turn":', c.turn) END, '}') AS canonical, r.content, r.contents
  FROM c LEFT JOIN l ON c.call_id = l.call_id LEFT JOIN r ON c.call_id = r.call_id
  UNION ALL
  SELECT call_id, NULL, NULL, NULL, false, n_results, 'no call', 'null', content, contents FROM r WHERE call_id NOT IN (SELECT call_id FROM k)
  UNION ALL
  SELECT NULL, NULL, NULL, NULL, false, 1, 'no call', 'null', text, [text] FROM t WHERE role = 'assistant' AND asked IS NULL
  UNION ALL
  SELECT own, NULL, 'message', NULL, false, 0, '', concat('{', concat_ws(',', '"role":' || to_json(role)::VARCHAR, '"text":' || to_json(text)::VARCHAR, '"turn":' || turn::VARCHAR), '}'), NULL, []
  FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant')
)
SELECT call_id, parent_id, name, level, linked, n_results, errors,
  concat('{"arguments":', canonical, ',"call_id":', coalesce(to_json(call_id)::VARCHAR, 'null'), ',"level":', coalesce(level::VARCHAR, 'null'), ',"name":', coalesce(to_json(name)::VARCHAR, 'null'),
    ',"parent_id":', coalesce(to_json(parent_id)::VARCHAR, 'null'), ',"result":', coalesce(to_json(content)::VARCHAR, 'null'),
    CASE WHEN n_results > 1 THEN concat(',"results":[', array_to_string(list_transform(contents, lambda x: coalesce(to_json(x)::VARCHAR, 'null')), ','), ']') ELSE '' END, '}') AS json
FROM e
"""
