"""Operator 10: links, levels, validation and canonical JSON, and its SQL."""

import json

import duckdb
import pandas as pd
import pytest

from tessera.llm import registry, tool_calls

SF = "/root/testdata/sf0.001"
CALLS, RESULTS = "call_id string, parent_id string, name string, arguments string, level int, content string", "call_id string, content string, name string"
SCHEMAS = [("add", "a", "number", True), ("add", "b", "number", True), ("add", "note", "string", False), ("list", "items", "array", True), ("flag", "on", "boolean", True), ("obj", "o", "object", True), ("int", "n", "integer", True)]


def link(spark, calls, results):
    schemas = spark.createDataFrame(SCHEMAS, "name string, argument string, type string, required boolean")
    rows = tool_calls.link_tool_calls(spark.createDataFrame([(*c, 9, "z") for c in calls], CALLS), spark.createDataFrame([(*r, "z") for r in results], RESULTS), schemas)
    return rows.collect()


def test_links_and_levels(spark):
    chain = [("c0", None, "add", "{}")] + [(f"c{k}", f"c{k - 1}", "add", "{}") for k in range(1, 37)]
    loop = [("x", "y", "add", "{}"), ("y", "x", "add", "{}"), ("z", "y", "add", "{}"), ("self", "self", "add", "{}")]
    other = [("lone", "nobody", "add", "{}"), (None, "c0", "add", "{}"), ("twice", None, "add", "{}"), ("twice", "c1", "add", "{}")]
    got = link(spark, chain + loop + other, [("c1", "r"), ("c1", "q"), ("c2", None), ("ghost", "g"), (None, "n")])
    by = {r.call_id: r for r in got}
    assert [by[f"c{k}"].level for k in range(37)] == list(range(37))
    assert [by[k].level for k in ("x", "y", "z", "self", "lone", None)] == [None, None, None, None, 0, 0]
    assert by["c1"].n_results == 2 and by["c1"].linked and json.loads(by["c1"].json)["result"] == "q"
    assert by["c2"].linked and json.loads(by["c2"].json)["result"] is None and not by["c3"].linked
    assert by["ghost"].errors == ["no call"] and by["ghost"].name is None and by["ghost"].level is None
    assert sum(r.call_id == "twice" for r in got) == 2 and len(got) == 46
    assert link(spark, [], []) == []


@pytest.mark.parametrize(
    ("name", "arguments", "errors"),
    [
        ("add", '{"a":1,"b":2.5}', []), ("add", '{"b":1}', ["missing a"]), ("add", '{"a":"1","b":null,"x":1}', ["type a", "type b", "unknown x"]), ("list", '{"items":[1,"a"]}', []), ("list", '{"items":{}}', ["type items"]), ("flag", '{"on":true}', []), ("obj", '{"o":{"k":1}}', []),
        ("int", '{"n":1}', []), ("int", '{"n":1.5}', ["type n"]), ("nope", "{}", ["unknown tool"]), (None, "{}", ["unknown tool"]), ("add", None, ["not an object"]), ("add", "[1]", ["not an object"]), ("add", "{oops", ["not an object"]),
    ],
)
def test_validation(spark, name, arguments, errors):
    assert link(spark, [("c", None, name, arguments)], [])[0].errors == errors


def test_canonical_json(spark):
    text = 'a"\\\n\t\u0001é/\U0001f600'
    raw = json.dumps({"note": text, "b": 1.50, "a": [True, None, {"z": 1, "y": 2}]}, indent=2)
    got = link(spark, [("c", None, "add", raw)], [("c", text)])[0].json
    parsed = json.loads(got)
    assert parsed == {"arguments": {"a": [True, None, {"y": 2, "z": 1}], "b": 1.5, "note": text}, "call_id": "c", "level": 0, "name": "add", "parent_id": None, "result": text}
    assert got.startswith('{"arguments":{"a":[true,null,{"y":2,"z":1}],"b":1.5,"note":"') and "\n" not in got and "é/" in got


TURNS = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo"), (1, 3, "user", "so"), (2, 0, "user", "a"), (2, 1, "tool", 'b"'), (2, 2, None, None), (None, 3, "assistant", "c"), (3, None, "assistant", "d"), (None, 0, "user", "e"), (None, 4, "system", "f")]
MORE = [(4, 0, "user", None), (4, 1, "assistant", "z"), (4, 1, "assistant", None), (4, 1, "assistant", 'q"'), (4, 2, "user", "x"), (4, 2, "user", "y"), (4, 4, "user", "w"), (5, 3, "assistant", "p"), (5, 3, "assistant", "o"), (6, None, "user", "v"), (None, None, None, None)]


@pytest.mark.parametrize("rows", [None, TURNS, TURNS + MORE, TURNS + MORE * 2, []])
def test_sql_gives_the_same_rows(spark, rows, tmp_path):
    path = SF
    if rows is not None:
        path = str(tmp_path)
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet{'' if rows is None else '/*.parquet'}'")
    got, want = tool_calls.op10_tool_call_linking(spark, path).toPandas(), con.execute(registry.ORACLE_SQL["op10_tool_call_linking"]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) and (rows == [] or len(got))

    def plain(df):
        return sorted(str([None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in r]) for r in df[sorted(got.columns)].astype(object).itertuples(index=False))

    assert plain(got) == plain(want)


def test_only_dataframe_operations(spark):
    plan = tool_calls.op10_tool_call_linking(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ShuffledHashJoin" in plan and "NestedLoop" not in plan


def test_all_results_of_a_call_are_in_the_json(spark):
    got = {r.call_id: r for r in link(spark, [("c", None, "add", "{}"), ("d", None, "add", "{}")], [("c", "r"), ("c", None), ("c", "q"), ("d", "x"), ("ghost", "b"), ("ghost", "a")])}
    assert json.loads(got["c"].json)["results"] == [None, "q", "r"] and json.loads(got["ghost"].json)["results"] == ["a", "b"]
    assert "results" not in json.loads(got["d"].json)


def test_every_turn(spark):
    turns = TURNS
    rows = tool_calls.every_turn(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), tool_calls._schemas(spark)).collect()
    assert len(rows) == len(turns) - 1  # one result links
    made = [json.loads(r.json) for r in rows]
    assert sorted((m["call_id"] or "", m["arguments"].get("role", ""), m["arguments"].get("text", "")) for m in made if m["name"] == "message") == [("", "system", "f"), ("1:0", "system", "be brief"), ("2:1", "tool", 'b"'), ("2:2", "", "")]
    assert {m["call_id"]: m["arguments"]["first"] for m in made if m["name"] == "ask"} == {"1:1": True, "1:3": False, "2:0": True, None: False}
    assert sorted(m["result"] for m in made if m["name"] is None) == ["c", "d"] and [r.errors for r in rows if r.name is None] == [["no call"]] * 2
    assert [(r.call_id, json.loads(r.json)["result"]) for r in rows if r.linked] == [("1:1", "yo")]


def test_every_turn_of_the_table_is_in_the_query(spark):
    got = tool_calls.op10_tool_call_linking(spark, SF).toPandas()
    turns = spark.read.parquet(f"{SF}/conversations.parquet").toPandas()
    assert (got.name == "message").sum() == (~turns.role.isin(["user", "assistant"])).sum() > 0
    assert (got.name == "ask").sum() == (turns.role == "user").sum() and got.n_results.sum() == (turns.role == "assistant").sum()
