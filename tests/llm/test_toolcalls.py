import json

from cloudloom.llm import toolcalls


def test_order_and_cycles():
    call = lambda i, turn, uses=(): {"id": i, "turn": turn, "uses": list(uses)}
    order, late = toolcalls.ordered([call("c", 1, "a"), call("a", 3), call("b", 2, "c"), call("z", 0, ["gone"]), call("x", 0, "y"), call("y", 0, "x")])
    assert [c["id"] for c in order] == ["z", "a", "c", "b", "x", "y"] and late == 2


def test_validation():
    schema = toolcalls.SCHEMAS["lookup"]
    good = json.dumps({"query": "q", "turn": 1})
    bad = [None, "", "[1]", "{", json.dumps({"query": "q"}), json.dumps({"query": "", "turn": 1}), json.dumps({"query": "q", "turn": True}), json.dumps({"query": "q" * 121, "turn": 1}), json.dumps({"query": "q", "turn": 1, "more": 2}), json.dumps({"query": "q", "turn": -1}), json.dumps({"query": 3, "turn": 1})]
    assert toolcalls.valid(good, schema) and not toolcalls.valid(good, None)
    assert not any(toolcalls.valid(x, schema) for x in bad)


def test_links_of_odd_rows(spark):
    calls = [(1, "a", 0, "lookup", '{"turn":1,"query":"é\\n"}', []), (1, "a", 0, "lookup", '{"turn":1,"query":"é\\n"}', []), (1, "b", 2, "none", "not json", ["a"]), (1, None, 3, "lookup", "{}", None), (None, "q", 3, "lookup", "{}", None), (2, "x", None, "lookup", None, None), (3, "big", 1, "search", json.dumps({"query": "long " * 50_000, "turn": 1}), None)]
    results = [(1, "a", 1, "first"), (1, "a", 5, "second"), (1, "lost", 2, "alone"), (4, "o2", 1, None), (4, "o1", 1, "r"), (2, None, 1, "r")]
    c = spark.createDataFrame([(*r, 1) for r in calls], "conversation long, id string, turn int, name string, arguments string, uses array<string>, json int")
    r = spark.createDataFrame(results, "conversation long, id string, turn int, content string")
    got = {x.conversation: x for x in toolcalls.link(c, r, toolcalls.SCHEMAS).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert (one.n_calls, one.n_linked, one.n_orphans, one.n_invalid, one.call_order) == (2, 1, 1, 1, ["a", "b"])
    assert one.json == '{"calls":[{"arguments":{"query":"é\\n","turn":1},"id":"a","name":"lookup","result":"first","valid":true},{"arguments":"not json","id":"b","name":"none","result":null,"valid":false}],"orphans":["lost"]}'
    assert json.loads(got[4].json)["orphans"] == ["o1", "o2"] and got[2].n_invalid == 1 and got[3].n_invalid == 0
    assert toolcalls.link(c.limit(0), r.limit(0), toolcalls.SCHEMAS).count() == 0


def test_arguments_that_json_cannot_hold(spark):
    deep, half = "[" * 100_000 + "]" * 100_000, '{"query":"\\ud800","turn":1}'
    calls = [("c", "deep", 1, "search", deep, None), ("c", "half", 2, "search", half, None), ("c", "nan", 3, "search", '{"query":"q","turn":NaN}', None), ("c", "inf", 4, "search", '{"query":"q","turn":1e999}', None), ("c", "pair", 5, "search", '{"query":"\\ud83d\\ude00","turn":1}', ["nan", "later"]), ("c", "later", 6, "search", '{"turn":1,"query":"q"}', ["pair", "deep"])]
    c = spark.createDataFrame(calls, "conversation string, id string, turn int, name string, arguments string, uses array<string>")
    r = spark.createDataFrame([("c", "deep", 9, "x")], "conversation string, id string, turn int, content string")
    row = toolcalls.link(c, r, toolcalls.SCHEMAS).first()
    assert (row.n_calls, row.n_linked, row.n_invalid) == (6, 1, 3)
    listed = {x["id"]: x for x in json.loads(row.json, parse_constant=lambda name: 1 / 0)["calls"]}
    assert listed["deep"]["arguments"] == deep and listed["nan"]["arguments"] == calls[2][4] and listed["half"]["arguments"]["query"] == "\ud800"
    assert listed["pair"]["arguments"]["query"] == "😀" and "\\ud800" in row.json
    assert row.call_order == ["deep", "half", "nan", "inf", "pair", "later"] and listed["pair"]["cyclic"] and listed["later"]["cyclic"]
