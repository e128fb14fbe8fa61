import json

from trajframe.llm import tool_calls as tc

SCHEMA = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}, "c": {"enum": ["x", None]}}, "required": ["a"], "additionalProperties": False}


def run(spark, calls, results):
    c = spark.createDataFrame([(*r, "z") for r in calls], "conv_id long, turn long, call_id string, name string, arguments string, record string")
    r = spark.createDataFrame([(*x, "z") for x in results], "conv_id long, turn long, call_id string, content string, part string")
    t = spark.createDataFrame([("t", json.dumps(SCHEMA)), ("free", "{}")], "name string, schema string")
    return tc.link_tool_calls(c, r, t).collect()


def test_faults():
    assert tc.faults({"a": 1, "b": ["s"], "c": None}, SCHEMA) == []
    assert tc.faults({"b": [1], "c": "y", "d": 0}, SCHEMA) == ["$.a: missing", "$.d: unknown", "$.b[0]: not string", "$.c: not in enum"]
    assert tc.faults({"a": True}, SCHEMA) == ["$.a: not integer"] and tc.faults({"a": 2.0}, SCHEMA) == [] and tc.faults([], SCHEMA) == ["$: not object"]


def test_links_order_and_records(spark):
    ref = lambda x: json.dumps({"a": 1, "b": ["$result:" + x]})
    calls = [(1, 1, "p", "t", ref("r")), (1, 3, "q", "t", ref("p")), (1, 5, "r", "t", '{"c":null, "a" : 1}'),       # p waits for r, a later call
             (2, 1, "p", "t", ref("q")), (2, 2, "q", "t", ref("p")), (2, 3, "s", "free", ref("q")), (2, 4, "u", "free", '"é\\n"'),   # a cycle and what follows
             (3, 1, "p", "nope", "{}"), (3, 2, "q", "t", None), (3, 3, "r", "t", "{"), (3, 4, "s", "free", ref("gone")), (3, 5, "s", "free", "{}"), (3, 6, "v", "free", "[NaN]"),
             (None, 1, "p", "t", "{}"), (4, None, "p", "t", "{}"), (4, 1, None, "t", "{}"), (4, 2000, "late", "free", "1"), (4, 2, "early", None, "{}")]
    results = [(1, 2, "p", "two"), (1, 9, "p", "nine"), (1, 4, "q", None), (2, 9, "u", "d\té"), (9, 1, "p", "other"), (3, 7, "s", "x" * 100000)]
    got = {}
    for r in run(spark, calls, results):
        got.setdefault(r.conv_id, []).append((r.position, r.call_id, r.status, r.errors, r.record))
    one = sorted(got[1])
    assert [(x[1], x[2]) for x in one] == [("r", "no result"), ("p", "ok"), ("q", "ok")] and [x[0] for x in one] == [0, 1, 2]
    assert one[0][4] == '{"arguments":{"a":1,"c":null},"id":"r","name":"t"}'
    assert one[1][4].endswith(',"name":"t","result":"two"}') and one[2][4].endswith('"result":null}')
    assert [(x[1], x[2]) for x in sorted(got[2])] == [("u", "ok"), ("p", "cycle"), ("q", "cycle"), ("s", "cycle")]
    assert sorted(got[2])[0][4] == '{"arguments":"é\\n","id":"u","name":"free","result":"d\\té"}'
    three = {(x[1], x[2]): x for x in got[3]}
    assert set(three) == {("p", "unknown tool"), ("q", "invalid"), ("r", "invalid"), ("s", "invalid"), ("s", "duplicate"), ("v", "invalid")}
    assert three[("s", "invalid")][3] == "no call gone" and three[("r", "invalid")][3] == "$: not JSON"
    assert [(x[1], x[2]) for x in sorted(got[4])] == [("early", "unknown tool"), ("late", "no result")] and set(got) == {1, 2, 3, 4}


def test_empty(spark):
    assert run(spark, [(None, 1, "p", "t", "{}")], [(1, 1, "p", "x")]) == []
