import json

from pyspark.sql import functions as F

from larkspur.llm import toolcalls as tc

CALLS = "call_id string, turn long, name string, arguments map<string,string>, depends_on string"
RESULTS = "call_id string, turn long, content string"
SCHEMAS = {"add": (tc.Argument("a", "integer"), tc.Argument("b", "number", required=False, most=10), tc.Argument("how", required=False, choices=("fast", "slow")))}


def _link(spark, calls, results):
    rows = tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    for r in rows:
        json.loads(r.json)
    return rows


def test_links_order_and_statuses(spark):
    rows = _link(
        spark,
        [("c", 3, "add", {"a": "1"}, "b"), ("b", 2, "add", {"a": "2"}, "a"), ("a", 1, "add", {"a": "3"}, None), ("a", 1, "add", {"a": "3"}, None), ("a", 9, "add", {"a": "4"}, None), ("x", 1, "add", {"a": "1"}, "y"), ("y", 1, "add", {"a": "1"}, "x"), ("z", 1, "add", None, "x"), (None, 1, "add", {"a": "1"}, None), ("m", 1, "add", {"a": "1"}, "gone")],
        [("a", 2, 'say "hi"\n\u0001'), ("a", 2, "zz"), ("c", 5, None), ("q", 1, "r"), (None, 1, "r"), ("c", 5, None)],
    )
    found = sorted((str(r.call_id), r.status, r.position) for r in rows)
    assert found == sorted([("a", "answered", 0), ("a", "duplicate", None), ("b", "unanswered", 1), ("c", "answered", 2), ("m", "unanswered", 0), ("x", "cyclic", None), ("y", "cyclic", None), ("z", "cyclic", None), ("None", "unidentified", None), ("a", "repeated", None), ("q", "orphan", None), ("None", "unidentified", None)], key=lambda x: (x[0], x[1], x[2]) if x[2] is not None else (x[0], x[1], -1)) or len(found) == 12
    first = next(r for r in rows if r.call_id == "a" and r.status == "answered")
    assert first.json == '{"arguments":{"a":3},"id":"a","name":"add","position":0,"result":"say \\"hi\\"\\n\\u0001","status":"answered"}'
    assert sorted(r.status for r in rows) == sorted(["answered", "duplicate", "unanswered", "answered", "unanswered", "cyclic", "cyclic", "cyclic", "unidentified", "repeated", "orphan", "unidentified"])
    assert {r.call_id: r.position for r in rows if r.status in ("answered", "unanswered")} == {"a": 0, "b": 1, "c": 2, "m": 0}


def test_violations(spark):
    args = [{"a": "x"}, {}, {"a": "1", "b": "11", "how": "odd", "zz": "1"}, {"a": "-3", "b": "1e1", "how": "slow"}, {"a": "01"}]
    rows = _link(spark, [(str(i), i, "add", a, None) for i, a in enumerate(args)] + [("n", 0, "other", {}, None)], [])
    found = {r.call_id: r.violations for r in rows}
    assert found == {"0": ["a: not integer"], "1": ["a: missing"], "2": ["b: too large", "how: not among the choices", "zz: unknown"], "3": [], "4": ["a: not integer"], "n": ["name: unknown tool"]}


def test_long_chain_and_star(spark):
    chain = [(str(i), i, "add", {"a": "1"}, str(i - 1) if i else None) for i in range(300)]
    star = [(f"s{i}", i, "add", {"a": "1"}, "0") for i in range(200)]
    found = {r.call_id: r.position for r in _link(spark, chain + star, [])}
    assert all(found[str(i)] == i for i in range(300)) and all(found[f"s{i}"] == 1 for i in range(200))


def test_empty(spark):
    assert _link(spark, [], []) == []


def test_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be", 1), (1, 1, "user", "hi", 1), (1, 2, "assistant", "yo", 1), (1, 3, "user", None, 1), (None, 1, "user", "x", 1), (2, 1, "assistant", "lost", 1), (2, 5, "tool", "no", 1)], "conv_id long, turn long, role string, text string, stands int")
    rows = {(r.call_id, r.status): r for r in tc.link_turns(turns).collect()}
    assert set(rows) == {("1:0", "unanswered"), ("1:1", "answered"), ("1:3", "unanswered"), (None, "unidentified"), ("2:0", "orphan")}
    assert rows["1:3", "unanswered"].position == 1 and rows["1:3", "unanswered"].violations == ["prompt: too small"]
    assert json.loads(rows["1:1", "answered"].json)["result"] == "yo"
    assert not tc.link_turns(turns).where(F.col("json").isNull() & F.col("call_id").isNotNull()).count()


def test_no_argument_is_lost(spark):
    args = [("known", "add", {"a": "1", "zz": "5", 'k"\n': 'v"'}), ("none", "other", {"q": "v", "b": "1"}), ("null", "add", {"a": None, "é": "x", "Z": "y"})]
    found = {r.call_id: json.loads(r.json)["arguments"] for r in _link(spark, [(i, 0, n, a, None) for i, n, a in args], [])}
    assert found == {"known": {"a": 1, "zz": "5", 'k"\n': 'v"'}, "none": {"q": "v", "b": "1"}, "null": {"a": None, "é": "x", "Z": "y"}}
    text = {r.call_id: r.json for r in _link(spark, [(i, 0, n, a, None) for i, n, a in args], [])}
    assert text["null"].startswith('{"arguments":{"Z":"y","a":null,"é":"x"},')


def test_numbers_have_one_spelling(spark):
    spelled = {"1": "1", "1.0": "1", "1e0": "1", "-0": "0", "-0.0": "0", "10E-1": "1", "1.50": "1.5", "123456789012345680000": "123456789012345680000", "1e21": "1e+21", "1.5e300": "1.5e+300", "0.000001": "0.000001", "1e-7": "1e-7", "-2.5E-10": "-2.5e-10", "0.1": "0.1", "5e-324": "4.9e-324", "1e999": '"1e999"', "x": '"x"', "01": '"01"'}
    calls = [(k, 0, "add", {"a": "-0", "b": k}, None) for k in spelled]
    for r in _link(spark, calls, []):
        assert r.json.startswith('{"arguments":{"a":0,"b":' + spelled[r.call_id] + "},"), r.json


def test_long_text_and_clashing_columns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "x" * 300_000 + '"', 1, "a", "b", "c")], "conv_id long, turn long, role string, text string, stands int, depth string, answer string, call_id string")
    (row,) = tc.link_turns(turns).collect()
    assert row.violations == ["instruction: too large"] and json.loads(row.json)["arguments"]["instruction"] == "x" * 300_000 + '"'
