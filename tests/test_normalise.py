import ast
import json
import random

from tracemill.functions.jsonx import loads
from tracemill.operators import normalise, trace
from tracemill.plans import catalogue

CALL = {"name": "go", "arguments": {"b": 1, "a": [True, None, "x"]}}
RECORDS = [
    {"trajectory": [{"parsed_tool_calls": [{"valid": True, "tool_call": CALL}, {"valid": False, "tool_call": CALL}, {"valid": 1, "tool_call": CALL}, {"valid": None, "call": CALL}], "tool_results": [{"tool_call": CALL, "result": {"ok": True, "result": {"z": 1, "y": 2}}}, {"ok": False, "error": "bad", "error_type": "E"}]}]},
    {"trajectory": [{"parsed_tool_calls": None, "tool_calls": [CALL], "tool_results": [{"call": CALL, "tool_result": 5}]}]},
    {"trajectory": [{"tool_calls": CALL, "calls": [CALL, CALL]}, {"calls": json.dumps(CALL)}, {"tool_call": None, "call": CALL, "result": 1}, {"call": CALL, "tool_result": {"success": False}}]},
    {"trajectory": [{"model_output": "x <TOOL_CALL> y"}, {"model_output": "tool_call"}, {"parsed_tool_calls": [], "model_output": "</tool_call"}, None, 7, "text", [], {}]},
    {"trajectory": [{"results": [{"tool_call": CALL, "result": None}, {"call": None, "ok": True}, None, "plain", 0, {"name": "bare", "args": {"q": 1}, "ok": True}]}]},
    {"trajectory": [{"tool_calls": [{"tool": "t", "args": '{"k": "v"}'}, {"name": "", "tool": "t"}, {"name": 5}, {"name": "n", "arguments": None}, {"name": "m", "arguments": "not json"}, '{"name":"s"}', "no", None, {"tool_call": '{"name":"in"}'}]}]},
    {"trajectory": [], "tool_calls": [CALL, "x"], "tool_results": [{"ok": True, "result": 3}, {"tool_call": CALL, "result": {"error_type": ""}}, {"name": "bare"}]},
    {"trajectory": {"a": 1}, "parsed_tool_calls": CALL, "tool_results": {"message": "m", "error": None}},
    {"trajectory": [{}], "model_output": "<tool_call>", "tool_results": None}, {"trajectory": [{}], "parsed_tool_calls": None, "model_output": 5},
    {"trajectory": [{"tool_call": CALL, "result": {"ok": None, "result": 2}}, {"tool_call": CALL, "tool_result": {"ok": "true"}}, {"tool_call": CALL, "tool_result": {"error": False}}, {"tool_call": CALL, "tool_result": {"error_type": 0, "success": True}}, {"tool_call": CALL, "tool_result": {"success": "no", "message": ["a"]}}]},
    {"trajectory": [{"tool_call": CALL, "result": {"error": True, "error_type": None}}, {"tool_call": CALL, "result": {"error": "", "message": "later"}}]},
    [], 5, None, "text", {}, {"model_output": "<tool_call"},
]


def same(spark, records):
    texts = [(f"r{i}", r if isinstance(r, str) and r.startswith("{") else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)] + [("null", None), ("bad", "{bad"), ("empty", "")]
    df = spark.createDataFrame(texts, "id string, result string")
    plain = lambda r: (r["case_id"], r["kind"], r["idx"], r["step"], r["valid"], r["tool"], repr(_sorted(loads(r["args_json"]))), r["ok"], said(r["error_type"]), said(r["error"]), repr(_sorted(loads(r["payload_json"]))))
    want = sorted(map(plain, trace.event_tables(df).collect()), key=repr)
    got = sorted(map(plain, normalise.event_tables(df).collect()), key=repr)
    assert got == want
    return got


def said(text):
    """Objects and lists are told apart by value: the row version has them as Python writes them."""
    for read in (json.loads, ast.literal_eval):
        try:
            if isinstance(found := read(text or ""), (dict, list)):
                return repr(_sorted(found))
        except (ValueError, SyntaxError):
            pass
    return text


def _sorted(v):
    return {k: _sorted(v[k]) for k in sorted(v)} if isinstance(v, dict) else [_sorted(x) for x in v] if isinstance(v, list) else v


def test_odd_records_equal_the_row_version(spark):
    assert len(same(spark, RECORDS)) > 50


def test_random_records_equal_the_row_version(spark):
    rng = random.Random(9)
    keys = ["parsed_tool_calls", "tool_calls", "calls", "tool_call", "call", "tool_results", "results", "tool_result", "result", "model_output", "ok", "error", "error_type", "success", "name", "tool", "arguments", "args", "valid", "message", "trajectory"]

    def value(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([None, True, False, 0, 3, "", "x", "<tool_call>", json.dumps(CALL), CALL])
        if rng.random() < 0.35:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {k: value(depth - 1) for k in rng.sample(keys, rng.randrange(1, 5))}

    assert len(same(spark, [{"trajectory": [value(3) for _ in range(3)], **{k: value(2) for k in rng.sample(keys[:-1], 3)}} for _ in range(400)])) > 300


def test_no_python_stage(spark, sf_dir):
    plan = catalogue.QUERIES["normalised_events"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
