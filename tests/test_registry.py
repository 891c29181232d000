import pytest

from tracemill.functions import registry
from tracemill.functions.registry import Argument, Tool

TOOLS = {
    "look": Tool({}, "'seen'"),
    "go": Tool({"page": Argument("string", ("home", "it's"))}, "upper(page)"),
    "set": Tool({"action": Argument("string", ("set", "back")), "value": Argument("string", ("high", "low"), required=False, needed_if=("action", "set"))}, "concat(action, coalesce(value, ''))"),
    "ratio": Tool({"a": Argument("bigint"), "b": Argument("bigint")}, "try_divide(a, b)", "ZeroDivisionError"),
    "check": Tool({"expected": Argument("object"), "flag": Argument("boolean", required=False)}, "to_json(expected)"),
}

CALLS = [
    ("look", "{}", (True, "seen", None)), ("look", '{"x":1}', (False, None, "unknown argument x")), ("nope", "{}", (False, None, "no tool nope")), (None, "{}", (False, None, "no tool null")),
    ("go", '{"page":"it\'s"}', (True, "IT'S", None)), ("go", '{"page":"away"}', (False, None, "page is none of its values")), ("go", '{"page":1}', (False, None, "page is no string")), ("go", "{}", (False, None, "missing argument page")),
    ("go", None, (False, None, "arguments are no object")), ("go", "[1]", (False, None, "arguments are no object")), ("go", "{bad", (False, None, "arguments are no object")),
    ("set", '{"action":"set"}', (False, None, "missing argument value")), ("set", '{"action":"set","value":"mid"}', (False, None, "value is none of its values")), ("set", '{"action":"set","value":"high"}', (True, "sethigh", None)), ("set", '{"action":"back"}', (True, "back", None)),
    ("ratio", '{"a":1,"b":2}', (True, "0.5", None)), ("ratio", '{"a":1,"b":0}', (False, None, "ratio failed")), ("ratio", '{"a":1,"b":true}', (False, None, "b is no bigint")),
    ("check", '{"expected":{"b":1,"a":2}}', (True, '{"a":2,"b":1}', None)), ("check", '{"expected":"x"}', (False, None, "expected is no object")), ("check", '{"z":1,"expected":{},"y":2}', (False, None, "unknown argument y, z")),
]


def test_calls_through_sql(spark):
    registry.install(spark, TOOLS)
    spark.createDataFrame([(n, a, *w) for n, a, w in CALLS], "name string, arguments string, ok boolean, result string, error string").createOrReplaceTempView("calls_to_try")
    rows = spark.sql("SELECT name, arguments, ok, result, error, call_tool(name, arguments) AS r, tool_fault(name, arguments) AS fault FROM calls_to_try").collect()
    for r in rows:
        assert (r.r.ok, r.r.result, r.r.error) == (r.ok, r.result, r.error)
        assert r.r.error_type == (None if r.ok else "unknown_tool" if r.error.startswith("no tool") else "ZeroDivisionError" if r.error == "ratio failed" else "invalid_arguments")
        assert (r.fault is None) == (r.ok or r.error == "ratio failed")
    plan = spark.sql("SELECT call_tool(name, arguments) FROM calls_to_try")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_supervised_turns(spark):
    registry.register(spark)
    turns = [(1, 2, "assistant", "cc"), (1, 0, "user", "aaa"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (2, 1, "system", "yy"), (2, 2, "assistant", "z")]
    spark.createDataFrame(turns, "c int, t int, role string, text string").repartition(3).createOrReplaceTempView("turns_to_try")
    got = spark.sql("SELECT * FROM supervised(TABLE(turns_to_try), 'c', 't')").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3, 0), (1, 2, 3, 2), (2, 0, 0, 1), (2, 2, 3, 1)]
    with pytest.raises(Exception, match="no column when"):
        spark.sql("SELECT * FROM supervised(TABLE(turns_to_try), 'c', 'when')").collect()


def test_callbacks(spark):
    from pyspark.sql import functions as F

    from tracemill.operators import callbacks

    texts = ['<tool_call>{"name":"a","arguments":{"k":1}}</tool_call> <tool_call>{"tool":"b"}</tool_call>', "<tool_call>{bad</tool_call>", "none", None, '<tool_call> {"name":"c","args":[1]} </tool_call>', "<tool_call>[1]</tool_call>"]
    turns = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    calls = callbacks.generated(turns, lambda t: F.concat(t, F.lit("!")))
    assert sorted((r.id, r.place, r.valid, r.name, r.arguments) for r in calls.collect()) == [(0, 0, True, "a", '{"k":1}'), (0, 1, True, "b", "{}"), (1, 0, False, None, None), (4, 0, True, "c", "[1]"), (5, 0, True, None, "{}")]
    envelope = lambda name, arguments: F.struct((name == "a").alias("ok"), arguments.alias("result"), F.when(name.isNull(), "unknown_tool").alias("error_type"), F.lit(None).cast("string").alias("error"))
    got = {(r.id, r.place): (r.ok, r.result, r.error_type) for r in callbacks.executed(calls, envelope).collect()}
    assert got == {(0, 0): (True, '{"k":1}', None), (0, 1): (False, "{}", None), (1, 0): (False, None, "invalid_call"), (4, 0): (False, "[1]", None), (5, 0): (None, "{}", "unknown_tool")}
