"""Tools and generators as functions of SQL.

A tool has a signature (arguments with a kind, perhaps allowed values) and a
body, which is an SQL expression over its arguments. ``install`` makes two
temporary SQL functions of all of them, so that Catalyst sees through a call and
no Python runs:

    tool_fault(name, arguments)  why a call is outside its tool's domain, or null
    call_tool(name, arguments)   struct<ok, result, error_type, error>

``supervised`` is a table function: from the turns of conversations to one row
per assistant turn. Its ``analyze`` names the columns by which it must be
partitioned and ordered, so a caller cannot forget them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

ENVELOPE = "STRUCT<ok BOOLEAN, result STRING, error_type STRING, error STRING>"
KINDS = {"string": "STRING", "bigint": "BIGINT", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class Argument:
    """kind: string, bigint, boolean or object. ``among``: allowed values. ``needed_if``: (argument, value) that makes it required."""

    kind: str
    among: tuple[str, ...] = ()
    required: bool = True
    needed_if: tuple[str, str] | None = None


@dataclass(frozen=True)
class Tool:
    """``body``: SQL over the arguments' names; null is a failure with ``failure`` as its error type."""

    arguments: dict[str, Argument]
    body: str = "NULL"
    failure: str = "ValueError"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _part(name: str) -> str:
    return f"try_variant_get(try_parse_json(arguments), {_text(f'$.{name}')}, 'variant')"


def _fault(tool: Tool) -> str:
    """The first rule that the arguments break."""
    cases = []
    known = ", ".join(map(_text, tool.arguments)) or "''"
    extra = f"array_sort(array_except(map_keys(try_variant_get(try_parse_json(arguments), '$', 'map<string,variant>')), array({known})))"
    cases.append(f"WHEN size({extra}) > 0 THEN concat('unknown argument ', array_join({extra}, ', '))")
    for name, a in tool.arguments.items():
        there = f"({_part(name)} IS NOT NULL)"
        kind = f"startswith(schema_of_variant({_part(name)}), {_text('OBJECT' if a.kind == 'object' else KINDS[a.kind])})"
        if a.required:
            cases.append(f"WHEN NOT {there} THEN {_text(f'missing argument {name}')}")
        if a.needed_if:
            other, value = a.needed_if
            cases.append(f"WHEN NOT {there} AND try_variant_get(try_parse_json(arguments), {_text(f'$.{other}')}, 'string') = {_text(value)} THEN {_text(f'missing argument {name}')}")
        cases.append(f"WHEN {there} AND NOT {kind} THEN {_text(f'{name} is no {a.kind}')}")
        if a.among:
            cases.append(f"WHEN {there} AND try_variant_get(try_parse_json(arguments), {_text(f'$.{name}')}, 'string') NOT IN ({', '.join(map(_text, a.among))}) THEN {_text(f'{name} is none of its values')}")
    return f"CASE {' '.join(cases)} END"


def install(spark: SparkSession, tools: dict[str, Tool]) -> None:
    """Define tool_fault and call_tool in the session; a later call replaces them. An argument text that is no JSON object has a fault of its own."""
    faults = " ".join(f"WHEN {_text(n)} THEN {_fault(t)}" for n, t in tools.items())
    is_object = "coalesce(startswith(schema_of_variant(try_parse_json(arguments)), 'OBJECT'), false)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION tool_fault(name STRING, arguments STRING) RETURNS STRING RETURN
        CASE WHEN name IS NULL OR name NOT IN ({', '.join(map(_text, tools))}) THEN concat('no tool ', coalesce(name, 'null')) WHEN NOT {is_object} THEN 'arguments are no object' ELSE CASE name {faults} END END""")

    def run(tool: Tool) -> str:
        given = ", ".join(f"try_variant_get(try_parse_json(arguments), {_text(f'$.{n}')}, {_text(a.kind if a.kind != 'object' else 'variant')}) AS {n}" for n, a in tool.arguments.items()) or "1 AS none"
        return f"(SELECT CAST({tool.body} AS STRING) FROM (SELECT {given}))"

    bodies = " ".join(f"WHEN {_text(n)} THEN {run(t)}" for n, t in tools.items())
    failures = " ".join(f"WHEN {_text(n)} THEN {_text(t.failure)}" for n, t in tools.items())
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION tool_value(name STRING, arguments STRING) RETURNS STRING RETURN CASE name {bodies} END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION tool_envelope(name STRING, fault STRING, value STRING) RETURNS {ENVELOPE} RETURN
        CASE WHEN fault IS NOT NULL THEN named_struct('ok', false, 'result', CAST(NULL AS STRING), 'error_type', CASE WHEN startswith(fault, 'no tool ') THEN 'unknown_tool' ELSE 'invalid_arguments' END, 'error', fault)
        WHEN value IS NULL THEN named_struct('ok', false, 'result', CAST(NULL AS STRING), 'error_type', CASE name {failures} END, 'error', concat(name, ' failed'))
        ELSE named_struct('ok', true, 'result', value, 'error_type', CAST(NULL AS STRING), 'error', CAST(NULL AS STRING)) END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION call_tool(name STRING, arguments STRING) RETURNS {ENVELOPE} RETURN
        tool_envelope(name, tool_fault(name, arguments), CASE WHEN tool_fault(name, arguments) IS NULL THEN tool_value(name, arguments) END)""")


class Supervised:
    """supervised(TABLE(turns), case, order): per assistant turn the characters that stand before it (masked) and its own (learned)."""

    @staticmethod
    def analyze(turns: AnalyzeArgument, case: AnalyzeArgument, order: AnalyzeArgument) -> AnalyzeResult:
        if not turns.isTable:
            raise ValueError("the first argument is a table")
        names = {f.name: f.dataType for f in turns.dataType.fields}
        for name in (case.value, order.value, "role", "text"):
            if name not in names:
                raise ValueError(f"the table has no column {name}")
        schema = T.StructType([T.StructField(case.value, names[case.value]), T.StructField(order.value, names[order.value]), T.StructField("prefix", T.LongType()), T.StructField("target", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(case.value)], orderBy=[OrderingColumn(order.value)])

    def __init__(self) -> None:
        self.before = 0

    def eval(self, turn: Row, case: str, order: str) -> Iterator[tuple]:
        own = len(turn["text"] or "")
        if turn["role"] == "assistant":
            yield turn[case], turn[order], self.before, own
        self.before += own


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    spark.udtf.register("supervised", udtf(Supervised))
