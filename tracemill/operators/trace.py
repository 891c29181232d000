"""Trajectory normalisation (C2-C9): from a permissive result record to attempts and executions.

The same rules serve the record scorer, row by row in Arrow batches, and
``event_tables``, which turns a table of records into the two event tables that
the DataFrame operators use. A malformed shape becomes empty, never an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.jsonx import MISSING, dumps, loads

_MARKER = re.compile(r"</?tool_call(?=\s|>|$)", re.IGNORECASE)


@dataclass(frozen=True)
class Call:
    name: str
    arguments: Any

    @cached_property
    def signature(self) -> tuple[str, str]:
        return self.name, dumps(self.arguments)


@dataclass(frozen=True)
class Attempt:
    step: int
    index: int
    valid: bool
    call: Call | None
    marker: bool = False


@dataclass(frozen=True)
class Execution:
    step: int
    index: int
    call: Call | None
    envelope: Any

    @property
    def name(self) -> str | None:
        return self.call.name if self.call else None

    @property
    def ok(self) -> bool:
        """An explicit ok, else an error, else a boolean success, else any value."""
        e = self.envelope
        if not isinstance(e, dict):
            return e is not None
        if "ok" in e:
            return e["ok"] is True
        if e.get("error") is not None or e.get("error_type"):
            return False
        return e["success"] if isinstance(e.get("success"), bool) else True

    @property
    def payload(self) -> Any:
        e = self.envelope
        return e["result"] if isinstance(e, dict) and "ok" in e and "result" in e else e

    def said(self, *keys: str) -> str:
        """C11: the first of the keys in the envelope, as text."""
        found = _first(self.envelope, keys)
        return "" if found is MISSING else str(found)


def _first(value: Any, keys: Iterable[str]) -> Any:
    """The value of the first key that is present, even if it is null."""
    return next((value[k] for k in keys if k in value), MISSING) if isinstance(value, dict) else MISSING


def _listed(value: Any) -> list:
    return [] if value is None or value is MISSING else value if isinstance(value, list) else [value]


def as_call(item: Any) -> Call | None:
    """A call, bare or wrapped, its arguments parsed if they are JSON text."""
    item = loads(item)
    inner = _first(item, ("tool_call", "call"))
    body = loads(item if inner is MISSING else inner)
    name, arguments = _first(body, ("name", "tool")), _first(body, ("arguments", "args"))
    if not isinstance(name, str) or not name:
        return None
    return Call(name, {} if arguments is MISSING else loads(arguments))


def is_valid(item: Any) -> bool:
    """A named call that no explicit flag denies."""
    return as_call(item) is not None and (not isinstance(item, dict) or item.get("valid", True) is True)


def _calls_of(step: Any) -> list:
    found = _first(step, ("parsed_tool_calls", "tool_calls", "calls"))
    if found is not MISSING:
        return _listed(found)
    single = _first(step, ("tool_call", "call"))
    return [] if single is MISSING else [single]


def _results_of(step: Any) -> list:
    found = _first(step, ("tool_results", "results"))
    if found is not MISSING:
        return _listed(found)
    call, result = _first(step, ("tool_call", "call")), _first(step, ("tool_result", "result"))
    return [] if MISSING in (call, result) else [{"tool_call": call, "result": result}]


def _steps(result: Any) -> list:
    found = _first(result, ("trajectory",))
    return found if isinstance(found, list) else []


def _marked(value: Any) -> bool:
    return isinstance(value, str) and _MARKER.search(value) is not None


def _attempts_of(items: list, step: int) -> list[Attempt]:
    return [Attempt(step, i, is_valid(x), as_call(x)) for i, x in enumerate(items)]


def attempts(result: Any) -> list[Attempt]:
    """Attempts of every step; a marker without calls is one invalid attempt, executed calls stand in for missing ones."""
    out: list[Attempt] = []
    for n, step in enumerate(_steps(result)):
        items = _calls_of(step)
        if items:
            out += _attempts_of(items, n)
        elif isinstance(step, dict) and _marked(step.get("model_output")):
            out.append(Attempt(n, 0, False, None, True))
        else:
            ran = [_first(r, ("tool_call", "call")) for r in _results_of(step)]
            out += _attempts_of([c for c in ran if c is not MISSING and c is not None], n)
    if out or not isinstance(result, dict):
        return out
    top = _first(result, ("parsed_tool_calls", "tool_calls"))
    out = _attempts_of(_listed(top), 0)
    return out or ([Attempt(0, 0, False, None, True)] if _marked(result.get("model_output")) else [])


def _envelope(item: Any) -> Any:
    if _first(item, ("tool_call", "call")) is not MISSING:
        inner = _first(item, ("result", "tool_result"))
        if inner is not MISSING:
            return inner
    return item


def _executions_of(items: list, step: int, calls: list[Call], bare: bool) -> list[Execution]:
    out = []
    for i, item in enumerate(items):
        own = None
        if isinstance(item, dict):
            named = _first(item, ("tool_call", "call"))
            own = as_call(None if named is MISSING else named)
            if own is None and bare and "name" in item:
                own = as_call(item)
        out.append(Execution(step, i, own or (calls[i] if i < len(calls) else None), _envelope(item)))
    return out


def executions(result: Any) -> list[Execution]:
    """Executions of every step, with their own call or the step's valid call at the same place."""
    out: list[Execution] = []
    for n, step in enumerate(_steps(result)):
        own = [as_call(x) for x in _calls_of(step) if is_valid(x)]
        out += _executions_of(_results_of(step), n, own, True)
    if out or not isinstance(result, dict):
        return out
    return _executions_of(_listed(result.get("tool_results", [])), 0, calls(result), False)


def calls(result: Any) -> list[Call]:
    """Valid, named calls in order."""
    return [a.call for a in attempts(result) if a.valid and a.call is not None]


_EVENTS = pa.schema([
    ("case_id", pa.string()), ("kind", pa.string()), ("idx", pa.int64()), ("step", pa.int64()), ("valid", pa.bool_()), ("tool", pa.string()), ("args_json", pa.string()),
    ("ok", pa.bool_()), ("error_type", pa.string()), ("error", pa.string()), ("payload_json", pa.string()),
])


def event_tables(records: DataFrame, id_col: str = "id", result_col: str = "result") -> DataFrame:
    """One row per attempt and per execution of each record (result as JSON text), told apart by kind."""
    text = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)

    def rows(case: str, result: Any) -> Iterator[tuple]:
        for i, a in enumerate(attempts(result)):
            yield case, "attempt", i, a.step, a.valid, a.call and a.call.name, a.call and dumps(a.call.arguments), None, None, None, None
        for i, e in enumerate(executions(result)):
            yield case, "execution", i, e.step, None, e.name, e.call and dumps(e.call.arguments), e.ok, e.said("error_type") or None, e.said("error", "message") or None, text(e.payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for case, result in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows(case, loads(result))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [()] * len(_EVENTS), _EVENTS, strict=True)], schema=_EVENTS)

    kinds = "case_id string, kind string, idx bigint, step bigint, valid boolean, tool string, args_json string, ok boolean, error_type string, error string, payload_json string"
    return records.select(F.col(id_col).cast("string").alias("case_id"), F.col(result_col)).mapInArrow(run, kinds)
