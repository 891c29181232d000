"""Can a case be passed at all? Its own calls are run on a fresh application machine (O-gen, K1, K3).

A case states its environment, the calls that solve it and the criteria of
success. The calls are run in turn; what then contradicts the case is named, one
text per contradiction: ``call:<place>`` for a call that is refused although no
planned fault is spent on it, ``fault:<operation>:<target>`` for a planned fault
that no call spends, ``state:<field>`` for a field of the required final state,
and ``result:<place>`` for a required result that no successful call returned.
A case that nothing contradicts is satisfiable.

Defined results: a case that is no JSON object, or lacks calls or criteria, has
the only contradiction ``unreadable``; a null case as well; repeated rows are
judged alike; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.jsonx import MISSING, equal, loads
from tracemill.operators.machines import AppMachine
from tracemill.operators.scoring import result_found
from tracemill.operators.trace import Call, Execution

UNREADABLE = ["unreadable"]


def _answers(machine: AppMachine, calls: list[dict], extra: dict[str, Callable[..., Any]]) -> Iterator[tuple[dict, bool]]:
    """Of each call, what the machine returns, and whether a planned fault was spent on it."""
    left = sum(f["times"] for f in machine.faults)
    for call in calls:
        found = {"ok": True, "result": extra[call["name"]](**call["arguments"])} if call["name"] in extra else machine.run(call)
        before, left = left, sum(f["times"] for f in machine.faults)
        yield found, left < before


def contradictions(case: Any, extra: dict[str, Callable[..., Any]] | None = None) -> list[str]:
    """What contradicts a case; ``extra`` has the tools that the machine lacks (a search, say) by name."""
    try:
        machine, calls, rules = AppMachine(case["environment"]), case["required_calls"], case["success_criteria"]
        answers = list(_answers(machine, calls, extra or {}))
        ran = [Execution(i, 0, Call(c["name"], c.get("arguments")), a) for i, (c, (a, _)) in enumerate(zip(calls, answers, strict=True))]
        end = machine.state
        return [
            *(f"call:{i}" for i, (a, planned) in enumerate(answers) if not (a["ok"] or planned)),
            *(f"fault:{f['operation']}:{f['target']}" for f in machine.faults if f["times"] > 0),
            *(f"state:{k}" for k, v in rules.get("final_state", {}).items() if not equal(v, end.get(k, MISSING))),
            *(f"result:{i}" for i, rule in enumerate(rules.get("required_tool_results", [])) if not result_found(rule, ran)),
        ]
    except (AttributeError, KeyError, TypeError):
        return UNREADABLE


def satisfiability(cases: DataFrame, *, id_col: str = "id", case_col: str = "case", extra: dict[str, Callable[..., Any]] | None = None) -> DataFrame:
    """id, satisfiable and contradictions of each case (JSON text); without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [contradictions(loads(c), extra) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([not f for f in found], pa.bool_()), pa.array(found, pa.list_(pa.string()))], names=[id_col, "satisfiable", "contradictions"])

    kind = cases.schema[id_col].dataType.simpleString()
    return cases.select(F.col(id_col), F.col(case_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, satisfiable boolean, contradictions array<string>")
