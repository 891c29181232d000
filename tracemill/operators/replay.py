"""Replay audits over tables (K2-K4, E18, L5, M8): one row per case in, one row of findings out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import machines

_AUDIT = pa.schema([
    ("case_id", pa.string()), ("mismatch_at", pa.int64()), ("execution_success", pa.bool_()), ("policy_violations", pa.int64()), ("answer_correct", pa.bool_()), ("task_success", pa.bool_()),
    ("tool_calls", pa.int64()), ("mutations", pa.int64()), ("outcome", pa.string()), ("revision", pa.int64()), ("tool_errors", pa.int64()), ("check_failures", pa.int64()),
])
_KINDS = {"string": "string", "int64": "bigint", "bool": "boolean"}


def packed(events: DataFrame, case: str = "case_id") -> DataFrame:
    """Long events (case, index, tool_call and result as JSON) as one ordered array per case: the only shuffle of an audit."""
    return events.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(F.col("index").cast("bigint").alias("index"), "tool_call", "result"))).alias("events"))


def audit(cases: DataFrame) -> DataFrame:
    """K4 over rows of case_id, scenario, desired, final_answer (JSON texts) and events (array of index, tool_call, result)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for case, scenario, desired, answer, events in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trace = [{"index": e["index"], "tool_call": json.loads(e["tool_call"]), "result": json.loads(e["result"])} for e in events or []]
                found = machines.judge(json.loads(scenario), json.loads(desired), trace, answer)
                rows.append(found | found.get("report", {}) | {"case_id": case})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _AUDIT], schema=_AUDIT)

    source = cases.select(F.col("case_id").cast("string"), "scenario", "desired", "final_answer", "events")
    return source.mapInArrow(run, ", ".join(f"{f.name} {_KINDS[str(f.type)]}" for f in _AUDIT))


def teacher_traces(cases: DataFrame) -> DataFrame:
    """M8: the teacher's events and answer for rows of case_id, scenario and desired (JSON texts)."""
    event = pa.struct([("index", pa.int64()), ("tool_call", pa.string()), ("result", pa.string())])
    text = lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scenarios, goals = (c.to_pylist() for c in batch.columns)
            made = [machines.teach(json.loads(s), json.loads(d)) for s, d in zip(scenarios, goals, strict=True)]
            events = [[{"index": e["index"], "tool_call": text(e["tool_call"]), "result": text(e["result"])} for e in es] for es, _ in made]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(scenarios), pa.array(goals), pa.array([text(r) for _, r in made]), pa.array(events, pa.list_(event))], names=["case_id", "scenario", "desired", "final_answer", "events"])

    kinds = "case_id string, scenario string, desired string, final_answer string, events array<struct<index:bigint,tool_call:string,result:string>>"
    return cases.select(F.col("case_id").cast("string"), "scenario", "desired").mapInArrow(run, kinds)


def shape(events) -> object:
    """The trace's shape: tool and error kind, status or 'ok' of each event, as JSON."""
    kind = lambda e: F.coalesce(F.get_json_object(e["result"], "$.error_type"), F.get_json_object(e["result"], "$.result.status"), F.lit("ok"))
    return F.to_json(F.transform(events, lambda e: F.array(F.get_json_object(e["tool_call"], "$.name"), kind(e))))


def receipts(events) -> object:
    """Receipts by operation id within a trace: the last committed one of each."""
    committed = F.filter(events, lambda e: F.get_json_object(e["result"], "$.result.status") == "committed")
    pairs = F.transform(committed, lambda e, i: F.struct(F.get_json_object(e["result"], "$.result.operation_id").alias("key"), i.alias("place"), F.get_json_object(e["result"], "$.result").alias("value")))
    # ordered by operation and place, the last of each operation is the one that another key follows
    last = lambda ordered: F.filter(ordered, lambda p, i: ~F.get(ordered, i + 1)["key"].eqNullSafe(p["key"]))
    kept = F.get(F.transform(F.array(F.array_sort(pairs)), last), F.lit(0))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))))
