"""Metrics of scored records as columns (F7-F10, D7, D8, E11, C11): aggregations over normalised events, no Python.

``normalise.event_tables`` gives the attempts and executions of all records; one
aggregation by case counts them and makes the counters of multiset scores. What a case asks for (tools, calls, faults) is read from its
JSON with VARIANT. The values are those of ``scoring.score`` for the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators import counters
from tracemill.operators.normalise import at
from tracemill.operators.scoring import BAD_TRANSITION_TEXT, BAD_TRANSITIONS, INJECTED_TEXT


def _rate(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, empty).otherwise(a / F.nullif(b, F.lit(0)))


def _string(v: Column) -> Column:
    return F.when(F.startswith(F.to_json(v), F.lit('"')), F.try_variant_get(v, "$", "string"))


def _list(v: Column) -> Column:
    """The items of an array, none for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _names(items: Column) -> Column:
    """Names of tools or specs, in order: texts as they are, specs by name or tool; others have none."""
    one = lambda x: F.coalesce(_string(x), _string(at(x, "name", "tool")))
    return F.filter(F.transform(items, one), lambda n: n.isNotNull() & (n != ""))


def _spec_names(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: _string(at(x, "name", "tool"))), lambda n: n.isNotNull() & (n != ""))


def required(case: Column) -> Column:
    """the counter of what a case requires: the larger count of each name among tools and calls, the expected tools where neither key is there, null without any."""
    named = at(case, "required_tools").isNotNull() | at(case, "required_calls").isNotNull()
    tools, calls = counters.of_array(_names(_list(at(case, "required_tools")))), counters.of_array(_spec_names(_list(at(case, "required_calls"))))
    expected = F.try_variant_get(at(case, "expected_tools"), "$", "array<variant>")
    return F.when(named, counters.union(tools, calls)).when(expected.isNotNull(), counters.of_array(F.transform(expected, _string)))


_FAULT = "array<struct<tool:string,key:string,target:string,times:int>>"


def faults(case: Column) -> Column:
    """The fault plan: tool, argument that must equal the target, target (JSON) and times of each fault."""
    def one(f: Column) -> Column:
        operation, times = _string(at(f, "operation")), at(f, "times")
        whole = F.when(times.isNull(), 1).when(F.schema_of_variant(times) == "BIGINT", F.greatest(F.try_variant_get(times, "$", "int"), F.lit(0))).otherwise(0)
        is_object = F.try_variant_get(f, "$", "map<string,variant>").isNotNull()
        tool = F.when(operation == "navigate", "navigate_ui").when(operation == "action", "execute_action").otherwise(operation)
        key = F.when(operation == "navigate", "target_page").when(operation == "action", "action")
        return F.struct(tool.alias("tool"), key.alias("key"), F.coalesce(F.to_json(at(f, "target")), F.lit("null")).alias("target"), F.when(is_object, whole).otherwise(0).cast("int").alias("times"))

    return F.transform(_list(F.try_variant_get(case, "$.environment.fault_injections", "variant")), one).cast(_FAULT)


def explained(plan: Column, failures: Column) -> Column:
    """The places of failed executions (place, tool, arguments, injected) that a plan explains: each fault up to its times in order, each execution once."""
    def fits(e: Column, f: Column) -> Column:
        arguments = F.try_parse_json(F.coalesce(e["args"], F.lit("{}")))
        is_object = F.try_variant_get(arguments, "$", "map<string,variant>").isNotNull()
        part = F.when(f["key"] == "target_page", at(arguments, "target_page")).otherwise(at(arguments, "action"))
        return e["injected"] & is_object & e["tool"].eqNullSafe(f["tool"]) & (f["key"].isNull() | (F.coalesce(F.to_json(part), F.lit("null")) == f["target"]))

    def step(taken: Column, f: Column) -> Column:
        free = F.filter(failures, lambda e: fits(e, f) & ~F.array_contains(taken, e["place"]))
        return F.concat(taken, F.transform(F.slice(free, F.lit(1), f["times"]), lambda e: e["place"]))

    return F.aggregate(plan, F.array().cast("array<bigint>"), step)


def execution_metrics(events: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case of ``cases`` (case_id, case as JSON text): counts, rates, explained failures and multiset scores of its normalised events.

    A case without events has the values of an empty record. A case text that is no JSON asks for nothing.
    """
    tried, ran = F.col("kind") == "attempt", F.col("kind") == "execution"
    failed = ran & ~F.col("ok")
    kind = F.coalesce(F.col("error_type"), F.lit(""))
    message = F.lower(F.coalesce("error", F.lit("")))
    unknown = ran & F.replace(F.lower(F.trim(kind)), F.lit("-"), F.lit("_")).isin("unknown_tool", "unknowntool")
    told = F.lit(False)
    for text in BAD_TRANSITION_TEXT:
        told = told | F.contains(message, F.lit(text))
    bad = failed & (F.coalesce(F.col("flagged"), F.lit(False)) | F.regexp_replace(F.lower(kind), "[^a-z]", "").isin(*BAD_TRANSITIONS) | told)
    injected = (F.lower(F.trim(kind)) == "runtimeerror") | F.contains(F.coalesce("error", F.lit("")), F.lit(INJECTED_TEXT))
    count = lambda c: F.count_if(c).cast("bigint")
    failure = F.when(failed, F.struct(F.col("idx").alias("place"), F.col("tool").alias("tool"), F.col("args_json").alias("args"), injected.alias("injected")))
    per = events.groupBy("case_id").agg(
        count(tried).alias("tool_attempt_count"), count(tried & F.col("valid")).alias("_valid"), count(tried & F.col("valid") & F.col("tool").isNotNull()).alias("tool_call_count"), count(ran).alias("tool_execution_count"),
        count(tried & F.col("marker")).alias("malformed_tool_call_markers"), count(failed).alias("failed_tool_calls"), count(unknown).alias("unknown_tool_calls"), count(bad).alias("invalid_transition_count"),
        F.array_sort(F.collect_list(failure)).alias("_failures"), F.collect_list(F.when(tried & F.col("valid"), F.col("tool"))).alias("_names"))
    per = per.withColumn("_got", counters.of_array(F.col("_names"))).drop("_names")
    asked = cases.select(F.col("case_id").cast("string").alias("case_id"), F.try_parse_json("case").alias("_case"))
    asked = asked.select("case_id", required(F.col("_case")).alias("_want"), counters.of_array(_names(_list(at(F.col("_case"), "optional_tools")))).alias("_excused"), faults(F.col("_case")).alias("_plan"))
    rows = asked.join(per, "case_id", "left")
    counts = ["tool_attempt_count", "tool_call_count", "tool_execution_count", "malformed_tool_call_markers", "failed_tool_calls", "unknown_tool_calls", "invalid_transition_count", "_valid"]
    rows = rows.na.fill(0, counts)
    rows = rows.withColumn("observed_expected_failed_calls", F.coalesce(F.size(explained(F.coalesce("_plan", F.array().cast(_FAULT)), F.coalesce("_failures", F.array().cast("array<struct<place:bigint,tool:string,args:string,injected:boolean>>")))), F.lit(0)).cast("bigint"))
    rows = rows.withColumn("unexpected_failed_calls", F.greatest(F.col("failed_tool_calls") - F.col("observed_expected_failed_calls"), F.lit(0)))
    want, made, n, tries = F.col("_want"), F.coalesce("_got", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))), F.col("tool_execution_count"), F.col("tool_attempt_count")
    scores = {
        "tool_true_positives": counters.total(counters.intersection(want, made)), "tool_false_negatives": counters.total(counters.excess(want, made)),
        "tool_false_positives": counters.total(counters.excess(counters.excess(made, want), F.col("_excused"))),
    }
    rows = rows.withColumns({k: F.when(want.isNotNull(), v) for k, v in scores.items()})
    tp, fp, fn = (F.col(f"tool_{x}") for x in ("true_positives", "false_positives", "false_negatives"))
    rows = rows.withColumns({"tool_precision": F.when(want.isNotNull(), _rate(tp, tp + fp, 1.0)), "tool_recall": F.when(want.isNotNull(), _rate(tp, tp + fn, 1.0))})
    p, r = F.col("tool_precision"), F.col("tool_recall")
    return rows.withColumns({
        "tool_f1": F.when(want.isNotNull(), _rate(2 * p * r, p + r, 0.0)), "invalid_tool_calls": tries - F.col("_valid"), "valid_call_rate": _rate(F.col("_valid"), tries, 1.0),
        "execution_success_rate": _rate(n - F.col("failed_tool_calls"), n, 1.0), "adjusted_execution_success_rate": _rate(n - F.col("unexpected_failed_calls"), n, 1.0),
        "expected_failed_calls": F.coalesce(F.aggregate("_plan", F.lit(0).cast("bigint"), lambda t, f: t + f["times"]), F.lit(0).cast("bigint")),
        "unknown_tool_rate": _rate(F.col("unknown_tool_calls"), n, 0.0), "invalid_transition_rate": _rate(F.col("invalid_transition_count"), n, 0.0),
    }).drop("_valid", "_failures", "_want", "_excused", "_plan", "_got")
