"""Trajectory normalisation as columns (C2-C9): from a permissive result record to attempts and executions, on VARIANT.

Precedence among keys is by *presence*: a key that is there with a JSON null
wins over a later one with a value. ``try_variant_get`` tells the two apart (SQL
null for an absent key, a variant null for a null value), so ``coalesce`` is the
precedence rule. Steps and items are arrays of variants; all of a record is one
row until its events are laid out, so there is no shuffle and no Python.

Defined results: the same as ``trace.event_tables``, except that what Spark does
not take for JSON (repeated keys, NaN) stays text, that numbers are written in
their shortest form (1.0 as 1), and that payloads, and errors that are objects or lists, are compact JSON with sorted keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARKER = r"(?i)</?tool_call(?=\s|>|$)"
_CALLS, _RESULTS, _OWN = ("parsed_tool_calls", "tool_calls", "calls"), ("tool_results", "results"), ("tool_call", "call")
_FALSE = ('""', "0", "0.0", "false", "null", "[]", "{}")
_EVENT = "struct<kind:string,step:int,valid:boolean,tool:string,args_json:string,ok:boolean,error_type:string,error:string,payload_json:string,marker:boolean,flagged:boolean>"
_CALL = "struct<name:string,args:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(value: Column, *keys: str) -> Column:
    """The value of the first key that is present, even if it is a JSON null; SQL null if none is."""
    found = [F.try_variant_get(value, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _is_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull() & ~_is_null(value)


def _text(value: Column) -> Column:
    """The value if it is a string, else null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _loaded(value: Column) -> Column:
    """The value of a string that holds JSON, any other value as it is."""
    return F.coalesce(F.try_parse_json(_text(value)), value)


def _listed(value: Column) -> Column:
    return F.when(_is_null(value), F.array().cast("array<variant>")).otherwise(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value)))


def _marked(value: Column) -> Column:
    return F.coalesce(F.regexp_like(_text(value), F.lit(_MARKER)), F.lit(False))


def _loaded_call(value: Column) -> Column:
    """As ``_loaded``, but what has a call's keys is an object and is not written out to see whether it is a string."""
    return F.when(at(value, *_OWN, "name", "tool").isNotNull(), value).otherwise(_loaded(value))


def call_of(item: Column) -> Column:
    """(name, args) of a call, bare or wrapped, its arguments parsed if they are JSON text; null for anything else."""
    def parsed(arguments: Column) -> Column:
        own = lambda j: F.when(F.startswith(j, F.lit('"')), F.coalesce(F.to_json(F.try_parse_json(F.try_variant_get(arguments, "$", "string"))), j)).otherwise(j)
        return F.coalesce(let(F.to_json(arguments), own), F.lit("{}"))

    def named(body: Column) -> Column:
        name = _text(at(body, "name", "tool"))
        return F.when(F.length(name) > 0, F.struct(name.alias("name"), parsed(at(body, "arguments", "args")).alias("args")))

    return let(_loaded_call(item), lambda x: let(F.when(at(x, *_OWN).isNotNull(), _loaded_call(at(x, *_OWN))).otherwise(x), named)).cast(_CALL)


def _attempt(items: Column, step: Column) -> Column:
    """Attempts of items; valid is a named call that no explicit flag denies."""
    def one(item: Column) -> Column:
        allowed = F.coalesce(F.to_json(at(item, "valid")), F.lit("true")) == "true"
        return let(call_of(item), lambda c: F.struct(step.cast("int").alias("step"), (c.isNotNull() & allowed).alias("valid"), c.alias("call"), F.lit(False).alias("marker")))

    return F.transform(items, one)


_ATTEMPTS = f"array<struct<step:int,valid:boolean,call:{_CALL},marker:boolean>>"


def _marker_attempt(step: Column) -> Column:
    return F.array(F.struct(step.cast("int").alias("step"), F.lit(False).alias("valid"), F.lit(None).cast(_CALL).alias("call"), F.lit(True).alias("marker")))


def _calls_of(step: Column) -> Column:
    """C4: the call items of a step."""
    found, single = at(step, *_CALLS), at(step, *_OWN)
    return F.when(found.isNotNull(), _listed(found)).when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<variant>"))


def _envelope(item: Column) -> Column:
    return F.when(at(item, *_OWN).isNotNull(), F.coalesce(at(item, "result", "tool_result"), item)).otherwise(item)


def _results_of(step: Column) -> Column:
    """C4: the result items of a step as (named call, bare item, envelope)."""
    found, call, result = at(step, *_RESULTS), at(step, *_OWN), at(step, "tool_result", "result")
    listed = lambda items: F.transform(items, lambda x: F.struct(at(x, *_OWN).alias("named"), x.alias("bare"), _envelope(x).alias("envelope")))
    own = F.array(F.struct(call.alias("named"), F.lit(None).cast("variant").alias("bare"), result.alias("envelope")))
    none = F.array().cast("array<struct<named:variant,bare:variant,envelope:variant>>")
    return F.when(found.isNotNull(), listed(_listed(found))).when(call.isNotNull() & result.isNotNull(), own).otherwise(none)


def _attempts_of(s: Column, n: Column) -> Column:
    """Attempts of a step (step, own attempts, results); a marker without calls is one invalid attempt, executed calls stand in for missing ones."""
    ran = F.filter(F.transform(s["results"], lambda r: r["named"]), lambda c: ~_is_null(c))
    marked = _marked(at(s["step"], "model_output"))  # only an object has one
    return F.when(F.size(s["own"]) > 0, s["own"]).when(marked, _marker_attempt(n).cast(_ATTEMPTS)).otherwise(_attempt(ran, n).cast(_ATTEMPTS))


def _ok(e: Column) -> Column:
    """An explicit ok, else an error, else a boolean success, else any value."""
    truth = lambda c: ~F.coalesce(F.to_json(c), F.lit("null")).isin(*_FALSE)
    success = F.to_json(at(e, "success"))
    inner = F.when(at(e, "ok").isNotNull(), F.to_json(at(e, "ok")) == "true").when(~_is_null(at(e, "error")) | truth(at(e, "error_type")), False).when(success.isin("true", "false"), success == "true").otherwise(True)
    told = at(e, "ok", "error", "error_type", "success").isNotNull()  # then it is an object; any other object is good, as any value is
    return F.when(told, inner).otherwise(~_is_null(e))


def _said(e: Column, *keys: str) -> Column:
    """C11: the first of the keys in an envelope, as text; null where it is empty."""
    found = at(e, *keys)
    text = F.coalesce(_text(found), F.to_json(found))
    return F.nullif(F.when(_text(found).isNotNull(), text).when(text == "null", "None").when(text == "true", "True").when(text == "false", "False").otherwise(text), F.lit(""))


def _executions_of(results: Column, calls: Column, n: Column, bare: bool) -> Column:
    """Executions with their own call, or the call at the same place."""
    def one(r: Column, i: Column) -> Column:
        itself = F.when(at(r["bare"], "name").isNotNull(), call_of(r["bare"])) if bare else F.lit(None).cast(_CALL)
        call = F.coalesce(F.when(r["named"].isNotNull(), call_of(r["named"])), itself, F.get(calls, i))
        payload = F.when(at(r["envelope"], "ok").isNotNull(), F.coalesce(at(r["envelope"], "result"), r["envelope"])).otherwise(r["envelope"])

        def event(c: Column) -> Column:
            e = r["envelope"]
            return F.struct(
                F.lit("execution").alias("kind"), n.cast("int").alias("step"), F.lit(None).cast("boolean").alias("valid"), c["name"].alias("tool"), c["args"].alias("args_json"), _ok(e).alias("ok"),
                _said(e, "error_type").alias("error_type"), _said(e, "error", "message").alias("error"), F.when(~_is_null(payload), F.to_json(payload)).alias("payload_json"), F.lit(False).alias("marker"), (F.to_json(at(e, "invalid_transition")) == "true").alias("flagged"))

        return let(call, event)

    return F.transform(results, one)


def _valid_calls(attempts: Column) -> Column:
    return F.transform(F.filter(attempts, lambda a: a["valid"] & a["call"].isNotNull()), lambda a: a["call"])


def event_tables(records: DataFrame, id_col: str = "id", result_col: str = "result") -> DataFrame:
    """One row per attempt and per execution of each record (result as JSON text), told apart by kind."""
    v = F.col("_v")
    # a text that is no JSON object has no steps and no items
    rows = records.select(F.col(id_col).cast("string").alias("case_id"), F.try_parse_json(F.col(result_col).cast("string")).alias("_v"))
    steps = F.when(_is_object(v), F.coalesce(F.try_variant_get(v, "$.trajectory", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>"))
    rows = rows.withColumn("_steps", F.filter(steps, lambda s: s.isNotNull()))
    own = F.transform("_steps", lambda s, n: F.struct(s.alias("step"), _attempt(_calls_of(s), n).cast(_ATTEMPTS).alias("own"), _results_of(s).alias("results")))
    per_step = F.transform("_own", lambda s, n: F.struct(_attempts_of(s, n).alias("tried"), _valid_calls(s["own"]).alias("made"), s["results"].alias("results")))
    rows = rows.withColumn("_own", own).withColumn("_per", per_step).withColumn("_tried", F.flatten(F.transform("_per", lambda p: p["tried"])))
    top = _attempt(_listed(at(v, "parsed_tool_calls", "tool_calls")), F.lit(0)).cast(_ATTEMPTS)
    lone = F.when(_marked(at(v, "model_output")), _marker_attempt(F.lit(0)).cast(_ATTEMPTS)).otherwise(F.array().cast(_ATTEMPTS))
    rows = rows.withColumn("_tried", F.when((F.size("_tried") > 0) | ~_is_object(v), F.col("_tried")).otherwise(let(top, lambda t: F.when(F.size(t) > 0, t).otherwise(lone))))
    ran = F.flatten(F.transform("_per", lambda p, n: _executions_of(p["results"], p["made"], n, True))).cast(f"array<{_EVENT}>")
    rows = rows.withColumn("_ran", ran)
    outer = F.transform(_listed(at(v, "tool_results")), lambda x: F.struct(at(x, *_OWN).alias("named"), x.alias("bare"), _envelope(x).alias("envelope")))
    fallback = _executions_of(outer, _valid_calls(F.col("_tried")), F.lit(0), False).cast(f"array<{_EVENT}>")
    rows = rows.withColumn("_ran", F.when((F.size("_ran") > 0) | ~_is_object(v), F.col("_ran")).otherwise(fallback))
    none = lambda t: F.lit(None).cast(t)
    tried = F.transform("_tried", lambda a: F.struct(
        F.lit("attempt").alias("kind"), a["step"].alias("step"), a["valid"].alias("valid"), a["call"]["name"].alias("tool"), a["call"]["args"].alias("args_json"), none("boolean").alias("ok"),
        none("string").alias("error_type"), none("string").alias("error"), none("string").alias("payload_json"), a["marker"].alias("marker"), none("boolean").alias("flagged"))).cast(f"array<{_EVENT}>")
    numbered = lambda c: F.transform(c, lambda e, i: F.struct(i.cast("bigint").alias("idx"), e.alias("e")))
    out = rows.select("case_id", F.explode(F.concat(numbered(tried), numbered(F.col("_ran")))).alias("x")).select("case_id", "x.idx", "x.e.*")
    return out.select("case_id", "kind", "idx", F.col("step").cast("bigint").alias("step"), "valid", "tool", "args_json", "ok", "error_type", "error", "payload_json", "marker", "flagged")
