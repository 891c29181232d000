"""Operators that take the model and the executor as functions of columns (L3).

What a turn generates and what a call returns are given as callbacks, so the same
plan serves a recorded answer, an SQL function or a Pandas UDF around a model:
Catalyst sees through the first two, and only the last leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import tool_calls

ENVELOPE = ("ok", "result", "error_type", "error")


def generated(turns: DataFrame, generate: Callable[[Column], Column], prompt: str = "text") -> DataFrame:
    """Each turn once per tool call of what it generates: place (from 0), valid, name and arguments (JSON; {} where none are given). Turns without a call have no row."""
    calls = turns.withColumn("_calls", tool_calls(generate(F.col(prompt))))
    rows = calls.select(*turns.columns, F.posexplode("_calls").alias("place", "_c"))
    body = F.try_parse_json(F.col("_c.raw"))
    name = F.when(F.col("_c.valid"), F.coalesce(F.try_variant_get(body, "$.name", "string"), F.try_variant_get(body, "$.tool", "string")))
    arguments = F.coalesce(F.to_json(F.try_variant_get(body, "$.arguments", "variant")), F.to_json(F.try_variant_get(body, "$.args", "variant")), F.lit("{}"))
    return rows.select(*turns.columns, F.col("place").cast("bigint").alias("place"), F.col("_c.valid").alias("valid"), name.alias("name"), F.when(F.col("_c.valid"), arguments).alias("arguments"))


def executed(calls: DataFrame, execute: Callable[[Column, Column], Column]) -> DataFrame:
    """Each call with the envelope (ok, result, error_type, error) that the executor gives for its name and arguments; calls that are not valid are not executed and fail as such."""
    ran = calls.withColumn("_e", F.when(F.col("valid"), execute(F.col("name"), F.col("arguments"))))
    refused = {"ok": F.lit(False), "error_type": F.lit("invalid_call"), "error": F.lit("not executed")}
    return ran.select(*calls.columns, *(F.when(F.col("valid"), F.col(f"_e.{n}")).otherwise(refused.get(n, F.lit(None))).alias(n) for n in ENVELOPE))
