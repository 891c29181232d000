"""What executions prove, and what a policy lets through, as columns.

Executions have a case, idx, tool, ok, error_type, error and payload_json. The
audit's report is one aggregation per case; the read-only policy is a condition
per call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: tools that only read, and what the policy says
READ_TOOLS = ("get_build_info", "inspect_ui_state", "verify_state", "query_logs", "search_knowledge")
BLOCKED, BLOCKED_TEXT = "policy_blocked", "Application read-only policy forbids this tool. Use read-only tools; do not navigate or act."


def under_policy(calls: DataFrame, read_only: Column, *, reads: tuple[str, ...] = READ_TOOLS) -> DataFrame:
    """Each call with ``dispatched``, and the envelope's ok, error_type and error as the policy leaves them: what it blocks never runs."""
    blocked = F.coalesce(read_only, F.lit(False)) & ~F.coalesce(F.col("tool").isin(*reads), F.lit(False))
    return calls.withColumns({
        "dispatched": ~blocked, "ok": F.when(blocked, False).otherwise(F.col("ok")), "error_type": F.when(blocked, BLOCKED).otherwise(F.col("error_type")),
        "error": F.when(blocked, BLOCKED_TEXT).otherwise(F.col("error")), "payload_json": F.when(~blocked, F.col("payload_json")),
    })


def evidence(executions: DataFrame, read_only: Column, case: str = "case_id") -> DataFrame:
    """per case tool_errors, verification_failures, policy_blocks, total_failures, the newest state (JSON), the newest log's length and the decision.

    ``read_only`` is an aggregate: whether the case may not be changed now. Decisions, first that holds: stop changing,
    repair arguments, look before trying again, nothing to try again.
    """
    good = F.coalesce(F.col("ok"), F.lit(True))
    tool = lambda *names: F.col("tool").isin(*names)
    payload = F.try_parse_json("payload_json")
    failed = good & tool("verify_state") & (F.to_json(F.try_variant_get(payload, "$.success", "variant")) == "false")
    is_object = F.startswith("payload_json", F.lit("{"))
    state = F.when(good & tool("verify_state"), F.to_json(F.try_variant_get(payload, "$.current_state", "variant"))).when(good & tool("inspect_ui_state", "execute_action", "navigate_ui") & is_object, F.to_json(payload))
    logs = F.when(good & tool("query_logs"), F.size(F.try_variant_get(payload, "$", "array<variant>")))
    count = lambda c: F.count_if(c).cast("bigint")
    kinds = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = executions.groupBy(case).agg(
        count(~good).alias("tool_errors"), count(failed).alias("verification_failures"), count(~good & (F.col("error_type") == BLOCKED)).alias("policy_blocks"),
        F.max_by(state, F.when(state.isNotNull(), F.col("idx"))).alias("state"), F.max_by(logs, F.when(logs.isNotNull(), F.col("idx"))).cast("bigint").alias("log_count"),
        read_only.alias("read_only"), kinds(~good & (F.col("error_type") == "TypeError")).alias("_arguments"), kinds(~good & F.contains("error", F.lit("transient_failure"))).alias("_transient"))
    decision = F.when(F.col("read_only"), "stop_mutations").when(F.col("_arguments"), "repair_arguments").when(F.col("_transient"), "inspect_before_retry").otherwise("no_retry_needed")
    return out.withColumns({"total_failures": F.col("tool_errors") + F.col("verification_failures"), "decision": decision}).drop("_arguments", "_transient")


def config_fault(text: Column, fields: dict[str, tuple[str, ...] | str]) -> Column:
    """Why a JSON text is no configuration of exactly these fields, or null. A field's domain is a tuple of strings or a kind: boolean (no number) or bigint."""
    own = F.try_parse_json(text)
    keys = F.map_keys(F.try_variant_get(own, "$", "map<string,variant>"))
    part = lambda k: F.try_variant_get(own, f"$.{k}", "variant")
    fault = F.lit(None).cast("string")
    for k, domain in reversed(list(fields.items())):
        kind = F.schema_of_variant(part(k))
        fits = (kind == "STRING") & F.try_variant_get(own, f"$.{k}", "string").isin(*domain) if isinstance(domain, tuple) else kind == domain.upper()
        fault = F.when(~F.coalesce(fits, F.lit(False)), f"bad {k}").otherwise(fault)
    names = F.array(*(F.lit(k) for k in sorted(fields)))
    return F.when(~F.coalesce(F.startswith(F.schema_of_variant(own), F.lit("OBJECT")), F.lit(False)), "no object").when(F.array_sort(keys) != names, "other fields").otherwise(fault)
