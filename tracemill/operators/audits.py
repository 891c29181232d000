"""Audits and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.jsonx import canonical
from tracemill.functions.text import clauses
from tracemill.operators.events import so_far


def record_digest(case: Column, result: Column) -> Column:
    """The digest of a case and its result."""
    whole = F.concat(F.lit('{"case":'), canonical(case), F.lit(',"result":'), canonical(result), F.lit("}"))
    return F.sha2(whole.cast("binary"), 256)


def fingerprint(metadata: Column) -> Column:
    """The digest of a run's metadata as canonical JSON."""
    return F.sha2(canonical(metadata).cast("binary"), 256)


def drifted(now: DataFrame, frozen: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose JSON value is not the frozen one; missing and new keys too."""
    both = now.select(key, canonical(F.col(value)).alias("a")).join(frozen.select(key, canonical(F.col(value)).alias("b")), key, "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "new").otherwise("changed").alias("reason"))


def comparable(runs: DataFrame, metadata: str, ignored: list[str]) -> DataFrame:
    """Distinct metadata without the columns that may differ; one row if the runs are comparable."""
    return runs.select(F.col(metadata).dropFields(*ignored).alias("m")).distinct()


def requery(results: DataFrame, cases: DataFrame, key: str = "id", query: str = "query") -> DataFrame:
    """Results whose query is no longer the case's."""
    return results.join(cases.select(key, F.col(query).alias("_now")), key).filter(~F.col(query).eqNullSafe(F.col("_now"))).drop("_now")


_CLAIM = r"^(?:实际发生的失败次数\s*[:：]\s*(\d+)\s*(?:次)?|实际工具失败\s*(\d+)\s*次)$"


def claim_status(answer: Column, observed: Column) -> Column:
    """Failure counts that an answer states in clauses of their own, against what was observed: a struct of claims and status."""
    plain = F.transform(clauses(F.replace(F.coalesce(answer, F.lit("")), F.lit("**"), F.lit(""))), lambda c: F.trim(F.regexp_replace(c, r"^[- ]+", "")))
    number = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, _CLAIM, 1), F.lit("")), F.regexp_extract(c, _CLAIM, 2)).cast("bigint")
    claims = F.transform(F.filter(plain, lambda c: c.rlike(_CLAIM)), number)
    status = F.when(F.size(claims) == 0, "unparsed_needs_review").when(F.size(F.array_distinct(claims)) > 1, "conflicting_claims_needs_review").when(F.get(claims, F.lit(0)) != observed, "mismatch_needs_review").otherwise("matched_count_only")
    return F.struct(claims.alias("claims"), status.alias("status"))


# fixed values: what makes a template's contract incomplete, and the families that need knowledge first
KNOWLEDGE_FAMILIES = ("reproduce_black_screen", "negative_control_ios", "workaround_black_screen")


def contract_risks(query: Column, family: Column, tools: Column) -> Column:
    """the gaps between a case's public text and its hidden rules."""
    has = lambda text: F.contains(query, F.lit(text))
    flags = {
        "mandatory_logs_not_explicit_in_prompt": F.array_contains(tools, "query_logs") & ~has("日志"), "knowledge_before_action_order_not_enforced": family.isin(*KNOWLEDGE_FAMILIES),
        "explicit_no_redundant_mutation_not_enforced": has("不做多余跳转") | has("不重复改设置"), "explicit_read_only_not_enforced_throughout_trace": has("不要改变界面"),
        "build_tool_identity_required_despite_equivalent_state_tool": family == "build_info",
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in flags.items())))


def decided(df: DataFrame, table: dict[str, str], key: str = "id") -> DataFrame:
    """Verdicts from a table of constants; an id without one stays open."""
    verdict = F.lit(None).cast("string")
    for k, v in table.items():
        verdict = F.when(F.col(key) == k, v).otherwise(verdict)
    return df.withColumn("verdict", verdict)


def dpo_drift(log: DataFrame, reference: DataFrame, *, beta: float = 0.1, key: str = "case_id", tolerance: float = 1e-6) -> DataFrame:
    """Logged steps (key, chosen, rejected, loss, margin, coefficient, tokens) whose terms or token counts the reference scores do not give."""
    from tracemill.functions.maths import dpo_terms, is_close

    ref = reference.select(key, F.col("chosen").alias("_c"), F.col("rejected").alias("_r"), F.col("tokens").alias("_t"))
    both = log.join(ref, key, "left")
    terms = dpo_terms(F.col("chosen"), F.col("rejected"), F.col("_c"), F.col("_r"), beta)
    wrong = F.array_compact(F.array(F.when(F.col("_c").isNull(), "unknown"), F.when(F.col("tokens") != F.col("_t"), "tokens"), *(F.when(F.col("_c").isNotNull() & ~is_close(F.col(n), v, tolerance, tolerance), n) for n, v in terms.items())))
    return both.withColumn("wrong", wrong).filter(F.size("wrong") > 0).drop("_c", "_r", "_t")


def inherited(old: DataFrame, new: DataFrame, reviews: DataFrame, key: str = "id", result: str = "result") -> DataFrame:
    """Reviews that a rerun may keep, because its result is exactly the reviewed one."""
    same = old.select(key, canonical(F.col(result)).alias("a")).join(new.select(key, canonical(F.col(result)).alias("b")), key).filter("a = b").select(key)
    return reviews.join(same, key, "left_semi")


def trace_facts(executions: DataFrame, case: str = "case_id") -> DataFrame:
    """what each trace's executions (idx, tool, ok, error_type, payload_json) show: failures, refusals, checks, changes, logs read, latest state."""
    tool = lambda *names: F.col("tool").isin(*names)
    state = F.when(tool("verify_state"), F.get_json_object("payload_json", "$.current_state")).when(tool("inspect_ui_state", "navigate_ui", "execute_action", "get_build_info"), F.col("payload_json"))
    bad_check = tool("verify_state") & (F.get_json_object("payload_json", "$.success") == "false")
    return executions.groupBy(case).agg(
        F.count_if(~F.col("ok")).alias("failures"), F.count_if(F.col("error_type") == "policy_blocked").alias("policy_blocks"), F.count_if(F.col("ok") & bad_check).alias("failed_checks"),
        F.count_if(F.col("ok") & tool("navigate_ui", "execute_action")).alias("mutations"), F.count_if(F.col("ok") & tool("query_logs")).alias("logs_read"),
        F.max_by(state, F.when(F.col("ok") & state.isNotNull(), F.col("idx"))).alias("latest_state"),
    )


def retrospective(cases: DataFrame) -> DataFrame:
    """by category, what a changed protocol lets one say about old records: rows of category, requires_new_inference, execution_success, task_success."""
    eligible = ~F.col("requires_new_inference")
    return cases.groupBy("category").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(~eligible).alias("requires_new_inference"), F.count_if(eligible).alias("eligible"),
        F.count_if(eligible & F.col("execution_success")).alias("execution_success"), F.count_if(eligible & F.col("task_success").isNull()).alias("answer_review_pending"))


# fixed values: state fields with their types and labels
FACT_FIELDS = {"current_page": ("STRING", "最终页面"), "graphics_preset": ("STRING", "画质"), "battle_hud_visible": ("BOOLEAN", "HUD"), "black_screen": ("BOOLEAN", "黑屏")}


def observed_facts(executions: DataFrame, case: str = "case_id") -> DataFrame:
    """Only what returns show: a field (as JSON) counts if it was seen, rightly typed, no earlier than the last successful change.

    unknown_status counts executions without a plain success or failure; no sheet should be published where it is not 0.
    """
    tool = lambda *names: F.col("tool").isin(*names)
    acts = tool("navigate_ui", "execute_action")
    tells = F.col("ok") & (acts | tool("inspect_ui_state", "verify_state", "get_build_info"))
    payload = F.try_parse_json("payload_json")
    told = F.when(tells, F.when(tool("verify_state"), F.try_variant_get(payload, "$.current_state", "variant")).otherwise(payload))
    changed = F.coalesce(acts & F.col("ok"), F.lit(False)).cast("int")
    epoch = F.coalesce(F.sum(changed).over(so_far(case)), F.lit(0)) + changed  # what a change itself returns is seen after it
    rows = executions.withColumns({"_told": told, "_epoch": epoch})
    failed_check = F.col("ok") & tool("verify_state") & (F.get_json_object("payload_json", "$.success") == "false")
    logs = F.col("ok") & tool("query_logs") & F.startswith(F.ltrim("payload_json"), F.lit("["))

    def newest(field: str, kind: str) -> Column:
        value = F.try_variant_get("_told", f"$.{field}", "variant")
        is_a = F.schema_of_variant(value)
        return F.max(F.when(is_a.isNotNull(), F.struct("_epoch", "idx", F.when(is_a == kind, F.to_json(value)).alias("value")))).alias(field)

    found = rows.groupBy(case).agg(
        *(newest(f, kind) for f, (kind, _) in FACT_FIELDS.items()), F.max("_epoch").alias("mutations"),
        (F.count_if(~F.col("ok")) + F.count_if(failed_check)).alias("failures"), F.count_if(~F.col("ok") & (F.col("error_type") == "policy_blocked")).alias("policy_blocks"),
        F.count_if(F.col("ok") & tool("inspect_ui_state")).alias("inspections"), F.count_if(logs).alias("logs_read"),
        (F.max(F.when(logs, F.col("idx"))) > F.coalesce(F.max(F.when(acts, F.col("idx"))), F.lit(-1))).alias("_late"), F.count_if(F.col("ok").isNull()).alias("unknown_status"),
    )
    valid = {f: F.when(F.col(f"{f}._epoch") == F.col("mutations"), F.col(f"{f}.value")) for f in FACT_FIELDS}
    return found.withColumns(valid | {"logs_after_last_attempt": F.coalesce("_late", F.lit(False))}).drop("_late")


def fact_sheet(facts: DataFrame) -> DataFrame:
    """The facts as the text that accompanies an answer, in column sheet."""
    shown = [F.concat(F.lit(f"{label}="), F.coalesce(f, F.lit("未知（缺少有效观测）")), F.lit("。")) for f, (_, label) in FACT_FIELDS.items()]
    return facts.withColumn("sheet", F.concat_ws(
        "\n", F.lit("系统工具事实摘要（不是模型原回答，也不自动证明任务完成）："), *shown,
        F.format_string("实际失败%d次，其中策略拦截%d次；inspect_ui_state成功调用%d次。", "failures", "policy_blocks", "inspections"),
        F.format_string("成功导航/应用动作%d次；成功日志查询%d次。", "mutations", "logs_read"),
        F.concat(F.lit("最后一次应用操作尝试后的日志证据："), F.when(F.col("logs_after_last_attempt"), "已取得。").otherwise("未取得。")),
        F.lit("失败统计来自完整工具返回（含验证失败），不是仅从应用日志计数。"),
    ))


def folder_digest(path: str, block: int = 1 << 20) -> str:
    """F32: sorted relative paths and bytes folded into one digest; the fold has an order, so this is driver work on one folder."""
    import hashlib
    from pathlib import Path

    fold = hashlib.sha256()
    for p in sorted(x for x in Path(path).rglob("*") if x.is_file()):
        fold.update(p.relative_to(path).as_posix().encode() + b"\0")
        with p.open("rb") as f:
            while part := f.read(block):
                fold.update(part)
    return fold.hexdigest()


# fixed values: what a revision of a protocol puts into a case
INCIDENTS = {"knowledge_hud": "INC-102"}
INCIDENT_TEXT, OTHER_INCIDENT = "用事件编号", "INC-101"


def revised_queries(cases: DataFrame) -> DataFrame:
    """C13, 2.1: queries that name the incident they only hint at, and whether the case must be run again."""
    incident = F.lit(OTHER_INCIDENT)
    for family, name in INCIDENTS.items():
        incident = F.when(F.col("scenario_family") == family, name).otherwise(incident)
    new = F.replace(F.col("query"), F.lit(INCIDENT_TEXT), F.concat(F.lit(f"{INCIDENT_TEXT} "), incident))
    return cases.withColumns({"query": new, "source_case_id": F.col("id"), "requires_new_inference": new != F.col("query"), "protocol_version": F.lit("2.1")})


def process_contracts(cases: DataFrame) -> DataFrame:
    """C13, 2.2: the process rule of recovery cases; a fault for a family that has none."""
    known = F.col("scenario_family").isin("recovery_action", "recovery_navigation")
    rules = F.when(F.col("requires_recovery") & known, F.array(F.lit("observe_state_before_retry"))).otherwise(F.array().cast("array<string>"))
    return cases.withColumns({"process_constraints": rules, "fault": F.when(F.col("requires_recovery") & ~known, "recovery family without contract"), "protocol_version": F.lit("2.2")})


def public_contracts(cases: DataFrame) -> DataFrame:
    """C13, 2.3: the switches that a case's text and required tools (array) give."""
    has = lambda text: F.contains(F.col("query"), F.lit(text))
    contract = F.struct(
        has("不要改变界面").alias("read_only"), has("不做多余跳转").alias("no_navigation"), has("不重复改设置").alias("no_set_graphics"),
        F.col("scenario_family").isin(*KNOWLEDGE_FAMILIES).alias("knowledge_before_mutation"), F.array_contains("tools", "get_build_info").alias("build_evidence"),
    )
    return cases.withColumns({"public_contract": contract, "tags": F.array_remove("tags", "held_out"), "protocol_version": F.lit("2.3"), "requires_new_inference": F.lit(True)})
