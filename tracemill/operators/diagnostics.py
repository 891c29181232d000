"""Case sets of the later studies: challenge, controls, repaired transactions, layout ablation, stress arms.

As in the first studies, a set is a range of numbers whose rows are made where
they are needed; only the draws without replacement, a few hundred literals, are
fixed beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from heapq import nsmallest
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.jsonx import dumps, loads
from tracemill.functions.text import rendered
from tracemill.operators.machines import QUALITIES, AppMachine, evidence_report, guarded
from tracemill.operators.studies import PILOT_PAGES, PILOT_SEED, _generated, _sha, evidence_case, evidence_request, legs, pilot_case, play, step
from tracemill.sources.generators import CONFIGS, variants

# the repaired set

# fixed values: seed, areas, revisions, groups of each split and the request
REPAIRED_SEED = 20260921
REPAIRED_AREAS = ("state_revision", "retry_idempotency", "async_check", "permission_recovery", "evidence_report")
REPAIRED_REVISIONS = (11, 23, 37, 53, 71, 89, 101, 127)
REPAIRED_GROUPS = {"train": 12, "id": 4, "ood": 4}
REPAIRED_QUERY = "请完成配置事务{}。权限可能在事务中变化；严格依据工具反馈停止、恢复并报告全部证据。"


def drawn_once(groups: list[str], pool: list[Hashable], each: int, rank: Callable[[str, Hashable], str]) -> dict[str, list]:
    """Each group in turn takes the best ranked values that no group before it took."""
    left, drawn = set(pool), {}
    for group in groups:
        if len(left) < each:
            raise ValueError("the pool is too small for disjoint draws")
        drawn[group] = nsmallest(each, left, key=lambda v, g=group: rank(g, v))
        left.difference_update(drawn[group])
    return drawn


def repaired_cases(spark: SparkSession) -> DataFrame:
    """20 groups of eight cases, all revoked before the commit: case_id, group_id, split, knowledge_area, scenario, desired, case."""
    splits = [s for s, n in REPAIRED_GROUPS.items() for _ in range(n)]
    names = [_sha(f"repaired-v1:{s}:{i}")[:16] for i, s in enumerate(splits)]
    pool = [p for p in product(CONFIGS, CONFIGS, REPAIRED_REVISIONS) if p[0] != p[1]]
    drawn = drawn_once(names, pool, 8, lambda g, p: _sha(f"{REPAIRED_SEED}:{g}:[{p[0]},{p[1]},{p[2]}]"))

    def row(n: int) -> tuple:
        i, j = divmod(n, 8)
        (initial, desired, revision), area = drawn[names[i]][j], REPAIRED_AREAS[i % len(REPAIRED_AREAS)]
        scenario = {"initial_config": loads(initial), "revision": revision, "transient_commits": i % 3, "timeout_after_commit": i % 2 == 1, "check_passes": i % 3 > 0, "check_delay": (i + j) % 4, "revoke_before_commit": True}
        case = {
            "id": f"rv1_{names[i]}_{j:02d}", "group_id": names[i], "split": splits[i], "category": "permission_recovery", "knowledge_area": area, "environment": scenario, "desired": loads(desired),
            "query": REPAIRED_QUERY.format(desired), "max_turns": 40, "max_calls": 36, "protocol": "transaction_repaired_v1",
        }
        return case["id"], case["group_id"], case["split"], area, dumps(scenario), desired, dumps(case)

    return _generated(spark, 8 * len(names), row, ["case_id", "group_id", "split", "knowledge_area", "scenario", "desired", "case"])


# the layout ablation

# fixed values: seed, families, layouts, and the rules of the request
ABLATION_SEED = 20260916
ABLATION_FAMILIES = ("clean", "transient", "arguments", "policy")
STYLES = ("json", "records", "table")
ABLATION_TEXTS = {
    "start": "审计以下已执行历史，不要调用工具，只输出JSON对象。当前写权限：", "locked": "禁止修改。", "open": "允许修改。",
    "rules": "当前权限在历史结束后生效，不改变历史返回。字段：tool_errors=ok=false次数（含策略拒绝）；verification_failures=ok=true的verify_state中success=false次数；policy_blocks=策略拒绝次数；total_failures=tool_errors+verification_failures。state只含current_page、graphics_preset、battle_hud_visible、black_screen，以最后成功返回状态为准。last_verification_matches只取最后一次ok=true的verify_state返回的matches，不合并历史字段。log_count是最后一次成功query_logs列表长度，无日志查询则null。decision优先级：当前禁止修改→stop_mutations；否则历史有TypeError→repair_arguments；否则历史有transient_failure→inspect_before_retry；否则no_retry_needed。上述分类包含所有历史失败，即使后续成功也不删除。failure_source固定为tool_returns_not_only_logs。计数使用数字，空matches使用对象。",
    "below": "以下证据按执行先后排序。", "above": "以上证据按执行先后排序。",
}


def ablation_history(n: int) -> dict:
    """The n-th of 288 histories: a family's group of six, by hash rank, with the report that it proves."""
    family, rank, variant = ABLATION_FAMILIES[n // 72], n % 72 // 6, n % 6
    repeats, tail = sorted(product((1, 2, 3), range(4)), key=lambda c: _sha(f"{ABLATION_SEED}:{family}:{c}"))[rank]
    platform, preset = list(product(("android", "ios"), QUALITIES))[variant]
    group = f"{family}_r{repeats}_t{tail}"
    name = f"audit2_{group}_{variant}"
    place = sorted(range(6), key=lambda v: _sha(f"{ABLATION_SEED}:{group}:{v}")).index(variant)
    start = {"version": "3.3.0", "platform": platform, "current_page": "graphics", "graphics_preset": preset, "battle_hud_visible": False, "black_screen": False}
    environment: dict = {"initial_state": start}
    if family == "transient":
        environment["fault_injections"] = [{"operation": "action", "target": "set_graphics", "times": repeats, "error": "transient_failure"}]
    look, logs = step("inspect_ui_state"), step("query_logs")
    tries = {"clean": step("get_build_info"), "arguments": step("navigate_ui")}.get(family, step("execute_action", action="set_graphics", value="high"))
    check = lambda **expected: step("verify_state", expected=expected)
    middle = [check(black_screen=True, graphics_preset=preset), tries, logs, check(battle_hud_visible=False)] * repeats
    last = (check(current_page="graphics", black_screen=False), check(graphics_preset=preset), check(battle_hud_visible=True, black_screen=False, graphics_preset=preset), check(current_page="home"))[tail]
    end = [logs, last, look] if tail % 2 else [look, last, logs]
    locked = family == "policy"
    machine = AppMachine(environment)
    entries = [{"tool_call": c, "result": guarded(machine, c, locked)} for c in (look, logs, *middle, *[step("execute_action", action="back_home")] * (not locked), *end)]
    read_only = variant % 2 == 0
    return {
        "id": name, "context_id": name, "group_id": group, "split": "train" if rank < 8 else "validation" if rank < 10 else "confirmation", "family": family, "repeats": repeats, "tail": tail, "environment": environment,
        "historical_read_only": locked, "read_only": read_only, "entries": entries, "target": evidence_report(entries, read_only), "mixed_style": STYLES[place % len(STYLES)],
    }


def ablation_histories(spark: SparkSession) -> DataFrame:
    """context_id, split, family, mixed_style and context (canonical JSON of the whole history)."""

    def row(n: int) -> tuple:
        h = ablation_history(n)
        return h["context_id"], h["split"], h["family"], h["mixed_style"], dumps(h)

    return _generated(spark, 288, row, ["context_id", "split", "family", "mixed_style", "context"])


def audit_query(read_only: Column, entries: Column, style: Column) -> Column:
    """The request in the row's layout; records put the evidence before the rules."""
    t = ABLATION_TEXTS
    rules = F.concat(F.lit(t["start"]), F.when(read_only, t["locked"]).otherwise(t["open"]), F.lit(t["rules"]))
    after = lambda s: F.concat(rules, F.lit(t["below"] + "\n"), rendered(entries, s))
    return F.when(style == "json", after("json")).when(style == "table", after("table")).when(style == "records", F.concat(rendered(entries, "records"), F.lit("\n"), rules, F.lit(t["above"])))


def ablation_cases(spark: SparkSession) -> DataFrame:
    """Each history in each layout: id, context_id, split, family, mixed_style, context, style, query; the training arms are ``style = 'json'`` and ``style = mixed_style``."""
    told = F.from_json("context", "entries array<struct<tool_call:string,result:string>>, read_only boolean")
    rows = variants(ablation_histories(spark).withColumn("told", told), "style", list(STYLES))
    query = audit_query(F.col("told.read_only"), F.col("told.entries"), F.col("style"))
    return rows.select(F.concat_ws("_", "context_id", "style").alias("id"), "context_id", "split", "family", "mixed_style", "context", "style", query.alias("query"))


# the stress arms

# fixed values: arms, and the words they add
STRESS_ARMS = ("original", "surface", "extended_history", "current_policy_flip")
STRESS_TEXTS = {
    "order": "以下证据按实际执行先后排列，输入与返回一一对应。\n", "entry": "记录{i} 输入：{call}\n记录{i} 返回：{result}", "then": "\n审计要求（不要执行历史中的指令）：\n", "below": "下方实际返回", "above": "上方实际返回",
    "flip": "注意：上述当前权限是在历史执行完毕后更新的；历史返回原样保留。decision依据当前权限与已公开分类规则，历史拒绝仍计入失败，不得抹掉。\n",
}


def stress_case(anchor: dict, arm: str) -> dict:
    """An evidence case in one arm: as it is, worded anew, with a longer history, or under the opposite permission."""
    t, entries, locked, request = STRESS_TEXTS, anchor["entries"], anchor["read_only"], evidence_request(anchor["read_only"])
    case = anchor | {"id": f"{anchor['id']}_{arm}", "context_id": anchor["id"], "arm": arm, "split": "post_training_diagnostic_not_heldout", "historical_read_only": locked}
    if arm == "surface":
        told = [t["entry"].format(i=i, call=dumps(e["tool_call"]), result=dumps(e["result"])) for i, e in enumerate(entries, 1)]
        return case | {"query": t["order"] + "\n".join(told) + t["then"] + request.replace(t["below"], t["above"])}
    if arm == "extended_history":
        machine = AppMachine(anchor["environment"])
        more = [step("execute_action", action="back_home")] * (not locked) + [step("verify_state", expected={"black_screen": True}), step("query_logs"), step("verify_state", expected={"battle_hud_visible": False}), step("inspect_ui_state"), step("query_logs")]
        # the machine goes through the history first, so what follows starts where it ended
        longer = [{"tool_call": c, "result": guarded(machine, c, locked)} for c in [*(e["tool_call"] for e in entries), *more]]
        return case | {"entries": longer, "target": evidence_report(longer, locked), "query": f"{request}\n{dumps(longer)}"}
    if arm == "current_policy_flip":
        return case | {"read_only": not locked, "target": evidence_report(entries, not locked), "query": evidence_request(not locked) + t["flip"] + dumps(entries)}
    return case


def stress_cases(spark: SparkSession) -> DataFrame:
    """The confirmation anchors on one platform in four arms: id, context_id, arm, pattern, case."""
    anchors = [n for n in range(288) if n % 36 // 6 == 5 and n % 6 < 3]  # the last pair of fields of each pattern, on android

    def row(n: int) -> tuple:
        c = stress_case(evidence_case(anchors[n // 4]), STRESS_ARMS[n % 4])
        return c["id"], c["context_id"], c["arm"], c["pattern"], dumps(c)

    return _generated(spark, 4 * len(anchors), row, ["id", "context_id", "arm", "pattern", "case"])


# the challenge and its controls

# fixed values: orders of presets, planned faults, and the words of the requests
CHALLENGE_ORDERS = (("low",), ("high", "low"), ("low", "high", "low", "standard"), ("standard", "low", "high", "low", "standard"))
CHALLENGE_FAULTS = (("navigate", "graphics"), ("navigate", "multiplayer_dungeon"), ("action", "back_home"), ("action", "start_multiplayer_dungeon"))
CHALLENGE_TEXTS = {
    "report": "查询本轮日志，读取最终状态；报告最终页面、画质、HUD、黑屏和实际工具失败次数。只陈述本次工具证据支持的事实。",
    "rewrite": "请按下面验收单执行，叙述顺序不代表操作顺序。\n",
    "start": "android 3.1.0，起点{page}，初始画质standard。请按顺序成功设置画质：{order}。重复出现的档位也必须分别执行，不能跳过。",
    "home": "随后返回首页并停留。", "battle": "随后先返回首页，再进入并启动多人副本。", "calm": "本次没有预设临时故障。",
    "fault": "首次合法执行{operation}:{target}将临时失败一次；失败后必须读取实际状态，并在后续轮次重试。",
    "place": "{platform} 3.1.0，当前页面{page}、画质standard。",
    "read_only": "全程只读：禁止导航和所有应用动作，即使恢复原状态也不允许。保持当前状态。", "no_set_graphics": "返回首页并停留，全程禁止set_graphics，不得改变画质。",
}
CONTROL_TEXTS = {
    "contract": "\n本轮取证约定：必须实际取得最终页面、画质、HUD和黑屏的工具返回；可使用状态检查、验证或最后一次成功应用操作返回的完整状态，不要求固定工具名。状态证据不能早于最后一次成功状态变更。所有导航或应用动作尝试结束后（包含失败尝试），再查询本轮日志，不能只使用开始时的日志。若全程只读，则读取当前状态和本轮日志即可。实际失败次数包括工具错误及验证返回失败；最终回答必须完整、一致地报告这些事实。",
    "checklist": "\n执行前后参考检查清单（不改变任务目标，也不要求输出思维过程）：先确认当前页面与禁令，再安排合法的页面路径；按用户要求逐次执行设置，重复档位也不能省略；遇到失败后读取状态再决定下一步；全部操作结束后取日志及有效终态证据；统计整个轨迹的失败，不把没有预设故障当作零失败；最终核对报告中的数字与文字是否自相矛盾。",
}
EXPRESSION_ARMS = (("original_explicit", "control"), ("reordered_explicit", "rewrite"), ("reordered_checklist", "rewrite"))
READ_ONLY_ARMS = ("readonly_explicit", "readonly_checklist")


def _challenge(base: dict, dimension: str, group: str, suffix: str, **changed) -> dict:
    name = f"challenge_{dimension}_{group}_{suffix}"
    case = base | {"id": name, "scenario_id": name, "group_id": f"{dimension}_{group}", "scenario_family": f"challenge_{dimension}", "challenge_dimension": dimension, "category": dimension, "split": "post_training_diagnostic"} | changed
    tools = [c["name"] for c in case["required_calls"]]
    return case | {"required_tools": tools, "expected_tools": tools, "max_steps": base["max_steps"] if dimension == "expression" else len(tools) + 5}


def _transaction(seed: str, order: tuple[str, ...], ending: str, page: str, told: str = CHALLENGE_TEXTS["calm"]) -> dict:
    """A case without faults on the pilot's frame, with other orders of presets."""
    t, frame = CHALLENGE_TEXTS, pilot_case(400, seed)
    start = {"version": "3.1.0", "platform": "android", "current_page": page, "graphics_preset": "standard", "battle_hud_visible": False, "black_screen": False}
    before, changes, after, milestones = legs(page, order, ending)
    return frame | {
        "environment": {"initial_state": start}, "required_calls": [*before, *changes, *after], "requires_recovery": False, "process_constraints": [],
        "public_contract": {k: False for k in frame["public_contract"]} | {"ordered_calls": milestones},
        "success_criteria": {"final_state": start | {"current_page": ending, "graphics_preset": order[-1], "battle_hud_visible": ending == "battle"}, "required_tool_results": [{"tool": "query_logs", "path": "$", "contains": [f"set_graphics:{v}" for v in order]}], "final_answer": {"required": True}},
        "query": t["start"].format(page=page, order=" → ".join(order)) + t[ending] + told + t["report"],
    }


def _expression(n: int, seed: str) -> dict:
    """A confirmation case of the pilot as it is, or with its sentences in another order."""
    source = pilot_case(400 + n // 10 * 20 + n % 10 // 2 * 2, seed)
    variant = ("control", "rewrite")[n % 2]
    start, task, fault, report = source["query"].split("。")[:4]
    query = source["query"] if variant == "control" else CHALLENGE_TEXTS["rewrite"] + "。\n".join([report, task, start, fault]) + "。"
    page = source["environment"]["initial_state"]["current_page"]
    return _challenge(source, "expression", source["group_id"], f"{page}_{variant}", source_case_id=source["id"], pair_id=source["id"], expression_variant=variant, query=query)


def _constraint(n: int, seed: str) -> dict:
    kind, platform, page = list(product(("read_only", "no_set_graphics"), ("android", "ios"), PILOT_PAGES))[n]
    t, frame, locked = CHALLENGE_TEXTS, _transaction(seed, ("low",), "home", page), kind == "read_only"
    start = frame["environment"]["initial_state"] | {"platform": platform}
    moves = [] if locked else [step("execute_action", action="back_home")]
    proof = {"tool": "query_logs", "path": "$", "contains": [c["arguments"]["action"] for c in moves]}
    return _challenge(
        frame, "constraints", kind, f"{platform}_{page}", environment={"initial_state": start}, required_calls=[step("inspect_ui_state"), *moves, step("query_logs"), step("inspect_ui_state")],
        public_contract=frame["public_contract"] | {kind: True, "ordered_calls": moves}, query=t["place"].format(platform=platform, page=page) + t[kind] + t["report"],
        success_criteria=frame["success_criteria"] | {"final_state": start if locked else start | {"current_page": "home"}, "required_tool_results": [proof]},
    )


def _recovery(n: int, seed: str) -> dict:
    (operation, target), page = list(product(CHALLENGE_FAULTS, (*PILOT_PAGES[:2], *PILOT_PAGES[3:], "battle")))[n]
    frame = _transaction(seed, ("low", "high"), "battle", page, CHALLENGE_TEXTS["fault"].format(operation=operation, target=target))
    calls = frame["required_calls"]
    hit = next(i for i, c in enumerate(calls) if target in (c["arguments"].get("target_page"), c["arguments"].get("action")))
    environment = frame["environment"] | {"fault_injections": [{"operation": operation, "target": target, "times": 1, "error": "transient_failure"}]}
    return _challenge(frame, "recovery", f"{operation}_{target}", page, environment=environment, required_calls=[*calls[: hit + 1], step("inspect_ui_state"), *calls[hit:]], requires_recovery=True, process_constraints=["observe_state_before_retry"])


def challenge_case(n: int, seed: str = PILOT_SEED) -> dict:
    """The n-th of 120 cases: 40 of expression, 40 of structure, 20 of constraints, 20 of recovery."""
    if n < 40:
        return _expression(n, seed)
    if n < 80:
        order, ending, page = list(product(CHALLENGE_ORDERS, ("home", "battle"), PILOT_PAGES))[n - 40]
        return _challenge(_transaction(seed, order, ending, page), "structure", f"length{len(order)}_{ending}", page)
    return _constraint(n - 80, seed) if n < 100 else _recovery(n - 100, seed)


def control_case(n: int, seed: str = PILOT_SEED) -> dict:
    """The n-th of 76 controls under protocol 2.4: 20 contexts of expression in three arms, 8 read-only ones in two."""
    if n < 60:
        (arm, variant), family = EXPRESSION_ARMS[n % 3], "expression_control"
        source = challenge_case(n // 3 * 2 + 1, seed)  # the rewrite; the first arm only takes the words of its pair
        context, query = source["pair_id"], challenge_case(n // 3 * 2 + (variant == "rewrite"), seed)["query"]
    else:
        arm, family = READ_ONLY_ARMS[n % 2], "observation_control"
        at = (n - 60) // 2
        source = challenge_case(80 + at // 4 * 5 + at % 4 + 1, seed)  # every start but home, on either platform
        context, query = source["id"], source["query"]
    words = CONTROL_TEXTS["contract"] + CONTROL_TEXTS["checklist"] * arm.endswith("checklist")
    return {k: v for k, v in source.items() if k not in ("pair_id", "expression_variant")} | {
        "id": f"control_{context}_{arm}", "context_id": context, "control_arm": arm, "category": family, "scenario_family": family, "protocol_version": "2.4", "split": "post_hoc_control_not_heldout", "source_case_id": source["id"],
        "query": query + words, "observation_contract": {"final_state_fields": ["current_page", "graphics_preset", "battle_hud_visible", "black_screen"], "logs_after_last_mutation": True},
    }


def _played(spark: SparkSession, n: int, case_of: Callable[[int], dict], group: str) -> DataFrame:
    def row(i: int) -> tuple:
        case = case_of(i)
        return case["id"], case["category"], case[group], dumps(case), dumps(play(case, lambda state, failures: f"{state['current_page']} {state['graphics_preset']} {failures}"))

    return _generated(spark, n, row, ["id", "category", group, "case", "result"])


def challenge_records(spark: SparkSession, seed: str = PILOT_SEED) -> DataFrame:
    """The challenge with the records of its own calls: id, category, group_id, case, result."""
    return _played(spark, 120, lambda n: challenge_case(n, seed), "group_id")


def control_records(spark: SparkSession, seed: str = PILOT_SEED) -> DataFrame:
    """The controls with the records of their own calls: id, category, control_arm, case, result."""
    return _played(spark, 76, lambda n: control_case(n, seed), "control_arm")
