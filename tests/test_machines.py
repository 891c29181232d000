import itertools
import json

import pytest

from tracemill.operators import machines, replay
from tracemill.sources import generators

LOW, HIGH, STD = ({"quality": q, "cache_enabled": True} for q in ("low", "high", "standard"))
GRID = list(itertools.product((0, 1, 2), (False, True), (None, STD), (False, True), (0, 2)))


@pytest.mark.parametrize(("transient", "timeout", "concurrent", "passes", "delay"), GRID)
def test_teacher_passes_its_own_judge_and_follows_the_closed_form(transient, timeout, concurrent, passes, delay):
    scenario = {"initial_config": HIGH, "revision": 7, "transient_commits": transient, "timeout_after_commit": timeout, "concurrent_config": concurrent, "check_passes": passes, "check_delay": delay}
    events, report = machines.teach(scenario, LOW)
    found = machines.judge(scenario, LOW, events, json.dumps(report))
    c = int(concurrent is not None)
    assert found["task_success"] and len(events) == 7 + 4 * (c + transient) + timeout + delay + (not passes)
    assert report["tool_errors"] == c + transient + timeout and report["revision"] == 7 + c + 1 + (not passes)
    assert report["config"] == (LOW if passes else concurrent or HIGH)


def test_forged_or_incomplete_traces_fail():
    scenario = {"initial_config": HIGH, "revision": 1, "check_passes": True}
    events, report = machines.teach(scenario, LOW)
    text = json.dumps(report)
    forged = machines.copied(events)
    forged[3]["result"]["result"]["revision"] = 99
    assert machines.judge(scenario, LOW, forged, text) == {"mismatch_at": 3}
    typed = machines.copied(events)
    typed[0]["result"]["result"]["writable"] = 1
    assert machines.judge(scenario, LOW, typed, text)["mismatch_at"] == 0
    assert not machines.judge(scenario, LOW, events[:-1], text)["execution_success"]
    assert not machines.judge(scenario, LOW, events, text.replace("{", '{"outcome": "applied", ', 1))["answer_correct"]


def test_permission_and_idempotency():
    m = machines.Transactions({"initial_config": HIGH, "writable": False})
    assert m.run({"name": "stage_config", "arguments": {"config": LOW, "base_revision": 1}})["error_type"] == "permission_denied"
    assert m.run({"name": "stage_config", "arguments": {"config": LOW, "base_revision": True}})["error_type"] == "invalid_arguments"
    assert m.run({"name": "nope", "arguments": {}})["error_type"] == "unknown_tool" and m.run([])["error_type"] == "invalid_call"
    m = machines.Transactions({"initial_config": HIGH})
    m.run({"name": "stage_config", "arguments": {"config": LOW, "base_revision": 1}})
    m.run({"name": "validate_candidate", "arguments": {"candidate_id": "candidate_1"}})
    commit = {"name": "commit_candidate", "arguments": {"candidate_id": "candidate_1", "operation_id": "o"}}
    assert m.run(commit)["ok"] and m.run(commit)["result"]["replayed"] and len(m.mutations) == 1
    assert m.run({"name": "rollback", "arguments": {"committed_operation_id": "o", "expected_revision": 2, "operation_id": "o"}})["error_type"] == "idempotency_conflict"
    with pytest.raises(ValueError):
        machines.Transactions({"writable": 1})


def test_application_machine():
    m = machines.AppMachine({"fault_injections": [{"operation": "navigate", "target": "settings"}]})
    go = lambda page: m.run({"name": "navigate_ui", "arguments": {"target_page": page}})
    assert go("graphics")["error_type"] == "ValueError"  # an invalid move does not use up the fault
    assert go("settings")["error_type"] == "RuntimeError" and go("settings")["ok"] and go("graphics")["ok"]
    act = lambda a, v=None: m.run({"name": "execute_action", "arguments": {"action": a, "value": v}})
    assert act("start_multiplayer_dungeon")["error_type"] == "ValueError" and act("back_home")["ok"]
    assert go("dungeon_select")["ok"] and go("multiplayer_dungeon")["ok"] and act("start_multiplayer_dungeon")["result"]["black_screen"]
    assert m.run({"name": "verify_state", "arguments": {}})["error_type"] == "TypeError"
    assert machines.guarded(m, {"name": "navigate_ui", "arguments": {}}, True)["error_type"] == "policy_blocked"


def test_evidence_report():
    m = machines.AppMachine({"initial_state": {"current_page": "graphics"}, "fault_injections": [{"operation": "action", "target": "set_graphics"}]})
    calls = [{"name": "inspect_ui_state", "arguments": {}}, {"name": "execute_action", "arguments": {"action": "set_graphics", "value": "low"}}, {"name": "verify_state", "arguments": {"expected": {"black_screen": True}}}, {"name": "query_logs", "arguments": {}}]
    report = machines.evidence_report([{"tool_call": c, "result": m.run(c)} for c in calls], False)
    assert (report["tool_errors"], report["verification_failures"], report["log_count"], report["decision"]) == (1, 1, 1, "inspect_before_retry")
    assert machines.evidence_score(json.dumps(report), report)["exact_report"] and not machines.evidence_score("{", report)["valid_json"]


def test_study_counts_are_the_published_ones(spark):
    cases = generators.transaction_cases(spark)
    counts = {r["split"]: r["count"] for r in cases.groupBy("split").count().collect()}
    assert counts == {"train": 2058, "dev": 256, "confirmation_id": 128, "confirmation_ood": 400}
    assert cases.select("case_id").distinct().count() == 2842


def test_audit_over_tables(spark):
    cases = generators.transaction_cases(spark).filter("split = 'dev'").limit(20)
    traces = replay.teacher_traces(cases).cache()
    assert replay.audit(traces).filter("task_success").count() == 20
    from pyspark.sql import functions as F

    long = traces.select("case_id", F.explode("events").alias("e")).select("case_id", "e.*")
    again = replay.packed(long).join(traces.drop("events"), "case_id")
    assert replay.audit(again).filter("task_success").count() == 20
    row = traces.select(replay.shape(F.col("events")).alias("s"), replay.receipts(F.col("events")).alias("r")).first()
    assert json.loads(row.s)[0] == ["inspect_workspace", "ok"] and set(row.r) == {"apply"}
