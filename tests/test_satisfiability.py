import json
from copy import deepcopy

from tracemill.operators import diagnostics, satisfiability, studies


def test_generated_cases_are_satisfiable(spark):
    for cases in (diagnostics.challenge_records(spark), diagnostics.control_records(spark)):
        assert all(r.satisfiable and r.contradictions == [] for r in satisfiability.satisfiability(cases).collect())


def test_each_contradiction_is_named():
    case = studies.pilot_case(10)
    assert satisfiability.contradictions(case) == []
    calls = case["required_calls"]
    spoilt = deepcopy(case)
    spoilt["required_calls"] = [{"name": "nothing", "arguments": {}}, *calls]
    assert satisfiability.contradictions(spoilt) == ["call:0"]
    spoilt = deepcopy(case)
    spoilt["environment"]["fault_injections"] = [{"operation": "navigate", "target": "home", "times": 2, "error": "x"}]
    assert "fault:navigate:home" in satisfiability.contradictions(spoilt)
    spoilt = deepcopy(case)
    spoilt["success_criteria"]["final_state"] |= {"black_screen": 0, "unknown": None}  # zero is not false, and no field is not null
    assert satisfiability.contradictions(spoilt) == ["state:black_screen", "state:unknown"]
    spoilt = deepcopy(case)
    spoilt["success_criteria"]["required_tool_results"] = [{"tool": "query_logs", "path": "$", "contains": "set_graphics:none"}, {"tool": "search_knowledge", "path": "$[0].id", "equals": "k1"}]
    assert satisfiability.contradictions(spoilt) == ["result:0", "result:1"]
    spoilt["required_calls"] = [*calls, {"name": "search_knowledge", "arguments": {"query": "x"}}]
    assert satisfiability.contradictions(spoilt, {"search_knowledge": lambda query: [{"id": "k1"}]}) == ["result:0"]


def test_a_planned_fault_must_be_spent_by_a_call_that_is_otherwise_valid():
    case = studies.pilot_case(10)
    start = case["environment"]["initial_state"] | {"current_page": "home"}
    fault = {"operation": "action", "target": "set_graphics", "times": 1, "error": "x"}
    tries = [{"name": "execute_action", "arguments": {"action": "set_graphics", "value": "low"}}]  # refused at home, so the fault stays
    made = {"environment": {"initial_state": start, "fault_injections": [fault]}, "required_calls": tries, "success_criteria": {"final_state": {}, "required_tool_results": []}}
    assert satisfiability.contradictions(made) == ["call:0", "fault:action:set_graphics"]
    assert satisfiability.contradictions(made | {"environment": {"initial_state": start | {"current_page": "graphics"}, "fault_injections": [fault]}}) == []


def test_odd_rows(spark):
    good = json.dumps(studies.pilot_case(0))
    rows = [(1, good, "a"), (1, good, "a"), (None, good, None), (2, None, "b"), (3, "", "c"), (4, "[]", "d"), (5, "{}", None), (6, '{"environment": {}, "required_calls": null, "success_criteria": {}}', None), (7, '{"environment": {"platform": 3}, "required_calls": [], "success_criteria": {}}', None)]
    cases = spark.createDataFrame(rows, "id bigint, case string, satisfiable string")
    got = satisfiability.satisfiability(cases).collect()
    assert sorted((r.id or 0, r.satisfiable) for r in got) == [(0, True), (1, True), (1, True), *((i, False) for i in range(2, 8))]
    assert all(r.contradictions == ["unreadable"] for r in got if not r.satisfiable)
    assert satisfiability.satisfiability(cases.limit(0)).count() == 0
