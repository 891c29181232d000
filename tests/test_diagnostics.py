import hashlib
import json
from collections import Counter

import pytest

from tracemill.functions.jsonx import dumps
from tracemill.operators import diagnostics, machines, scoring, studies


def lines_digest(texts):
    return hashlib.sha256("".join(t + "\n" for t in texts).encode()).hexdigest()


def test_repaired_set_is_the_published_one(spark):
    rows = diagnostics.repaired_cases(spark).collect()
    # fixed values: digests of the published files
    published = {"train": "cd55c720f8eb3425b1533d8c9b4c6d8ac1f2c19b3ffa8a10ce386e539ef30512", "id": "e1168ba190b7dd31d19d0a7ca7b6e209d5847d8fec1607025fcdf8dd0e9873d6", "ood": "f7af23d822944dce2fb27c366a4c3b1960244d84eebebbfdacaec95679fcc24e"}
    assert {s: lines_digest(r.case for r in rows if r.split == s) for s in published} == published
    assert len({(r.scenario, r.desired) for r in rows}) == len(rows) == 160


def test_repaired_cases_are_solved_by_the_teacher(spark):
    for r in diagnostics.repaired_cases(spark).limit(40).collect():
        events, report = machines.teach(json.loads(r.scenario), json.loads(r.desired))
        assert machines.judge(json.loads(r.scenario), json.loads(r.desired), events, json.dumps(report))["task_success"]


def test_draws_are_disjoint_and_best_first():
    drawn = diagnostics.drawn_once(["a", "b"], list(range(7)), 3, lambda g, v: f"{v if g == 'a' else 9 - v}")
    assert drawn == {"a": [0, 1, 2], "b": [6, 5, 4]}
    with pytest.raises(ValueError):
        diagnostics.drawn_once(["a", "b"], [1, 2, 3], 2, lambda g, v: str(v))


def test_evidence_set_is_the_published_one(spark):
    cases = [studies.evidence_case(n) for n in range(288)]
    # fixed values: digests of the published files
    published = {"train": "7dfb7724b888a3a5af628d5764b46d3de8e6946693025234371213d53067706b", "validation": "6871b3e46f845463d5196bea42be3202b0c1e286576fa034d0f087a238e6b602", "confirmation": "0c7428d03b948052a7ddb445e4411808c587479756a3ca3d63d83bf1cfc14e10"}
    assert {s: lines_digest(dumps(c) for c in cases if c["split"] == s) for s in published} == published


def test_stress_set_is_the_published_one(spark):
    rows = diagnostics.stress_cases(spark).collect()
    assert len(rows) == 96 and lines_digest(r.case for r in rows) == "b719102da5c6c37c7e942baff1e61de7892b44febbfae6b4dd9d947f396a9584"


def test_ablation_set_is_the_published_one(spark):
    histories = diagnostics.ablation_histories(spark).collect()
    # fixed values: digests of the published files
    published = {"train": "271372b51dc8545646ac68ab28ca587a0cd084225765e9a5315ab84fbf4fc27e", "validation": "5932bffa2bec87defbff47b5ef2065aafdaa22da6533fc9c657423ceee5d6b40", "confirmation": "b9936a8357f18a6481d6142b8cb28ae36815a99dc544c22e47ccb0c68afb6019"}
    assert {s: lines_digest(r.context for r in histories if r.split == s) for s in published} == published
    rows = diagnostics.ablation_cases(spark).collect()
    whole = lambda r: dumps(json.loads(r.context) | {"id": r.id, "style": r.style, "query": r.query})
    styled = {"validation": "3e28d735b4ae262b9cc55b7588096f3bf4c6707764e502e00f27d379c736c29c", "confirmation": "a264132c241edcb947bde0ccb0a9286eb31abc3d5f31d5fa0ce0959cab797fd6"}
    assert {s: lines_digest(whole(r) for r in rows if r.split == s) for s in styled} == styled


def test_arguments_that_do_not_fit():
    machine = machines.AppMachine({})
    assert machine.run({"name": "navigate_ui", "arguments": {}})["error"] == "navigate_ui() missing 1 required positional argument: 'target_page'"
    assert machine.run({"name": "query_logs", "arguments": {"n": 1}})["error"] == "query_logs() got an unexpected keyword argument 'n'"


def test_challenge_counts_and_every_case_passes_by_its_own_calls(spark):
    rows = diagnostics.challenge_records(spark).collect()
    assert Counter(r.category for r in rows) == {"expression": 40, "structure": 40, "constraints": 20, "recovery": 20}
    assert len({r.id for r in rows}) == 120 and len({r.group_id for r in rows}) == 18
    for r in rows:
        assert scoring.score_record(json.loads(r.case), json.loads(r.result))["execution_success"], r.id


def test_controls_counts_and_every_case_passes_by_its_own_calls(spark):
    rows = diagnostics.control_records(spark).collect()
    assert Counter(r.control_arm for r in rows) == {"original_explicit": 20, "reordered_explicit": 20, "reordered_checklist": 20, "readonly_explicit": 8, "readonly_checklist": 8}
    assert len({json.loads(r.case)["context_id"] for r in rows}) == 28 and len({r.id for r in rows}) == 76
    for r in rows:
        case, result = json.loads(r.case), json.loads(r.result)
        assert scoring.score_record(case, result)["execution_success"], r.id
        late = result | {"trajectory": [t for t in result["trajectory"] if t["parsed_tool_calls"][0]["tool_call"]["name"] != "query_logs"]}
        assert not scoring.score_record(case, late)["execution_success"], r.id


def test_rewrites_keep_every_sentence():
    pairs = [(diagnostics.challenge_case(n), diagnostics.challenge_case(n + 1)) for n in range(0, 40, 2)]
    for told, anew in pairs:
        body = anew["query"].removeprefix(diagnostics.CHALLENGE_TEXTS["rewrite"]).replace("\n", "")
        assert told["pair_id"] == anew["pair_id"] and sorted(told["query"].split("。")) == sorted(body.split("。")) and told["query"] != body
