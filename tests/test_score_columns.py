import json
import random

from tests.test_normalise import CALL, RECORDS
from tracemill.operators import normalise, score_columns, scoring

NAMES = ["go", "navigate_ui", "execute_action", "query_logs"]


def case(rng):
    out = {"id": "x"}
    spec = lambda: rng.choice([rng.choice(NAMES), {"name": rng.choice(NAMES)}, {"tool": rng.choice(NAMES)}, 5, None, ""])
    for key in ("required_tools", "required_calls", "optional_tools", "expected_tools"):
        if rng.random() < 0.5:
            out[key] = [spec() for _ in range(rng.randrange(4))] if key != "expected_tools" else [rng.choice(NAMES) for _ in range(rng.randrange(4))]
    if rng.random() < 0.8:
        out["environment"] = {"fault_injections": [rng.choice([None, {"operation": rng.choice([*NAMES, "navigate", "action"]), "target": rng.choice(["home", "set", None]), "times": rng.choice([0, 1, 2, -1, True, "2"])}, {"operation": rng.choice(NAMES)}]) for _ in range(rng.randrange(4))]}
    return out


def result(rng):
    def entry():
        name = rng.choice(NAMES)
        call = {"name": name, "arguments": rng.choice([{}, {"target_page": "home"}, {"action": "set"}, [1], {"action": None}])}
        back = {"ok": rng.random() < 0.4, "error_type": rng.choice(["RuntimeError", " runtimeerror", "unknown-tool", "Invalid_Transition", "PreconditionFailed", "E", None]), "error": rng.choice(["x", "注入的临时故障: y", "you cannot navigate", None]), "invalid_transition": rng.choice([True, False, 1, None])}
        return {"valid": rng.random() < 0.9, "tool_call": call}, {"tool_call": call, "result": back}

    steps = []
    for _ in range(rng.randrange(5)):
        made = [entry() for _ in range(rng.randrange(4))]
        steps.append({"parsed_tool_calls": [a for a, _ in made], "tool_results": [b for _, b in made]})
    return {"trajectory": steps}


def test_columns_equal_the_row_version(spark):
    rng = random.Random(11)
    rows = [(f"r{i}", json.dumps(case(rng), ensure_ascii=False), json.dumps(result(rng), ensure_ascii=False)) for i in range(300)]
    rows += [(f"o{i}", json.dumps(case(rng), ensure_ascii=False), json.dumps(r, ensure_ascii=False)) for i, r in enumerate(RECORDS)] + [("bad", "{bad", json.dumps({"trajectory": [{"tool_call": CALL, "result": 1}]})), ("none", None, None)]
    df = spark.createDataFrame(rows, "id string, case string, result string")
    got = {r["case_id"]: r.asDict() for r in score_columns.execution_metrics(normalise.event_tables(df), df.selectExpr("id AS case_id", "case")).collect()}
    assert len(got) == len(rows)
    for name, c, r in rows:
        own = [json.loads(x) if x and x != "{bad" else {} for x in (c, r)]
        want = scoring.score(*own)
        for k, v in got[name].items():
            if k != "case_id":
                assert v == want[k] or abs(v - want[k]) < 1e-12, (name, k, v, want[k])


def test_no_python(spark):
    df = spark.createDataFrame([("a", "{}", "{}")], "id string, case string, result string")
    plan = score_columns.execution_metrics(normalise.event_tables(df), df.selectExpr("id AS case_id", "case"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
