import json
import random

from pyspark.sql import functions as F

from tracemill.operators import machines, reports


def test_reports_equal_the_row_version(spark):
    rng = random.Random(2)
    tools = [*reports.READ_TOOLS, "navigate_ui", "execute_action"]
    cases, rows = {}, []
    for c in range(80):
        entries = []
        for i in range(rng.randrange(9)):
            tool = rng.choice(tools)
            if rng.random() < 0.35:
                result = {"ok": False, "error_type": rng.choice(["TypeError", "policy_blocked", "RuntimeError"]), "error": rng.choice(["x", "a transient_failure"])}
            else:
                state = {f: rng.choice(["a", "b", True]) for f in machines.EVIDENCE_FIELDS}
                result = {"ok": True, "result": {"success": rng.random() < 0.5, "current_state": state, "matches": {}} if tool == "verify_state" else [1] * rng.randrange(3) if tool in ("query_logs", "search_knowledge") else state}
            entries.append({"tool_call": {"name": tool}, "result": result})
            rows.append((c, i, tool, result["ok"], result.get("error_type"), result.get("error"), json.dumps(result["result"]) if "result" in result else None, c % 2 == 0))
        cases[c] = entries
    df = spark.createDataFrame(rows, "case_id int, idx int, tool string, ok boolean, error_type string, error string, payload_json string, locked boolean")
    got = {r.case_id: r for r in reports.evidence(df, F.bool_or("locked")).collect()}
    for c, entries in cases.items():
        if not entries:
            continue
        want, r = machines.evidence_report(entries, c % 2 == 0), got[c]
        assert (r.tool_errors, r.verification_failures, r.policy_blocks, r.total_failures, r.log_count, r.decision) == tuple(want[k] for k in ("tool_errors", "verification_failures", "policy_blocks", "total_failures", "log_count", "decision"))
        assert {f: json.loads(r.state or "{}").get(f) for f in want["state"]} == want["state"] and bool(r.state) == bool(want["state"])


def test_policy_and_domains(spark):
    rows = [("a", 1, "navigate_ui", True), ("a", 2, "inspect_ui_state", True), ("b", 1, "navigate_ui", True), ("a", 3, None, True)]
    df = spark.createDataFrame(rows, "case_id string, idx int, tool string, ok boolean").selectExpr("*", "null AS error_type", "null AS error", "'{}' AS payload_json")
    got = {(r.case_id, r.idx): (r.dispatched, r.ok, r.error_type, r.payload_json) for r in reports.under_policy(df, F.when(F.col("case_id") == "a", True)).collect()}
    assert got == {("a", 1): (False, False, "policy_blocked", None), ("a", 2): (True, True, None, "{}"), ("b", 1): (True, True, None, "{}"), ("a", 3): (False, False, "policy_blocked", None)}
    texts = [('{"q":"low","c":true}', None), ('{"c":false,"q":"high"}', None), ('{"q":"low","c":1}', "bad c"), ('{"q":"mid","c":true}', "bad q"), ('{"q":"low"}', "other fields"), ('{"q":"low","c":true,"x":1}', "other fields"), ("[1]", "no object"), ("{bad", "no object"), (None, "no object"), ('{"q":null,"c":true}', "bad q")]
    df = spark.createDataFrame(texts, "j string, want string").select("*", reports.config_fault(F.col("j"), {"q": ("low", "high"), "c": "boolean"}).alias("got"))
    assert all(r.got == r.want for r in df.collect())
