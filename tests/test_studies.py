import json

from pyspark.sql import functions as F

from tracemill.operators import audits, scoring, studies, trace
from tracemill.sources import sinks


def test_every_pilot_call_fits_its_schema_and_mutations_fail(spark):
    case = studies.pilot_case(3)
    assert all(studies.argument_fault(c) is None for c in case["required_calls"])
    bad = [({"name": "x"}, "unknown tool"), ({"name": "query_logs", "arguments": 1}, "arguments are no object"), ({"name": "query_logs", "arguments": {"z": 1}}, "unknown argument z"), ({"name": "navigate_ui", "arguments": {"target_page": "home"}}, "bad target_page"), ({"name": "execute_action", "arguments": {"action": "set_graphics"}}, "bad value"), ({"name": "verify_state", "arguments": {}}, "bad expected")]
    assert [studies.argument_fault(c) for c, _ in bad] == [w for _, w in bad]
    result = studies.play(case, lambda s, f: "done")
    assert scoring.score_record(case, result)["execution_success"]
    silent = result | {"trajectory": [t for t in result["trajectory"] if t["parsed_tool_calls"][0]["tool_call"]["name"] != "query_logs"]}
    assert not scoring.score_record(case, silent)["execution_success"]


def test_facts_of_traces(spark):
    records = studies.pilot_records(spark).limit(5)
    facts = audits.trace_facts(trace.event_tables(records).filter("kind = 'execution'")).collect()
    by = {r.id: json.loads(r.result) for r in records.collect()}
    for r in facts:
        assert json.loads(r.latest_state) == by[r.case_id]["final_environment_state"] and r.logs_read == 1
        assert r.failures == sum(not t["tool_results"][0]["result"]["ok"] for t in by[r.case_id]["trajectory"])


def test_fact_sheets_show_only_what_returns_prove(spark):
    state = '{"current_page":"home","graphics_preset":"low","battle_hud_visible":false,"black_screen":false}'
    log = [
        ("a", 0, "inspect_ui_state", True, None, state), ("a", 1, "execute_action", True, None, '{"graphics_preset":"high"}'), ("a", 2, "verify_state", True, None, '{"success":false,"current_state":{"black_screen":1,"battle_hud_visible":true}}'),
        ("a", 3, "query_logs", True, None, "[]"), ("a", 4, "navigate_ui", False, "policy_blocked", None),
        ("b", 0, "inspect_ui_state", True, None, state), ("b", 1, "get_build_info", True, None, '{"version":"1"}'), ("b", 2, "query_logs", True, None, '["x"]'),
        ("c", 0, "query_logs", None, None, None),
    ]
    rows = spark.createDataFrame(log, "case_id string, idx bigint, tool string, ok boolean, error_type string, payload_json string")
    got = {r.case_id: r for r in audits.fact_sheet(audits.observed_facts(rows)).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.current_page, a.graphics_preset, a.battle_hud_visible, a.black_screen) == (None, '"high"', "true", None)
    assert (a.failures, a.policy_blocks, a.mutations, a.inspections, a.logs_read, a.logs_after_last_attempt) == (2, 1, 1, 1, 1, False)
    assert (b.current_page, b.black_screen, b.failures, b.logs_after_last_attempt, b.unknown_status) == ('"home"', "false", 0, True, 0)
    assert c.unknown_status == 1 and c.current_page is None
    assert '画质="high"。' in a.sheet and "最终页面=未知（缺少有效观测）。" in a.sheet and "实际失败2次，其中策略拦截1次；" in a.sheet and b.sheet.count("\n") == 8
    assert audits.observed_facts(rows.limit(0)).count() == 0


def test_dpo_logs_and_inherited_reviews(spark):
    log = spark.createDataFrame([("a", 0.0, 0.0, 0.6931471805599453, 0.0, 0.05, 7), ("b", 0.0, 0.0, 0.5, 0.0, 0.05, 7), ("c", 0.0, 0.0, 0.0, 0.0, 0.0, 1)], "case_id string, chosen double, rejected double, loss double, margin double, coefficient double, tokens int")
    ref = spark.createDataFrame([("a", 0.0, 0.0, 7), ("b", 0.0, 0.0, 8)], "case_id string, chosen double, rejected double, tokens int")
    assert {r.case_id: r.wrong for r in audits.dpo_drift(log, ref).collect()} == {"b": ["tokens", "loss"], "c": ["unknown"]}
    old, new = (spark.createDataFrame([("1", '{"a": 1, "b": 2}'), ("2", x)], "id string, result string") for x in ("{}", "[]"))
    reviews = spark.createDataFrame([("1", "pass"), ("2", "pass")], "id string, verdict string")
    assert [r.id for r in audits.inherited(old, new.replace('{"a": 1, "b": 2}', '{"b":2,"a":1}'), reviews).collect()] == ["1"]


def test_revisions(spark):
    rows = [("1", "请用事件编号查", "knowledge_hud", True, ["held_out", "x"], ["get_build_info"]), ("2", "不要改变界面", "recovery_action", True, [], [])]
    cases = spark.createDataFrame(rows, "id string, query string, scenario_family string, requires_recovery boolean, tags array<string>, tools array<string>")
    one = audits.revised_queries(cases).orderBy("id").collect()
    assert one[0].query == "请用事件编号 INC-102查" and [r.requires_new_inference for r in one] == [True, False]
    two = audits.process_contracts(cases).orderBy("id").collect()
    assert two[0].fault and two[1].process_constraints == ["observe_state_before_retry"]
    three = audits.public_contracts(cases).orderBy("id").collect()
    assert three[0].public_contract.build_evidence and three[0].tags == ["x"] and three[1].public_contract.read_only


def test_store_and_digests(spark, tmp_path):
    examples = spark.range(25).select(F.col("id").alias("ordinal"), F.array(F.col("id")).alias("input_ids"))
    assert sinks.example_store(examples, str(tmp_path / "s"), per_file=10) == 25
    assert sinks.example(spark, str(tmp_path / "s"), 7) == {"ordinal": 7, "input_ids": [7]} and sinks.example(spark, str(tmp_path / "s"), 99) is None
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a").write_text("x")
    before = audits.folder_digest(str(tmp_path / "d"))
    (tmp_path / "d/a").write_text("y")
    assert before != audits.folder_digest(str(tmp_path / "d"))
