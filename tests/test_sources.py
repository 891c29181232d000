import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import maths, text
from tracemill.operators import audits, selection, tokens
from tracemill.sources import jsonl, sinks


def put(path, rows, end="\n"):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + end, encoding="utf-8")
    return str(path)


def test_strict_cases(spark, tmp_path):
    good = put(tmp_path / "a.jsonl", [{"id": "1", "query": "x"}, "", {"id": "2", "query": "y"}])
    assert [r.id for r in jsonl.load_cases(spark, good).orderBy("line").collect()] == ["1", "2"]
    for bad, why in ((["{"], "not JSON"), (["[1]"], "not an object"), ([{"id": 1, "query": "x"}], "bad id"), ([{"id": "1", "query": "x"}] * 2, "repeated id"), ([{"id": "1", "query": " "}], "bad query")):
        path = put(tmp_path / "b.jsonl", bad)
        with pytest.raises(ValueError, match=f"b.jsonl:{len(bad)}: {why}"):
            jsonl.load_cases(spark, path)
    mixed = put(tmp_path / "c.jsonl", [{"id": "1", "query": "x"}, "{"])
    assert jsonl.load_cases(spark, mixed, limit=1).count() == 1


def record(i, fingerprint="f", **more):
    return {"case": {"id": str(i), "query": "q"}, "result": {"trajectory": []}, "run_metadata": {"fingerprint": fingerprint, "selected_case_count": 3}} | more


def test_records_of_one_run(spark, tmp_path):
    rows = jsonl.load_records(spark, put(tmp_path / "a.jsonl", [record(1), record(2)]))
    assert rows.count() == 2 and jsonl.run_coverage(rows).first().coverage == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="fingerprint"):
        jsonl.load_records(spark, put(tmp_path / "b.jsonl", [record(1), record(2, "g")]))
    with pytest.raises(ValueError, match="differ"):
        jsonl.load_records(spark, put(tmp_path / "c.jsonl", [record(1, evaluator_version="2.1")]))


def test_resume_drops_only_a_torn_tail(spark, tmp_path):
    torn = put(tmp_path / "a.jsonl", [record(1), '{"case": {"id"'], end="")
    assert [r.id for r in jsonl.resume(spark, torn, "f").collect()] == ["1"]
    with pytest.raises(ValueError, match="not JSON"):
        jsonl.resume(spark, put(tmp_path / "b.jsonl", ["{", record(1)]))
    with pytest.raises(ValueError, match="another run"):
        jsonl.resume(spark, torn, "other")
    selected = spark.createDataFrame([("1",), ("2",)], "id string")
    assert [r.id for r in jsonl.pending(selected, jsonl.resume(spark, torn)).collect()] == ["2"]


def test_reviews_bind_to_records(spark, tmp_path):
    known = spark.createDataFrame([("1", "s1", "2.2"), ("2", "s2", "2.0")], "id string, record_sha256 string, protocol string")
    base = {"source_sha256": "src", "verdict": "pass", "reason": "r", "reviewer": "x", "reviewer_type": "human", "reviewed_at": "now"}
    rows = [base | {"id": "1", "record_sha256": "s1", "protocol_version": "2.2"}, base | {"id": "1", "record_sha256": "s1", "protocol_version": "2.2"}, base | {"id": "2", "record_sha256": "old", "protocol_version": "2.1"}, base | {"id": "9", "record_sha256": "s1", "protocol_version": "2.2"}]
    got = [r.violation for r in jsonl.reviews(spark, put(tmp_path / "r.jsonl", rows), known, "src").orderBy("line").collect()]
    assert got == [None, "repeated id", "stale", "unknown id"]


def test_documents_checkpoints_and_manifests(spark, tmp_path):
    put(tmp_path / "notes.json", [json.dumps([{"a": 1}, {"b": [2]}], indent=1)])
    assert sorted((r.source, r.content) for r in jsonl.documents(spark, str(tmp_path / "*.json")).collect()) == [("notes.json", '{"a":1}'), ("notes.json", '{"b":[2]}')]
    for step, names in ((1, "ab"), (2, "ab"), (3, "a")):
        for n in names:
            (tmp_path / f"run/checkpoint-{step}").mkdir(parents=True, exist_ok=True)
            (tmp_path / f"run/checkpoint-{step}/{n}").write_text("x")
    assert jsonl.newest_checkpoint(spark, str(tmp_path / "run"), ["a", "b"]).first().step == 2
    manifest = spark.createDataFrame([("checkpoint-1/a", "0" * 64), ("checkpoint-9/a", "1")], "path string, sha256 string")
    assert sorted(r.reason for r in jsonl.manifest_drift(spark, str(tmp_path / "run"), manifest).collect()) == ["changed", "missing"]


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.when(F.col("id") > 2, F.col("id")))
    path = str(tmp_path / "t")
    assert sinks.write_once(df, path) and not sinks.write_once(df.repartition(3), path)
    with pytest.raises(ValueError):
        sinks.write_once(df.limit(4), path)
    assert sinks.regenerates(df, path) and sinks.publish({path: df, str(tmp_path / "u"): df}) == [str(tmp_path / "u")]
    with pytest.raises(ValueError):
        sinks.publish({path: df.limit(1), str(tmp_path / "v"): df})
    assert not (tmp_path / "v").exists()
    assert sinks.gated_write(df, str(tmp_path / "w"), {"n": F.count(F.lit(1))}, lambda m: m["n"] == 5) == {"n": 5}
    with pytest.raises(ValueError):
        sinks.gated_write(df, str(tmp_path / "z"), {"n": F.count(F.lit(1))}, lambda m: m["n"] > 5)
    assert not (tmp_path / "z").exists() and not (tmp_path / "z.part").exists()


def test_numeric_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (1e6, -1e6, 0.0, 0.0), (-1e6, 1e6, 0.0, 0.0)], "a double, b double, c double, d double")
    got = df.select(*(v.alias(n) for n, v in maths.dpo_terms(*map(F.col, "abcd"), 0.1).items())).collect()
    assert got[0].loss == pytest.approx(0.6931471805599453) and got[0].coefficient == pytest.approx(0.05)
    assert got[1].loss == 0.0 and got[2].loss == pytest.approx(2e5) and got[2].coefficient == pytest.approx(0.1)
    rewards = spark.createDataFrame([("g", float(r)) for r in (0, 1, 1, 1)] + [("h", 1.0)] * 2, "g string, r double")
    adv = sorted(round(r.advantage, 6) for r in selection.advantages(rewards, "g", "r").collect())
    assert adv == [-1.732051, 0.0, 0.0, 0.57735, 0.57735, 0.57735]


def test_arrays_and_text(spark):
    one = spark.range(1)
    row = one.select(
        maths.masked_labels(F.array(*map(F.lit, (5, 6, 7))), F.lit(2)).alias("m"), maths.padded(F.array(F.lit(5)), F.lit(3), 0).alias("p"), maths.chunk_ranges(F.lit(65), 32).alias("c"),
        text.search_terms(F.lit("Check v 2.3.1 的黑屏恢复 42 一个")).alias("t"), text.without_end_marks(F.lit("hi</s> </s>\n"), "</s>").alias("e"),
        audits.claim_status(F.lit("- **实际发生的失败次数：2次**。\n其他"), F.lit(2)).alias("k"),
    ).first()
    assert row.m == [-100, -100, 7] and row.p == [5, 0, 0] and [(c.start, c.end) for c in row.c] == [(0, 32), (32, 64), (64, 65)]
    assert {"check", "v", "2.3.1", "的黑", "黑屏恢复"} <= set(row.t) and "42" not in row.t and "一个" not in row.t
    assert row.e == "hi" and row.k.status == "matched_count_only" and row.k.claims == [2]


def test_selection_helpers(spark):
    a, b = spark.range(5), spark.range(3, 7)
    assert {(r.id, r.side) for r in selection.differing(a, b).collect()} == {(0, "left"), (1, "left"), (2, "left"), (5, "right"), (6, "right")}
    weights = tokens.episode_weights(spark.createDataFrame([("u", "e1"), ("u", "e1"), ("u", "e2")], "u string, e string"), "u", "e")
    assert sorted(r.weight for r in weights.collect()) == [0.25, 0.25, 0.5]
    turns = spark.createDataFrame([([1], [2], [0.1], [0.2]), ([1], [], [], []), ([1], [2], [float("nan")], [0.1])], "prompt_ids array<int>, generated_ids array<int>, old_logprobs array<double>, token_entropies array<double>")
    assert [r.fault for r in tokens.behaviour_faults(turns).collect()] == [None, "empty", "not_finite"]
