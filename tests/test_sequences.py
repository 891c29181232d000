import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tracemill.operators import counters, events, matching, scoring, skeletons
from tracemill.operators.trace import Call, Execution


# skeletons


def brute_skeleton(calls, keep=()):
    numbers = {}

    def shown(v, key=None):
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{shown(x, k)}" for k, x in sorted(v.items())) + "}"
        if isinstance(v, list):
            return "[" + ",".join(shown(x) for x in v) + "]"
        text = json.dumps(v, ensure_ascii=False)
        if key in keep:
            return text
        kind = "boolean" if isinstance(v, bool) else "null" if v is None else "string" if isinstance(v, str) else "number"
        return f"<{kind}:{numbers.setdefault((kind, text), sum(k == kind for k, _ in numbers))}>"

    return ";".join(name + shown(args) for name, args in calls)


TRACES = {
    "a": [("go", {"to": "x", "n": 1}), ("see", {"at": {"to": "x"}, "n": [1, 2, True, None]}), ("go", {"to": "y\"}{:", "n": 2})],
    "b": [("go", {"n": 7, "to": "p"}), ("see", {"n": [7, 0.5, False, None], "at": {"to": "p"}}), ("go", {"to": "q", "n": 0.5})],
    "c": [("go", {"to": "x", "n": 1}), ("see", {"at": {"to": "z"}, "n": [1, 2, True, None]}), ("go", {"to": "y", "n": 2})],
    "d": [("go", {})], "e": [("go", {"to": ""}), ("go", {"to": "true"}), ("go", {"to": "é\\"})],
}


def made(spark, traces, **kw):
    rows = [(c, i, name, json.dumps(args, ensure_ascii=False)) for c, calls in traces.items() for i, (name, args) in enumerate(calls)]
    return skeletons.skeletons(spark.createDataFrame(rows, "case_id string, idx int, tool string, arguments string"), ["case_id"], **kw)


@pytest.mark.parametrize("keep", [(), ("to",)])
def test_skeletons_equal_a_renaming(spark, keep):
    got = {r.case_id: r.skeleton for r in made(spark, TRACES, keep=keep).collect()}
    assert got == {c: brute_skeleton(t, keep) for c, t in TRACES.items()}
    assert (got["a"] == got["b"]) is (not keep) and got["a"] != got["c"]


def test_overlap_of_skeletons(spark):
    rows = made(spark, TRACES)
    old, new = rows.filter("case_id = 'a'"), rows.filter("case_id <> 'a'")
    assert {r.case_id: r.seen for r in skeletons.reused(new, old).collect()} == {"b": True, "c": False, "d": False, "e": False}
    assert {r.case_id for r in skeletons.fresh(new, old).collect()} == {"c", "d", "e"}
    split = rows.withColumn("split", F.when(F.col("case_id") == "a", "train").otherwise("dev"))
    assert [(r.splits, r.n) for r in skeletons.crossing(split).collect()] == [(2, 2)]
    assert made(spark, {"x": []}).count() == 0


def test_odd_arguments(spark):
    rows = [("a", 0, "go", None), ("a", 1, None, "{bad"), ("a", 2, "go", '"text"')]
    (r,) = skeletons.skeletons(spark.createDataFrame(rows, "case_id string, idx int, tool string, arguments string"), ["case_id"]).collect()
    assert r.skeleton == "go<null:0>;<string:0>;go<string:1>"


def test_unordered_keys(spark):
    rows = [('{"e":["b","a"],"f":[2,1]}', '{"e":["a","b"],"f":[2,1]}'), ('{"e":{"x":1}}', '{"e":{"x":1}}'), ("[2,1]", "[2,1]"), ('{"e\\"":[3,1]}', '{"e\\"":[3,1]}')]
    df = spark.createDataFrame(rows, "j string, want string")
    assert all(r.got == r.want for r in df.select("want", skeletons.unordered(F.col("j"), ["e"]).alias("got")).collect())


# repeats, alignment, common subsequences


def test_repeat_classes_equal_the_definition(spark):
    rng = random.Random(4)
    names = ["view", "navigate_ui", "execute_action", "query_logs", "other"]
    cases, calls, runs, want = {}, [], [], {}
    for c in range(60):
        made_ = [Call(rng.choice(names), {"k": rng.randrange(2)}) for _ in range(rng.randrange(1, 25))]
        ran, step = [], 0
        for call in made_:
            step += rng.random() < 0.5
            if rng.random() < 0.85:
                ran.append(Execution(step, 0, call, {"ok": rng.random() < 0.6}))
        cases[c] = (made_, ran)
        want[c] = scoring.repeat_counts(made_, ran)
        places = scoring.aligned(made_, ran)
        calls += [(c, i, x.name, "|".join(x.signature), p) for i, (x, p) in enumerate(zip(made_, places, strict=True))]
        runs += [(c, i, e.step, e.name, e.ok) for i, e in enumerate(ran)]
    calls = spark.createDataFrame(calls, "case_id int, idx int, tool string, sig string, execution int")
    runs = spark.createDataFrame(runs, "case_id int, idx int, step int, tool string, ok boolean")
    got = events.repeat_metrics(events.repeat_classes(calls, runs, sensitive=F.col("tool").isin(*scoring.SENSITIVE), mutates=F.col("tool").isin(*scoring.MUTATES)))
    assert {r.case_id: (r.repeated_tool_calls, r.retry_calls) for r in got.collect()} == want


def test_one_case_of_very_many_events_takes_linear_time(spark):
    n = 100_000
    log = spark.range(n).select(F.lit(1).alias("case_id"), F.col("id").alias("idx"), F.floor(F.col("id") / 3).alias("step"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("tool"), (F.col("id") % 2).alias("target"), (F.col("id") % 5 != 0).alias("ok"))
    log = log.withColumn("sig", F.concat_ws(":", "tool", F.col("target").cast("string")))
    began = time.time()
    assert events.retried_later(log, "target", ~F.col("ok"), F.col("ok")).filter("recovered").count() >= n // 5 - 2
    assert events.observed_before_retry(log, "target", ~F.col("ok"), F.col("tool") == "view").count() == n // 5
    classes = events.repeat_classes(log.withColumn("execution", F.col("idx")), log, sensitive=F.col("tool") == "view", mutates=F.col("tool") == "error")
    assert events.repeat_metrics(classes).first().repeated_tool_calls > 0
    assert time.time() - began < 60


def test_a_million_calls_align_in_linear_time(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).alias("case_id"), F.col("id").alias("idx"), F.concat(F.lit("s"), F.col("id") % 1000).alias("sig"))
    began = time.time()
    got = events.aligned(rows, rows).agg(F.count_if(F.col("execution") == F.col("idx")).alias("n")).first()["n"]
    assert got == n and time.time() - began < 60
    back = rows.withColumn("idx", n - F.col("idx"))  # most calls miss
    assert events.aligned(back, rows).filter("execution is not null").count() < n // 2


def test_alignment_of_random_lists(spark):
    rng = random.Random(2)
    calls, ran, want = [], [], {}
    for c in [None, *range(30)]:
        a, b = ([rng.choice(["x", "y", "z", None]) for _ in range(rng.randrange(12))] for _ in range(2))
        calls += [(c, i, s) for i, s in enumerate(a)]
        ran += [(c, i, s) for i, s in enumerate(b)]
        at = 0
        for i, s in enumerate(a):
            hit = next((j for j in range(at, len(b)) if s is not None and b[j] == s), None)
            at = at if hit is None else hit + 1
            want[c, i] = hit
    frame = lambda rows: spark.createDataFrame(rows, "case_id int, idx int, sig string")
    assert {(r.case_id, r.idx): r.execution for r in events.aligned(frame(calls), frame(ran)).collect()} == want


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_in_words(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(63))], [rng.choice("abcde") for _ in range(rng.randrange(90))]) for _ in range(150)] + [([], ["a"]), (["a"] * 62, ["a"] * 70)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", events.lcs_short(F.col("a"), F.col("b")).alias("s"), events.lcs_length("a", "b").alias("l")).collect():
        assert r.s == r.l == brute_lcs(r.a, r.b)
    with pytest.raises(Exception, match="more than 62"):
        spark.createDataFrame([(["a"] * 63, ["a"])], "a array<string>, b array<string>").select(events.lcs_short(F.col("a"), F.col("b"))).collect()


def test_long_common_subsequences_are_fast():
    rng = random.Random(5)
    a, b = ([rng.randrange(50) for _ in range(10_000)] for _ in range(2))
    began = time.time()
    assert 2000 < events.common_length(a, b) < 10_000
    assert time.time() - began < 5


# matching


def brute_matches(specs, calls):
    from tracemill.functions.jsonx import equal, subset

    options = [[j for j, c in enumerate(calls) if (equal if exact else subset)(s, c)] for exact, s in specs]
    best = 0
    for order in itertools.product(*[[None, *o] for o in options]):
        used = [x for x in order if x is not None]
        best = max(best, len(used)) if len(set(used)) == len(used) else best
    return best


def test_matching_equals_all_assignments():
    rng = random.Random(6)
    value = lambda: rng.choice([1, 1.0, True, "1", None, {"a": 1}, {"a": {"b": 1}}, [1], {}])
    pick = lambda: {k: value() for k in rng.sample("xyz", rng.randrange(3))}
    for _ in range(300):
        specs = [(rng.random() < 0.4, pick() if rng.random() < 0.9 else value()) for _ in range(rng.randrange(5))]
        calls = [pick() if rng.random() < 0.9 else value() for _ in range(rng.randrange(6))]
        assert matching.most_matches(specs, calls) == brute_matches(specs, calls)


def test_long_augmenting_paths():
    n = 300
    assert matching.maximum([1 << i | 1 << (i + 1) for i in range(n)] + [1], n + 1) == n + 1
    assert matching.maximum([0b11, 0b1, 0b1], 2) == 2 and matching.maximum([0, 0], 2) == 0


def test_ten_thousand_specs_and_calls():
    rng = random.Random(7)
    specs = [(False, {"a": rng.randrange(2000), **({"b": rng.randrange(3)} if i % 2 else {})}) for i in range(10_000)]
    calls = [{"a": rng.randrange(2000), "b": rng.randrange(3), "c": i} for i in range(10_000)]
    began = time.time()
    got = matching.most_matches(specs, calls)
    assert 7000 < got < 10_000 and time.time() - began < 20
    own = [(False, {"c": i}) for i in range(5000)] + [(False, {f"k{i}": 1}) for i in range(5000)]  # many different specs that fit all calls
    many = [{"c": i, **{f"k{j}": 1 for j in range(20)}} for i in range(10_000)]
    assert matching.most_matches(own, many) == 5020


def test_matched_table(spark):
    specs = [("a", "x", True, '{"k":1.0}'), ("a", "x", True, '{"k":1}'), ("a", "x", True, '{"k":2}'), ("a", "y", False, "{}"), ("a", "y", None, '{"k":1}'), ("a", None, True, "{}"), ("b", "z", False, None), ("c", "x", True, "{bad")]
    calls = [("a", "x", '{"k":1}'), ("a", "x", '{"k":1}'), ("a", "x", '{"k":3}'), ("a", "y", '{"k":1}'), ("a", None, "{}"), ("c", "x", "{bad"), ("d", "x", "{}")]
    got = matching.matched(spark.createDataFrame(specs, "case_id string, name string, exact boolean, arguments string"), spark.createDataFrame(calls, "case_id string, name string, arguments string"))
    assert {(r.case_id, r.specs, r.matches, r.accuracy) for r in got.collect()} == {("a", 6, 3, 0.5), ("b", 1, 0, 0.0), ("c", 1, 1, 1.0)}


def test_matching_joins_nothing_and_keeps_cases_apart(spark):
    rng = random.Random(9)
    cases = [*range(40), None]
    specs = [(rng.choice(cases), rng.choice(["x", "y", None]), rng.choice([True, True, False, None]), rng.choice(['{"k":1}', '{"k":1.0}', '{"k":2}', "{}", None, "{bad"])) for _ in range(300)]
    calls = [(rng.choice(cases), rng.choice(["x", "y", None]), rng.choice(['{"k":1}', '{"k":2,"l":0}', "{}", None, "{bad"])) for _ in range(300)]
    found = matching.matched(spark.createDataFrame(specs, "case_id int, name string, exact boolean, arguments string"), spark.createDataFrame(calls, "case_id int, name string, arguments string"))
    want = {}
    for case in {s[0] for s in specs}:
        m = sum(matching.most_matches([(bool(e), matching._loads(a or "{}")) for c, n, e, a in specs if (c, n) == (case, name)], [matching._loads(a or "{}") for c, n, a in calls if (c, n) == (case, name)]) for name in "xy")
        want[case] = (sum(s[0] == case for s in specs), 0 if case is None else m)
    assert {r.case_id: (r.specs, r.matches) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


# counters


def test_counters(spark):
    df = spark.createDataFrame([({"a": 2, "b": 1}, {"b": 3, "c": 1}), (None, {"a": 1}), ({}, {})], "a map<string,bigint>, b map<string,bigint>")
    a, b = F.col("a"), F.col("b")
    got = df.select(counters.intersection(a, b).alias("i"), counters.union(a, b).alias("u"), counters.excess(a, b).alias("e"), counters.added(a, b).alias("s"), counters.total(counters.union(a, b)).alias("t"), counters.keys(counters.union(a, b)).alias("k"), counters.rendered(counters.added(a, b)).alias("r")).collect()
    assert tuple(got[0]) == ({"b": 1}, {"a": 2, "b": 3, "c": 1}, {"a": 2}, {"a": 2, "b": 4, "c": 1}, 6, ["a", "b", "c"], "a:2,b:4,c:1")
    assert tuple(got[1])[:4] == ({}, {"a": 1}, {}, {"a": 1}) and got[2]["t"] == 0
    assert spark.createDataFrame([(["x", None, "x", "y"],)], "v array<string>").select(counters.of_array(F.col("v"))).first()[0] == {"x": 2, "y": 1}


def test_the_index_and_single_comparisons_agree(monkeypatch):
    rng = random.Random(8)
    for _ in range(100):
        specs = [{"name": rng.choice("ab"), "args": {k: rng.randrange(2) for k in rng.sample("xy", rng.randrange(3))}, "match": rng.choice(["exact", "subset"])} for _ in range(6)] + [None, {"args": {}}]
        calls = [Call(rng.choice("ab"), {k: rng.randrange(2) for k in rng.sample("xy", rng.randrange(3))}) for _ in range(8)]
        monkeypatch.setattr(scoring, "COMPARED", 10_000)
        one = scoring.most_matches(specs, calls)
        monkeypatch.setattr(scoring, "COMPARED", 0)
        assert scoring.most_matches(specs, calls) == one
