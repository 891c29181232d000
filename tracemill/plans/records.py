"""Queries over records, sources, token tables and audits, with their SQL.

Driver tables stand in for agent data as in ``catalogue``: lines, answers and
metadata are made from the tables' texts, labels and events, in the query and in
its SQL, and what the operators find in them is computed from the rows on both
sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import jsonx, maths, text
from tracemill.operators import aggregate, audits, replay, scoring
from tracemill.operators import tokens as token_ops
from tracemill.plans.catalogue import LOG, executions, query, table
from tracemill.sources import jsonl, sinks


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# sources


_LINES = """lines AS (SELECT doc_id AS line, CASE doc_id % 8 WHEN 0 THEN '   ' WHEN 1 THEN '{bad' WHEN 2 THEN '[' || doc_id || ']' WHEN 3 THEN '{"id":' || doc_id || ',"query":"q"}'
  WHEN 4 THEN '{"id":"r' || (doc_id % 24) || '","query":"q"}' WHEN 5 THEN '{"id":"d' || doc_id || '","query":" "}' WHEN 6 THEN '{"id":"","query":"q"}' ELSE '{"id":"d' || doc_id || '","query":"' || lang || '"}' END AS text FROM documents)"""


@query(rf"""WITH {_LINES}, p AS (SELECT line, text, CASE WHEN json_valid(text) THEN text END AS j FROM lines WHERE trim(text) <> ''),
f AS (SELECT line, j, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.id') = 'VARCHAR' THEN j ->> '$.id' END AS id, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.query') = 'VARCHAR' THEN j ->> '$.query' END AS query FROM p),
n AS (SELECT *, id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY line) = 1 AS first FROM f)
SELECT line, id, CASE WHEN j IS NULL THEN 'not JSON' WHEN json_type(j) <> 'OBJECT' THEN 'not an object' WHEN coalesce(id, '') = '' THEN 'bad id' WHEN NOT first THEN 'repeated id' WHEN trim(coalesce(query, '')) = '' THEN 'bad query' END AS violation FROM n""")
def case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A4: lines of a case file with the first rule that each breaks; blank lines are no cases."""
    d, third = F.col("doc_id"), F.col("doc_id") % 8
    made = {
        0: F.lit("   "), 1: F.lit("{bad"), 2: F.concat(F.lit("["), d, F.lit("]")), 3: F.concat(F.lit('{"id":'), d, F.lit(',"query":"q"}')), 4: F.concat(F.lit('{"id":"r'), d % 24, F.lit('","query":"q"}')),
        5: F.concat(F.lit('{"id":"d'), d, F.lit('","query":" "}')), 6: F.lit('{"id":"","query":"q"}'), 7: F.concat(F.lit('{"id":"d'), d, F.lit('","query":"'), F.col("lang"), F.lit('"}')),
    }
    line = F.coalesce(*(F.when(third == k, v) for k, v in made.items()))
    return jsonl.check_cases(_docs(spark, sf_dir).select(F.lit("cases").alias("file"), d.alias("line"), line.alias("text"))).select("line", "id", "violation")


_META = """'{"adapter":"a' || (doc_id % 3) || '","model":"m1"}'"""
_RECORDS = f"""made AS (SELECT doc_id AS line, 'd' || doc_id AS id, '{{"id":"d' || doc_id || '","lang":"' || lang || '","protocol_version":"2.' || (doc_id % 5) || '"}}' AS kase, {_META} AS meta, lang FROM documents),
lines AS (SELECT line, id, kase, meta, CASE WHEN line % 7 = 0 THEN '{{"case":' || kase || '}}' ELSE '{{"case":' || kase || ',"result":{{"n":' || line || '}},"evaluator_version":"2.' || CASE WHEN line % 11 = 0 THEN 9 ELSE line % 5 END ||
  '","run_metadata":' || CASE WHEN line % 13 = 0 THEN '{{}}' ELSE substr(meta, 1, length(meta) - 1) || ',"fingerprint":"' || CASE WHEN line % 17 = 0 THEN 'x' ELSE sha256(meta) END || '"}}' END || '}}' END AS text FROM made)"""
_FIRST = """CASE WHEN line % 7 = 0 THEN 'no case or result' WHEN line % 13 = 0 THEN 'bad run metadata' WHEN line % 11 = 0 AND line % 5 <> 9 THEN 'evaluator and protocol differ' END"""


def _record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kase = F.concat(F.lit('{"id":"d'), d, F.lit('","lang":"'), F.col("lang"), F.lit('","protocol_version":"2.'), d % 5, F.lit('"}'))
    meta = F.concat(F.lit('{"adapter":"a'), d % 3, F.lit('","model":"m1"}'))
    signed = F.concat(F.regexp_replace(meta, r"\}$", ""), F.lit(',"fingerprint":"'), F.when(d % 17 == 0, "x").otherwise(F.sha2(meta.cast("binary"), 256)), F.lit('"}'))
    whole = F.concat(F.lit('{"case":'), kase, F.lit(',"result":{"n":'), d, F.lit('},"evaluator_version":"2.'), F.when(d % 11 == 0, 9).otherwise(d % 5), F.lit('","run_metadata":'), F.when(d % 13 == 0, "{}").otherwise(signed), F.lit("}"))
    line = F.when(d % 7 == 0, F.concat(F.lit('{"case":'), kase, F.lit("}"))).otherwise(whole)
    return _docs(spark, sf_dir).select(F.lit("records").alias("file"), d.alias("line"), line.alias("text"), kase.alias("known_case"))


@query(f"""WITH {_RECORDS} SELECT line, id, text ->> '$.result.n' AS n, coalesce(text ->> '$.evaluator_version', '<legacy>') AS evaluator, {_FIRST} AS violation FROM lines""")
def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records with the first rule that each breaks: parts, run metadata, evaluator against protocol."""
    checked = jsonl.check_records(_record_lines(spark, sf_dir).drop("known_case"))
    return checked.select("line", "id", F.get_json_object("result", "$.n").alias("n"), "evaluator", "violation")


@query("""WITH r AS (SELECT d.doc_id, lang, source, length(text) AS n, contains(text, '@') AS marked, l.quality, l.toxic, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN labels l USING (doc_id) WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL),
m AS (SELECT max(source) AS own FROM r)
SELECT doc_id AS line, CASE WHEN n % 10 = 0 THEN 'no case or result' WHEN n % 10 = 1 THEN 'bad run metadata' WHEN NOT known THEN 'unknown case' WHEN toxic = 1 THEN 'changed case' WHEN quality <> 1 THEN 'wrong protocol' WHEN source <> own THEN 'other adapter' WHEN marked THEN 'bad fingerprint' END AS violation FROM r, m""")
def study_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a study against its known cases (labelled documents), its protocol (good ones have the study's), its manifest (the last source is its adapter) and their own fingerprint (texts with an @ have another one)."""
    both = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").filter("text is not null and source is not null and lang is not null")
    n = F.length("text") % 10
    case = lambda tongue: F.format_string('{"id":"d%d","lang":"%s","protocol_version":"%s"}', "doc_id", tongue, F.when(F.coalesce("quality", F.lit(1)) == 1, "2.4").otherwise("2.3"))
    meta = F.format_string('{"adapter":"%s","model":"m1"}', "source")
    signed = F.format_string('{"adapter":"%s","fingerprint":"%s","model":"m1"}', "source", F.when(F.contains("text", F.lit("@")), "x").otherwise(F.sha2(meta.cast("binary"), 256)))
    line = F.when(n == 0, F.format_string('{"case":%s}', case(F.col("lang")))).otherwise(F.format_string('{"case":%s,"result":{"n":%d},"evaluator_version":"%s","run_metadata":%s}', case(F.col("lang")), "doc_id", F.when(F.coalesce("quality", F.lit(1)) == 1, "2.4").otherwise("2.3"), F.when(n == 1, "{}").otherwise(signed)))
    known = both.filter("toxic is not null").select(F.concat(F.lit("d"), "doc_id").alias("id"), case(F.when(F.col("toxic") == 1, "zz").otherwise(F.col("lang"))).alias("case"))
    own = both.agg(F.max("source")).first()[0]
    rows = both.select(F.lit("records").alias("file"), F.col("doc_id").alias("line"), line.alias("text"))
    return jsonl.study_records(jsonl.check_records(rows), known, {"adapter": own or "", "model": "m1"}).select("line", "violation")


# scoring


def _trajectories(spark: SparkSession, sf_dir: str, case: Column, payload: Column, error: Column, **result: Column) -> DataFrame:
    """A record per user with one step a day: what ran, its payload or its error, and the case that ``case`` makes from case_id."""
    return trajectories(executions(spark, sf_dir), case, payload, error, **result)


def trajectories(log: DataFrame, case: Column, payload: Column, error: Column, **result: Column) -> DataFrame:
    """As above, over a log of case_id, idx, step, tool, target and ok."""
    call = F.struct(F.col("tool").alias("name"), F.struct(F.col("target").alias("k")).alias("arguments"))
    envelope = F.concat(F.lit('{"ok":'), F.col("ok").cast("string"), F.lit(","), F.when(F.col("ok"), F.concat(F.lit('"result":'), payload)).otherwise(error), F.lit("}"))
    entry = F.concat(F.lit('{"tool_call":'), F.to_json(call), F.lit(',"result":'), envelope, F.lit("}"))
    days = log.withColumn("entry", entry).withColumn("call", F.concat(F.lit('{"valid":true,"tool_call":'), F.to_json(call), F.lit("}"))).groupBy("case_id", "step").agg(F.array_sort(F.collect_list(F.struct("idx", "call", "entry"))).alias("x"))
    listed = lambda f: F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e[f]), ","), F.lit("]"))
    step = F.concat(F.lit('{"step":'), F.col("step"), F.lit(',"parsed_tool_calls":'), listed("call"), F.lit(',"tool_results":'), listed("entry"), F.lit("}"))
    steps = days.select("case_id", "step", step.alias("json")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("step", "json"))).alias("s"))
    more = [F.concat(F.lit(f',"{k}":'), v) for k, v in result.items()]
    return steps.select("case_id", case.alias("case"), F.concat(F.lit('{"trajectory":['), F.array_join(F.transform("s", lambda s: s["json"]), ","), F.lit("]"), *more, F.lit("}")).alias("result"))


@query(f"""WITH {LOG}, n AS (SELECT case_id, bool_or(ok AND tool = 'view' AND target % 3 = case_id % 3) AS a, bool_or(ok AND tool = 'click' AND target % 7 = case_id % 7) AS b, bool_or(ok AND tool = 'purchase' AND target % 3 = 1 AND target % 5 = case_id % 5) AS c,
  arg_max(target, idx) FILTER (ok) AS last FROM log GROUP BY 1)
SELECT case_id::VARCHAR AS id, (coalesce(a, false)::INT + coalesce(b, false)::INT + coalesce(c, false)::INT)::BIGINT AS required_tool_result_matches, 3::BIGINT AS required_tool_result_total, coalesce(last % 3 = case_id % 3, false) AS final_state_match,
coalesce(a, false) AND coalesce(b, false) AND coalesce(c, false) AND coalesce(last % 3 = case_id % 3, false) AS task_success FROM n""")
def nested_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D3, D5, G3, O: results that must contain a text, equal a value at a path or hold an object, and the final state as a subset."""
    k, c = F.col("target"), F.col("case_id")
    payload = F.format_string('{"current_page":"p%d","graphics_preset":"x","tags":["a%d","z"],"deep":{"v":%d,"w":[{"m":%d,"n":%d}]}}', k % 3, k % 3, k % 7, k % 3, k % 5)
    case = F.format_string('{"id":"%d","success_criteria":{"final_state":{"current_page":"p%d"},"required_tool_results":[{"tool":"view","path":"tags","contains":["a%d"]},{"tool":"click","path":"$.deep.v","equals":%d},{"tool":"purchase","contains":{"m":1,"n":%d}}]}}', c, c % 3, c % 3, c % 7, c % 5)
    return scoring.score_records(_trajectories(spark, sf_dir, case, payload, F.lit('"error":"x"'))).select("id", "required_tool_result_matches", "required_tool_result_total", "final_state_match", "task_success")


_KINDS = """CASE target % 4 WHEN 0 THEN 'unknown_tool' WHEN 1 THEN 'Invalid-Transition' WHEN 2 THEN 'ValueError' ELSE 'RuntimeError' END"""


@query(f"""WITH {LOG}, k AS (SELECT *, CASE WHEN NOT ok THEN target % 4 END AS k FROM log),
f AS (SELECT case_id, min(idx) AS i, arg_min(step, idx) AS s FROM log WHERE NOT ok GROUP BY 1),
r AS (SELECT f.case_id, bool_or(l.ok AND l.idx > f.i AND l.step > f.s) AS again FROM f JOIN log l USING (case_id) GROUP BY 1)
SELECT k.case_id::VARCHAR AS id, count(*) FILTER (k = 0)::BIGINT AS unknown_tool_calls, count(*) FILTER (k IN (1, 2))::BIGINT AS invalid_transition_count, round(count(*) FILTER (k IN (1, 2)) / count(*), 9) AS invalid_transition_rate,
count(*) FILTER (k IS NOT NULL)::BIGINT AS failed_tool_calls, bool_or(k IS NOT NULL) AS recovery_attempted, coalesce(any_value(r.again), false) AND count(*) <= 70 AS recovery_success FROM k LEFT JOIN r USING (case_id) GROUP BY k.case_id""")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by their kind and message, and recovery in a later step of a case without a fault plan."""
    kind = F.element_at(F.array(*map(F.lit, ("unknown_tool", "Invalid-Transition", "ValueError", "RuntimeError"))), (F.col("target") % 4 + 1).cast("int"))
    error = F.concat(F.lit('"error_type":"'), kind, F.lit('","error":"'), F.when(F.col("target") % 4 == 2, "cannot navigate there").otherwise("x"), F.lit('"'))
    case = F.format_string('{"id":"%d","requires_recovery":true,"success_criteria":{"max_tool_calls":70}}', "case_id")
    scored = scoring.score_records(_trajectories(spark, sf_dir, case, F.lit("1"), error))
    return scored.select("id", "unknown_tool_calls", "invalid_transition_count", F.round("invalid_transition_rate", 9).alias("invalid_transition_rate"), "failed_tool_calls", "recovery_attempted", "recovery_success")


@query(f"""WITH {LOG}, n AS (SELECT case_id, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok AND (target % 2 = 0 OR target % 3 = 0)) AS injected FROM log GROUP BY 1)
SELECT case_id::VARCHAR AS id, (case_id % 4)::BIGINT AS expected_failed_calls, least(case_id % 4, injected)::BIGINT AS observed_expected_failed_calls, (failed - least(case_id % 4, injected))::BIGINT AS unexpected_failed_calls FROM n""")
def planned_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that a plan of faults explains: of the planned tool, by kind or by message, each fault up to its times."""
    k = F.col("target")
    error = F.concat(F.lit('"error_type":"'), F.when(k % 2 == 0, " RuntimeError").otherwise("Other"), F.lit('","error":"'), F.when(k % 3 == 0, f"{scoring.INJECTED_TEXT}: x").otherwise("x"), F.lit('"'))
    case = F.format_string('{"id":"%d","environment":{"fault_injections":[{"operation":"error","times":%d},{"operation":"navigate","target":"settings","times":0}]}}', "case_id", F.col("case_id") % 4)
    return scoring.score_records(_trajectories(spark, sf_dir, case, F.lit("1"), error)).select("id", "expected_failed_calls", "observed_expected_failed_calls", "unexpected_failed_calls")


_REVIEWED = f"""WITH {LOG}, n AS (SELECT case_id, count(*) AS calls, count(*) FILTER (tool = 'view' AND target % 10 = case_id % 10) AS hit FROM log GROUP BY 1),
v AS (SELECT case_id, CASE WHEN case_id % 11 = 0 THEN 'unsupported protocol' WHEN case_id % 13 = 0 THEN 'query differs' WHEN case_id % 3 = 2 AND case_id % 7 = 0 THEN 'missing process contract' END AS fault, 'c' || (case_id % 4) AS category,
  calls <= 60 + case_id % 20 AS done, CASE case_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'uncertain' ELSE 'pending' END AS verdict, least(hit, 1)::DOUBLE AS structured FROM n),
m AS (SELECT *, CASE WHEN fault IS NULL THEN CASE WHEN NOT done OR verdict = 'fail' THEN false WHEN verdict = 'pass' THEN true END END AS task FROM v)"""


def _reviewed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("case_id")
    version = F.when(c % 11 == 0, "9").when(c % 3 == 2, "2.2").otherwise("2.1")
    contract = F.when(c % 7 == 0, "null").otherwise("[]")
    case = F.format_string('{"id":"%d","query":"q%d","category":"c%d","protocol_version":"%s","process_constraints":%s,"required_calls":[{"name":"view","arguments":{"d":%d}}],"success_criteria":{"max_tool_calls":%d,"final_answer":{"contains_all":["never said"]}}}', c, c, c % 4, version, contract, c % 10, F.lit(60) + c % 20)
    query_of = F.concat(F.lit('"q'), F.when(c % 13 == 0, -1).otherwise(c), F.lit('"'))
    made = _trajectories(spark, sf_dir, case, F.lit("1"), F.lit('"error":"x"'), query=query_of)
    # the calls carry the last digit of their target, as the specs name it
    made = made.withColumn("result", F.regexp_replace("result", r'"k":\d*(\d)\}', r'"d":$1}'))
    review = F.when(c % 5 < 3, F.concat(F.lit('{"verdict":"'), F.element_at(F.array(*map(F.lit, ("pass", "fail", "uncertain", "", ""))), (c % 5 + 1).cast("int")), F.lit('"}')))
    return scoring.score_records(made.withColumn("review", review), review_col="review")


@query(f"""{_REVIEWED} SELECT case_id::VARCHAR AS id, fault, CASE WHEN fault IS NULL THEN done END AS execution_success, CASE WHEN fault IS NULL THEN verdict END AS answer_review, task AS task_success,
CASE WHEN fault IS NULL THEN structured END AS structured_argument_accuracy FROM m""")
def reviewed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-2.1, O-2.2, O-rev, D13, L6: records under their own protocol with answer reviews: execution without the prose, a tri-state verdict, faults of records that cannot be scored."""
    return _reviewed_scores(spark, sf_dir).select("id", "fault", "execution_success", "answer_review", "task_success", "structured_argument_accuracy")


@query(f"""{_REVIEWED}, k AS (SELECT * FROM m WHERE fault IS NULL), g AS (SELECT coalesce(category, '') AS key, CASE WHEN category IS NULL THEN 'overall' ELSE 'category' END AS scope, count(*)::BIGINT AS num_cases, count(*) FILTER (task)::BIGINT AS p,
  count(*) FILTER (task IS NULL)::BIGINT AS u, count(*) FILTER (done) AS d, count(*) FILTER (verdict = 'uncertain')::BIGINT AS un FROM k GROUP BY GROUPING SETS ((), (category)))
SELECT scope, key, num_cases, p AS task_pass_count, num_cases - p - u AS task_fail_count, u AS task_unresolved_count, CASE WHEN u = 0 THEN round(p / num_cases, 9) END AS task_success_rate, round(p / num_cases, 9) AS task_success_lower_bound,
round((p + u) / num_cases, 9) AS task_success_upper_bound, round(d / num_cases, 9) AS task_execution_success_rate, un AS answer_uncertain_count FROM g""")
def reviewed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the tri-state summary over scored records, overall and by category."""
    out = aggregate.reviewed_summary(_reviewed_scores(spark, sf_dir).filter("fault is null"), ("category",))
    rates = ("task_success_rate", "task_success_lower_bound", "task_success_upper_bound", "task_execution_success_rate")
    return out.select("scope", "key", "num_cases", "task_pass_count", "task_fail_count", "task_unresolved_count", *(F.round(r, 9).alias(r) for r in rates), "answer_uncertain_count")


@query(f"""{_REVIEWED}, k AS (SELECT category, count(*) FILTER (task IS NULL) AS pending, avg(task::INT) AS rate FROM m WHERE fault IS NULL AND verdict IN ('pass', 'fail') GROUP BY 1)
SELECT CASE WHEN sum(pending) = 0 THEN round(avg(rate), 9) END AS task_success_rate, NULL::DOUBLE AS long_horizon_success_rate, NULL::DOUBLE AS recovery_success_rate FROM k""")
def reviewed_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the mean of the categories' rates over reviewed records."""
    out = aggregate.reviewed_category_macro(_reviewed_scores(spark, sf_dir).filter("fault is null and answer_review in ('pass', 'fail')"))
    return out.withColumn("task_success_rate", F.round("task_success_rate", 9))


@query(f"""{_REVIEWED} SELECT category, count(*)::BIGINT AS cases, count(*) FILTER (case_id % 6 = 0)::BIGINT AS requires_new_inference, count(*) FILTER (case_id % 6 <> 0)::BIGINT AS eligible,
count(*) FILTER (case_id % 6 <> 0 AND done)::BIGINT AS execution_success, count(*) FILTER (case_id % 6 <> 0 AND task IS NULL)::BIGINT AS answer_review_pending FROM m WHERE fault IS NULL GROUP BY 1""")
def retrospective_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what a changed protocol lets one say about old records, by category."""
    scored = _reviewed_scores(spark, sf_dir).filter("fault is null").withColumn("requires_new_inference", F.col("id").cast("bigint") % 6 == 0)
    return audits.retrospective(scored)


@query("""WITH r AS (SELECT lang, CASE WHEN quality = 1 THEN 0.25 * (toxic + 1) WHEN quality IS NOT NULL THEN 0.5 WHEN source IS NOT NULL AND lang = 'en' THEN 1.0 END AS rate, CASE WHEN quality = 1 THEN toxic = 0 WHEN quality IS NOT NULL THEN n_chars > 500 END AS ok FROM documents LEFT JOIN labels USING (doc_id))
SELECT coalesce(lang, 'unknown') AS category, count(*)::BIGINT AS n, count(rate)::BIGINT AS rated, round(sum(rate), 6) AS rates, count(*) FILTER (ok)::BIGINT AS passed FROM r GROUP BY 1""")
def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with stored metrics (good documents), as flat metrics of their own (other labelled ones), with a result to be scored (the rest in one language), and with neither."""
    both = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    case = F.format_string('"case":{"category":"%s"}', "lang")
    stored = F.format_string('{%s,"metrics":{"execution_success_rate":%s,"task_success":%s}}', case, (0.25 * (F.col("toxic") + 1)).cast("string"), (F.col("toxic") == 0).cast("string"))
    flat = F.format_string('{"category":"%s","execution_success_rate":0.5,"task_success":%s}', "lang", (F.col("n_chars") > 500).cast("string"))
    record = F.when(F.col("quality") == 1, stored).when(F.col("quality").isNotNull(), flat).when(F.col("source").isNotNull() & (F.col("lang") == "en"), F.format_string('{%s,"result":{"trajectory":[]}}', case)).otherwise(F.format_string("{%s}", case))
    rows = scoring.metric_rows(both.select(record.alias("record")))
    return rows.groupBy(aggregate.group_key("category").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count("execution_success_rate").alias("rated"), F.round(F.sum("execution_success_rate"), 6).alias("rates"), F.count_if("task_success").alias("passed"))


# JSON values and texts


@query(f"""WITH {LOG}, p AS (SELECT *, lag(target) OVER w AS k, lag(tool) OVER w AS t, lag(ok) OVER w AS o, lag(value) OVER w AS v FROM log WINDOW w AS (PARTITION BY case_id ORDER BY idx))
SELECT event_id, v BETWEEN 5 AND 50 AND target = k AND tool = t AND ok = o AS equal, v < 5 AS broken FROM p WHERE k IS NOT NULL""")
def strict_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event against the one before it as JSON: keys in another order and 1.0 for 1 do not matter, a number for a boolean (dear events) does, and a repeated key (cheap events) is no JSON."""
    w = Window.partitionBy("case_id").orderBy("idx")
    log = executions(spark, sf_dir).withColumns({n: F.lag(c).over(w) for n, c in (("k", "target"), ("t", "tool"), ("o", "ok"), ("v", "value"))}).filter("k IS NOT NULL")
    a = F.format_string('{"k": %d, "of": {"tool": "%s", "l": [%d, 1]}, "ok": %s}', "target", "tool", "target", F.col("ok").cast("string"))
    flag = F.when(F.col("v") > 50, F.col("o").cast("int").cast("string")).otherwise(F.col("o").cast("string"))
    b = F.format_string('{"ok":%s,%s"of":{"l":[%d,1.0],"tool":"%s"},"k":%d.0}', flag, F.when(F.col("v") < 5, '"k":1,').otherwise(""), "k", "t", "k")
    return log.select("event_id", jsonx.strictly_equal(a, b).alias("equal"), jsonx.canonical(b).isNull().alias("broken"))


@query("""SELECT doc_id, rtrim(regexp_replace(text || CASE doc_id % 3 WHEN 0 THEN ' <|end|> <|end|>' WHEN 1 THEN '<|end|>' ELSE '' END, '(\\s*<\\|end\\|>)+\\s*$', '')) = rtrim(text) AS stripped FROM documents WHERE text IS NOT NULL""")
def end_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-of-sequence marks at the end of texts."""
    mark = F.element_at(F.array(F.lit(" <|end|> <|end|>"), F.lit("<|end|>"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    own = text.without_end_marks(F.concat("text", mark), "<|end|>")
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", (F.rtrim(own) == F.rtrim("text")).alias("stripped"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS a, l_extendedprice * (1 + (l_linenumber - 3) * 1e-7) AS b, CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber = 2 THEN 'Infinity'::DOUBLE ELSE l_tax END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(a - b) <= 1.5e-7 * greatest(abs(a), abs(b)) AS close, isfinite(c) AS finite, c = 'Infinity'::DOUBLE AS same FROM v""")
def numeric_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness and finiteness, infinities and NaN included."""
    a, n = F.col("l_extendedprice"), F.col("l_linenumber")
    odd = F.when(n == 1, float("nan")).when(n == 2, float("inf")).otherwise(F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", maths.is_close(a, a * (1 + (n - 3) * 1e-7), 1.5e-7).alias("close"), maths.is_finite(odd).alias("finite"), maths.is_close(odd, F.lit(float("inf")), 0.5).alias("same"))


# tokens


@query("""WITH t AS (SELECT conv_id % 8 AS u, conv_id, turn FROM conversations), e AS (SELECT u, count(DISTINCT conv_id) AS episodes FROM t GROUP BY 1), n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1)
SELECT conv_id, turn, round(1.0::DOUBLE / (episodes * n), 12) AS weight FROM t JOIN e USING (u) JOIN n USING (conv_id)""")
def policy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: the weight of each token of an update: 1 / (episodes * tokens of its episode)."""
    rows = table(spark, sf_dir, "conversations").withColumn("u", F.col("conv_id") % 8)
    return token_ops.episode_weights(rows, "u", "conv_id").select("conv_id", "turn", F.round("weight", 12).alias("weight"))


@query("""WITH w AS (SELECT doc_id, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS tokens FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(ws) = 0 THEN 'empty' WHEN len(tokens) <> len(ws) THEN 'misaligned' WHEN len(list_filter(ws, lambda x: length(x) = 1)) > 0 THEN 'not_finite' WHEN len(ws) > 512 THEN 'too_many_new' WHEN length(text) + len(ws) > 8192 THEN 'context_too_long' END AS fault FROM w""")
def behaviour_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: texts as recorded turns: a token per word, log-probabilities of its length (none for one letter), entropies for the words of all lines, so that texts of several lines are misaligned; empty, not finite and too long ones."""
    parts = lambda t: F.filter(F.split(t, " ", -1), lambda x: x != "")
    log = lambda x: F.when(F.length(x) == 1, float("-inf")).otherwise(-F.log(F.length(x).cast("double")))
    rows = _docs(spark, sf_dir).filter("text is not null").withColumns({"w": parts(F.col("text")), "t": parts(F.translate("text", "\n", " "))})
    made = rows.select("doc_id", F.transform("w", F.length).alias("generated_ids"), F.transform("w", log).alias("old_logprobs"), F.transform("t", lambda x: F.length(x) / 10).alias("token_entropies"), F.transform(F.split("text", ""), F.ascii).alias("prompt_ids"))
    return token_ops.behaviour_faults(made).select("doc_id", "fault")


@query("""WITH e AS (SELECT doc_id, (n_chars % 40)::INT AS n, (doc_id % 6)::INT AS p, doc_id // 16 AS batch FROM documents), w AS (SELECT *, max(n) OVER (PARTITION BY batch) AS width FROM e)
SELECT doc_id, width::INT AS width, (least(p, n))::BIGINT AS masked, (width - n)::BIGINT AS filled, (list_sum(list_transform(range(least(p, n) + 1, n + 1), lambda x: x)))::BIGINT AS supervised FROM w""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and labels of a batch, the prefix masked, filled up to the longest of the batch."""
    n, p = (F.col("n_chars") % 40).cast("int"), (F.col("doc_id") % 6).cast("int")
    rows = _docs(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), F.least(p, n).alias("p"), F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("ids"))
    width = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("width"))
    both = rows.join(width, "batch").withColumns({"labels": maths.masked_labels(F.col("ids"), F.col("p")), "whole": maths.padded(F.col("ids"), F.col("width"), 0)})
    kept = F.filter("labels", lambda x: x != -100)
    return both.select("doc_id", "width", F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("masked"), F.size(F.filter("whole", lambda x: x == 0)).cast("bigint").alias("filled"), F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("supervised"))


@query("""SELECT conv_id, (count(*) + 2)::BIGINT AS messages, sha256('system:You help.|user:q' || conv_id || '|' || string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1""")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: trajectories as messages after the system prompt and the query."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("t"))
    made = turns.select("conv_id", token_ops.messages_of(F.col("t"), F.concat(F.lit("q"), "conv_id"), "You help.").alias("m"))
    joined = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")
    return made.select("conv_id", F.size("m").cast("bigint").alias("messages"), F.sha2(joined.cast("binary"), 256).alias("digest"))


# audits


@query("""WITH now AS (SELECT doc_id, n_chars AS a FROM documents WHERE lang <> 'de'), then_ AS (SELECT doc_id, length(text) + toxic AS a FROM labels JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN now.a IS NULL THEN 'missing' WHEN then_.a IS NULL THEN 'new' ELSE 'changed' END AS reason FROM now FULL JOIN then_ USING (doc_id) WHERE now.a IS DISTINCT FROM then_.a""")
def plan_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that differ from the frozen ones as JSON values; keys in another order do not count. Plans are those of documents in any language but one, frozen ones those of labelled documents, with the length of their text, one more for toxic ones."""
    docs, labels = _docs(spark, sf_dir), table(spark, sf_dir, "labels")
    now = docs.filter("lang <> 'de'").select("doc_id", F.format_string('{"a":%d,"b":"%s"}', "n_chars", "source").alias("plan"))
    frozen = labels.join(docs, "doc_id").select("doc_id", F.format_string('{"b":"%s", "a":%d}', "source", (F.length("text") + F.col("toxic")).cast("bigint")).alias("plan"))
    return audits.drifted(now, frozen, "doc_id", "plan")


@query("""SELECT conv_id AS id, a AS query FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS a, arg_max(text, turn) FILTER (role = 'user') AS b FROM conversations GROUP BY 1) WHERE a <> b""")
def changed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose query (a conversation's first of the user) is no longer the case's (the user's last)."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    both = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", user).alias("old"), F.max_by("text", user).alias("now")).filter("old is not null")
    return audits.requery(both.select("id", F.col("old").alias("query")), both.select("id", F.col("now").alias("query"))).select("id", "query")


@query("""SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders""")
def comparable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct metadata of runs without the columns that may differ."""
    runs = table(spark, sf_dir, "orders").select(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("adapter")).alias("meta"))
    return audits.comparable(runs, "meta", ["adapter"]).select("m.status", "m.priority")


@query("""SELECT lang AS id, CASE lang WHEN 'en' THEN 'pass' WHEN 'de' THEN 'fail' WHEN 'es' THEN 'uncertain' END AS verdict, count(*)::BIGINT AS n FROM documents GROUP BY ALL""")
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from a table of constants over the documents' languages; an id without one stays open."""
    rows = audits.decided(_docs(spark, sf_dir).select(F.col("lang").alias("id")), {"en": "pass", "de": "fail", "es": "uncertain"})
    return rows.groupBy("id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LOG}, c AS (SELECT case_id, count(*) FILTER (NOT ok) AS seen, count(*) FILTER (NOT ok AND step <= 15) AS early, arg_max(tool, idx) AS last FROM log GROUP BY 1),
a AS (SELECT *, CASE last WHEN 'view' THEN [early] WHEN 'click' THEN [early, seen] WHEN 'purchase' THEN [seen, seen] ELSE []::BIGINT[] END AS claims FROM c)
SELECT case_id, len(claims)::BIGINT AS claims, CASE WHEN len(claims) = 0 THEN 'unparsed_needs_review' WHEN len(list_distinct(claims)) > 1 THEN 'conflicting_claims_needs_review' WHEN claims[1] <> seen THEN 'mismatch_needs_review' ELSE 'matched_count_only' END AS status FROM a""")
def failure_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure counts that answers state in clauses of their own, against what the events show. What an answer states depends on the case's last tool: the failures of the month's first half, both counts, all failures twice, or nothing that is a clause."""
    bad = ~F.col("ok")
    counted = executions(spark, sf_dir).groupBy("case_id").agg(F.count_if(bad).alias("seen"), F.count_if(bad & (F.col("step") <= 15)).alias("early"), F.max_by("tool", "idx").alias("last"))
    one = lambda n: F.concat(F.lit("完成。实际发生的失败次数：**"), n, F.lit("** 次；好"))
    more = lambda n: F.concat(F.lit("\n- 实际工具失败 "), n, F.lit(" 次"))
    early, seen, last = F.col("early"), F.col("seen"), F.col("last")
    answer = F.when(last == "view", one(early)).when(last == "click", F.concat(one(early), more(seen))).when(last == "purchase", F.concat(one(seen), more(seen))).otherwise(F.concat(F.lit("共实际工具失败"), seen, F.lit("次左右")))
    return counted.select("case_id", audits.claim_status(answer, seen).alias("c")).select("case_id", F.size("c.claims").cast("bigint").alias("claims"), F.col("c.status").alias("status"))


@query("""WITH c AS (SELECT doc_id, contains(text, 'an') AS log_tool, contains(text, '@') AS log_text, contains(text, 'token') AS redundant, contains(text, ' 1') AS locked, lang FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, unnest([CASE WHEN log_tool AND NOT log_text THEN 'mandatory_logs_not_explicit_in_prompt' END, CASE WHEN lang = 'en' THEN 'knowledge_before_action_order_not_enforced' END, CASE WHEN redundant THEN 'explicit_no_redundant_mutation_not_enforced' END,
  CASE WHEN locked THEN 'explicit_read_only_not_enforced_throughout_trace' END, CASE WHEN lang = 'de' THEN 'build_tool_identity_required_despite_equivalent_state_tool' END]) AS risk FROM c)
SELECT risk, count(*)::BIGINT AS n FROM r WHERE risk IS NOT NULL GROUP BY 1""")
def contract_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the gaps between a case's public text and its hidden rules, counted; a case may have several. Texts that hold certain marks ask for what the rules name; the language is the family."""
    has = lambda mark: F.contains("text", F.lit(mark))
    asked = F.concat(F.lit("任务"), F.when(has("@"), "查询日志").otherwise(""), F.when(has("token"), "不做多余跳转").otherwise(""), F.when(has(" 1"), "不要改变界面").otherwise(""))
    family = F.when(F.col("lang") == "en", "reproduce_black_screen").when(F.col("lang") == "de", "build_info").otherwise("ui_state")
    tools = F.when(has("an"), F.array(F.lit("query_logs"))).otherwise(F.array(F.lit("verify_state")))
    return aggregate.histogram(_docs(spark, sf_dir).filter("text is not null"), [], audits.contract_risks(asked, family, tools), "risk")


@query(f"""WITH {LOG}, r AS (SELECT *, CASE tool WHEN 'view' THEN 'inspect_ui_state' WHEN 'click' THEN 'verify_state' WHEN 'purchase' THEN 'execute_action' ELSE 'query_logs' END AS t FROM log)
SELECT case_id, count(*) FILTER (NOT ok)::BIGINT AS failures, count(*) FILTER (NOT ok AND target % 2 = 0)::BIGINT AS policy_blocks, count(*) FILTER (ok AND t = 'verify_state' AND target % 3 = 0)::BIGINT AS failed_checks,
count(*) FILTER (ok AND t = 'execute_action')::BIGINT AS mutations, count(*) FILTER (ok AND t = 'query_logs')::BIGINT AS logs_read, 'p' || arg_max(target % 5, idx) FILTER (ok AND t <> 'query_logs') AS page FROM r GROUP BY 1""")
def trace_fact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what traces show: failures, refusals, failed checks, changes, logs read and the latest state."""
    log, k = executions(spark, sf_dir), F.col("target")
    name = F.when(F.col("tool") == "view", "inspect_ui_state").when(F.col("tool") == "click", "verify_state").when(F.col("tool") == "purchase", "execute_action").otherwise("query_logs")
    state = F.concat(F.lit('{"current_page":"p'), k % 5, F.lit('"}'))
    payload = F.when(F.col("tool") == "click", F.concat(F.lit('{"success":'), (k % 3 != 0).cast("string"), F.lit(',"current_state":'), state, F.lit("}"))).otherwise(state)
    made = log.select("case_id", "idx", name.alias("tool"), "ok", F.when(~F.col("ok"), F.when(k % 2 == 0, "policy_blocked").otherwise("x")).alias("error_type"), payload.alias("payload_json"))
    return audits.trace_facts(made).withColumn("page", F.get_json_object("latest_state", "$.current_page")).drop("latest_state")


@query("""SELECT doc_id AS id FROM labels JOIN documents USING (doc_id) WHERE n_chars = length(text) + toxic AND quality = 1""")
def inherited_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews (of good documents) that a rerun may keep, because its result is exactly the reviewed one: a document's length and source, the length one more for toxic ones."""
    docs, labels = _docs(spark, sf_dir), table(spark, sf_dir, "labels")
    old = docs.select(F.col("doc_id").alias("id"), F.format_string('{"a":%d,"b":"%s"}', "n_chars", "source").alias("result"))
    new = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.format_string('{"b":"%s","a":%d}', "source", (F.length("text") + F.coalesce("toxic", F.lit(0))).cast("bigint")).alias("result"))
    return audits.inherited(old, new, labels.filter("quality = 1").select(F.col("doc_id").alias("id")))


@query("""WITH c AS (SELECT doc_id, lang, contains(text, 'tion') AS hinted, quality = 1 AS recovers FROM documents JOIN labels USING (doc_id))
SELECT doc_id AS id, CASE WHEN hinted THEN '报告用事件编号 ' || CASE lang WHEN 'fr' THEN 'INC-102' ELSE 'INC-101' END || '核对' ELSE '报告' END AS query, hinted AS requires_new_inference, CASE WHEN recovers AND lang = 'en' THEN 1 ELSE 0 END::INT AS rules,
CASE WHEN recovers AND lang <> 'en' THEN 'recovery family without contract' END AS fault FROM c""")
def case_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases revised for later protocols: named incidents, new inference where the query has changed, process rules, faults of families without one. Labelled documents are the cases: the language is the family, good ones ask for recovery, and a syllable of the text hints at an incident."""
    family = F.when(F.col("lang") == "fr", "knowledge_hud").when(F.col("lang") == "en", "recovery_action").otherwise("no_tool")
    both = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    cases = both.select(F.col("doc_id").alias("id"), family.alias("scenario_family"), F.when(F.contains("text", F.lit("tion")), "报告用事件编号核对").otherwise("报告").alias("query"), (F.col("quality") == 1).alias("requires_recovery"))
    return audits.process_contracts(audits.revised_queries(cases)).select("id", "query", "requires_new_inference", F.size("process_constraints").alias("rules"), "fault")


@query(f"""WITH {LOG}, o AS (SELECT case_id, target % 9 AS op, arg_max(target, idx) AS kept FROM log WHERE tool = 'purchase' GROUP BY 1, 2), s AS (SELECT case_id, count(*) AS ops, sum(kept) AS kept FROM o GROUP BY 1),
e AS (SELECT case_id, count(*) AS n, count(*) FILTER (tool = 'purchase') AS done, count(*) FILTER (NOT ok) AS bad FROM log GROUP BY 1)
SELECT case_id, n::BIGINT AS events, done::BIGINT AS committed, bad::BIGINT AS refused, coalesce(ops, 0)::BIGINT AS receipts, coalesce(kept, 0)::BIGINT AS kept FROM e LEFT JOIN s USING (case_id)""")
def trace_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of traces (tool and status or error of each event) and the last receipt of each operation."""
    log, k = executions(spark, sf_dir), F.col("target")
    result = F.when(~F.col("ok"), '{"ok":false,"error_type":"refused"}').when(F.col("tool") == "purchase", F.format_string('{"ok":true,"result":{"status":"committed","operation_id":"o%d","k":%d}}', k % 9, k)).otherwise('{"ok":true,"result":{}}')
    call = F.concat(F.lit('{"name":"'), "tool", F.lit('"}'))
    packed = replay.packed(log.select("case_id", F.col("idx").alias("index"), call.alias("tool_call"), result.alias("result")))
    found = packed.select("case_id", F.from_json(replay.shape(F.col("events")), "array<array<string>>").alias("s"), replay.receipts(F.col("events")).alias("r"))
    of = lambda kind: F.size(F.filter("s", lambda e: e[1] == kind)).cast("bigint")
    kept = F.aggregate(F.map_values("r"), F.lit(0).cast("bigint"), lambda a, x: a + F.get_json_object(x, "$.k").cast("bigint"))
    return found.select("case_id", F.size("s").cast("bigint").alias("events"), of("committed").alias("committed"), of("refused").alias("refused"), F.size("r").cast("bigint").alias("receipts"), kept.alias("kept"))


@query("""WITH g AS (SELECT lang, count(*) AS n, avg(n_chars % 2) AS odd, avg(CASE WHEN lang = 'none' THEN 1 END) AS none FROM documents GROUP BY GROUPING SETS ((), (lang)))
SELECT CASE WHEN lang IS NULL THEN 'overall' ELSE 'lang:' || lang END || '  n=' || n || '  odd=' || printf('%.1f', round(odd * 100, 1)) || '%  none=n/a' AS text FROM g""")
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as lines of text: percentages with one decimal, n/a for what was not measured."""
    rows = _docs(spark, sf_dir).withColumns({"odd": (F.col("n_chars") % 2).cast("double"), "none": F.lit(None).cast("double")})
    counts = [F.count(F.lit(1)).alias("num_cases"), F.round(F.avg("odd"), 3).alias("odd"), F.avg("none").alias("none")]
    return sinks.rendered(aggregate.grouped(rows, ["lang"], counts), ["odd", "none"]).select("text")
