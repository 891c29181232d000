"""Queries over sequences of calls: skeletons, repeats, matching, counters; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import counters, events, matching, normalise, score_columns, skeletons
from tracemill.plans.catalogue import LOG, case_records, executions, query, tool

_SKELETONS = f"""{LOG}, a AS (SELECT case_id, step, idx, tool, target % 4 AS k, value > 30 AS big, 't' || (target % 3) AS tag FROM log),
f AS (SELECT *, min(idx) OVER (PARTITION BY case_id, step, k) AS fk, min(idx) OVER (PARTITION BY case_id, step, big) AS fb, min(idx) OVER (PARTITION BY case_id, step, tag) AS ft FROM a),
n AS (SELECT case_id, step, idx, tool, dense_rank() OVER (PARTITION BY case_id, step ORDER BY fk) - 1 AS k, dense_rank() OVER (PARTITION BY case_id, step ORDER BY fb) - 1 AS b, dense_rank() OVER (PARTITION BY case_id, step ORDER BY ft) - 1 AS t FROM f),
s AS (SELECT case_id, step, string_agg(tool || '{{"at":{{"big":<boolean:' || b || '>,"k":<number:' || k || '>}},"tags":[<string:' || t || '>]}}', ';' ORDER BY idx) AS skeleton FROM n GROUP BY ALL)"""


@query(f"""WITH {_SKELETONS} SELECT case_id, step, sha256(skeleton) AS digest, skeleton IN (SELECT skeleton FROM s WHERE step <= 15) AS seen FROM s WHERE step > 15""")
def call_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skeleton of each case of the month's second half (a user's day), and whether a case of the first half has it."""
    k = F.col("target")
    arguments = F.format_string('{"tags":["t%d"],"at":{"k":%d, "big":%s}}', k % 3, k % 4, (F.col("value") > 30).cast("string"))
    log = executions(spark, sf_dir).select("case_id", "step", "idx", "tool", arguments.alias("arguments"))
    made = skeletons.skeletons(log, ["case_id", "step"])
    return skeletons.reused(made.filter("step > 15"), made.filter("step <= 15")).select("case_id", "step", "digest", "seen")


@query(f"""WITH {LOG}, e AS (SELECT *, tool || ':' || (target % 5) AS sig, CASE WHEN target % 10 <> 9 THEN idx END AS ran, sum((tool = 'purchase' AND value > 40)::INT) OVER (PARTITION BY case_id ORDER BY idx) AS changes FROM log),
x AS (SELECT case_id, idx, tool, sig, ran, CASE WHEN ran IS NOT NULL THEN step END AS step, CASE WHEN ran IS NOT NULL THEN ok END AS ok, CASE WHEN ran IS NOT NULL THEN changes - (tool = 'purchase' AND value > 40)::INT END AS before, CASE WHEN ran IS NOT NULL THEN changes END AS upto FROM e),
w AS (SELECT *, row_number() OVER s - 1 AS n, lag(idx) OVER s AS lidx, lag(step) OVER s AS lstep, lag(ok) OVER s AS lok, lag(upto) OVER s AS lupto,
  last_value(CASE WHEN NOT ok THEN idx END IGNORE NULLS) OVER p AS fidx, last_value(CASE WHEN NOT ok THEN step END IGNORE NULLS) OVER p AS fstep FROM x
  WINDOW s AS (PARTITION BY case_id, sig ORDER BY idx), p AS (PARTITION BY case_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT case_id, n > 0 AND lok IS FALSE AND coalesce(step > lstep, false) AS retry, n > 0 AND CASE WHEN lok IS FALSE THEN NOT coalesce(step > lstep, false) OR n > 1
  ELSE NOT (tool IN ('view', 'purchase') AND coalesce(before > lupto, false)) AND NOT coalesce(fidx > lidx AND step > fstep, false) END AS repeat FROM w)
SELECT case_id, count(*) FILTER (repeat)::BIGINT AS repeated_tool_calls, round(count(*) FILTER (repeat) / count(*), 9) AS repeated_tool_call_rate, count(*) FILTER (retry)::BIGINT AS retry_calls, round(count(*) FILTER (retry) / count(*), 9) AS retry_call_rate FROM c GROUP BY 1""")
def repeat_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: redundant repeats and retries by call signature. Every event is a call; targets that end in 9 were never executed, purchases over 40 change the state."""
    log = executions(spark, sf_dir).withColumn("sig", F.concat_ws(":", "tool", (F.col("target") % 5).cast("string")))
    calls = log.select("case_id", "idx", "tool", "sig", F.when(F.col("target") % 10 != 9, F.col("idx")).alias("execution"))
    found = events.repeat_classes(calls, log, sensitive=F.col("tool").isin("view", "purchase"), mutates=tool("purchase") & (F.col("value") > 40))
    rates = ("repeated_tool_call_rate", "retry_call_rate")
    return events.repeat_metrics(found).withColumns({r: F.round(r, 9) for r in rates})


_SPECS = f"""{LOG}, s AS (SELECT case_id, step + 1 AS step, tool, target % 5 AS k, value > 70 AS any_ FROM log), c AS (SELECT case_id, step, tool, target % 5 AS k, count(*) AS c FROM log GROUP BY ALL),
x AS (SELECT case_id, step, tool, k, count(*) AS s FROM s WHERE NOT any_ OR tool = 'click' GROUP BY ALL), g AS (SELECT case_id, step, tool, count(*) AS g FROM s WHERE any_ AND tool <> 'click' GROUP BY ALL),
own AS (SELECT case_id, step, tool, sum(least(s, coalesce(c, 0))) AS m FROM x LEFT JOIN c USING (case_id, step, tool, k) GROUP BY ALL), made AS (SELECT case_id, step, tool, sum(c) AS c FROM c GROUP BY ALL),
t AS (SELECT case_id, step, tool, coalesce(m, 0) + least(coalesce(g, 0), coalesce(c, 0) - coalesce(m, 0)) AS m FROM (SELECT DISTINCT case_id, step, tool FROM s) LEFT JOIN own USING (case_id, step, tool) LEFT JOIN g USING (case_id, step, tool) LEFT JOIN made USING (case_id, step, tool)),
n AS (SELECT case_id, step, count(*) AS specs FROM s GROUP BY ALL)"""


@query(f"""WITH {_SPECS} SELECT case_id, step, specs::BIGINT AS specs, sum(m)::BIGINT AS matches, round(sum(m) / specs, 9) AS accuracy FROM t JOIN n USING (case_id, step) WHERE step <= 31 GROUP BY case_id, step, specs""")
def spec_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of the day before as specs of a day's calls: clicks exactly, others as a subset; dear ones name no argument. The SQL takes specs with an argument first, as no other call meets them."""
    log = executions(spark, sf_dir).withColumn("arguments", F.format_string('{"k":%d,"big":%s}', F.col("target") % 5, F.lit("false")))
    at = lambda shift: F.struct("case_id", (F.col("step") + shift).alias("step")).alias("case")
    loose = F.when(F.col("value") > 70, "{}").otherwise(F.format_string('{"k":%d}', F.col("target") % 5))
    specs = log.select(at(1), F.col("tool").alias("name"), (F.col("tool") == "click").alias("exact"), F.when(F.col("tool") == "click", F.format_string('{"big":false,"k":%d.0}', F.col("target") % 5)).otherwise(loose).alias("arguments"))
    found = matching.matched(specs.filter("case.step <= 31"), log.select(at(0), F.col("tool").alias("name"), "arguments"), "case")
    return found.select("case.case_id", "case.step", "specs", "matches", F.round("accuracy", 9).alias("accuracy"))


@query(f"""WITH {LOG}, d AS (SELECT case_id, step, tool, count(*) AS n FROM log GROUP BY ALL), k AS (SELECT DISTINCT case_id, step FROM d),
p AS (SELECT k.case_id, k.step, v.tool, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM k JOIN k y ON y.case_id = k.case_id AND y.step = k.step - 1 CROSS JOIN (SELECT DISTINCT tool FROM log) v
  LEFT JOIN d a ON a.case_id = k.case_id AND a.step = k.step AND a.tool = v.tool LEFT JOIN d b ON b.case_id = k.case_id AND b.step = k.step - 1 AND b.tool = v.tool)
SELECT case_id, step, sum(least(a, b))::BIGINT AS shared, sum(greatest(a, b))::BIGINT AS either, sum(greatest(a - b, 0))::BIGINT AS extra, sum(greatest(b - a, 0))::BIGINT AS missing,
string_agg(tool, ',' ORDER BY tool) FILTER (least(a, b) > 0) AS both, coalesce(string_agg(tool || ':' || (a - b), ',' ORDER BY tool) FILTER (a > b), '') AS excess FROM p GROUP BY ALL HAVING sum(least(a, b)) > 0""")
def tool_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a day's tools and of the day before as maps: least and largest counts, excess, key sets, sorted keys."""
    days = executions(spark, sf_dir).groupBy("case_id", "step", "tool").agg(F.count(F.lit(1)).alias("n")).groupBy("case_id", "step").agg(counters.of_pairs("tool", "n").alias("own"))
    before = days.select("case_id", (F.col("step") + 1).alias("step"), F.col("own").alias("old"))
    own, old = F.col("own"), F.col("old")
    both = days.join(before, ["case_id", "step"]).withColumns({"both": counters.intersection(own, old), "excess": counters.excess(own, old)})
    return both.filter(F.size("both") > 0).select(
        "case_id", "step", counters.total(F.col("both")).alias("shared"), counters.total(counters.union(own, old)).alias("either"), counters.total(F.col("excess")).alias("extra"),
        counters.total(counters.excess(old, own)).alias("missing"), F.array_join(counters.keys(F.col("both")), ",").alias("both"), counters.rendered(F.col("excess")).alias("excess"))


@query(f"""WITH {LOG}, n AS (SELECT case_id, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, least(count(*) FILTER (tool = 'view'), 1) + least(count(*) FILTER (tool = 'click'), 1) + least(count(*) FILTER (tool = 'purchase'), 1) AS tp FROM log GROUP BY 1)
SELECT case_id::VARCHAR AS case_id, calls::BIGINT AS tool_attempt_count, calls::BIGINT AS tool_call_count, calls::BIGINT AS tool_execution_count, failed::BIGINT AS failed_tool_calls, round((calls - failed) / calls, 9) AS execution_success_rate, tp::BIGINT AS tool_true_positives, (calls - tp)::BIGINT AS tool_false_positives, (3 - tp)::BIGINT AS tool_false_negatives,
round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / calls) * (tp / 3) / (tp / calls + tp / 3) END, 9) AS tool_f1, 0::BIGINT AS expected_failed_calls, failed::BIGINT AS unexpected_failed_calls FROM n""")
def execution_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rates and multiset scores of records, from JSON to metrics without Python."""
    rows = case_records(spark, sf_dir).withColumn("case_id", F.get_json_object("case", "$.id"))
    found = score_columns.execution_metrics(normalise.event_tables(rows, "case_id"), rows.select("case_id", "case"))
    rates = ("execution_success_rate", "tool_f1")
    return found.select("case_id", "tool_attempt_count", "tool_call_count", "tool_execution_count", "failed_tool_calls", "tool_true_positives", "tool_false_positives", "tool_false_negatives", "expected_failed_calls", "unexpected_failed_calls", *(F.round(r, 9).alias(r) for r in rates))
