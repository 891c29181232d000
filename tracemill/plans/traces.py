"""Queries over traces made of the events table: grids, variants, layouts, reports, policies, contracts; with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import diagnostics, reports, scoring
from tracemill.plans.catalogue import LOG, executions, query, table
from tracemill.sources import jsonl
from tracemill.sources.generators import variants
from tracemill.sources.shared import new_folder

#: An event type as a tool of the studied application.
_TOOLS = {"view": "inspect_ui_state", "click": "verify_state", "purchase": "execute_action", "error": "query_logs", "signup": "search_knowledge"}
_TOOL_SQL = "CASE tool " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TOOLS.items()) + " END"


def _tool() -> Column:
    out = F.lit(None).cast("string")
    for k, v in _TOOLS.items():
        out = F.when(F.col("tool") == k, v).otherwise(out)
    return out


@query("""WITH d AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), l AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)
SELECT l.lang, s.source, k::INTEGER AS layout, left(sha256(l.lang || '|' || s.source || '|' || k), 12) AS id, coalesce(d.n, 0)::BIGINT AS documents FROM l CROSS JOIN s CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) LEFT JOIN d ON d.lang = l.lang AND d.source = s.source""")
def dimension_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of the documents' languages, sources and three layouts as cases with derived ids, and how many documents each has. The dimensions are distinct values, counted before they are crossed."""
    docs = table(spark, sf_dir, "documents")
    counts = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"))
    one = lambda c: counts.select(c).filter(F.col(c).isNotNull()).distinct()
    grid = one("lang").crossJoin(one("source")).withColumn("layout", F.explode(F.sequence(F.lit(0), F.lit(2))))
    key = F.substring(F.sha2(F.concat_ws("|", "lang", "source", F.col("layout").cast("string")).cast("binary"), 256), 1, 12)
    return grid.join(counts, ["lang", "source"], "left").select("lang", "source", "layout", key.alias("id"), F.coalesce("documents", F.lit(0)).alias("documents"))


@query("""SELECT item_id || '_' || style || '_' || arm AS id, item_id, style, arm, sha256(style || text) AS digest FROM benchmark, (SELECT unnest(['json', 'records', 'table']) AS style), (SELECT unnest(['fixed', 'mixed']) AS arm)""")
def variant_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item once per style and arm, with ids of their own."""
    rows = variants(variants(table(spark, sf_dir, "benchmark"), "style", ["json", "records", "table"]), "arm", ["fixed", "mixed"])
    return rows.select(F.concat_ws("_", F.col("item_id").cast("string"), "style", "arm").alias("id"), "item_id", "style", "arm", F.sha2(F.concat("style", "text").cast("binary"), 256).alias("digest"))


_ENTRIES = f"""{LOG}, e AS (SELECT case_id, step, row_number() OVER (PARTITION BY case_id, step ORDER BY idx) AS i, '{{"arguments":{{"k":' || target || '}},"name":"' || tool || '"}}' AS c, CASE WHEN ok THEN '{{"ok":true,"result":' || target || '}}' ELSE '{{"error":"x","ok":false}}' END AS r FROM log)"""


@query(f"""WITH {_ENTRIES}, d AS (SELECT case_id, step, count(*) AS entries, '[' || string_agg('{{"result":' || r || ',"tool_call":' || c || '}}', ',' ORDER BY i) || ']' AS json, string_agg('记录' || i || ' 输入：' || c || chr(10) || '返回：' || r, chr(10) ORDER BY i) AS records,
  '序号 | 工具输入JSON | 实际返回JSON' || chr(10) || string_agg(i || ' | ' || c || ' | ' || r, chr(10) ORDER BY i) AS "table" FROM e GROUP BY ALL)
SELECT case_id, step, entries::BIGINT AS entries, style, sha256(CASE style WHEN 'json' THEN json WHEN 'records' THEN records ELSE "table" END) AS digest FROM d, (SELECT unnest(['json', 'records', 'table']) AS style)""")
def evidence_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls and returns of each user's day as JSON, as records and as a table."""
    log = executions(spark, sf_dir)
    call = F.format_string('{"arguments":{"k":%d},"name":"%s"}', "target", "tool")
    result = F.when(F.col("ok"), F.format_string('{"ok":true,"result":%d}', "target")).otherwise('{"error":"x","ok":false}')
    days = log.groupBy("case_id", "step").agg(F.array_sort(F.collect_list(F.struct("idx", call.alias("tool_call"), result.alias("result")))).alias("entries"))
    rows = variants(days, "style", list(diagnostics.STYLES))
    shown = F.coalesce(*(F.when(F.col("style") == s, text.rendered(F.col("entries"), s)) for s in diagnostics.STYLES))
    return rows.select("case_id", "step", F.size("entries").cast("bigint").alias("entries"), "style", F.sha2(shown.cast("binary"), 256).alias("digest"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as executions of the application's tools: dear views fail with a wrong argument, dear checks for a moment."""
    log, k, dear = executions(spark, sf_dir), F.col("target"), F.col("value") > 80
    name = _tool()
    ok = ~((name == "inspect_ui_state") & dear | (name == "verify_state") & dear)
    state = F.format_string('{"current_page":"p%d"}', k % 5)
    payload = F.when(name == "verify_state", F.format_string('{"success":%s,"current_state":%s}', (k % 3 != 0).cast("string"), state)).when(name == "query_logs", F.to_json(F.array_repeat(k, (k % 4).cast("int")))).otherwise(state)
    return log.select("case_id", "idx", name.alias("tool"), ok.alias("ok"), F.when(~ok, F.when(name == "inspect_ui_state", "TypeError").otherwise("RuntimeError")).alias("error_type"), F.when(~ok, "a transient_failure").alias("error"), F.when(ok, payload).alias("payload_json"), F.col("tool").alias("event"))


_OUTCOMES = f"""{LOG}, x AS (SELECT case_id, idx, target AS k, {_TOOL_SQL} AS tool, NOT (tool IN ('view', 'click') AND value > 80) AS ok FROM log), f AS (SELECT case_id, arg_min(tool, idx) = 'inspect_ui_state' AS read_only FROM x GROUP BY 1)"""


@query(f"""WITH {_OUTCOMES}, b AS (SELECT x.*, f.read_only, read_only AND tool = 'execute_action' AS blocked FROM x JOIN f USING (case_id))
SELECT case_id, read_only, count(*) FILTER (NOT blocked)::BIGINT AS dispatched, count(*) FILTER (blocked OR NOT ok)::BIGINT AS tool_errors, count(*) FILTER (NOT blocked AND ok AND tool = 'verify_state' AND k % 3 = 0)::BIGINT AS verification_failures, count(*) FILTER (blocked)::BIGINT AS policy_blocks,
count(*) FILTER (blocked OR NOT ok)::BIGINT + count(*) FILTER (NOT blocked AND ok AND tool = 'verify_state' AND k % 3 = 0)::BIGINT AS total_failures, 'p' || arg_max(k % 5, idx) FILTER (NOT blocked AND ok AND tool NOT IN ('query_logs', 'search_knowledge')) AS page, (arg_max(k % 4, idx) FILTER (tool = 'query_logs'))::BIGINT AS log_count,
CASE WHEN read_only THEN 'stop_mutations' WHEN count(*) FILTER (NOT blocked AND NOT ok AND tool = 'inspect_ui_state') > 0 THEN 'repair_arguments' WHEN count(*) FILTER (NOT blocked AND NOT ok) > 0 THEN 'inspect_before_retry' ELSE 'no_retry_needed' END AS decision FROM b GROUP BY case_id, read_only""")
def policy_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as calls under a read-only policy (cases that begin with a look), and the report that each case's returns prove."""
    rows = _outcomes(spark, sf_dir)
    first = rows.groupBy("case_id").agg((F.min_by("tool", "idx") == "inspect_ui_state").alias("locked"))
    guarded = reports.under_policy(rows.join(first, "case_id"), F.col("locked"))
    told = reports.evidence(guarded, F.bool_or("locked"))
    sent = guarded.groupBy("case_id").agg(F.count_if("dispatched").alias("dispatched"))
    return told.join(sent, "case_id").select("case_id", "read_only", "dispatched", "tool_errors", "verification_failures", "policy_blocks", "total_failures", F.get_json_object("state", "$.current_page").alias("page"), "log_count", "decision")


@query(f"""WITH {LOG} SELECT event_id, CASE WHEN tool = 'error' THEN 'no object' WHEN value > 60 THEN 'other fields' WHEN target % 7 NOT IN (0, 1, 2) THEN 'bad quality' WHEN value < 10 THEN 'bad cache_enabled' END AS fault FROM log""")
def config_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations made of events, outside their domain or not: exactly two fields, a known quality, a real boolean."""
    quality = F.coalesce(F.get(F.array(*map(F.lit, ("low", "standard", "high"))), (F.col("target") % 7).cast("int")), F.lit("other"))
    flag = F.when(F.col("value") < 10, "1").otherwise("true")
    config = F.when(F.col("tool") == "error", F.concat(F.lit('["'), quality, F.lit('"]'))).when(F.col("value") > 60, F.format_string('{"quality":"%s","cache_enabled":%s,"k":1}', quality, flag)).otherwise(F.format_string('{"cache_enabled":%s,"quality":"%s"}', flag, quality))
    fault = reports.config_fault(config, {"quality": ("low", "standard", "high"), "cache_enabled": "boolean"})
    return executions(spark, sf_dir).select("event_id", fault.alias("fault"))


@query("""SELECT a.conv_id, a.turn, s.turn AS source_turn, sha256(s.text) AS source, length(a.text)::BIGINT - length(s.text)::BIGINT AS longer FROM conversations a JOIN conversations s ON s.conv_id = a.conv_id AND s.turn = a.turn - 1 WHERE a.role = 'assistant' AND s.role = 'user'""")
def rewrite_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original of each rewrite, looked up by id: an assistant's turn and the user's turn before it."""
    turns = table(spark, sf_dir, "conversations")
    originals = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("source_turn"), F.col("text").alias("original"))
    rewrites = turns.filter("role = 'assistant'").withColumn("source_turn", F.col("turn") - 1)
    return rewrites.join(originals, ["conv_id", "source_turn"]).select("conv_id", "turn", "source_turn", F.sha2(F.col("original").cast("binary"), 256).alias("source"), (F.length("text") - F.length("original")).cast("bigint").alias("longer"))


def _contract_records(spark: SparkSession, sf_dir: str, names: dict[str, str], case: Column, payload: Column, error: Column) -> DataFrame:
    from tracemill.plans.records import trajectories

    tool = F.coalesce(*(F.when(F.col("tool") == k, v) for k, v in names.items()))
    return scoring.score_records(trajectories(executions(spark, sf_dir).withColumn("tool", tool), case, payload, error, query=F.lit('"q"')))


@query(f"""WITH {LOG}, n AS (SELECT case_id, count(*) AS calls, count(*) FILTER (tool = 'purchase') AS p, count(*) FILTER (tool = 'click') AS c, min(idx) FILTER (tool IN ('purchase', 'click')) AS m FROM log GROUP BY 1),
v AS (SELECT case_id, calls <= 70 AS within, list_filter([CASE WHEN case_id % 2 = 0 AND p + c > 0 THEN 'read_only_violated' END, CASE WHEN case_id % 3 = 0 AND c > 0 THEN 'unnecessary_navigation' END], lambda x: x IS NOT NULL) AS violations FROM n)
SELECT case_id::VARCHAR AS id, within AND len(violations) = 0 AS execution_success, array_to_string(violations, ',') AS violations FROM v""")
def contract_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-2.3: records under the public contract: cases that may only read, cases that must not navigate."""
    c = F.col("case_id")
    flag = lambda on: F.when(on, "true").otherwise("false")
    case = F.format_string(
        '{"id":"%d","query":"q","category":"c","protocol_version":"2.3","process_constraints":[],"required_calls":[],"public_contract":{"read_only":%s,"no_navigation":%s,"no_set_graphics":false,"knowledge_before_mutation":false,"build_evidence":false,"ordered_calls":[]},"success_criteria":{"max_tool_calls":70}}',
        c, flag(c % 2 == 0), flag(c % 3 == 0))
    names = {"view": "inspect_ui_state", "click": "navigate_ui", "purchase": "execute_action", "error": "query_logs", "signup": "search_knowledge"}
    scored = _contract_records(spark, sf_dir, names, case, F.lit("{}"), F.lit('"error":"x"'))
    return scored.select("id", "execution_success", F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {LOG}, n AS (SELECT case_id, arg_max(target % 3, idx) FILTER (tool IN ('view', 'purchase')) AS page, arg_max(target % 3, idx) FILTER (tool IN ('view', 'purchase', 'signup')) AS last_page, max(idx) FILTER (tool IN ('purchase', 'error')) AS attempt, max(idx) FILTER (tool = 'click') AS logs FROM log GROUP BY 1),
v AS (SELECT case_id, coalesce(page = case_id % 3, false) AS same, coalesce(last_page = case_id % 3, false) AS final, logs IS NOT NULL AND logs > coalesce(attempt, -1) AS read_last FROM n)
SELECT case_id::VARCHAR AS id, final AS final_state_match, final AND same AND (read_last OR case_id % 2 = 1) AS execution_success, array_to_string(list_filter([CASE WHEN NOT same THEN 'final_state_observation_missing_or_mismatched' END, CASE WHEN case_id % 2 = 0 AND NOT read_last THEN 'logs_not_read_after_last_application_attempt' END], lambda x: x IS NOT NULL), ',') AS violations FROM v""")
def observation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-2.4, G4, G5: records under the observation contract: the final page (of any return that has one) must have been seen by a tool that shows the state since the last change, and in even cases a log must be read after the last attempt, failed ones included."""
    c, k = F.col("case_id"), F.col("target")
    contract = '{"read_only":false,"no_navigation":false,"no_set_graphics":false,"knowledge_before_mutation":false,"build_evidence":false,"ordered_calls":[]}'
    case = F.format_string(
        '{"id":"%d","query":"q","category":"c","protocol_version":"2.4","process_constraints":[],"required_calls":[],"public_contract":' + contract + ',"observation_contract":{"final_state_fields":["current_page"],"logs_after_last_mutation":%s},"success_criteria":{"final_state":{"current_page":"p%d"}}}',
        c, F.when(c % 2 == 0, "true").otherwise("false"), c % 3)
    names = {"view": "inspect_ui_state", "click": "query_logs", "purchase": "execute_action", "error": "navigate_ui", "signup": "search_knowledge"}
    payload = F.when(F.col("tool") == "query_logs", "[]").otherwise(F.format_string('{"current_page":"p%d"}', k % 3))
    scored = _contract_records(spark, sf_dir, names, case, payload, F.lit('"error":"x"'))
    return scored.select("id", "final_state_match", "execution_success", F.array_join("violations", ",").alias("violations"))


@query("""SELECT max(y)::BIGINT AS step FROM (SELECT year(o_orderdate) AS y, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY 1) WHERE 3 * done > n HAVING max(y) IS NOT NULL""")
def newest_whole_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint folders, one per year of orders; a year of whose orders over a third are done has its seal, and the newest sealed one is found without opening a file."""
    root = new_folder(spark, "checkpoints")
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("n")).collect()  # a row per year
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in years:
        for name in ("model", "state", *(["seal"] if 3 * r["done"] > r["n"] else [])):
            stream = fs.create(place(f"{root}/checkpoint-{r['y']}/{name}"))
            stream.write(ord("x"))
            stream.close()
    return jsonl.newest_checkpoint(spark, root, ["model", "state", "seal"]).select("step")
