"""Queries that write files to the shared folder and return what was read back, and queries in SQL text; with their SQL.

What is written comes from the given tables, so the files grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import jsonx, registry
from tracemill.functions.registry import Argument, Tool
from tracemill.operators import callbacks, draws, tree_digest
from tracemill.plans.catalogue import LOG, executions, query, table
from tracemill.sources import jsonl, line_source, sinks
from tracemill.sources.shared import new_folder
from tracemill.streaming import streams

PARTS = 4


def _written(rows: DataFrame, part: Column, order: list[str], text: Column, folder: str) -> str:
    """One text file for each of PARTS parts, its lines in order, below folders part=N."""
    made = rows.withColumn("part", part).repartition(PARTS, "part").sortWithinPartitions("part", *order)
    made.select("part", text.alias("value")).write.partitionBy("part").text(folder)
    return folder


def _turn() -> Column:
    return F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("query")))


@query(f"""WITH l AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id % {PARTS} ORDER BY conv_id, turn) AS line FROM conversations)
SELECT conv_id % {PARTS} AS part, line, conv_id || '-' || turn AS id, role AS query, NULL::VARCHAR AS violation FROM l""")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON Lines and read by the data source: byte ranges of 4 KB, numbers within the file, checked as cases."""
    folder = _written(table(spark, sf_dir, "conversations"), F.col("conv_id") % PARTS, ["conv_id", "turn"], _turn(), new_folder(spark, "lines"))
    rows = line_source.numbered(line_source.scan(spark, folder, split=4096, torn="error"))
    part = F.regexp_extract("file", r"/part=(\d+)/", 1).cast("bigint").alias("part")
    return jsonl.check_cases(rows.drop("terminated")).select(part, "line", "id", "query", "violation")


@query("""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS line FROM conversations) SELECT conv_id || '-' || turn AS id, role AS query FROM t WHERE line <= 25""")
def limited_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3, A1: the first 25 cases of a file (a limit is the feature); lines behind them are not checked."""
    folder = new_folder(spark, "limited")
    table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").coalesce(1).select(_turn().alias("value")).write.text(folder)
    return jsonl.load_cases(spark, folder, 25).select("id", "query")


@query("""SELECT conv_id || '-' || turn AS id FROM conversations WHERE role <> 'assistant'""")
def pending_after_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is selected and not in a log of completed records; the log has the assistant's turns, read through the data source without a torn tail."""
    turns = table(spark, sf_dir, "conversations")
    record = F.concat(F.lit('{"case":{"id":"'), F.concat_ws("-", "conv_id", "turn"), F.lit('"},"result":{"role":"'), F.col("role"), F.lit('"}}'))
    folder = _written(turns.filter("role = 'assistant'"), F.col("conv_id") % PARTS, ["conv_id", "turn"], record, new_folder(spark, "log"))
    done = jsonl.require_clean(jsonl.check_records(line_source.numbered(line_source.whole_records(line_source.scan(spark, folder))).drop("terminated")))
    return jsonl.pending(turns.select(F.concat_ws("-", "conv_id", "turn").alias("id")), done)


@query("""SELECT user_id AS case_id, event_type AS tool, count(*)::BIGINT AS kept FROM (SELECT DISTINCT user_id, event_type, props FROM events) GROUP BY ALL""")
def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7, B1: a stream of events appended once per key (user, type and properties), by state; what the target holds, counted."""
    target, checkpoint = new_folder(spark, "appended"), new_folder(spark, "append-state")
    key = F.struct("user_id", "event_type", "props").alias("key")
    stream = streams.event_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema).select(key, F.col("user_id").alias("case_id"), F.col("event_type").alias("tool"))
    streams.append_new(stream, target, checkpoint, "key").awaitTermination()
    return spark.read.parquet(target).groupBy("case_id", "tool").agg(F.count(F.lit(1)).alias("kept"))


@query("""SELECT conv_id::VARCHAR AS id, count(*)::BIGINT AS messages, CASE WHEN conv_id % 7 = 0 THEN 'other split' WHEN arg_min(role, turn) <> 'user' THEN 'other prompt' END AS violation FROM conversations GROUP BY conv_id""")
def trajectory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: conversations written as training trajectories and read with the first rule that each breaks: empty, of another split, with another first message. Every seventh is of another split; the first message must be the user's."""
    turn = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    made = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn.alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.when(x["turn"] == F.get("m", F.lit(0))["turn"], x["role"]).otherwise(x["content"]).alias("content")))
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.when(F.col("conv_id") % 7 == 0, "dev").otherwise("train").alias("split"), messages.alias("messages")))
    folder = _written(made, F.col("conv_id") % PARTS, ["conv_id"], line, new_folder(spark, "trajectories"))
    return jsonl.trajectories(spark, folder, "train", "user").select("id", F.size("messages").cast("bigint").alias("messages"), "violation")


@query("""SELECT lang, item, sha256('{"doc_id":' || doc_id || ',"source":"' || source || '"}') AS digest FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS item FROM documents WHERE lang IS NOT NULL)""")
def array_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON arrays over many lines, a file per language below folders, and read by a pattern, each item with its file."""
    rows = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select("lang", F.struct("doc_id", "source").alias("d"))
    arrays = rows.groupBy("lang").agg(F.sort_array(F.collect_list("d")).alias("items"))
    folder = new_folder(spark, "arrays")
    arrays.select("lang", F.concat(F.lit("[\n"), F.array_join(F.transform("items", lambda x: F.to_json(x)), ",\n"), F.lit("\n]")).alias("value")).write.partitionBy("lang").text(folder)
    items = jsonl.documents(spark, f"{folder}/lang=*", whole_path=True).withColumn("lang", F.regexp_extract("source", "/lang=([^/]*)/", 1))
    place = F.rank().over(_by("lang", F.get_json_object("content", "$.doc_id").cast("bigint"))) - 1
    return items.select("lang", place.cast("bigint").alias("item"), F.sha2(F.to_json(F.try_parse_json("content")).cast("binary"), 256).alias("digest"))


def _by(part: str, order: Column):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


@query("""WITH t AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1) SELECT status, n::BIGINT AS n, 'true,false,conflict,true,false' AS writes, 2::BIGINT AS published FROM t""")
def write_once_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written once (the same again is left alone, other content refused), published with a second one, and compared with its regeneration; the rows are what was read back."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    other = counts.withColumn("n", F.col("n") + 1)
    path = new_folder(spark, "once")
    writes = [sinks.write_once(counts, path), sinks.write_once(counts.repartition(3), path)]
    try:
        sinks.write_once(other, path)
    except ValueError:
        writes.append("conflict")
    writes += [sinks.regenerates(counts, path), sinks.regenerates(other, path)]
    second, third = new_folder(spark, "published"), new_folder(spark, "published")
    published = sinks.publish({path: counts, second: other, third: counts})
    return spark.read.parquet(path).select("status", "n", F.lit(",".join(str(w).lower() for w in writes)).alias("writes"), F.lit(len(published)).cast("bigint").alias("published"))


@query("""WITH t AS (SELECT l_returnflag AS flag, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1) SELECT flag, round(quantity, 2) AS quantity, n::BIGINT AS n, (SELECT count(*) FROM lineitem)::BIGINT AS seen, true AS refused FROM t""")
def gated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written beside the target with the metrics that the write itself gathers, moved into place as they pass; a second write that does not pass leaves nothing."""
    lines, path, bad = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), new_folder(spark, "gated"), new_folder(spark, "gated")
    found = sinks.gated_write(lines, path, {"rows": F.count(F.lit(1)), "least": F.min("l_quantity")}, lambda m: m["rows"] > 0 and m["least"] >= 0)
    refused = False
    try:
        sinks.gated_write(lines, bad, {"rows": F.count(F.lit(1))}, lambda m: m["rows"] < 0)
    except ValueError:
        refused = not sinks.exists(spark, bad)
    out = spark.read.parquet(path).groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).alias("n"))
    return out.withColumns({"seen": F.lit(found["rows"]).cast("bigint"), "refused": F.lit(refused)})


@query("""SELECT doc_id AS ordinal, sha256(text) AS digest, (SELECT count(*) FROM documents)::BIGINT AS stored FROM documents""")
def example_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples stored by number in sorted files and read again."""
    path = new_folder(spark, "examples")
    n = sinks.example_store(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), "text"), path, 500)
    return spark.read.parquet(path).select("ordinal", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit(n).cast("bigint").alias("stored"))


@query()
def folder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the data folder with their tree digests and the folder's, from blocks of 1 MB."""
    files = tree_digest.kept(tree_digest.file_digests(spark, sf_dir, block=1 << 20))
    return files.withColumn("folder", F.lit(tree_digest.folder_digest(files)))


@query(f"""WITH t AS (SELECT conv_id % {PARTS} AS part, '{{"id":"' || conv_id || '-' || turn || '","query":"' || role || '"}}' || chr(10) AS line, conv_id, turn FROM conversations)
SELECT part, sum(strlen(line))::BIGINT AS size, sha256(string_agg(line, '' ORDER BY conv_id, turn)) AS digest, NULL::VARCHAR AS reason FROM t GROUP BY part""")
def written_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from conversations, their sizes and digests as read block by block, and what a manifest of them says of the folder (nothing has drifted). The SQL holds for files of one block of 64 MB."""
    folder = _written(table(spark, sf_dir, "conversations"), F.col("conv_id") % PARTS, ["conv_id", "turn"], _turn(), new_folder(spark, "digests"))
    files = tree_digest.kept(tree_digest.file_digests(spark, folder))
    drift = tree_digest.drift(spark, folder, files)
    return files.join(drift, "path", "left").select(F.regexp_extract("path", r"^part=(\d+)/", 1).cast("bigint").alias("part"), "size", "digest", "reason")


# tools and generators in SQL, draws, reports


TOOLS = {
    "measure": Tool({"text": Argument("string")}, "length(text)"),
    "head": Tool({"text": Argument("string"), "n": Argument("bigint")}, "left(text, CAST(n AS INT))"),
    "share": Tool({"part": Argument("bigint"), "whole": Argument("bigint")}, "floor(try_divide(100 * part, whole))", "ZeroDivisionError"),
    "look": Tool({"role": Argument("string", ("user", "assistant"))}, "upper(role)"),
}


@query("""WITH c AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix, length(text)::BIGINT AS target,
  length(text) - length(replace(text, ',', '')) AS commas, length(text) - length(replace(text, '.', '')) - 1 AS stops FROM conversations),
r AS (SELECT *, CASE length(text) % 5 WHEN 0 THEN 'measure' WHEN 1 THEN 'head' WHEN 2 THEN 'share' WHEN 3 THEN 'look' ELSE 'nothing' END AS name FROM c WHERE role = 'assistant')
SELECT conv_id, turn, prefix, target, name, CASE name WHEN 'nothing' THEN 'unknown_tool' WHEN 'share' THEN CASE WHEN stops = 0 THEN 'ZeroDivisionError' END WHEN 'look' THEN CASE WHEN commas > 3 THEN 'invalid_arguments' END END AS error_type,
CASE name WHEN 'measure' THEN target::VARCHAR WHEN 'head' THEN left(text, 3) WHEN 'share' THEN CASE WHEN stops <> 0 THEN floor(100 * commas / stops)::BIGINT::VARCHAR END WHEN 'look' THEN CASE WHEN commas <= 3 THEN 'ASSISTANT' END END AS result FROM r""")
def sql_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SQL text: a table function gives the supervised turns, and a tool that the turn's length chooses is called on each; unknown tools, arguments outside the domain and failures come back as envelopes."""
    registry.install(spark, TOOLS)
    registry.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("tracemill_turns")
    return spark.sql("""
        WITH counted AS (
          SELECT s.conv_id, s.turn, s.prefix, s.target, c.text, length(c.text) - length(replace(c.text, ',', '')) AS commas, length(c.text) - length(replace(c.text, '.', '')) - 1 AS stops
          FROM supervised(TABLE(tracemill_turns), 'conv_id', 'turn') s JOIN tracemill_turns c ON c.conv_id = s.conv_id AND c.turn = s.turn),
        called AS (
          SELECT *, CASE target % 5 WHEN 0 THEN 'measure' WHEN 1 THEN 'head' WHEN 2 THEN 'share' WHEN 3 THEN 'look' ELSE 'nothing' END AS name,
            CASE target % 5 WHEN 0 THEN to_json(named_struct('text', text)) WHEN 1 THEN to_json(named_struct('text', text, 'n', 3)) WHEN 2 THEN to_json(named_struct('part', commas, 'whole', stops))
              WHEN 3 THEN to_json(named_struct('role', IF(commas > 3, 'nobody', 'assistant'))) ELSE '{}' END AS arguments FROM counted)
        SELECT conv_id, turn, prefix, target, name, r.error_type, r.result FROM (SELECT *, call_tool(name, arguments) AS r FROM called)""")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT source AS g, n_chars % 50 AS c FROM documents WHERE source IS NOT NULL), o AS (SELECT g, row_number() OVER (ORDER BY g) AS i, list(c ORDER BY sha256(g || ':' || c), c) AS wanted FROM p GROUP BY g),
t AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS g, []::BIGINT[] AS used, []::BIGINT[] AS mine
  UNION ALL SELECT i, g, list_concat(used, mine), mine FROM (SELECT o.i, o.g, t.used, list_filter(o.wanted, lambda x: NOT list_contains(t.used, x))[1:3] AS mine FROM t JOIN o ON o.i = t.i + 1))
SELECT g AS source, unnest(mine) AS value, unnest(range(1, len(mine) + 1))::INTEGER AS place FROM t WHERE i > 0""")
def drawn_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source draws three of the values that its documents have (their length modulo 50), by hash rank, none that an earlier source has drawn; in parallel rounds."""
    pairs = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.col("source").alias("group"), (F.col("n_chars") % 50).alias("candidate")).distinct()
    ranked = pairs.withColumn("rank", F.sha2(F.concat_ws(":", "group", "candidate").cast("binary"), 256))
    return draws.draw(ranked, 3).select(F.col("group").alias("source"), F.col("candidate").alias("value"), "place")


@query(f"""WITH {LOG}, p AS (SELECT *, lag(tool) OVER w AS t, lag(target) OVER w AS k FROM log WINDOW w AS (PARTITION BY case_id ORDER BY idx))
SELECT event_id, value >= 5 AS valid_json, value >= 5 AND tool = t AND target = k AS exact_report, value >= 5 AND tool = t AS decision_correct FROM p WHERE t IS NOT NULL""")
def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-ev, J2: an event as a report on the event before it: valid, exactly equal as JSON, the same decision; cheap events repeat a key and so are no JSON."""
    before = executions(spark, sf_dir).withColumns({n: F.lag(c).over(_by("case_id", F.col("idx"))) for n, c in (("t", "tool"), ("k", "target"))}).filter("t IS NOT NULL")
    text = F.when(F.col("value") >= 5, F.format_string('{"k": %d, "decision": "%s"}', "target", "tool")).otherwise(F.format_string('{"decision":"%s","k":%d,"k":%d}', "tool", "target", "target"))
    score = jsonx.report_score(text, F.format_string('{"decision":"%s","k":%d.0}', "t", "k"))
    return before.select("event_id", score.alias("s")).select("event_id", "s.*")


@query("""SELECT event_id, contains(props, (floor(value) % 10)::BIGINT::VARCHAR) AS digit, contains(props, '"k": ' || floor(value)::BIGINT) AS start FROM events""")
def loose_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generators' looser check on texts: a digit of the properties, and a key with the start of its number."""
    whole = F.floor("value").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", jsonx.loosely_contains(F.col("props"), (whole % 10).cast("string")).alias("digit"), jsonx.loosely_contains(F.col("props"), F.concat(F.lit('"k": '), whole.cast("string"))).alias("start"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, length(text) - length(replace(text, ',', '')) AS commas FROM conversations WHERE role = 'user'),
m AS (SELECT *, unnest([0, 1]) AS place FROM c)
SELECT conv_id, turn, place::BIGINT AS place, place = 0 OR commas < 2 AS valid, CASE WHEN place = 0 THEN 'measure' WHEN commas < 2 THEN 'look' END AS name, place = 0 OR commas = 0 AS ok,
CASE WHEN place = 0 THEN commas + 1 WHEN commas = 0 THEN NULL END::VARCHAR AS length, CASE WHEN place = 0 OR commas = 0 THEN NULL WHEN commas = 1 THEN 'invalid_arguments' ELSE 'invalid_call' END AS error_type FROM m""")
def generated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's turns through two callbacks: one generates two tool calls from the text (the second one broken where there are several commas), the other executes them as SQL functions."""
    registry.install(spark, TOOLS)
    commas = lambda t: F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))

    def generate(t: Column) -> Column:
        first = F.concat(F.lit('I see. <tool_call>{"name":"measure","arguments":{"text":"'), F.repeat(F.lit("x"), commas(t) + 1), F.lit('"}}</tool_call>'))
        second = F.when(commas(t) == 0, '{"tool":"look","args":{"role":"user"}}').when(commas(t) == 1, '{"name":"look","arguments":{"role":"none"}}').otherwise('{"name":"look"')
        return F.concat(first, F.lit(" and then <tool_call> "), second, F.lit(" </tool_call>"))

    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    done = callbacks.executed(callbacks.generated(turns, generate), lambda name, arguments: F.call_function("call_tool", name, arguments))
    return done.select("conv_id", "turn", "place", "valid", "name", "ok", F.when(F.col("name") == "measure", F.col("result")).alias("length"), "error_type")
