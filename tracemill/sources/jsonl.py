"""Strict JSON Lines sources (A1-A12, D13, F25, N-group): scans with line numbers, violations as columns, resume.

Line numbers come from counts per file block, so no task sees a whole file and
files may have any size. A violation is a column; ``require_clean`` turns the
first one into an error that names its line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text of every line, blank ones included."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_m"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("_m"))
    before = raw.groupBy("file", "block").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return raw.withColumn("place", place).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("line"), F.col("value").alias("text"))


def _kind(text: Column, path: str) -> Column:
    """The JSON kind at a path, null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))


def _text_at(text: Column, path: str) -> Column:
    return F.when(_kind(text, path) == "STRING", F.try_variant_get(F.try_parse_json(text), path, "string"))


def _checked(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds the name of the first rule that a row breaks."""
    broken = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        broken = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(broken)
    return rows.withColumn("violation", broken)


def _unique(df: DataFrame, key: str) -> Column:
    """Whether no earlier line has the same key; lines without one are groups of their own, so that they don't meet in one task."""
    own = F.coalesce(F.concat(F.lit("k"), F.col(key)), F.concat_ws(":", F.lit("n"), "file", F.col("line").cast("string")))
    return F.row_number().over(Window.partitionBy(own).orderBy("file", "line")) == 1


def cases(spark: SparkSession, path: str) -> DataFrame:
    """A1: the lines of a file, checked."""
    return check_cases(lines(spark, path))


def check_cases(numbered: DataFrame) -> DataFrame:
    """A1 over file, line and text: id, query and the first violation of each line; blank lines are skipped."""
    text = F.col("text")
    rows = numbered.filter(F.trim("text") != "").withColumns({"id": _text_at(text, "$.id"), "query": _text_at(text, "$.query")})
    rows = rows.withColumn("first", _unique(rows, "id"))
    rules = [
        ("not JSON", F.try_parse_json(text).isNotNull()), ("not an object", F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")),
        ("bad id", F.col("id") != ""), ("repeated id", F.col("first")), ("bad query", F.trim("query") != ""),
    ]
    return _checked(rows, rules).drop("first")


def records(spark: SparkSession, path: str) -> DataFrame:
    """A2: the result records of a file, checked."""
    return check_records(lines(spark, path))


def check_records(numbered: DataFrame) -> DataFrame:
    """A2 over file, line and text: case, result, fingerprint and evaluator version, and the first violation of a line."""
    text = F.col("text")
    part = lambda p: F.to_json(F.try_variant_get(F.try_parse_json(text), p, "variant"))
    rows = numbered.filter(F.trim("text") != "").withColumns({
        "id": _text_at(text, "$.case.id"), "case": part("$.case"), "result": part("$.result"), "metrics": part("$.metrics"),
        "protocol": F.coalesce(_text_at(text, "$.case.protocol_version"), F.lit("2.0")), "evaluator": F.coalesce(_text_at(text, "$.evaluator_version"), F.lit("<legacy>")),
        "fingerprint": F.when(_kind(text, "$.run_metadata").isNull() | (_kind(text, "$.run_metadata") == "VOID"), "<legacy>").otherwise(_text_at(text, "$.run_metadata.fingerprint")),
        "selected": F.try_variant_get(F.try_parse_json(text), "$.run_metadata.selected_case_count", "bigint"),
    })
    rows = rows.withColumn("first", _unique(rows, "id"))
    rules = [
        ("not JSON", F.try_parse_json(text).isNotNull()), ("no case or result", _kind(text, "$.case").startswith("OBJECT") & _kind(text, "$.result").startswith("OBJECT")),
        ("bad id", F.col("id") != ""), ("repeated id", F.col("first")), ("bad run metadata", F.col("fingerprint").isNotNull()),
        ("evaluator and protocol differ", (F.col("evaluator") == "<legacy>") | (F.col("evaluator") == F.col("protocol"))),
        ("unsupported protocol", F.col("protocol").isin("2.0", "2.1", "2.2", "2.3", "2.4")),
    ]
    return _checked(rows, rules).drop("first")


def study_records(checked: DataFrame, known: DataFrame, manifest: dict[str, str], protocol: str = "2.4") -> DataFrame:
    """A3 over checked records: besides A2 a record must be a case that the study knows, unchanged, scored under its protocol, by
    a run whose fingerprint is the digest of its own metadata and whose metadata name what the manifest (metadata field to value) says.

    ``known`` has id and case (JSON text). More than one metadata text over all rows is for ``mixed`` to find, by fingerprint.
    """
    text = F.col("text")
    meta = F.try_variant_get(F.try_parse_json(text), "$.run_metadata", "map<string,variant>")
    own = F.to_json(F.map_filter(meta, lambda k, _: k != "fingerprint"))
    computed = F.sha2(F.to_json(F.try_parse_json(own)).cast("binary"), 256)
    rows = checked.join(known.select("id", F.to_json(F.try_parse_json("case")).alias("_known")), "id", "left")
    rules = [
        ("unknown case", F.col("_known").isNotNull()), ("changed case", F.to_json(F.try_parse_json("case")) == F.col("_known")), ("wrong protocol", F.col("evaluator") == protocol),
        *((f"other {name}", _text_at(text, f"$.run_metadata.{name}") == value) for name, value in manifest.items()), ("bad fingerprint", F.col("fingerprint") == computed),
    ]
    found = _checked(rows.withColumnRenamed("violation", "_first"), rules)
    return found.withColumn("violation", F.coalesce("_first", "violation")).drop("_first", "_known")


def mixed(rows: DataFrame, columns: tuple[str, ...] = ("fingerprint", "evaluator", "protocol")) -> list[str]:
    """The columns that have more than one value; such files are not summed up."""
    found = rows.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    return [c for c in columns if found[c] > 1]


def run_coverage(rows: DataFrame) -> DataFrame:
    """completed of selected cases; null rates while no selection is known."""
    n, selected = F.count(F.lit(1)), F.max("selected")
    return rows.agg(n.alias("completed"), selected.alias("selected"), F.when((selected == 0) & (n == 0), 1.0).when(selected > 0, n / selected).alias("coverage"), (n == selected).alias("complete"), ((F.count_distinct("selected") > 1) | (n > selected)).alias("inconsistent"))


def require_clean(rows: DataFrame) -> DataFrame:
    """The rows without the violation column; an error that names the first broken line if there is one."""
    bad = rows.filter("violation is not null").orderBy("file", "line").select("file", "line", "violation").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}:{bad[0]['line']}: {bad[0]['violation']}")
    return rows.drop("violation")


def load_cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A1, H3: valid cases in file order; with a limit, only lines up to the limit-th case are checked."""
    rows = cases(spark, path)
    if limit is not None:
        rows = rows.orderBy("file", "line").limit(limit)
    return require_clean(rows)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """A2: valid records of one run, one evaluator and one protocol."""
    rows = require_clean(records(spark, path))
    if found := mixed(rows):
        raise ValueError(f"{path} mixes different {', '.join(found)}")
    return rows


def ends_torn(spark: SparkSession, path: str) -> bool:
    """Whether the last byte of a file is no line end (one byte is read, through the file system of the path)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    size = fs.getFileStatus(place).getLen()
    if not size:
        return False
    stream = fs.open(place)
    try:
        stream.seek(size - 1)
        return stream.read() not in (10, 13)
    finally:
        stream.close()


def resume(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """Ids that a run has completed. A last line that is cut off is dropped; damage elsewhere, a repeated id or another fingerprint is an error."""
    rows = records(spark, path)
    if ends_torn(spark, path):
        last = rows.agg(F.max("line").alias("n")).first()["n"]
        rows = rows.filter((F.col("line") != last) | (F.col("violation") != "not JSON") | F.col("violation").isNull())
    done = require_clean(rows)
    if fingerprint is not None and done.filter(F.col("fingerprint") != fingerprint).limit(1).count():
        raise ValueError(f"{path} was written by another run")
    return done.select("id")


def pending(selected: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What is selected and not done."""
    return selected.join(done.select(key), key, "left_anti")


def reviews(spark: SparkSession, path: str, known: DataFrame, source_sha256: str) -> DataFrame:
    """Reviews with the first violation; ``known`` has id, record_sha256 and protocol of the reviewed records."""
    text = F.col("text")
    names = ("id", "source_sha256", "record_sha256", "protocol_version", "verdict", "reason", "reviewer", "reviewer_type", "reviewed_at")
    rows = lines(spark, path).filter(F.trim("text") != "").withColumns({n: _text_at(text, f"$.{n}") for n in names})
    rows = rows.withColumn("first", _unique(rows, "id"))
    now = known.select("id", F.col("record_sha256").alias("_sha"), F.when(F.col("protocol") == "2.0", "2.1").otherwise(F.col("protocol")).alias("_protocol"))
    joined = rows.join(now, "id", "left")
    filled = F.lit(True)
    for n in names[5:]:
        filled = filled & (F.trim(n) != "")
    rules = [
        ("not an object", F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")), ("unknown id", F.col("_sha").isNotNull()), ("repeated id", F.col("first")),
        ("stale", (F.col("source_sha256") == source_sha256) & (F.col("record_sha256") == F.col("_sha"))), ("wrong protocol", F.col("protocol_version") == F.col("_protocol")),
        ("bad verdict", F.col("verdict").isin("pass", "fail", "uncertain")), ("missing field", filled),
    ]
    return _checked(joined, rules).drop("first", "_sha", "_protocol", "text")


def documents(spark: SparkSession, path: str, *, whole_path: bool = False) -> DataFrame:
    """Items of multi-line JSON arrays (a path, a list or a pattern), with their file's name (or whole path); content as JSON text."""
    file = F.col("_metadata.file_path")
    raw = spark.read.text(path, wholetext=True).select((file if whole_path else F.element_at(F.split(file, "/"), -1)).alias("source"), "value")
    return raw.select("source", F.explode(F.from_json("value", "array<variant>")).alias("v")).select("source", F.to_json("v").alias("content"))


def trajectories(spark: SparkSession, path: str, split: str, system: str) -> DataFrame:
    """A5: training trajectories of one split whose first message is the system prompt; a violation otherwise."""
    text = F.col("text")
    rows = lines(spark, path).filter(F.trim("text") != "").withColumns({"id": _text_at(text, "$.id"), "split": _text_at(text, "$.split"), "messages": F.from_json(F.get_json_object("text", "$.messages"), "array<struct<role:string,content:string>>")})
    return _checked(rows, [("empty", F.size("messages") > 0), ("other split", F.col("split") == split), ("other prompt", F.get("messages", F.lit(0))["content"] == system)])


def newest_checkpoint(spark: SparkSession, root: str, required: list[str]) -> DataFrame:
    """The checkpoint folder of the highest step that has all required files; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("_metadata.file_path").alias("path"))
    part = files.select(F.regexp_extract("path", r"^(.*/checkpoint-(\d+))/([^/]+)$", 1).alias("folder"), F.regexp_extract("path", r"/checkpoint-(\d+)/[^/]+$", 1).cast("bigint").alias("step"), F.regexp_extract("path", r"/([^/]+)$", 1).alias("name"))
    whole = part.filter(F.col("name").isin(required)).groupBy("folder", "step").agg(F.count_distinct("name").alias("n")).filter(F.col("n") == len(required))
    return whole.orderBy(F.desc("step")).limit(1).select("folder", "step")


def manifest_drift(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (path, sha256; of 2 GB at most each) that are missing or differ, on any file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    plain = lambda c: F.regexp_replace(c, r"^([A-Za-z0-9+.-]+):/+", "$1:/")  # noqa: E731 - any scheme, however many slashes follow it
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(plain(F.col("_metadata.file_path")).alias("full"), F.sha2("content", 256).alias("now"))
    own = found.withColumn("path", F.substring("full", F.length(plain(F.lit(top))) + 2, F.length("full"))).select("path", "now")
    return manifest.join(own, "path", "left").withColumn("reason", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")).filter("reason is not null").select("path", "reason")
