"""Sinks (B1-B8): append, write once, publish several artifacts, sealed and gated writes, reports.

A table's content digest is the sum of its rows' digests in canonical JSON, so
it does not depend on the order or the number of files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def content_digest(df: DataFrame) -> str:
    """An order-free digest of all rows, repeated ones included."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    hashes = df.select(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h"))
    row = hashes.agg(F.sum("h").alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}-{row['s'] or 0}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def append(df: DataFrame, path: str) -> None:
    """B1: add rows to a JSON Lines folder."""
    df.write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> bool:
    """B2: write a new table; equal content that is there is left alone (False), other content is an error."""
    spark = df.sparkSession
    if exists(spark, path):
        if content_digest(spark.read.schema(df.schema).parquet(path)) != content_digest(df):
            raise ValueError(f"{path} holds other content")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def publish(tables: dict[str, DataFrame]) -> list[str]:
    """Check all tables that are there first, then write the missing ones."""
    missing = []
    for path, df in tables.items():
        if not exists(df.sparkSession, path):
            missing.append(path)
        elif content_digest(df.sparkSession.read.schema(df.schema).parquet(path)) != content_digest(df):
            raise ValueError(f"{path} holds other content; nothing was written")
    for path in missing:
        tables[path].write.mode("errorifexists").parquet(path)
    return missing


def regenerates(df: DataFrame, path: str) -> bool:
    """Whether a table holds exactly these rows."""
    return exists(df.sparkSession, path) and content_digest(df) == content_digest(df.sparkSession.read.schema(df.schema).parquet(path))


def gated_write(df: DataFrame, path: str, metrics: dict[str, Column], gate: Callable[[dict], bool]) -> dict:
    """Write beside the target, look at the metrics that the write itself gathered, and move into place only if they pass."""
    spark = df.sparkSession
    seen = Observation()
    df.observe(seen, *(c.alias(n) for n, c in metrics.items())).write.mode("overwrite").parquet(f"{path}.part")
    found = seen.get
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not gate(found):
        fs.delete(place(f"{path}.part"), True)
        raise ValueError(f"the write of {path} did not pass: {found}")
    if fs.exists(place(path)) or not fs.rename(place(f"{path}.part"), place(path)):
        raise ValueError(f"{path} is there already")
    return found


def review_queue(scored: DataFrame, records: DataFrame, source_sha256: str) -> DataFrame:
    """Records whose task success is open, with the digests that bind a review to them; scores and model names stay out."""
    from tracemill.functions.jsonx import canonical

    whole = F.concat(F.lit('{"case":'), canonical(F.col("case")), F.lit(',"result":'), canonical(F.col("result")), F.lit("}"))
    queue = records.join(scored.filter("task_success is null and fault is null").select("id"), "id", "left_semi")
    empty = [F.lit("").alias(n) for n in ("reason", "reviewer", "reviewer_type", "reviewed_at")]
    return queue.select("id", F.lit(source_sha256).alias("source_sha256"), F.sha2(whole.cast("binary"), 256).alias("record_sha256"), F.get_json_object("case", "$.query").alias("query"), F.get_json_object("result", "$.final_answer").alias("answer"), F.get_json_object("result", "$.trajectory").alias("evidence"), F.lit("pending").alias("verdict"), *empty)


def rendered(summary: DataFrame, rates: list[str]) -> DataFrame:
    """A line of text per group: percentages with one decimal, n/a for what was not measured."""
    shown = [F.concat(F.lit(f"{r}="), F.coalesce(F.concat(F.format_number(F.col(r) * 100, 1), F.lit("%")), F.lit("n/a"))) for r in rates]
    return summary.select("scope", "key", F.concat_ws("  ", F.concat_ws(":", "scope", F.nullif("key", F.lit(""))), F.concat(F.lit("n="), F.col("num_cases").cast("string")), *shown).alias("text"))


def example_store(examples: DataFrame, path: str, per_file: int = 10_000) -> int:
    """Examples as numbered rows in sorted files, for reads of single rows by number; gives their count."""
    n = examples.count()
    examples.repartitionByRange(max(1, n // per_file), "ordinal").sortWithinPartitions("ordinal").write.mode("errorifexists").parquet(path)
    return n


def example(spark: SparkSession, path: str, ordinal: int) -> dict | None:
    """One example; the files' statistics leave only its row group to be read."""
    row = spark.read.parquet(path).filter(F.col("ordinal") == ordinal).first()
    return row.asDict(recursive=True) if row else None
