"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cases A-Z on UTF-8 bytes and leaves every other byte alone.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine (tests, local use)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracemill-checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system, whatever kind it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute now and cut the lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of an Arrow batch, at most: what a task holds beside its own state, in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to those above; texts are large, so the defaults would take much memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under names nothing can clash with."""
    return df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def map_texts(df: DataFrame, id_col: str, text_col: str, fields: list[tuple[str, str]], rows_of: Callable[[list[bytes]], Iterable[tuple]], *, raw: bool = False, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """Apply ``rows_of`` (UTF-8 texts of a batch, null as empty, to one tuple each) beside the ids.

    raw: the column is binary and stays so. Arrow batches pass through one by one, in parts of about ``most_bytes``, so a
    task holds one batch at a time; what gives more bytes than it takes asks for smaller parts.
    """
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")) if raw else id_and_text(df, id_col, text_col)
    small_batches(df.sparkSession)
    id_type = source.schema["_id"].dataType
    out = T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
    kinds = [_ARROW[t] for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most_bytes):
                texts = [b or b"" for b in part.column(1).cast(pa.binary()).to_pylist()]
                columns = list(zip(*rows_of(texts), strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=out.names)

    return source.mapInArrow(run, out)


_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
    "array<struct<start:bigint,end:bigint>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    "array<struct<template:string,start:bigint,end:bigint,coverage:double>>": pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])),
}


def slices(batch: pa.RecordBatch, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most_bytes`` at most (a longer row stands alone)."""
    rows = batch.num_rows
    step = max(1, min(rows, int(rows * most_bytes / max(batch.nbytes, 1))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)
