"""Digests of files and folders of any size, from blocks.

A file is cut into blocks that tasks read by range and digest; a file's digest is
the root of a tree over its blocks' digests, ``fan`` of them at a time, and a
folder's digest covers the sorted relative paths and the files' digests. So a file
of terabytes is read by many tasks, and none holds more than a chunk of a block
or ``fan`` digests. The values differ from a SHA-256 over the files' bytes one
after another, which no two tasks could share; ``block`` and ``fan`` are part of
the definition:

    leaf = sha256(bytes of a block), hex; an empty file has one empty block
    node = sha256(hex digests of up to ``fan`` consecutive nodes, joined), until one is left
    folder = the same tree over sha256(path, 0, file digest) of its files by path

Files are listed by Spark and read through pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.sources.shared import kept

BLOCK, FAN, CHUNK = 64 << 20, 1024, 1 << 20


def _files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), full, size of all files below a folder; no file is opened."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    plain = lambda c: F.regexp_replace(c, r"^([A-Za-z0-9+.-]+):/+", "$1:/")  # noqa: E731 - any scheme, however many slashes follow it
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    names = spark.createDataFrame([(f,) for f in read.inputFiles()], "full string")  # the listing that Spark itself holds; a scan leaves empty files out
    found = names.withColumn("own", plain("full")).join(read.select(plain(F.col("_metadata.file_path")).alias("own"), "length"), "own", "left").select("full", F.coalesce("length", F.lit(0)).cast("bigint").alias("size"))
    decoded = F.url_decode(F.replace(plain("full"), F.lit("+"), F.lit("%2B")))
    return found.select(F.substring(decoded, F.length(plain(F.lit(top))) + 2, F.length(decoded)).alias("path"), F.col("full"), "size")


def block_digests(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(path, at, digest) of every block of files (path, full, size), each read by its own range."""
    last = F.greatest(F.ceil(F.col("size") / F.lit(block)) - 1, F.lit(0)).cast("bigint")
    parts = files.select("path", "full", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("at"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for full, size, at in zip(*(batch.column(c).to_pylist() for c in ("full", "size", "at")), strict=True):
                fs, place = pyarrow.fs.FileSystem.from_uri(full)
                whole, left = hashlib.sha256(), min(block, size - at * block)
                with fs.open_input_file(place) as stream:
                    stream.seek(at * block)
                    while left > 0:
                        data = stream.read(min(CHUNK, left))
                        if not data:
                            raise ValueError(f"{full} became shorter while it was read")
                        whole.update(data)
                        left -= len(data)
                out.append(whole.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("at"), pa.array(out, pa.string())], names=["path", "at", "digest"])

    return parts.repartition(tasks, "path", "at").mapInArrow(run, "path string, at bigint, digest string")


def roots(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """(path, digest): the root of each path's tree over its nodes (path, at from 0 without gaps, digest)."""
    nodes = kept(nodes.select("path", "at", "digest"))
    while (nodes.agg(F.max("at")).first()[0] or 0) > 0:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")  # ``fan`` digests at most
        several = F.max("at").over(Window.partitionBy("path")) > 0
        marked = nodes.withColumn("several", several)
        up = marked.filter("several").groupBy("path", F.floor(F.col("at") / F.lit(fan)).alias("up")).agg(F.sha2(joined.cast("binary"), 256).alias("digest"))
        nodes = kept(up.select("path", F.col("up").alias("at"), "digest").unionByName(marked.filter("NOT several").select("path", "at", "digest")))
    return nodes.select("path", "digest")


def file_digests(spark: SparkSession, root: str, *, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(path, size, digest) of every file below a folder."""
    files = kept(_files(spark, root))
    return files.select("path", "size").join(roots(block_digests(files, block), fan), "path")


def folder_digest(files: DataFrame, fan: int = FAN) -> str:
    """The digest of a folder from its files' (path, digest), in the order of the paths' UTF-8 bytes."""
    leaf = F.sha2(F.concat(F.col("path").cast("binary"), F.lit(b"\0"), F.col("digest").cast("binary")), 256)
    ranged = kept(files.select("path", leaf.alias("digest")).repartitionByRange("path").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_range").orderBy("path")) - 1
    numbered = ranged.withColumn("place", place).join(F.broadcast(counts), "_range").select(F.lit("").alias("path"), (F.col("before") + F.col("place")).alias("at"), "digest")
    found = roots(numbered, fan).first()
    return found["digest"] if found else hashlib.sha256(b"").hexdigest()


def drift(spark: SparkSession, root: str, manifest: DataFrame, *, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(path, reason) of files of a manifest (path, digest) that are missing or changed, and of those that it does not have (new)."""
    now = file_digests(spark, root, block=block, fan=fan).select("path", F.col("digest").alias("now"))
    reason = F.when(F.col("now").isNull(), "missing").when(F.col("digest").isNull(), "new").when(F.col("now") != F.col("digest"), "changed")
    return manifest.select("path", "digest").join(now, "path", "full_outer").select("path", reason.alias("reason")).filter("reason is not null")
