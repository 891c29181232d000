"""Deterministic sharded WARC writer, and the reader of its archives.

Records are ordered by (id, payload digest), null ids last. Their sizes are
summed up in that order, over ranges, and the running sum is cut into shards:
``least_shards`` of them, or more where one would hold over ``shard_bytes``. So
what a shard holds depends on the rows alone, not on the cluster. Only ids,
digests and sizes take part in this; the first key of each shard, a number of
rows that total size / ``shard_bytes`` bounds, goes to the tasks, and each page
is shuffled once, to its shard, where it is sorted. Which page revisits which is
found by joining ids and digests; these decisions travel to the shards as rows
of their own that sort before their page, so that hot payloads are never
gathered.

A task streams its shards: each record is a gzip member of its own with
regenerated headers, lengths, block and payload digests and record ids; when the
next member would exceed ``file_bytes`` of compressed size, the file is rolled.
A file is written under a temporary name of its attempt and renamed when it is
whole; as its bytes depend on the rows alone, a repeated or lost task changes
nothing. The manifest (file, shard, records, bytes, SHA-256) is written by Spark
when all tasks have ended, and is the commit: the reader opens only the files it
lists, streams them member by member, and checks every digest.

Defined results: a null payload is empty; a null url gives a record without a
target; control characters of a url are percent-encoded. Of equal payloads of at
least ``least_revisit`` bytes the one with the smallest id is the response; null
ids count as largest. Rows that repeat id and payload are the same page: one is
the response (or all revisit another page), the others revisit it; they stay in
one shard. Ids are longs. A payload larger than a shard or a file has one of its
own. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, remove, slices, small_batches

SHARD_BYTES, LEAST_SHARDS, LEAST_SHARD_BYTES, FILE_BYTES, LEAST_REVISIT = 4 << 30, 256, 64 << 10, 1 << 30, 0
#: What a record's headers take, about; it counts in a shard's size.
HEADER_BYTES = 700
#: Compressed bytes of archives that a task reads, about.
READ_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard int, sequence int, records bigint, responses bigint, revisits bigint, payload_bytes bigint, file_bytes bigint, sha256 string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, digests_hold boolean, file string, offset bigint, length bigint"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f-\x9f  ]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: bytes, turn: int) -> str:
    """The same for the same page and payload, on every run; turn counts rows that repeat both."""
    return f"<{uuid.UUID(bytes=hashlib.sha1(b'%s|%s|%d' % (str(page).encode(), digest, turn)).digest()[:16], version=5).urn}>"


def record(kind: str, name: str, date: str, block: bytes, fields: list[tuple[str, object]]) -> bytes:
    """A record as a gzip member; fields that are None are left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), *fields, ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # its header holds no time
    return packer.compress(text.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page: int | None, url: str | None, payload: bytes, digest: bytes, turn: int, revisits: tuple[int | None] | None, date: str = DATE) -> bytes:
    """A response, or the revisit of another page's payload, whose block has the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = None if url is None else _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    fields = [("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Page-ID", page)]
    if revisits is not None:
        of = revisits[0]
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(of, digest, 0)), ("WARC-Refers-To-Page-ID", of)]
    return record("response" if revisits is None else "revisit", record_id(page, digest, turn), date, http if revisits is not None else http + payload, fields)


class Roller:
    """The files of one shard: written under temporary names, rolled by compressed size, renamed when whole."""

    def __init__(self, folder: str, shard: int, file_bytes: int, date: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.shard, self.file_bytes, self.date, self.sequence, self.out = shard, file_bytes, date, 0, None
        self.done: list[tuple] = []

    def add(self, member: bytes, kind: str, payload_bytes: int) -> None:
        if self.out is not None and self.size + len(member) > self.file_bytes:
            self.close()
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.sequence:05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.hash, self.counts = self.fs.open_output_stream(self.temporary, compression=None), 0, hashlib.sha256(), {"response": 0, "revisit": 0, "bytes": 0}
            self._write(record("warcinfo", record_id(None, self.name.encode(), 0), self.date, b"software: tracemill\r\nformat: WARC File Format 1.1\r\n", [("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]))
        self._write(member)
        self.counts[kind] += 1
        self.counts["bytes"] += payload_bytes

    def _write(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out, final = None, f"{self.path}/{self.name}"
        if self.fs.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
            self.fs.move(self.temporary, final)
        else:  # another attempt was first, with the same bytes
            self.fs.delete_file(self.temporary)
        c = self.counts
        self.done.append((self.name, self.shard, self.sequence, c["response"] + c["revisit"], c["response"], c["revisit"], c["bytes"], self.size, self.hash.hexdigest()))
        self.sequence += 1

    def taken(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        return pa.RecordBatch.from_pylist([dict(zip(_MANIFEST_ARROW.names, r, strict=True)) for r in done], _MANIFEST_ARROW)


_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[t]) for n, t in (x.split(" ") for x in ddl.split(", "))])


_MANIFEST_ARROW = _arrow(MANIFEST)
_ORDER = ("_absent", "_id", "_digest")


def _shards(keys: DataFrame, shard_bytes: int, least_shards: int) -> list[tuple]:
    """The first key (absent, id, digest) of every shard but the first."""
    ranged = checkpointed(keys.repartitionByRange(*_ORDER).withColumn("_range", F.spark_partition_id()))
    parts = {r["_range"]: r["w"] for r in ranged.groupBy("_range").agg(F.sum("weight").alias("w")).collect()}  # a row per range
    total, before = 0, {}
    for at in sorted(parts):
        before[at], total = total, total + parts[at]
    width = min(shard_bytes, max(LEAST_SHARD_BYTES, -(-total // least_shards)))
    offsets = keys.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_range int, before bigint")
    running = F.sum("weight").over(Window.partitionBy("_range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("running", F.coalesce(running, F.lit(0))).join(F.broadcast(offsets), "_range")  # a row per range
    firsts = placed.withColumn("shard", F.floor((F.col("before") + F.col("running")) / F.lit(width))).groupBy("shard").agg(F.min(F.struct(*_ORDER)).alias("key"))
    return sorted((r["key"]["_absent"], r["key"]["_id"] or 0, bytes(r["key"]["_digest"])) for r in firsts.filter("shard > 0").collect())  # total / width rows


def write(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS, file_bytes: int = FILE_BYTES, least_revisit: int = LEAST_REVISIT, date: str = DATE) -> DataFrame:
    """Write the pages' archives and their manifest into a folder that all executors share; returns the manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), payload.alias("_payload"))
    keyed = rows.select(F.col("_id").isNull().alias("_absent"), "_id", F.unhex(F.sha1("_payload")).alias("_digest"), "_url", "_payload")
    keys = checkpointed(keyed.select(*_ORDER, (F.octet_length("_payload") + HEADER_BYTES).cast("bigint").alias("weight")))
    bounds = _shards(keys, shard_bytes, least_shards)
    firsts = keys.filter(F.col("weight") >= least_revisit + HEADER_BYTES).groupBy("_digest").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("_digest", "first")
    decisions = keys.join(firsts, "_digest").filter("_id > first OR _id IS NULL AND first IS NOT NULL")

    @F.pandas_udf("int")
    def shard_of(absent: pd.Series, id_: pd.Series, digest: pd.Series) -> pd.Series:
        ids = id_.fillna(0).astype("int64")
        return pd.Series([bisect_right(bounds, (bool(a), int(i), d)) for a, i, d in zip(absent, ids, digest, strict=True)], dtype="int32")

    nothing = lambda kind: F.lit(None).cast(kind)
    both = decisions.select(*_ORDER, F.lit(0).alias("_kind"), F.col("first").alias("_of"), nothing("string").alias("_url"), nothing("binary").alias("_payload")).unionByName(
        keyed.select(*_ORDER, F.lit(1).alias("_kind"), nothing("bigint").alias("_of"), "_url", "_payload"))
    ids = F.coalesce("_id", F.lit(0))
    staged = both.withColumn("_shard", shard_of("_absent", ids, "_digest")).repartition("_shard").sortWithinPartitions("_shard", *_ORDER, "_kind", "_url")
    staged = staged.select("_shard", "_id", "_digest", "_kind", "_of", "_url", "_payload")
    for made in (folder, f"{folder}/_temporary"):
        path = spark._jvm.org.apache.hadoop.fs.Path(made)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, decided, held, turn = None, None, None, 0
        for batch in batches:
            for part in slices(batch):
                for shard, page, digest, kind, of, url, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    key = (page, digest)
                    if kind == 0:
                        decided = (key, of)
                        continue
                    if out is None or out.shard != shard:
                        if out is not None:
                            out.close()
                            yield out.taken()
                        out = Roller(folder, shard, file_bytes, date)
                    turn = turn + 1 if key == held else 0
                    if decided is not None and decided[0] == key:
                        revisits = (decided[1],)
                    else:
                        revisits = (page,) if turn and len(data) >= least_revisit else None
                    held = key
                    out.add(page_record(page, url, data, digest, turn, revisits, date), "response" if revisits is None else "revisit", len(data))
            if out is not None and out.done:
                yield out.taken()
        if out is not None:
            out.close()
            yield out.taken()

    staged.mapInArrow(run, MANIFEST).write.json(f"{folder}/_manifest")
    remove(spark, f"{folder}/_temporary")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/_manifest")


class Corrupt(ValueError):
    """An archive does not hold what its manifest or its headers say."""


def members(stream: object, chunk: int = 64 << 10) -> Iterator[tuple[int, int, bytes, str]]:
    """(offset, compressed length, bytes, SHA-256 of all so far) of each gzip member of a stream, one at a time."""
    whole, data, at = hashlib.sha256(), b"", 0
    while True:
        if not data and not (data := stream.read(chunk)):
            return
        unpack, parts, start = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if not data and not (data := stream.read(chunk)):
                raise Corrupt(f"the member at {start} ends early")
            try:
                parts.append(unpack.decompress(data))
            except zlib.error as e:
                raise Corrupt(f"the member at {start}: {e}") from None
            used = len(data) - len(unpack.unused_data)
            whole.update(data[:used])
            at, data = at + used, unpack.unused_data
        yield start, at - start, b"".join(parts), whole.hexdigest()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not first.startswith("WARC/1.") or not fields.get("Content-Length", "").isdigit() or rest[(n := int(fields["Content-Length"])) :] != b"\r\n\r\n":
        raise Corrupt(f"not one whole record: {first[:40]!r}")
    return fields, rest[:n]


def records(spark: SparkSession, folder: str, *, payloads: bool = False) -> DataFrame:
    """One row per page record of the files that the manifest lists; ``payloads`` adds what responses hold (null for revisits)."""
    small_batches(spark)
    schema = RECORD + (", payload binary" if payloads else "")
    arrow = _arrow(schema)

    def of(fields: dict[str, str], block: bytes, where: tuple[str, int, int]) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
        length = int(re.search(rb"(?m)^Content-Length: (\d+)", head)[1])
        holds = fields["WARC-Block-Digest"] == f"sha1:{base32_sha1(block)}" and (kind == "revisit" or len(payload) == length and base32_sha1(payload) == digest)
        number = lambda name: int(fields[name]) if name in fields else None
        row = (number("WARC-Page-ID"), fields.get("WARC-Target-URI"), kind, number("WARC-Refers-To-Page-ID"), length, digest, holds, *where)
        return (*row, None if kind == "revisit" else payload) if payloads else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, sha256 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size, digest = [], 0, None
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for offset, length, data, digest in members(stream):  # noqa: B007
                        fields, block = parsed(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(of(fields, block, (name, offset, length)))
                        size += len(block) if payloads else 0
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], names=arrow.names)
                            rows, size = [], 0
                if digest != sha256:
                    raise Corrupt(f"{name} differs from its manifest")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], names=arrow.names)

    listed = manifest(spark, folder)
    whole = listed.agg(F.count(F.lit(1)).alias("files"), F.sum("file_bytes").alias("bytes")).first()
    tasks = min(max(whole["files"], 1), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(whole["bytes"] or 0) // READ_BYTES)))
    return listed.select("file", "sha256").repartition(tasks, "file").mapInArrow(run, schema)
