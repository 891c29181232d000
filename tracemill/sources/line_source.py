"""JSON Lines as a Spark data source (A1, A4, A9, A10): byte ranges, offsets, torn tails, batch and stream.

A file is cut into ranges of ``split`` bytes. A task seeks to its range, goes on
to the next line start and reads the lines that start within the range, so a line
belongs to one range wherever the cuts fall, and only the longest line must fit
in memory. Every line comes with its byte offset, its place in the range and
whether a line feed ends it; numbers within the file come from counting the lines
of the ranges before (``numbered``). A stream reads what has been added since the
last offset, whole lines only: an unterminated tail waits until it is finished.

Lines end at a line feed; one carriage return before it is not part of the line.
Bytes that are no UTF-8 are replaced. An empty file has no lines. Files are read
through pyarrow's file systems (local, HDFS, S3, GCS), so others have to be read
with ``jsonl.lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SPLIT = 64 << 20
CHUNK = 1 << 20
BATCH = 1000
COLUMNS = "file string, block bigint, place bigint, offset bigint, text string, terminated boolean"
_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("offset", pa.int64()), ("text", pa.string()), ("terminated", pa.bool_())])


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def lines_from(stream: pyarrow.fs.FileSystem, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, line, terminated) of the lines that start in [start, end) of a seekable stream."""
    at = max(start - 1, 0)
    stream.seek(at)
    data, skip = b"", start > 0  # a line starts at ``start`` only if the byte before ends one
    pieces: list[bytes] = []  # of a line that spans chunks
    begun = at
    while True:
        stop = data.find(b"\n")
        if stop >= 0:
            if not skip:
                if begun >= end:
                    return
                pieces.append(data[:stop])
                yield begun, b"".join(pieces), True
            skip, pieces = False, []
            at += stop + 1
            begun, data = at, data[stop + 1 :]
            if begun >= end:
                return
            continue
        pieces.append(data)
        at += len(data)
        if skip:
            pieces = []
        data = stream.read(chunk)
        if not data:
            if not skip and begun < end and any(pieces):
                yield begun, b"".join(pieces), False
            return


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, list[tuple[str, int]]]:
    """The files under a path with their sizes, in order; names that start with a dot or an underscore are left out."""
    fs, place = pyarrow.fs.FileSystem.from_uri(path)
    info = fs.get_file_info(place)
    if info.type == pyarrow.fs.FileType.File:
        return fs, [(info.path, info.size)]
    found = fs.get_file_info(pyarrow.fs.FileSelector(place, recursive=True))
    own = [(i.path, i.size) for i in found if i.type == pyarrow.fs.FileType.File and not any(p[0] in "._" for p in i.path[len(place) :].split("/") if p)]
    return fs, sorted(own)


class _Ranges:
    """What batch and stream share: reading one range."""

    def __init__(self, options: dict):
        self.path, self.split, self.chunk = options["path"], int(options.get("split", SPLIT)), int(options.get("chunk", CHUNK))

    def cut(self, file: str, start: int, end: int) -> list[Range]:
        return [Range(file, at, min(at + self.split, end)) for at in range(start, end, self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        size = 0
        with fs.open_input_file(part.file) as stream:
            for place, (offset, line, ended) in enumerate(lines_from(stream, part.start, part.end, self.chunk), 1):
                rows.append((part.file, part.start, place, offset, line.removesuffix(b"\r").decode("utf-8", "replace"), ended))
                size += len(line)
                if len(rows) >= BATCH or size > 8 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Batch(_Ranges, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, size in _files(self.path)[1] for r in self.cut(file, 0, size)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.file else iter(())


class _Stream(_Ranges, DataSourceStreamReader):
    """Offsets: of each file the end of its last whole line."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, files = _files(self.path)
        return {file: end for file, size in files if (end := self._whole(fs, file, size))}

    def _whole(self, fs: pyarrow.fs.FileSystem, file: str, size: int) -> int:
        with fs.open_input_file(file) as stream:
            while size > 0:
                at = max(0, size - (64 << 10))
                stream.seek(at)
                stop = stream.read(size - at).rfind(b"\n")
                if stop >= 0:
                    return at + stop + 1
                size = at
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file in sorted(end) if end[file] > start.get(file, 0) for r in self.cut(file, start.get(file, 0), end[file])] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.file else iter(())

    def commit(self, end: dict) -> None:
        """Nothing is held for an offset."""


class LineSource(DataSource):
    """``spark.read.format("byte_lines").load(path)``; options: split, chunk."""

    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def scan(spark: SparkSession, path: str, *, split: int = SPLIT, torn: str = "keep") -> DataFrame:
    """The lines of a file or folder. ``torn``: what becomes of a last line without a line feed: keep, drop, or error."""
    if torn not in ("keep", "drop", "error"):
        raise ValueError(f"torn is keep, drop or error, not {torn}")
    spark.dataSource.register(LineSource)
    rows = spark.read.format("byte_lines").option("split", split).load(path)
    if torn == "drop":
        return rows.filter("terminated")
    if torn == "error":
        return rows.withColumn("terminated", F.when(F.col("terminated"), True).otherwise(F.raise_error(F.concat(F.lit("unterminated last line in "), "file")).cast("boolean")))
    return rows


def numbered(rows: DataFrame) -> DataFrame:
    """file, line (from 1 within the file), text, terminated: numbers from a pass that counts the lines of every range."""
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("line"), "text", "terminated")


def whole_records(rows: DataFrame) -> DataFrame:
    """Without a last line that is cut off (unterminated and no JSON); an unterminated line that is JSON stays."""
    return rows.filter(F.col("terminated") | F.try_parse_json("text").isNotNull())


def stream(spark: SparkSession, path: str, *, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.readStream.format("byte_lines").option("split", split).load(path)
