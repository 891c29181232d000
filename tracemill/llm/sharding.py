"""Sharding by Karmarkar-Karp differencing under the law ``bytes``.

Equal texts form a group that one shard takes whole; every group is an item of
the differencing, none is gathered with others. Groups are summed up by a digest
of their text and dealt by it into parts of about ``part_groups``. A task
differences the groups of its part: each starts as a partial partition with one
filled shard, and the two partial partitions with the largest spread are
combined again and again, the fullest shards of one with the emptiest of the
other, until one is left. The parts' partial partitions, of which only the
loads count, are combined by the same rule, ``part_groups`` / shards of them in
a task and level by level, until one level has no more than that, which the
driver combines. So no task and no driver holds more than about ``part_groups``
items or loads at a time. Rows get their shard by joins on the digest: the
groups with a large share of bytes or rows (of which there are 128 * shards at
most) are broadcast, so their rows stay where they are. Slots come from a count
over many ranges of each shard and a number within the range; rows of a repeated
text are spread over ranges by their place, so no task holds a shard or a group.

Defined results: a null text has size ``overhead`` and is grouped with the
empty text; a group larger than a shard's fair share makes its shard larger,
since groups are not split; repeated rows take slots of their own; an empty
table gives no rows. Columns other than the two that are named are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, id_and_text

SHARDS, OVERHEAD, PART_GROUPS = 40, 16, 20_000
#: Rows of a shard that one task numbers, about.
RANGE_ROWS = 20_000


def combine(partitions: list[list[tuple[int, object]]], shards: int) -> list[tuple[int, object]]:
    """One partition from many: the two of largest spread are combined, oppositely ordered, until one is left.

    A partition is its filled shards as (load above the least one, items), fullest first; items are
    nested pairs, so that combining copies nothing.
    """
    spread = lambda p: p[0][0] - (p[-1][0] if len(p) == shards else 0)
    heap = [(-spread(p), turn, p) for turn, p in enumerate(partitions) if p]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = shards - len(a)
        merged = a[: shards - len(b)] + b[: max(free, 0)] if free < len(b) else a + b
        if free < len(b):  # the others meet: the emptiest of one with the fullest of the other
            merged += [(x + y, (own, other)) for (x, own), (y, other) in zip(a[shards - len(b) :], reversed(b[free:]), strict=True)]
        merged.sort(key=lambda p: -p[0])
        least = merged[-1][0] if len(merged) == shards else 0
        if least:
            merged = [(x - least, items) for x, items in merged]
        turn += 1
        heapq.heappush(heap, (-spread(merged), turn, merged))
    return heap[0][2] if heap else []


def unpacked(items: object) -> list[object]:
    """The leaves of nested pairs; a leaf is a one-item list."""
    out, todo = [], [items]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            out.append(x[0])
        else:
            todo.extend(x)
    return out


def difference(sizes: Iterable[tuple[object, int]], shards: int) -> list[list[object]]:
    """Items to shards by differencing."""
    held = [unpacked(items) for _, items in combine([[(size, [name])] for name, size in sizes], shards)]
    return held + [[] for _ in range(shards - len(held))]


def _levels(groups: DataFrame, n: int, shards: int, part_groups: int) -> tuple[DataFrame, int]:
    """(digest, part, place) of each group and how many parts there are; places are ordered by their load."""
    parts = max(1, -(-n // part_groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, int]]] = {}

        def done(part: int) -> pa.RecordBatch:
            rows = sorted(held.pop(part), key=lambda r: (-r[1], r[0]))
            of = {name: place for place, names in enumerate(difference(rows, shards)) for name in names}
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array([of[d] for d, _ in rows], pa.int32())], names=["digest", "size", "part", "place"])

        for batch in batches:
            for part, digest, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part not in held and held:  # rows come part by part
                    yield done(next(iter(held)))
                held.setdefault(part, []).append((digest, size))
        for part in list(held):
            yield done(part)

    part = F.pmod(F.xxhash64("digest"), F.lit(parts))
    dealt = groups.select(part.alias("part"), "digest", "size").repartition(parts, "part").sortWithinPartitions("part")
    return checkpointed(dealt.mapInArrow(run, "digest binary, size bigint, part bigint, place int")), parts


def _combined(loads: DataFrame, parts: int, shards: int, fan: int) -> DataFrame:
    """(part, place, shard): of every place of every part the shard that it becomes."""
    spark = loads.sparkSession
    if parts <= fan:
        by: dict[int, list[tuple[int, object]]] = {}
        for r in sorted(loads.collect(), key=lambda r: (r["part"], -r["load"], r["place"])):  # fan * shards rows at most
            by.setdefault(r["part"], []).append((r["load"], [(r["part"], r["place"])]))
        held = combine([by[p] for p in sorted(by)], shards)
        rows = [(*leaf, shard) for shard, (_, items) in enumerate(held) for leaf in unpacked(items)]
        return spark.createDataFrame(rows, "part bigint, place int, shard int")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, object]]] = {}
        for part, place, load in sorted(zip(*(table.column(c).to_pylist() for c in ("part", "place", "load")), strict=True), key=lambda r: (r[0], -r[2], r[1])):
            by.setdefault(part, []).append((load, [(part, place, load)]))
        held = combine([by[p] for p in sorted(by)], shards)
        rows = [(*leaf, key[0].as_py(), at) for at, (_, items) in enumerate(held) for leaf in unpacked(items)]
        return pa.table({n: pa.array(c, k) for n, k, c in zip(("part", "place", "load", "whole", "at"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), zip(*rows, strict=True), strict=True)})

    level = checkpointed(loads.withColumn("whole", F.floor(F.col("part") / fan)).groupBy("whole").applyInArrow(run, "part bigint, place int, load bigint, whole bigint, at int"))
    above = level.groupBy(F.col("whole").alias("part"), F.col("at").alias("place")).agg(F.sum("load").alias("load"))
    to = _combined(above, -(-parts // fan), shards, fan).select(F.col("part").alias("whole"), F.col("place").alias("at"), "shard")
    return level.join(to, ["whole", "at"]).select("part", "place", "shard")


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD, part_groups: int = PART_GROUPS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = checkpointed(id_and_text(docs, id_col, text_col).select(
        F.col("_id").alias(id_col), (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.monotonically_increasing_id().alias("row"),
    ))
    groups = checkpointed(rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("groups")).first()
    dealt, parts = _levels(groups, total["groups"], shards, part_groups)
    loads = dealt.groupBy("part", "place").agg(F.sum("size").alias("load"))
    to = _combined(loads, parts, shards, max(2, part_groups // shards))
    placed = dealt.join(to, ["part", "place"]).select("digest", "shard").join(groups, "digest").select("digest", "shard", "n", (F.col("n") * (64 * shards) >= total["n"]).alias("many"), (F.col("size") * (64 * shards) >= total["size"]).alias("large"))
    placed = checkpointed(placed)
    # of each share there are 64 * shards groups at most, so this side is bounded by the parameter
    heavy = F.broadcast(placed.filter("many or large").select("digest", "shard", "n"))
    light = placed.filter("not (many or large)").select("digest", "shard", "n")
    put = rows.join(heavy, "digest").unionByName(rows.join(heavy, "digest", "left_anti").join(light, "digest"))
    ranges = max(1, -(-total["n"] // (shards * range_rows)), 16)
    spread = F.when(F.col("n") > 1, F.pmod("row", F.lit(1024))).otherwise(0)  # rows of a repeated text, whose ids may repeat too
    put = put.withColumn("range", F.pmod(F.xxhash64(id_col, "digest", spread), F.lit(ranges)).cast("int"))
    counts = put.groupBy("shard", "range").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "range", F.coalesce("before", F.lit(0)).alias("before"))
    numbered = put.withColumn("number", F.row_number().over(Window.partitionBy("shard", "range").orderBy(id_col, "digest", "row")))
    return numbered.join(before, ["shard", "range"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
