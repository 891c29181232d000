"""SimHash near-duplicates: fingerprints, BK-trees over shards, components.

Fingerprints are linked when they differ in at most ``radius`` bits. The 64
bits are cut into m blocks; two such fingerprints agree on at least m - radius
of them, so for each choice of m - radius blocks the fingerprints that agree
there (in the first bits of the choice, as many as leave a shard about
``shard_nodes`` members) form a shard, and every link lies within a shard. m is
radius + 1 as long as that leaves at most twice ``shard_nodes`` members, and
grows beyond; no choice loses a link. Each shard becomes a BK-tree (children
keyed by their integer Hamming distance to the parent) that is sent to the task
which holds the shard's members, and each member follows only edges within the
radius. All trees together hold every fingerprint several times, so they are
not broadcast from the driver, which must not see them. A task holds the forest
of a few shards at a time. A shard of more than ``shard_rows`` fingerprints is
cut into slices, and every pair of slices has a tree of its own, so a task holds
two slices at most; n fingerprints of one shard cost (n / shard_rows)^2 / 2 trees
in all, so tasks are bounded but their number is not linear. Of a shard only a spanning star leaves the task, never its
pairs. Stars are contracted by joins until ``task_edges`` edges at most are
left, which one task joins up.

Defined results: a null, empty or word-free text has fingerprint zero, linked
like any other; fewer words than a shingle make one shingle; equal rows give
equal rows; a null id never becomes a component's id unless all its ids are
null; no documents give no rows. Columns other than the two that are named are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import LOWER_BYTES, checkpointed, map_texts

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a shard, about, and what one tree (of a shard or a slice of one) holds at most.
SHARD_NODES, SHARD_ROWS = 2048, 8192
#: Edges that one task joins up, at most.
TASK_EDGES = 1_000_000
_KEY, _KEPT, _PLACE, _COPIES = "__tracemill_row", "__tracemill_kept", "__tracemill_place", "__tracemill_copies"  # names that no input has
_PAIRS = 4_000_000  # query-node pairs that a search holds at a time


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    ws = text.translate(LOWER_BYTES).split()
    if not ws:
        return 0
    digest = xxhash.xxh64_digest
    if len(ws) <= shingle:
        return int.from_bytes(digest(b" ".join(ws), seed))
    joined = b" ".join(ws)
    ends = (np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws))) + np.arange(len(ws))).tolist()
    starts = [0, *(e + 1 for e in ends)]
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 8192):
        ones += np.unpackbits(rows[at : at + 8192], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id and the fingerprint as a signed long."""

    def rows_of(texts: list[bytes]) -> Iterable[tuple]:
        return [((f := fingerprint(t, shingle, seed)) - (f >> 63 << 64),) for t in texts]

    return map_texts(docs, id_col, text_col, [("fp", "bigint")], rows_of)


# BK-trees


class BKForest:
    """BK-trees of many shards at once, kept as arrays: the children of a node lie together, ordered by their distance to it."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps = fps
        n = len(fps)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        rest = np.argsort(shard, kind="stable")
        tree = shard[rest]
        roots = None
        while len(rest):  # the first of each subtree becomes a node; the others go to the child at their distance
            new = np.r_[True, tree[1:] != tree[:-1]]
            at = np.cumsum(new) - 1
            heads = rest[new]
            if roots is None:
                roots = heads[at]
                self.root = np.empty(n, np.int64)
                self.root[rest] = roots
            node = heads[at]
            distance = np.bitwise_count(fps[rest] ^ fps[node]).astype(np.int64)
            keep = ~new
            rest, node, distance = rest[keep], node[keep], distance[keep]
            order = np.argsort(node * 65 + distance, kind="stable")
            rest, node, distance = rest[order], node[order], distance[order]
            parent[rest], edge[rest] = node, distance
            tree = node * 65 + distance
        child = np.flatnonzero(parent >= 0)
        # of each (parent, distance) only the first member is the child; the others lie below it
        key = parent[child] * 65 + edge[child]
        order = np.argsort(key, kind="stable")
        self.child = child[order].astype(np.int32)
        #: Of each node and distance, the place of its first child at that distance or beyond.
        self.place = np.zeros(n * 65 + 1, np.int32)
        np.cumsum(np.bincount(key, minlength=n * 65), out=self.place[1:])

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of a shard within the radius, query's own node included, as arrays."""
        q, node = queries.astype(np.int32), self.root[queries].astype(np.int32)
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            base = node.astype(np.int64) * 65
            low = self.place[base + np.maximum(d - radius, 0)]
            count = self.place[base + np.minimum(d + radius, 64) + 1] - low
            some = count > 0
            q, low, count = q[some], low[some], count[some]
            ends = np.cumsum(count)
            q = np.repeat(q, count)
            node = self.child[np.repeat(low - ends + count, count) + np.arange(len(q))]


class Roots:
    """Disjoint sets over positions, joined from arrays of pairs; a set's root is its least position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.up[a], self.up[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up != (top := self.up[self.up])).any():
                self.up = top


def stars(fps: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, centre) for each fingerprint that has links within its shard; centres are the sets' first members."""
    if not len(fps):
        return fps, fps
    order = np.argsort(shard, kind="stable")
    fps, shard = fps[order], shard[order]
    sizes = np.diff(np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]))
    alone = np.repeat(sizes == 1, sizes)
    fps, shard = fps[~alone], shard[~alone]
    sizes = sizes[sizes > 1]
    if not len(fps):
        return fps, fps
    forest, sets = BKForest(fps, shard), Roots(len(fps))
    cost = np.cumsum(np.repeat(sizes, sizes)) // _PAIRS
    for part in np.split(np.arange(len(fps)), np.flatnonzero(np.diff(cost)) + 1):
        for q, node in forest.within(part, radius):
            sets.join(q, node)
    linked = sets.up != np.arange(len(fps))
    return fps[linked], fps[sets.up[linked]]


def _masks(n: int, radius: int, shard_nodes: int = SHARD_NODES) -> list[int]:
    """Bit masks of the block choices, for about n fingerprints."""
    m = radius + 1
    while n >> (m - radius) * (64 // m) > 2 * shard_nodes and m < 32:
        m += 1
    ends = [64 * i // m for i in range(m + 1)]
    bits = max(0, math.ceil(math.log2(max(n / shard_nodes, 1))))
    out = []
    for chosen in combinations(range(m), m - radius):
        places = [b for c in chosen for b in range(ends[c], ends[c + 1])][:bits]
        mask = sum(1 << b for b in places)
        out.append(mask - (mask >> 63 << 64))
    return out


def links(nodes: DataFrame, n: int, *, radius: int = RADIUS, shard_nodes: int = SHARD_NODES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v) fingerprints that are linked, as stars within shards; nodes has each fingerprint once, as fp."""
    choices = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("part")) for i, mask in enumerate(_masks(n, radius, shard_nodes))]
    keyed = nodes.select("fp", F.explode(F.array(*choices)).alias("c")).select("fp", F.xxhash64("c.i", "c.part").alias("shard"))
    large = checkpointed(keyed.groupBy("shard").count().filter(F.col("count") > shard_rows))
    if large.count():
        # each slice meets each slice, so that every pair of the shard's members shares a tree
        slices = F.ceil(F.col("count") / shard_rows).cast("int")
        own = F.pmod(F.xxhash64("fp"), slices).cast("int")
        cut = keyed.join(large, "shard", "left").withColumn("own", own).withColumn("other", F.explode(F.when(slices.isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), slices - 1))))
        keyed = cut.select("fp", F.when(F.col("own").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            rows = np.concatenate(held) if held else np.empty((0, 2), np.int64)
            end = len(rows) if last or not len(rows) else int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last shard may go on
            u, v = stars(rows[:end, 1].astype(np.int64).view(np.uint64), rows[:end, 0], radius)
            held, size = [rows[end:]], len(rows) - end
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append(np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
            if size > 8 * shard_rows:
                yield from flush(False)
        yield from flush(True)

    return keyed.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "u bigint, v bigint")


def _joined_up(edges: DataFrame) -> DataFrame:
    """(a, b): the least fingerprint that is reachable, for each end of so few edges that one task holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        ends = np.concatenate(rows) if rows else np.empty((0, 2), np.int64)
        names, place = np.unique(ends, return_inverse=True)
        place, sets = place.reshape(-1, 2), Roots(len(names))
        sets.join(place[:, 0], place[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[sets.up])], names=["a", "b"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, *, task_edges: int = TASK_EDGES) -> DataFrame:
    """(fp, label) for each fingerprint with an edge: equal labels for those that are connected.

    Each round every fingerprint joins the least of itself and its neighbours, by
    a hash order that the round changes; the edges between those that are left go
    into the next round. In such an order the rest shrinks by a constant share.
    The last ``task_edges`` edges are joined up in one task.
    """
    edges = checkpointed(edges.distinct())
    labels = checkpointed(edges.select(F.explode(F.array("u", "v")).alias("fp")).distinct().withColumn("label", F.col("fp")))
    turn = 0
    while (left := edges.count()) > 0:
        if left <= task_edges:
            to = checkpointed(_joined_up(edges))
            return checkpointed(labels.join(to, labels["label"] == to["a"], "left").select("fp", F.coalesce("b", "label").alias("label")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("x"))
        both = edges.select("u", rank("v").alias("r")).union(edges.select(F.col("v").alias("u"), rank("u").alias("r")))
        to = checkpointed(both.groupBy("u").agg(F.min("r").alias("r")).select(F.col("u").alias("a"), F.least(rank("u"), F.col("r"))["x"].alias("b")))
        labels = checkpointed(labels.join(to, labels["label"] == to["a"], "left").select("fp", F.coalesce("b", "label").alias("label")))
        moved = edges.join(to, edges["u"] == to["a"]).select(F.col("b").alias("u"), "v").join(to, F.col("v") == to["a"]).select("u", F.col("b").alias("v"))
        edges = checkpointed(moved.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        turn += 1
    return labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard_nodes: int = SHARD_NODES, shard_rows: int = SHARD_ROWS, task_edges: int = TASK_EDGES) -> DataFrame:
    """One row per document: id, fp (signed long), fingerprint (hex), component_id (least id that is reachable)."""
    rows = checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    labels = components(links(nodes, nodes.count(), radius=radius, shard_nodes=shard_nodes, shard_rows=shard_rows), task_edges=task_edges)
    grouped = nodes.join(labels, "fp").select("fp", "label", "least")
    # both right sides are written first, so that the joins read plain shuffles and the partition of a large component can be split
    whole = checkpointed(grouped.groupBy("label").agg(F.min("least").alias("whole")))
    linked = grouped.join(whole, "label").select("fp", "whole")
    owner = checkpointed(nodes.join(linked, "fp", "left").select("fp", F.coalesce("whole", "least").alias("component_id")))
    return rows.join(owner, "fp").select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stand for their component: the first by id, then by the text's digest; of copies of such a row, one.

    Rows of a null id are judged among themselves: each component keeps its first one too.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    keyed = docs.withColumn(_KEY, F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), digest.alias("digest")))
    # a key has one text and so one component, which makes the least key the component's own
    marked = near_duplicates(keyed, id_col=_KEY, text_col=text_col, **options)
    keys = marked.groupBy(_KEY).agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("copies"))
    best = keys.groupBy("component_id", F.col(f"{_KEY}.unnamed").alias("unnamed")).agg(F.min(F.struct(_KEY, "copies")).alias("best"))
    kept = checkpointed(best.select(F.col(f"best.{_KEY}").alias(_KEPT), F.col("best.copies").alias(_COPIES)))
    # nothing is asked of the join's partitioning, so a key that very many rows share can be split
    one = keyed.join(kept.filter(F.col(_COPIES) == 1), F.col(_KEY) == F.col(_KEPT), "left_semi").drop(_KEY)
    several = kept.filter(F.col(_COPIES) > 1)
    if several.isEmpty():
        return one
    row = F.row_number().over(Window.partitionBy(_KEY).orderBy(F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t))))
    repeated = keyed.join(several, F.col(_KEY) == F.col(_KEPT), "left_semi").withColumn(_PLACE, row)
    return one.unionByName(repeated.filter(F.col(_PLACE) == 1).drop(_PLACE, _KEY))
