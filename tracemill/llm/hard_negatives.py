"""Hard negatives from labelled vectors by a vector-approximation file.

Components become integers, floor(scale * x). Rows are dealt by their id into
blocks of about ``block_rows``, anchors into blocks of ``anchor_rows``, and each
pair of blocks is one group of a task. There the rows' components are quantised:
a dimension is cut into ``cells`` cells of about as many rows each, and a row is
kept as one byte per dimension. A table per dimension has the least and the
largest product of an anchor's component with every cell, so sums of looked-up
entries bound a row's score from below and above. Only rows whose bounds allow
them into a list are scored exactly: for the positives those whose upper bound
reaches the k-th largest lower bound among the rows of the anchor's label; for
the negatives those whose bounds meet the window of a positive and whose upper
bound reaches the k-th largest lower bound of the rows that surely lie in it. The blocks' lists are
merged by ranks that Spark limits before it shuffles them.

Anchors and rows are replicated block by block, not row by row, so the shuffle
is rows * anchors / block size; no task holds more than one block of each, and
no label, no vector and no anchor has a group of its own.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; neither do rows with a component so large
that a score might not fit a long (2**28 after scaling, less above 64
dimensions). Of rows that repeat an id, the one with the least label (as text),
then the least components counts. Vectors of different lengths are compared over
the dimensions they share. An anchor never is its own positive or negative.
Ties go to the smaller id. Positives of negative score have an empty window. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, small_batches

SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 5, 80, 100
CELLS, BLOCK_ROWS, ANCHOR_ROWS = 256, 16_384, 2_048
#: Rows and anchors whose bounds are held at once in a task.
CHUNK_ROWS, CHUNK_ANCHORS = 1_024, 256


class Approximations:
    """A block's vectors as a cell number per dimension, with the cells' edges."""

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        n, dims = vectors.shape
        self.codes, self.edges = np.empty((dims, n), np.uint8), []
        places = np.linspace(0, n - 1, min(cells, 256, n) + 1).round().astype(np.int64)
        for d, (column, ordered) in enumerate(zip(vectors.T, np.sort(vectors, axis=0).T, strict=True)):
            starts = np.unique(ordered[places[:-1]])
            self.codes[d] = np.searchsorted(starts, column, side="right") - 1
            self.edges.append((starts, np.append(starts[1:] - 1, ordered[-1])))  # both ends belong to the cell

    def bounds(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of each of the rows with each anchor."""
        n = len(range(*rows.indices(self.codes.shape[1])))
        most = sum((float(np.abs(anchors[:, d]).max(initial=0)) * float(max(abs(lo[0]), abs(hi[-1]))) for d, (lo, hi) in enumerate(self.edges)), 0.0)
        kind = np.int32 if most < 2**31 else np.int64
        lower, upper = np.zeros((n, len(anchors)), kind), np.zeros((n, len(anchors)), kind)
        tables = []
        for d, (lo, hi) in enumerate(self.edges):
            a, b = np.multiply.outer(lo, anchors[:, d]).astype(kind), np.multiply.outer(hi, anchors[:, d]).astype(kind)
            tables.append((np.minimum(a, b), np.maximum(a, b)))
        codes = self.codes[:, rows]
        for at in range(0, n, CHUNK_ROWS):
            part = slice(at, at + CHUNK_ROWS)
            for code, (low, high) in zip(codes, tables, strict=True):
                lower[part] += low[code[part]]
                upper[part] += high[code[part]]
        return lower, upper


def _kth(keys: np.ndarray, values: np.ndarray, k: int, n_keys: int) -> np.ndarray:
    """By key, the k-th largest value, or the least integer where there are fewer."""
    order = np.lexsort((-values, keys))
    keys, values = keys[order], values[order]
    at = np.searchsorted(keys, np.arange(n_keys)) + k - 1
    out = np.full(n_keys, np.iinfo(np.int64).min)
    there = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == np.arange(n_keys)) if len(keys) else np.zeros(n_keys, bool)
    out[there] = values[at[there]]
    return out


def _first(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each key's first k by score, then by smaller id."""
    order = np.lexsort((ids, -scores, keys))
    ordered = keys[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


class Block:
    """One block of rows: ids, labels and vectors ordered by label, and their approximations."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, cells: int = CELLS):
        order = np.argsort(labels, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.labels, starts = np.unique(labels[order], return_index=True)
        self.ranges = dict(zip(self.labels, zip(starts, [*starts[1:], len(ids)], strict=True), strict=True))
        self.file = Approximations(self.vectors, cells)
        self.scored = 0  # rows scored exactly so far

    def exact(self, rows: np.ndarray, anchors: np.ndarray, of: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        return np.concatenate([np.einsum("ij,ij->i", self.vectors[rows[i : i + 65_536]], anchors[of[i : i + 65_536]]) for i in range(0, max(len(rows), 1), 65_536)])

    def positives(self, ids: np.ndarray, label: object, anchors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's place, id, score) of the first k rows of the anchors' label."""
        start, end = self.ranges.get(label, (0, 0))
        lower, upper = self.file.bounds(anchors, slice(start, end))
        own = self.ids[start:end, None] == ids
        least = np.iinfo(lower.dtype).min
        bar = np.partition(np.where(own, least, lower), -k, axis=0)[-k] if end - start > k else least
        rows, of = np.nonzero((upper >= bar) & ~own)
        rows += start
        scores = self.exact(rows, anchors, of)
        best = _first(of, scores, self.ids[rows], k)
        return of[best], self.ids[rows[best]], scores[best]

    def negatives(self, ids: np.ndarray, label: object, anchors: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, anchors' places, ids, scores): for each window (least, largest score by anchor) its first k rows of other labels."""
        start, end = self.ranges.get(label, (0, 0))
        least, most = np.min([w for w, _ in windows], axis=0), np.max([w for _, w in windows], axis=0)
        pairs = []
        for rows in (slice(0, start), slice(end, len(self.ids))):
            lower, upper = self.file.bounds(anchors, rows)
            r, of = np.nonzero((upper >= least) & (lower <= most) & (self.ids[rows, None] != ids))
            pairs.append((r + rows.start, of, lower[r, of].astype(np.int64), upper[r, of].astype(np.int64)))
        rows, of, low, high = map(np.concatenate, zip(*pairs, strict=True))
        may = np.zeros((len(windows), len(rows)), bool)
        for m, (least, most) in zip(may, windows, strict=True):
            m[:] = (high >= least[of]) & (low <= most[of])
            sure = m & (low >= least[of]) & (high <= most[of])
            m &= high >= _kth(of[sure], low[sure], k, len(ids))[of]
        any_ = may.any(axis=0)
        rows, of, may = rows[any_], of[any_], may[:, any_]
        scores = self.exact(rows, anchors, of)
        for w, (m, (least, most)) in enumerate(zip(may, windows, strict=True)):
            inside = np.nonzero(m & (scores >= least[of]) & (scores <= most[of]))[0]
            best = inside[_first(of[inside], scores[inside], self.ids[rows[inside]], k)]
            yield w, of[best], self.ids[rows[best]], scores[best]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors of any lengths as rows of ``dims`` components, zeros behind the shorter ones."""
    arr = column.combine_chunks()
    lengths = arr.value_lengths().to_numpy()
    out = np.zeros((len(arr), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = arr.flatten().to_numpy()
    return out


def _groups(labels: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """Labels with the places of their anchors, in parts."""
    for label in np.unique(labels):
        places = np.nonzero(labels == label)[0]
        for at in range(0, len(places), CHUNK_ANCHORS):
            yield label, places[at : at + CHUNK_ANCHORS]


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, run, schema: str) -> DataFrame:  # noqa: ANN001
    """Apply ``run`` to every pair of a block of rows and a block of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.withColumn("row_block", place(blocks)).withColumn("anchor_block", every(anchor_blocks))
    right = anchors.withColumn("anchor_block", place(anchor_blocks)).withColumn("row_block", every(blocks))
    return left.groupBy("row_block", "anchor_block").cogroup(right.groupBy("row_block", "anchor_block")).applyInArrow(run, schema)


def mine(rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, cells: int = CELLS, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors, which a condition on the id column names.

    A negative's score is at least ``least`` and at most ``most`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    small_batches(spark)
    shares = (least, most)
    scaled = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    largest = F.least(F.lit(float(2**28)), F.sqrt(F.lit(float(2**62)) / F.greatest(F.size("v"), F.lit(1))))
    finite = F.forall(F.col(f"`{vector_col}`"), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    fit = (
        rows.filter(finite).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), scaled.alias("v"), is_anchor.alias("anchor"))
        .filter("id IS NOT NULL AND label IS NOT NULL").filter(F.forall("v", lambda x: F.abs(x) < largest)).withColumn("v", F.col("v").cast("array<int>"))
    )
    fit = checkpointed(fit.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*"))
    anchors = fit.filter("anchor").select("id", "label", "v")
    fit = fit.select("id", "label", "v")
    counts = fit.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("v")).alias("dims")).first()
    dims = counts["dims"] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts["rows"] // block_rows))
    anchor_blocks = max(1, -(-anchors.count() // anchor_rows))

    def block(table: pa.Table) -> Block:
        return Block(table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("v"), dims), cells)

    def first(own: pa.Table, of: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and of.num_rows:
            held, ids, vectors = block(own), of.column("id").to_numpy(), _matrix(of.column("v"), dims)
            for label, at in _groups(of.column("label").to_numpy()):
                place, ids_, scores = held.positives(ids[at], label, vectors[at], positives)
                found.append((ids[at][place], ids_, scores))
        return _table(found, ["id", "positive_id", "positive_score"])

    def second(own: pa.Table, of: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and of.num_rows:
            held, ids, vectors = block(own), of.column("id").to_numpy(), _matrix(of.column("v"), dims)
            names, scores = _matrix(of.column("positive_ids"), positives), _matrix(of.column("positive_scores"), positives)
            there = np.arange(positives) < of.column("positive_ids").combine_chunks().value_lengths().to_numpy()[:, None]
            low, high = np.where(there, -(-scores * shares[0] // 100), np.iinfo(np.int64).max), np.where(there, scores * shares[1] // 100, np.iinfo(np.int64).min)
            for label, at in _groups(of.column("label").to_numpy()):
                for w, place, ids_, got in held.negatives(ids[at], label, vectors[at], list(zip(low[at].T, high[at].T, strict=True)), negatives):
                    found.append((ids[at][place], names[at, w][place], scores[at, w][place], ids_, got))
        return _table(found, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    found = _met(fit, anchors, blocks, anchor_blocks, first, "id bigint, positive_id bigint, positive_score bigint")
    by_anchor = Window.partitionBy("id").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("rank", F.row_number().over(by_anchor)).filter(F.col("rank") <= positives)
    lists = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))  # ``positives`` entries at most
    known = checkpointed(anchors.join(lists, "id").select("id", "label", "v", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores")))
    found = _met(fit, known, blocks, anchor_blocks, second, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    by_positive = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(by_positive)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _table(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.empty(0, np.int64)] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})
