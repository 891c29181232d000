"""Merkle manifest of a dataset: every row a leaf, a tree of runs per group, one root over the groups.

Leaves are digests of the rows' values, made by Spark's own functions; from
there on only digests move. Leaves are ordered by (group, id, digest), numbered
without gaps in ranges, and cut into aligned blocks of ``run ** block_levels``
leaves. A task traverses a block recursively in postorder: a subtree returns its
digest, and while the recursion unwinds, each run appends the siblings of a node
to the paths of the leaves below it. The blocks' roots, numbered by their place,
are the leaves of the next distributed traversal, until every group has one node
left: its subroot. The subroots, in the order of the groups, are the leaves of
one more such tree, which ends in the root. Going down again, each block gets the
path of its own root, so a leaf's siblings are complete within its task; they
are folded and digested there and are never shuffled.

H is the lowercase hex SHA-256 of the concatenated inputs, digests as hex text.
A run at the end of a level may have fewer nodes, even one, and still becomes
their H; a level of one node is the end.

Defined results: a null value is ``-``, any other its UTF-8 byte count, ``:``
and the value, integers in decimal. Null groups come first, others in the order
of their UTF-8 bytes; null ids come first within a group. Rows that repeat an id
follow the order of their leaves; equal rows are leaves of their own, and which
of them stands first makes no difference. A group of one row is its own subroot,
a dataset of one group its own root; without siblings a proof is the digest of
nothing. An empty table gives no rows. Columns that are not named are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracemill.llm.common import UPPER, checkpointed, small_batches

RUN, BLOCK_LEVELS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "_group string, rank bigint, n bigint, digest string"
#: Siblings of a node in its run: the hex digests to the left and to the right, concatenated.
Step = tuple[str, str]
PATH = "array<struct<left:string,right:string>>"


def h(joined: str) -> str:
    return sha256(joined.encode()).hexdigest()


def traverse(leaves: list[str], levels: int, run: int = RUN) -> tuple[str, list[list[Step]]]:
    """Digest of the subtree of ``levels`` levels over the leaves, and each leaf's siblings, lowest level first."""
    paths: list[list[Step]] = [[] for _ in leaves]

    def visit(start: int, end: int, level: int) -> str:
        if level == 0:
            return leaves[start]
        span = run ** (level - 1)
        starts = range(start, end, span)
        nodes = [visit(at, min(at + span, end), level - 1) for at in starts]
        for i, at in enumerate(starts):
            step = "".join(nodes[:i]), "".join(nodes[i + 1 :])
            for leaf in range(at, min(at + span, end)):
                paths[leaf].append(step)
        return h("".join(nodes))

    return visit(0, len(leaves), levels), paths


def fold(leaf: str, path: list[Step]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = h(left + leaf + right)
    return leaf


def proof(path: list[Step]) -> str:
    """One digest of all siblings, level by level, left to right."""
    return h("".join(left + right for left, right in path))


def leaf(columns: list[Column]) -> Column:
    """H of a row's values."""
    one = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
    return F.sha2(F.concat(*map(one, columns)).cast("binary"), 256)


def lowered(column: Column) -> Column:
    return F.translate(column, UPPER, UPPER.lower())


def height(n: Column, run: int) -> Column:
    """Levels of a tree over n leaves, by comparing with powers of the run (up to the longs that there are)."""
    powers = [run**k for k in range(63) if run**k < 2**62]
    return sum((F.when(n > p, 1).otherwise(0) for p in powers), F.lit(0)).cast("int")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their gapless ``rank`` within ``_group`` and the group's ``n``.

    Rows are dealt into ranges of (group, order), which are kept; they are numbered within a range and a group,
    and what the ranges before hold of the group is added. A range is a task's share whatever the groups' sizes are.
    """
    ranged = checkpointed(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in ("_group", *order)]).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", "_group").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    by = Window.partitionBy("_group").orderBy("_range")
    counts = ranged.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("here"))
    before = counts.select("_group", "_range", (F.sum("here").over(by) - F.col("here")).alias("before"), F.sum("here").over(Window.partitionBy("_group")).alias("n"))
    placed = ranged.withColumn("place", F.row_number().over(within))
    return placed.join(before, ["_range", "_group"]).select(*rows.columns, (F.col("before") + F.col("place") - 1).alias("rank"), "n")


def _blocks(nodes: DataFrame, run: int, levels: int) -> DataFrame:
    span = F.lit(run**levels)
    return nodes.withColumn("block", F.floor(F.col("rank") / span)).withColumn("levels", F.least(F.lit(levels), height(F.col("n"), run)))


def _subtree(table: pa.Table, run: int) -> tuple[pa.Table, str, list[list[Step]]]:
    table = table.sort_by("rank")
    return table, *traverse(table.column("digest").to_pylist(), table.column("levels")[0].as_py(), run)


def climb(nodes: DataFrame, run: int, levels: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of those roots' blocks, and so on until every group has one."""

    def up(key: tuple, table: pa.Table) -> pa.Table:
        group, block = key
        _, digest, _ = _subtree(table, run)
        n = -(-table.column("n")[0].as_py() // run**levels)
        return pa.table({"_group": [group.as_py()], "rank": [block.as_py()], "n": [n], "digest": [digest]})

    floors = [nodes]
    while len(floors) == 1 or (floors[-1].agg(F.max("n")).first()[0] or 1) > 1:
        floors.append(checkpointed(_blocks(floors[-1], run, levels).select("_group", "block", "rank", "n", "digest", "levels").groupBy("_group", "block").applyInArrow(up, NODES)))
    return floors


def descend(nodes: DataFrame, above: DataFrame, run: int, levels: int, keep: list[str], fields: str, row_of) -> DataFrame:  # noqa: ANN001
    """``row_of`` (kept values, digest, whole path, subroot, root) of every node; ``above`` has the path, subroot and root of each block's own root."""

    def down(own: pa.Table, of: pa.Table) -> pa.Table:
        own, _, paths = _subtree(own, run)
        upper = [(s["left"], s["right"]) for s in of.column("path")[0].as_py()]
        subroot, root = of.column("subroot")[0].as_py(), of.column("root")[0].as_py()
        kept = zip(*(own.column(c).to_pylist() for c in keep), strict=True)
        rows = [row_of(k, digest, path + upper, subroot, root) for k, digest, path in zip(kept, own.column("digest").to_pylist(), paths, strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    schema = to_arrow_schema(T._parse_datatype_string(fields))
    blocks = _blocks(nodes, run, levels).groupBy("_group", "block")
    return blocks.cogroup(above.withColumnRenamed("rank", "block").groupBy("_group", "block")).applyInArrow(down, fields)


_PATHS = f"_group string, rank bigint, path {PATH}, subroot string, root string"


def _path_row(kept: tuple, digest: str, path: list[Step], subroot: str, root: str) -> tuple:
    return (*kept, [{"left": left, "right": right} for left, right in path], subroot, root)


def manifest(rows: DataFrame, *, group_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None, run: int = RUN, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` is what is found in place of a row's leaf on checking (null: the leaf itself); folded_root is
    where that and the manifest's siblings lead, and verified whether that is the root.
    """
    small_batches(rows.sparkSession)
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))  # null first, and no null keys
    leaves = checkpointed(rows.select(F.col(f"`{id_col}`").alias("_id"), group.alias("_group"), leaf([F.col(f"`{c}`") for c in columns]).alias("digest"), (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"), F.monotonically_increasing_id().alias("_row")))
    floors = climb(checkpointed(numbered(leaves, ["_id", "digest", "_row"]).select("_id", "_group", "rank", "n", "digest", "tampered")), run, block_levels)
    subroots = floors[-1].select(F.lit("").alias("_group"), F.col("_group").alias("of"), "digest")
    tops = climb(checkpointed(numbered(subroots, ["of"])), run, block_levels)
    top = F.col("digest")
    paths = tops[-1].select("_group", "rank", F.lit([]).cast(PATH).alias("path"), top.alias("subroot"), top.alias("root"))
    for floor in reversed(tops[1:-1]):
        paths = descend(floor, paths, run, block_levels, ["_group", "rank"], _PATHS, _path_row)
    # a subroot is the one node of its group that is left, at rank 0
    paths = descend(tops[0].withColumn("zero", F.lit(0).cast("bigint")), paths, run, block_levels, ["of", "zero"], _PATHS, lambda kept, digest, path, _, root: _path_row(kept, digest, path, digest, root))
    for floor in reversed(floors[1:-1]):
        paths = descend(floor, checkpointed(paths), run, block_levels, ["_group", "rank"], _PATHS, _path_row)

    def checked(kept: tuple, digest: str, path: list[Step], subroot: str, root: str) -> tuple:
        folded = fold(kept[1] or digest, path)
        return kept[0], digest, subroot, root, proof(path), folded, folded == root

    id_type = leaves.schema["_id"].dataType.simpleString()
    fields = f"{id_col} {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return descend(floors[0], paths, run, block_levels, ["_id", "tampered"], fields, checked)
