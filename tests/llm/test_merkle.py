import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tracemill.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes, run):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + run]) for i in range(0, len(out[-1]), run)])
    return out


def steps_of(levels, at, run):
    steps = []
    for nodes in levels[:-1]:
        start = at // run * run
        steps.append((nodes[start:at], nodes[at + 1 : start + run]))
        at //= run
    return steps


def brute(rows, run=8):
    """The definition, over (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], run) for g in order}
    top = levels_of([trees[g][-1][0] for g in order], run)
    out = []
    for place, g in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = steps_of(trees[g], at, run) + steps_of(top, place, run)
            folded = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                folded = leaf_of((*r[:4], None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in steps:
                folded = h(*left, folded, *right)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], h(*(s for left, right in steps for s in left + right)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def built(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumn("rank", F.lit(1)).withColumn("_group", F.lit("x"))
    changed = [merkle.lowered(F.col("text")) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf(changed))
    return sorted(map(tuple, merkle.manifest(df, tampered=tampered, **kw).collect()), key=repr)


def test_whole_table_equals_sql(spark, sf_dir):
    assert_same(queries.op11_merkle_manifest(spark, sf_dir), connect(sf_dir), queries.SQL["op11_merkle_manifest"])


@pytest.mark.parametrize("sizes", [[1], [8], [9], [65, 1, 64], [3] * 20])
def test_trees_over_several_traversals(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(i, "s", f"l{g}", 3, rng.choice(["Aa", "bb", "Ää Z"])) for g, n in enumerate(sizes) for i in rng.sample(range(1000), n)]
    assert built(spark, rows, block_levels=1) == brute(rows)
    assert built(spark, rows, run=2, block_levels=2) == brute(rows, 2)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (1, "s", "en", 1, "A"), (1, "s", "en", 1, "A"), (2, "", "", 0, ""), (3, "é", "é", 5, "X" * 2_000_000), (-4, "s", "en", -7, "😀A")]
    assert built(spark, rows) == brute(rows)
    assert built(spark, []) == []
    assert built(spark, rows[:1]) == brute(rows[:1])


def test_a_traversal_gives_what_folds_to_its_digest():
    leaves = [h(str(i)) for i in range(300)]
    digest, paths = merkle.traverse(leaves, 3)
    assert digest == levels_of(leaves, 8)[-1][0]
    assert all(merkle.fold(x, p) == digest for x, p in zip(leaves, paths, strict=True))
    assert merkle.traverse([leaves[0]], 0) == (leaves[0], [[]])
    assert merkle.traverse([leaves[0]], 2)[0] == h(h(leaves[0]))  # the last run of a larger tree


def test_one_hot_group_is_numbered_in_ranges(spark):
    rows = spark.range(3000).select(F.lit("=x").alias("_group"), F.lit(7).alias("id"), F.col("id").alias("_row"))
    got = merkle.numbered(rows.repartition(5), ["id", "_row"])
    assert sorted((r["_row"], r["rank"], r["n"]) for r in got.collect()) == [(i, i, 3000) for i in range(3000)]
