import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tracemill.llm import hard_negatives, queries


def brute(rows, is_anchor, k=5, k_neg=5, least=80, most=100):
    """The definition, over plain lists: (id, label, vector)."""
    fit = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        fit[i] = min(fit.get(i, (str(label), q)), (str(label), q))
    out = []
    for a, (label, v) in fit.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, lab == label) for i, (lab, w) in fit.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            found = [(-t, n) for t, n, same in scored if not same and least * -s <= 100 * -t <= most * -s][:k_neg]
            out += [(a, p, r, n, -s, t) for r, (t, n) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, every=3, kind="float", **kw):
    df = spark.createDataFrame(rows, f"vec_id bigint, label int, embedding array<{kind}>").select("*", F.lit(1).alias("id"), F.lit("x").alias("v"), F.lit(2).alias("row_block"))
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % every == 0, **kw).collect()))


def test_whole_table_equals_sql(spark, sf_dir):
    assert_same(queries.op13_hard_negatives(spark, sf_dir), connect(sf_dir), queries.SQL["op13_hard_negatives"])


@pytest.mark.parametrize("seed", range(3))
def test_random_tables_with_ties_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [[rng.choice([-0.5, 0.0, 0.25, 0.251]) for _ in range(6)] for _ in range(25)]  # few vectors, so many ties
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), rng.choice(pool)) for i in range(150)]
    assert mined(spark, rows, block_rows=20, anchor_rows=7) == brute(rows, lambda i: i % 3 == 0)


def test_odd_rows(spark):
    rows = [
        (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.25]), (2, 2, [0.4, 0.2]), (3, None, [0.5, 0.5]), (4, 2, None), (5, 2, [0.4, None]), (6, 2, [float("nan"), 0.1]),
        (7, 2, [float("inf"), 0.1]), (None, 2, [0.5, 0.5]), (8, 2, [0.5]), (9, 1, []), (10, 2, [0.5, 0.2, 9.0]), (2, 2, [0.4, 0.2]), (1, 1, [0.5, 0.2]), (12, 1, [-0.5, 0.5]), (15, 3, [0.5, 0.5]),
    ]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 3 == 0) and {r[0] for r in got} >= {0}
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [0.5])]) == [] and mined(spark, [(0, None, None)]) == []


def test_components_too_large_for_a_long_take_no_part(spark):
    rows = [(0, 1, [0.5]), (1, 1, [0.5]), (2, 2, [0.5]), (3, 2, [1e30]), (4, 1, [3e5])]
    assert mined(spark, rows, every=100, kind="double") == brute([r for r in rows if r[0] != 3], lambda i: i == 0)


def test_most_rows_are_not_scored():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    ids, labels = np.arange(4000), np.array([str(i % 10) for i in range(4000)])
    block = hard_negatives.Block(ids, labels, vectors)
    at = np.arange(0, 4000, 100)[:4]  # all of label "0"
    place, found, scores = block.positives(ids[at], "0", vectors[at], 5)
    want = vectors[at] @ vectors.T
    for i, a in enumerate(at):
        best = sorted((-want[i, j], j) for j in range(0, 4000, 10) if j != a)[:5]
        assert [(-s, j) for s, j in zip(scores[place == i], found[place == i], strict=True)] == best
    after = block.scored
    top = np.array([scores[place == i][0] for i in range(4)])
    list(block.negatives(ids[at], "0", vectors[at], [(-(-top * 80 // 100), top)], 5))
    assert after < 4 * 400 / 3 and block.scored - after < 4 * 3600 / 10


@pytest.mark.parametrize("cells", [1, 2, 16, 256])
def test_bounds_hold(cells):
    rng = np.random.default_rng(cells)
    vectors, anchors = rng.integers(-300, 300, (500, 7)), rng.integers(-300, 300, (20, 7))
    vectors[:, 3] = 5
    low, high = hard_negatives.Approximations(vectors, cells).bounds(anchors, slice(100, 500))
    exact = vectors[100:] @ anchors.T
    assert (low <= exact).all() and (exact <= high).all()
    if cells == 256:
        assert np.median(high - low) < 0.1 * exact.std() * 20


def test_large_components_use_wide_sums():
    vectors = np.array([[2**27, -(2**27)], [2**27 - 1, 5]])
    low, high = hard_negatives.Approximations(vectors).bounds(vectors, slice(0, 2))
    assert (low <= vectors @ vectors.T).all() and (vectors @ vectors.T <= high).all()
