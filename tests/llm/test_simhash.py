import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.llm import simhash
from tracemill.llm.common import read


def brute_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=4):
    """(id, fingerprint) rows to the least id that is reachable."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return {(i, f): least.get(root(f)) for i, f in rows}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB é\n\t\u2028\u00a0x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("ab",), ("é ç",), ("",)], "s string").select(F.xxhash64("s")).collect()
    assert [r[0] % 2**64 for r in got] == [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("ab", "é ç", "")]


def clusters(seed, centres=30, members=40):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, members)):
            out.append(f)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
    return out


@pytest.mark.parametrize("seed", range(4))
def test_forest_search_equals_all_pairs(seed):
    fps = np.array(sorted(set(clusters(seed))), np.uint64)
    shard = np.array([int(f) % 3 for f in fps])
    forest = simhash.BKForest(fps, shard)
    got = {(int(a), int(b)) for q, n in forest.within(np.arange(len(fps)), 4) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if shard[i] == shard[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert got == want


@pytest.mark.parametrize(("seed", "shard_rows", "task_edges", "n"), [(1, 8192, 1_000_000, 10**6), (2, 16, 5, 10**6), (3, 64, 1_000_000, 300), (4, 8192, 0, 10**8), (5, 8192, 20, 5000)])
def test_links_and_components_equal_all_pairs(spark, seed, shard_rows, task_edges, n):
    fps = sorted(set(clusters(seed)) | {0, 1, 3})
    signed = [f - (f >> 63 << 64) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    labels = {r.fp % 2**64: r.label for r in simhash.components(simhash.links(nodes, n, shard_rows=shard_rows), task_edges=task_edges).collect()}
    want = brute_components([(i, f) for i, f in enumerate(fps)])
    groups, mine = {}, {}
    for i, f in enumerate(fps):
        groups.setdefault(want[i, f], set()).add(f)
        mine.setdefault(labels.get(f, ("own", f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_query_equals_brute_force(spark, sf_dir):
    from tracemill.llm.queries import op1_simhash

    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = op1_simhash(spark, sf_dir).collect()
    assert len(got) == len(rows) and all(want[r.doc_id, int(r.fingerprint, 16)] == r.component_id for r in got)


def test_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in odd.collect()]
    want = brute_components(rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted((str(i), f"{f:016x}", want[i, f]) for i, f in rows)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "5", "6", "8", "None", "None"]


def test_keep_one_decides_by_row(spark):
    x, near, y, z = "the quick brown fox jumps over", "The quick brown FOX jumps OVER", "an entirely different line of words", "something else that nobody wrote before"
    rows = [(3, x, 1), (5, near, 2), (5, y, 3), (5, y, 4), (None, z, 5), (None, z, 6), (None, z.upper(), 7), (None, x, 8), (7, z, 9)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, n int")).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == sorted([("3", x), ("5", y), ("7", z), ("None", z), ("None", x)])


@pytest.mark.parametrize("n", [0, 1, 2048, 10**5, 10**7, 10**9, 10**11])
def test_shards_lose_no_link_and_hold_thousands(n):
    masks = [m % 2**64 for m in simhash._masks(n, 4)]
    rng = random.Random(n)
    for _ in range(300):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & differ for m in masks)
    size = n / 2 ** min(m.bit_count() for m in masks)
    assert size <= 4096 and (n <= 2048 or size > 1000)


def test_a_tree_prunes(spark):
    rng = random.Random(7)
    fps = np.array([rng.getrandbits(64) for _ in range(2000)], np.uint64)
    forest = simhash.BKForest(fps, np.zeros(2000, np.int64))
    queries, node, seen = np.arange(2000), forest.root[np.arange(2000)], 0
    while len(queries):  # the same walk, counting
        seen += len(queries)
        d = np.bitwise_count(fps[queries] ^ fps[node]).astype(np.int64)
        low, high = forest.place[node * 65 + np.maximum(d - 4, 0)], forest.place[node * 65 + np.minimum(d + 4, 64) + 1]
        node = np.concatenate([forest.child[a:b] for a, b in zip(low, high)]).astype(np.int64)
        queries = np.repeat(queries, high - low)
    assert seen < 0.5 * 2000 * 2000


def test_no_fingerprints_have_no_stars(spark):
    none = np.empty(0, np.uint64)
    assert [len(x) for x in simhash.stars(none, np.empty(0, np.int64), 4)] == [0, 0]
    nodes = spark.createDataFrame([(1,), (2,)], "fp bigint")
    assert simhash.links(nodes.repartition(3), 2).distinct().count() == 1
