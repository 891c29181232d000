import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tracemill.llm import sharding
from tracemill.llm.common import read


@pytest.mark.parametrize("seed", range(5))
def test_differencing_places_all_and_beats_greedy_or_nearly(seed):
    rng = random.Random(seed)
    sizes = [(i, int(rng.paretovariate(1.2) * 1000)) for i in range(600)]
    held = sharding.difference(sizes, 8)
    assert sorted(x for s in held for x in s) == list(range(600))
    by = dict(sizes)
    loads = [sum(by[x] for x in s) for s in held]
    greedy = [0] * 8
    for _, size in sorted(sizes, key=lambda x: -x[1]):
        greedy[greedy.index(min(greedy))] += size
    assert max(loads) - min(loads) <= max(max(greedy) - min(greedy), sum(by.values()) // 1000)


def test_differencing_by_hand():
    held = sharding.difference([("a", 8), ("b", 7), ("c", 6), ("d", 5), ("e", 4)], 2)
    assert sorted(map(sorted, held)) == [["a", "c"], ["b", "d", "e"]]  # differencing ends at a spread of 2
    assert sharding.difference([], 3) == [[], [], []] and sharding.difference([("a", 1)], 1) == [["a"]]


def check(rows, texts, shards):
    assert len(rows) == sum(texts.values())
    slots = defaultdict(list)
    of_group = defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        of_group[r.text_crc32, r.size].add(r.shard)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_group.values())
    assert Counter((r.text_crc32, r.size) for r in rows) == Counter({(zlib.crc32((t or "").encode()), len((t or "").encode()) + 16): 0 for t in texts}) + Counter(x for t, n in texts.items() for x in [(zlib.crc32((t or "").encode()), len((t or "").encode()) + 16)] * n)


def test_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = sharding.shard(docs, range_rows=5).collect()
    check(rows, Counter(r.text for r in docs.select("text").collect()), 40)


def test_balance(spark, sf_dir):
    docs = read(spark, sf_dir.replace("0.001", "0.1"), "documents")
    loads = Counter()
    for r in sharding.shard(docs).select("shard", "size").collect():
        loads[r["shard"]] += r["size"]
    assert len(loads) == 40 and max(loads.values()) - min(loads.values()) < 0.001 * max(loads.values())


def test_odd_rows(odd, nothing):
    check(sharding.shard(odd, shards=3).collect(), Counter(r.text for r in odd.select("text").collect()), 3)
    assert sharding.shard(nothing).count() == 0


def brute_spread(sizes, shards):
    """The least spread of any assignment."""
    best = None
    for to in itertools.product(range(shards), repeat=len(sizes)):
        loads = [sum(s for s, t in zip(sizes, to) if t == k) for k in range(shards)]
        best = min(max(loads) - min(loads), best) if best is not None else max(loads) - min(loads)
    return best


def plain_differencing(sizes, shards):
    """Differencing on full lists of loads, as it is defined."""
    partitions = [[s] + [0] * (shards - 1) for s in sizes]
    while len(partitions) > 1:
        partitions.sort(key=lambda p: max(p) - min(p))
        a, b = partitions.pop(), partitions.pop()
        partitions.append([x + y for x, y in zip(sorted(a), sorted(b, reverse=True))])
    return max(partitions[0]) - min(partitions[0])


@pytest.mark.parametrize("seed", range(40))
def test_differencing_against_all_assignments(seed):
    rng = random.Random(seed)
    shards, sizes = rng.choice([2, 3]), [rng.randint(1, 60) for _ in range(rng.randint(1, 8))]
    held = sharding.difference(list(enumerate(sizes)), shards)
    loads = [sum(sizes[i] for i in s) for s in held]
    spread, least = max(loads) - min(loads), brute_spread(sizes, shards)
    assert sorted(i for s in held for i in s) == list(range(len(sizes))) and least <= spread <= max(sizes)
    if len(set(sizes)) == len(sizes) and shards == 2:  # without ties the rule leaves no choice
        assert spread == plain_differencing(sizes, shards)


def test_parts_and_levels_place_every_group(spark, sf_dir):
    docs = read(spark, sf_dir.replace("0.001", "0.01"), "documents")
    want = Counter(r.text for r in docs.select("text").collect())
    for part_groups, slack in ((20_000, 0.001), (60, 0.001), (9, 0.02)):  # one part, one level of them, several levels of tiny parts (3 in each)
        rows = sharding.shard(docs, shards=3, part_groups=part_groups).collect()
        check(rows, want, 3)
        loads = Counter()
        for r in rows:
            loads[r.shard] += r["size"]
        assert max(loads.values()) - min(loads.values()) < slack * max(loads.values())


def test_repeated_rows_are_numbered_in_many_ranges(spark):
    docs = spark.range(6000).selectExpr("if(id < 2500, 1, id) as doc_id", "if(id < 2500, 'same text', concat('t', id)) as text")
    rows = sharding.shard(docs, shards=4).collect()
    check(rows, Counter(["same text"] * 2500 + [f"t{i}" for i in range(2500, 6000)]), 4)
