import hashlib
import os
import random

import pytest

from tracemill.operators import draws, tree_digest

# draws


def drawn(spark, rows, quota, **kw):
    got = draws.draw(spark.createDataFrame(rows, "group string, candidate int, rank int"), quota, **kw).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.group, r.place)):
        out.setdefault(r.group, []).append(r.candidate)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(f"g{g:02}", c, rng.randrange(12)) for g in range(15) for c in rng.sample(range(40), rng.randrange(1, 25))]
    rows += rows[:5] + [(None, 1, 1), ("g00", None, 1), ("g00", 1, None)]
    want = draws.in_turn(rows, 3)
    got = drawn(spark, rows, 3)
    assert got == {g: c for g, c in want.items() if c}
    assert len({c for cs in got.values() for c in cs}) == sum(map(len, got.values()))


def test_many_losers_and_empty_tables(spark):
    rows = [(f"g{g}", c, c) for g in range(6) for c in range(8)]  # all want the same
    assert drawn(spark, rows, 2) == {"g0": [0, 1], "g1": [2, 3], "g2": [4, 5], "g3": [6, 7]}
    assert drawn(spark, [], 2) == {}
    with pytest.raises(ValueError, match="not settled"):
        drawn(spark, rows, 2, most_rounds=1)


# digests


def tree(nodes, fan):
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
    return nodes[0]


def brute(data, block, fan):
    return tree([hashlib.sha256(data[i : i + block]).hexdigest() for i in range(0, max(len(data), 1), block)], fan)


def test_blocks_and_trees(spark, tmp_path):
    rng = random.Random(1)
    files = {"a": b"", "b": b"x" * 10, "sub/c": rng.randbytes(1000), "sub/d e+%41": rng.randbytes(999), "z": b"x" * 10}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = tree_digest.file_digests(spark, str(tmp_path), block=10, fan=3)
    assert {r.path: (r.size, r.digest) for r in got.collect()} == {n: (len(d), brute(d, 10, 3)) for n, d in files.items()}
    want = tree([hashlib.sha256(n.encode() + b"\0" + brute(d, 10, 3).encode()).hexdigest() for n, d in sorted(files.items())], 3)
    assert tree_digest.folder_digest(got, 3) == want
    assert tree_digest.folder_digest(got.limit(0), 3) == hashlib.sha256(b"").hexdigest()
    manifest = got.select("path", "digest").collect()
    old = spark.createDataFrame(manifest, "path string, digest string")
    (tmp_path / "b").write_bytes(b"y" * 10)
    os.remove(tmp_path / "z")
    (tmp_path / "new").write_bytes(b"")
    assert {(r.path, r.reason) for r in tree_digest.drift(spark, str(tmp_path), old, block=10, fan=3).collect()} == {("b", "changed"), ("z", "missing"), ("new", "new")}


def test_folder_manifest_query(spark, sf_dir):
    from pathlib import Path

    from tracemill.plans import catalogue

    rows = catalogue.QUERIES["folder_manifest"](spark, sf_dir).collect()
    files = {str(p.relative_to(sf_dir)): p.read_bytes() for p in Path(sf_dir).rglob("*") if p.is_file()}
    assert {r.path: r.digest for r in rows} == {n: brute(d, 1 << 20, 1024) for n, d in files.items()}
    assert {r.folder for r in rows} == {tree([hashlib.sha256(n.encode() + b"\0" + brute(d, 1 << 20, 1024).encode()).hexdigest() for n, d in sorted(files.items())], 1024)}
