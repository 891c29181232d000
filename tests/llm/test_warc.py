import base64
import gzip
import hashlib
import io
import random
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same, connect
from tracemill.llm import queries, warc

SCHEMA = "page_id bigint, url string, html string"


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by the definition; of repeated pages one is the first."""
    out, seen = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = data in seen and len(data) >= least
        out.append((i, len(data), digest, "revisit" if first else "response", seen[data] if first else None))
        seen.setdefault(data, i)
    return sorted(out, key=repr)


def written(spark, tmp_path, rows, parts=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("_id", F.lit(1)).withColumn("first", F.lit(2)).withColumn("shard", F.lit(2))
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    return folder, warc.write(df, folder, **kw)


def read_back(spark, folder):
    got = warc.records(spark, folder).collect()
    assert all(r.digests_hold for r in got)
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr)


def files(folder):
    top = Path(folder.removeprefix("file://"))
    return {p.name: p.read_bytes() for p in top.glob("*.warc.gz")}


ODD = [
    (5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (None, "http://a/x", "same"), (None, "http://a/y", "only null"), (None, "http://a/z", "only null"),
    (1, "http://a/1", None), (2, "http://a/2", ""), (4, "bad\r\nX: y  é", "a\r\n\r\nb"), (4, "http://a/4", "a\r\n\r\nb"), (4, "http://a/4", "other"), (-7, "http://a/7", "😀" * 10), (6, "http://a/6", "WARC/1.1\r\n\r\n" * 100_000),
]


def test_whole_table_equals_sql(spark, sf_dir):
    assert_same(queries.op12_warc(spark, sf_dir), connect(sf_dir), queries.SQL["op12_warc"])


def test_odd_rows(spark, tmp_path):
    folder, _ = written(spark, tmp_path, ODD)
    assert read_back(spark, folder) == brute(ODD)
    folder, manifest = written(spark, tmp_path, [])
    assert read_back(spark, folder) == [] and manifest.count() == 0 and not files(folder)


def test_small_payloads_are_all_responses(spark, tmp_path):
    folder, _ = written(spark, tmp_path, ODD, least_revisit=5)
    assert read_back(spark, folder) == brute(ODD, 5)


def pages(n, seed=1):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdef <>", k=rng.randrange(3000))) for _ in range(n // 2)]
    return [(i, f"http://h/{i}", rng.choice([*pool, "hot"] if rng.random() < 0.7 else ["hot"])) for i in range(n)]


def test_files_do_not_depend_on_partitions_or_runs(spark, tmp_path, monkeypatch):
    rows = pages(300)
    monkeypatch.setattr(warc, "LEAST_SHARD_BYTES", 1000)
    one, manifest = written(spark, tmp_path, rows, parts=1, least_shards=7, file_bytes=9000)
    two, _ = written(spark, tmp_path, rows[::-1], parts=9, least_shards=7, file_bytes=9000)
    assert files(one) == files(two) and len(files(one)) > 10
    listed = {r.file: r for r in manifest.collect()}
    assert set(listed) == set(files(one)) and {r.shard for r in listed.values()} == set(range(7))
    for name, data in files(one).items():
        assert listed[name].sha256 == hashlib.sha256(data).hexdigest() and listed[name].file_bytes == len(data)
        assert len(data) <= 9000 or listed[name].records == 1
    by_shard = Counter()
    for r in listed.values():
        by_shard[r.shard] += r.payload_bytes + warc.HEADER_BYTES * r.records
    assert max(by_shard.values()) < 1.3 * min(by_shard.values())
    assert read_back(spark, one) == brute(rows)


def test_archives_are_plain_warc(spark, tmp_path):
    """An independent parser: gzip as a whole, headers by line, blocks by length, records in the order of ids."""
    rows = pages(60)
    folder, _ = written(spark, tmp_path, rows, least_shards=1)
    (data,) = files(folder).values()
    stream, seen, by_uri = io.BytesIO(gzip.decompress(data)), [], {}
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            k, _, v = line.decode().strip().partition(": ")
            fields[k] = v
        block = stream.read(int(fields["Content-Length"]))
        assert stream.read(4) == b"\r\n\r\n"
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if fields["WARC-Type"] != "warcinfo":
            seen.append(int(fields["WARC-Page-ID"]))
            by_uri[fields["WARC-Record-ID"]] = fields
            if fields["WARC-Type"] == "response":
                assert block.split(b"\r\n\r\n", 1)[1].decode() == rows[seen[-1]][2]
            else:
                assert by_uri[fields["WARC-Refers-To"]]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
    assert seen == list(range(60)) and len(by_uri) == 60


def test_payloads_can_be_read(spark, tmp_path):
    rows = pages(30)
    folder, _ = written(spark, tmp_path, rows)
    got = {r.page_id: r.payload for r in warc.records(spark, folder, payloads=True).collect() if r.record_type == "response"}
    assert all(bytes(data).decode() == rows[i][2] for i, data in got.items()) and set(r[2] for r in rows) == {bytes(d).decode() for d in got.values()}


def test_only_what_the_manifest_lists_counts_and_damage_is_found(spark, tmp_path):
    folder, _ = written(spark, tmp_path, pages(40))
    top = Path(folder.removeprefix("file://"))
    (top / "pages-000099-00000.warc.gz").write_bytes(b"left by a run that failed")
    assert len(read_back(spark, folder)) == 40 and not (top / "_temporary").exists()
    path = next(top.glob("pages-000000-*.gz"))
    data = path.read_bytes()
    path.write_bytes(data[:-20])
    with pytest.raises(Exception, match="ends early"):
        warc.records(spark, folder).collect()
    member = warc.page_record(1, "http://x", b"y", hashlib.sha1(b"y").digest(), 0, None)
    path.write_bytes(data + member)
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.records(spark, folder).collect()


def test_a_second_attempt_leaves_the_first_ones_file(tmp_path):
    (tmp_path / "_temporary").mkdir()
    for _ in range(2):
        roller = warc.Roller(str(tmp_path), 0, 1 << 20, warc.DATE)
        roller.add(warc.page_record(1, "http://x", b"y", hashlib.sha1(b"y").digest(), 0, None), "response", 1)
        roller.close()
    assert [p.name for p in tmp_path.iterdir() if p.is_file()] == ["pages-000000-00000.warc.gz"] and not list((tmp_path / "_temporary").iterdir())
