import io
import random

import pytest

from tracemill.sources import jsonl, line_source


@pytest.mark.parametrize("chunk", [1, 3, 7, 100])
def test_ranges_cover_every_line_once(chunk):
    rng = random.Random(chunk)
    for _ in range(200):
        data = "".join(rng.choice(["a", "é", "\n", "\n", "bc", "\r\n"]) for _ in range(rng.randrange(25))).encode()
        want, at = [], 0
        for line in data.split(b"\n"):
            last = at + len(line) >= len(data)
            if line or not last:
                want.append((at, line, not last))
            at += len(line) + 1
        split = rng.randrange(1, 9)
        got = [x for start in range(0, len(data), split) for x in line_source.lines_from(io.BytesIO(data), start, min(start + split, len(data)), chunk)]
        assert got == want


def write(path, lines, end="\n"):
    path.write_bytes(("\n".join(lines) + end).encode() if lines else b"")


def test_numbers_across_ranges_and_files(spark, tmp_path):
    rng = random.Random(3)
    files = {f"f{i}.jsonl": ["x" * rng.randrange(30) + "é" * rng.randrange(3) for _ in range(rng.randrange(40))] for i in range(4)} | {"empty.jsonl": []}
    for name, lines in files.items():
        write(tmp_path / name, lines)
    (tmp_path / "_hidden").write_text("no\n")
    got = {(r.file.rsplit("/", 1)[1], r.line): r.text for r in line_source.numbered(line_source.scan(spark, str(tmp_path), split=37)).collect()}
    assert got == {(n, i): t for n, lines in files.items() for i, t in enumerate(lines, 1)}
    one = line_source.numbered(line_source.scan(spark, f"file://{tmp_path}/f1.jsonl", split=11))
    assert one.count() == len(files["f1.jsonl"]) and one.schema["line"].dataType.simpleString() == "bigint"


def test_torn_tails(spark, tmp_path):
    write(tmp_path / "a.jsonl", ['{"id":"a"}', '{"id":"b'], end="")
    path = str(tmp_path / "a.jsonl")
    assert [r.terminated for r in line_source.scan(spark, path).orderBy("offset").collect()] == [True, False]
    assert line_source.scan(spark, path, torn="drop").count() == 1
    assert line_source.whole_records(line_source.scan(spark, path)).count() == 1
    with pytest.raises(Exception, match="unterminated last line"):
        line_source.scan(spark, path, torn="error").collect()
    with pytest.raises(ValueError, match="keep, drop or error"):
        line_source.scan(spark, path, torn="x")
    write(tmp_path / "a.jsonl", ['{"id":"a"}', '{"id":"b"}'], end="")
    assert line_source.whole_records(line_source.scan(spark, path)).count() == 2


def test_checks_of_cases_run_on_the_source(spark, tmp_path):
    write(tmp_path / "c.jsonl", ['{"id":"a","query":"q"}', "", "{bad", '{"id":"a","query":"q"}', '{"query":"q"}', "[1]"])
    rows = jsonl.check_cases(line_source.numbered(line_source.scan(spark, str(tmp_path), split=9)).drop("terminated"))
    assert {r.line: r.violation for r in rows.collect()} == {1: None, 3: "not JSON", 4: "repeated id", 5: "bad id", 6: "not an object"}


def test_a_stream_reads_whole_lines_as_they_are_added(spark, tmp_path):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    source.mkdir()

    def run():
        line_source.stream(spark, str(source), split=5).select("file", "offset", "text").writeStream.format("parquet").option("checkpointLocation", cp).start(out).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(r.text for r in spark.read.parquet(out).collect())

    write(source / "a", ["one", "two", "thr"], end="")
    assert run() == ["one", "two"]
    write(source / "a", ["one", "two", "three", "four"])
    write(source / "b", ["other line"])
    assert run() == ["four", "one", "other line", "three", "two"]
    assert run() == ["four", "one", "other line", "three", "two"]
