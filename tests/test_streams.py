import time

from pyspark.sql import functions as F

from tracemill.operators import events
from tracemill.plans import catalogue
from tracemill.streaming import streams


def log_files(spark, sf_dir, path):
    log = catalogue.executions(spark, sf_dir).select("case_id", "event_id", "ts", "tool", "target", "value")
    log.repartition(2).write.parquet(path)
    return streams.event_stream(spark, path, "case_id bigint, event_id bigint, ts timestamp_ntz, tool string, target bigint, value double")


def test_streamed_blocked_writes_equal_the_window(spark, sf_dir, tmp_path):
    stream = log_files(spark, sf_dir, str(tmp_path / "log")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = streams.collected(streams.blocked_writes(stream, blocks="error", frees="view", writes="purchase"), "hits")
    log = catalogue.executions(spark, sf_dir)
    want = events.writes_while_blocked(log, catalogue.tool("error"), catalogue.tool("view"), catalogue.tool("purchase")).agg(F.sum("violations")).first()[0]
    assert got.count() == want > 0


def test_streamed_last_states(spark, sf_dir, tmp_path):
    stream = log_files(spark, sf_dir, str(tmp_path / "log"))
    got = streams.collected(streams.unresolved(stream, opens="error", closes="view"), "open_ops", "complete").filter("open").count()
    want = events.unresolved(catalogue.executions(spark, sf_dir), "target", catalogue.tool("error"), catalogue.tool("view")).agg(F.sum("unresolved")).first()[0]
    assert got == want


def test_append_writes_each_record_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], "id int").write.mode("append").parquet(source)
        streams.append_new(spark.readStream.schema("id int").parquet(source), target, str(tmp_path / "cp"), "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_a_restarted_append_goes_on_where_it_was(spark, tmp_path):
    source, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    feed = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id int, text string").write.mode("append").parquet(source)
    run = lambda **kw: streams.append_new(spark.readStream.schema("id int, text string").parquet(source), target, cp, "id", **kw).awaitTermination()
    done = spark.createDataFrame([(9,), (8,)], "id int")  # what an earlier log has
    feed([1, 1, 9])
    run(done=done)
    feed([1, 2])
    run(done=done)
    run(done=done)
    rows = spark.read.parquet(target)
    assert sorted((r.id, r.text) for r in rows.collect()) == [(1, "t1"), (2, "t2")] and {"run", "batch"} <= set(rows.columns)
    # a batch that is repeated overwrites its own folder
    first = rows.filter("batch = 0").select("id", "text")
    kept = first.collect()
    spark.createDataFrame(kept, first.schema).write.mode("overwrite").parquet(f"{target}/run={rows.first()['run']}/batch=0")
    assert spark.read.parquet(target).count() == 2


def test_a_key_is_forgotten_after_its_time(spark, tmp_path):
    source, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for _ in range(2):
        spark.createDataFrame([(1,)], "id int").write.mode("append").parquet(source)
        streams.append_new(spark.readStream.schema("id int").parquet(source), target, cp, "id", ttl_ms=1).awaitTermination()
        time.sleep(0.1)
    assert spark.read.parquet(target).count() == 2


def test_appends_for_good_run_no_python(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1,), (None,), (1,), (None,)], "id int").write.parquet(source)
    stream = spark.readStream.schema("id int").parquet(source)
    plan = lambda rows: rows._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan(streams.once(stream, "id")) and "TransformWithState" in plan(streams.once(stream, "id", ttl_ms=1))
    streams.append_new(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "id").awaitTermination()
    assert sorted(r.id or 0 for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]
