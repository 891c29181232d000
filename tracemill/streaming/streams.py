"""Structured Streaming forms (K7, B1, G4, G12, G13): exactly-once appends and stateful audits of event streams.

Each takes a streaming DataFrame and gives one (or starts a query), so the same
code serves files, sockets or queues. State is kept per case. It is kept for
good unless a call names how long after a case's last event (by the watermark)
it may be forgotten; a case that is forgotten counts as not blocked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOnly(StatefulProcessor):
    """Lets the first record of each key through; with a time to live, a key is forgotten so long after its record."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield from islice(rows, 1)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        """Nothing is held."""


def once(stream: DataFrame, key: str, *, ttl_ms: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """K7: the first record of every key, by keyed state; keys of ``done`` (which has the key column) count as seen from the start.

    A batch looks at the state of its own keys only. Null keys are one key. Needs the RocksDB state store where keys are
    done or forgotten; else it is Spark's own deduplication, without Python. The two keep their state in other forms, so a
    checkpoint goes on only with the form it was begun with.
    """
    if ttl_ms is None and done is None:
        return stream.dropDuplicates([key])
    start = None if done is None else done.select(key).distinct().groupBy(key)
    mode = "none" if ttl_ms is None else "processingTime"
    return stream.groupBy(key).transformWithState(statefulProcessor=FirstOnly(ttl_ms), outputStructType=stream.schema, outputMode="Append", timeMode=mode, initialState=start)


def append_new(stream: DataFrame, target: str, checkpoint: str, key: str, *, ttl_ms: int | None = None, done: DataFrame | None = None) -> StreamingQuery:
    """K7, B1: append each record once, also if the source repeats it or the run is started again.

    Which keys are done is state in RocksDB, so a batch costs what it holds, whatever the target holds. Each batch is a
    folder of its own, named by the run (its checkpoint) and the batch's number, and a batch that is repeated after a
    failure overwrites its folder with the same rows. The target has ``run`` and ``batch`` as partition columns.
    """
    spark = stream.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/run={run}/batch={epoch}")

    # batches without data would go on for ever where keys are to be forgotten, and have nothing to add
    own = {_STORE: _ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return once(stream, key, ttl_ms=ttl_ms, done=done).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def blocked_writes(stream: DataFrame, *, blocks: str, frees: str, writes: str, case: str = "case_id", delay: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """G12 over a stream, as the batch form decides it (with ``forget_ms``: for cases whose events are no further apart): each write that comes while its case is blocked; events of a case must arrive in order within a batch's sort."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        blocked = state.get[0] if state.exists else False
        events = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        after = events["tool"].map({blocks: True, frees: False}).astype("boolean").ffill().fillna(blocked)  # the state behind each event
        before = after.shift(fill_value=blocked)
        state.update((bool(after.iloc[-1]),))
        if forget_ms is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(events["ts"].max().timestamp() * 1000)) + forget_ms)
        hits = events[before.astype(bool) & (events["tool"] == writes)]
        yield pd.DataFrame({"case_id": [key[0]] * len(hits), "event_id": hits["event_id"], "ts": hits["ts"]})

    own = stream.select(F.col(case).cast("bigint").alias("case_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "tool").withWatermark("ts", delay)
    return own.groupBy("case_id").applyInPandasWithState(step, "case_id bigint, event_id bigint, ts timestamp", "blocked boolean", "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.EventTimeTimeout)


def unresolved(stream: DataFrame, *, opens: str, closes: str, case: str = "case_id") -> DataFrame:
    """G13 over a stream: by case and target, whether the newest opening or closing event opened it."""
    marked = stream.filter(F.col("tool").isin(opens, closes))
    last = F.max_by(F.col("tool") == opens, F.struct("ts", "event_id"))
    return marked.groupBy(case, "target").agg(last.alias("open"))


def latest_state(stream: DataFrame, *, mutates: str, value: str, case: str = "case_id") -> DataFrame:
    """G4 over a stream: the newest value of a case, and whether it is as new as the last mutation."""
    at = F.struct("ts", "event_id")
    per = stream.groupBy(case).agg(F.max(F.when(F.col("tool") == mutates, at)).alias("changed"), F.max(F.when(F.col(value).isNotNull(), at)).alias("seen"), F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias("value"))
    return per.withColumn("fresh", F.col("changed").isNull() | (F.col("seen") >= F.col("changed")))


def windowed_counts(stream: DataFrame, *, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """An extra beside the survey: event-time counts per tool with late data up to the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), "tool").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "tool", "n")


def collected(df: DataFrame, name: str, mode: str = "append") -> Any:
    """Run a bounded stream to its end into a table in memory, for tests and small reports."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
