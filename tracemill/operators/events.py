"""Ordered analytics over an event log.

An event log has a case, an index within it, a step (events of one step cannot
have seen each other's results), a tool and an outcome. Every operator needs
one shuffle by case, which the others reuse; windows stay within a case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_case(case: str = "case_id", order: str = "idx") -> WindowSpec:
    return Window.partitionBy(case).orderBy(order)


def so_far(case: str = "case_id", order: str = "idx") -> WindowSpec:
    """All events before this one."""
    return by_case(case, order).rowsBetween(Window.unboundedPreceding, -1)


def milestones(log: DataFrame, wanted: list[Column], case: str = "case_id") -> DataFrame:
    """How many of the wanted conditions are met one after another, by a cursor that only goes forward."""
    flags = F.array(*(F.coalesce(w, F.lit(False)) for w in wanted))
    packed = log.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("idx", flags.alias("flags")))).alias("e"))
    reached = F.aggregate("e", F.lit(0), lambda done, x: F.when(F.coalesce(F.get(x["flags"], done), F.lit(False)), done + 1).otherwise(done))
    return packed.select(case, reached.cast("bigint").alias("milestones"), (reached == len(wanted)).alias("complete"))


def retried_later(log: DataFrame, target: str, failed: Column, good: Column, case: str = "case_id") -> DataFrame:
    """Of each failure, whether a success on the same target follows in a strictly later step."""
    # from the last event back, so that a frame only grows: Spark computes a frame that shrinks anew for each row
    w = Window.partitionBy(case, target).orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("recovered", F.coalesce(F.max(F.when(good, F.col("step"))).over(w) > F.col("step"), F.lit(False))).filter(failed)


def observed_before_retry(log: DataFrame, target: str, failed: Column, observes: Column, case: str = "case_id") -> DataFrame:
    """Of each failure, its first retry on the same target, and whether an observation lies strictly between by step."""
    own = Window.partitionBy(case, target).orderBy("idx")
    marked = log.withColumns({
        "retry_idx": F.lead("idx").over(own), "retry_step": F.lead("step").over(own),
        "failed": failed, "observes": observes,
    })
    # the first observation in a later step; steps never fall as the index rises, so no other can lie before the retry
    later = Window.partitionBy(case).orderBy(-F.col("step")).rangeBetween(Window.unboundedPreceding, -1)  # from the last step back, so the frame only grows
    found = marked.withColumn("seen", F.coalesce(F.min(F.when(F.col("observes"), F.col("step"))).over(later) < F.col("retry_step"), F.lit(False)))
    return found.filter("failed").withColumn("reason", F.when(F.col("retry_idx").isNull(), "retry_missing").when(~F.col("seen"), "observation_missing")).drop("failed", "observes")


def evidence_before(log: DataFrame, mutates: Column, evidence: Column, case: str = "case_id") -> DataFrame:
    """How much evidence lies before the first mutation, by index and by step; all of it if there is none."""
    first = F.min(F.when(mutates, F.struct("idx", "step"))).over(Window.partitionBy(case))
    before = first.isNull() | ((F.col("idx") < first["idx"]) & (F.col("step") < first["step"]))
    return log.withColumn("before", before & evidence).groupBy(case).agg(F.count_if(F.col("before")).alias("evidence"), F.min(F.when(mutates, F.col("idx"))).alias("first_mutation"))


def fresh_state(log: DataFrame, mutates: Column, fields: dict[str, Column], case: str = "case_id") -> DataFrame:
    """The latest value of each field since the last mutation (that event included); null if it was not seen since."""
    epochs = log.withColumn("epoch", F.sum(mutates.cast("int")).over(by_case(case).rowsBetween(Window.unboundedPreceding, 0)))
    last = epochs.withColumn("last", F.max("epoch").over(Window.partitionBy(case))).withColumn("now", F.col("epoch") == F.col("last"))
    return last.groupBy(case).agg(F.max("last").alias("mutations"), *(F.max_by(v, F.when(v.isNotNull() & F.col("now"), F.col("idx"))).alias(n) for n, v in fields.items()))


def after_last(log: DataFrame, attempts: Column, reads: Column, case: str = "case_id") -> DataFrame:
    """How many reads follow the last attempt (all reads if there is none)."""
    last = F.coalesce(F.max(F.when(attempts, F.col("idx"))).over(Window.partitionBy(case)), F.lit(-1))
    return log.withColumn("after", reads & (F.col("idx") > last)).groupBy(case).agg(F.count_if(F.col("after")).alias("reads_after"))


def writes_while_blocked(log: DataFrame, blocks: Column, frees: Column, writes: Column, case: str = "case_id") -> DataFrame:
    """Writes after an event that blocks and before one that frees."""
    state = F.last(F.when(blocks, True).when(frees, False), ignorenulls=True).over(so_far(case))
    return log.withColumn("hit", F.coalesce(state, F.lit(False)) & writes).groupBy(case).agg(F.count_if(F.col("hit")).alias("violations"), F.count_if(writes).alias("writes"))


def unresolved(log: DataFrame, key: str, opens: Column, closes: Column, case: str = "case_id") -> DataFrame:
    """Per case, the keys whose last opening or closing event opened them."""
    last = log.filter(opens | closes).groupBy(case, key).agg(F.max_by(opens, F.col("idx")).alias("open"))
    return last.groupBy(case).agg(F.count_if(F.col("open")).alias("unresolved"), F.count(F.lit(1)).alias("operations"))


def newest_of(log: DataFrame, preferred: list[Column], value: Column, case: str = "case_id") -> DataFrame:
    """The value of the newest event of the first condition that any event of the case meets."""
    picks = [F.max_by(value, F.when(p, F.col("idx"))) for p in preferred]
    which = F.coalesce(*(F.when(F.count_if(p) > 0, F.lit(i)) for i, p in enumerate(preferred)))
    return log.groupBy(case).agg(F.coalesce(*picks).alias("state"), which.cast("bigint").alias("priority"))


def chronology(rows: DataFrame, start: str, end: str, case: str = "case_id", order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Rows that end before they start, or start before the previous row's end."""
    before = F.lag(end).over(Window.partitionBy(case).orderBy(*order))
    return rows.withColumn("backwards", F.col(end) < F.col(start)).withColumn("overlaps", F.coalesce(F.col(start) < before, F.lit(False)))


def within_budget(log: DataFrame, keys: list[str], failed: Column, times: Column, case: str = "case_id") -> DataFrame:
    """Failures that a plan of ``times`` per key explains, in order, and those beyond it."""
    rank = F.row_number().over(Window.partitionBy(case, *keys).orderBy("idx"))
    return log.filter(failed).withColumn("expected", rank <= times).groupBy(case).agg(F.count_if(F.col("expected")).alias("expected_failures"), F.count_if(~F.col("expected")).alias("unexpected_failures"))


LCS_WORD = 62


def lcs_short(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two arrays, the first of ``LCS_WORD`` items at most (an error beyond).

    A row of the table is a word: a bit that is unset is a place where the length grows. Each item of ``b`` turns the word
    by one addition, whose carries move the growth along.
    """
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    mask = lambda x: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0).cast("bigint"), lambda m, i: F.when(F.get(a, i) == x, m.bitwiseOR(bit(i))).otherwise(m))
    table = F.map_from_entries(F.transform(F.array_distinct(a), lambda x: F.struct(x, mask(x))))

    def length(t: Column) -> Column:
        full = bit(F.size(a)) - 1

        def turned(v: Column, y: Column) -> Column:
            u = v.bitwiseAND(F.coalesce(F.try_element_at(t, y), F.lit(0).cast("bigint")))
            return (v + u).bitwiseOR(v - u).bitwiseAND(full)

        return F.size(a) - F.bit_count(F.aggregate(b, full, turned))

    small = F.when(F.size(a) > LCS_WORD, F.raise_error(F.lit(f"more than {LCS_WORD} items: use lcs_length"))).otherwise(F.get(F.transform(F.array(table), length), F.lit(0)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(small).cast("int")


def common_length(a: list, b: list) -> int:
    """G2 for lists of any length: the same words, as long as ``a`` is."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if u := v & masks.get(y, 0):
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """The length of the longest common subsequence of two arrays of any length, in Arrow batches."""
    def lengths(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([common_length(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="int32")

    return F.pandas_udf(lengths, "int")(a, b)


def aligned(calls: DataFrame, executions: DataFrame, case: str = "case_id", idx: str = "idx", signature: str = "sig") -> DataFrame:
    """(case, idx, execution) of each call: the first execution with its signature behind the last one found; a miss leaves the cursor.

    Both are shuffled by case and sorted, executions first. A task keeps the places of one case's executions by signature and
    streams its calls past them; as the cursor only goes forward, each place is passed once. A null signature matches nothing.
    """
    kind = calls.schema[case].dataType.simpleString()
    tagged = lambda df, n: df.select(F.col(case).alias("case"), F.lit(n).alias("kind"), F.col(idx).cast("bigint").alias("idx"), F.col(signature).alias("sig"))
    # by a hash of the case: for the case itself Spark may leave the shuffle out and count on both halves being dealt alike
    rows = tagged(executions, 0).unionByName(tagged(calls, 1)).repartition(F.xxhash64("case")).sortWithinPartitions("case", "kind", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, upto, cursor = (), {}, {}, None
        for batch in batches:
            cases, at, found = [], [], []
            for of, made, i, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (of,) != now:
                    now, places, upto, cursor = (of,), {}, {}, None
                if not made:
                    if sig is not None:
                        places.setdefault(sig, []).append(i)
                    continue
                own, n = places.get(sig, ()), upto.get(sig, 0)
                while n < len(own) and cursor is not None and own[n] <= cursor:
                    n += 1
                upto[sig] = n
                hit = own[n] if n < len(own) else None
                cursor = cursor if hit is None else hit
                cases.append(of)
                at.append(i)
                found.append(hit)
            yield pa.RecordBatch.from_arrays([pa.array(cases, batch.schema.field(0).type), pa.array(at, pa.int64()), pa.array(found, pa.int64())], names=[case, "idx", "execution"])

    return rows.mapInArrow(run, f"{case} {kind}, idx bigint, execution bigint")


def repeat_classes(calls: DataFrame, executions: DataFrame, *, sensitive: Column, mutates: Column, case: str = "case_id") -> DataFrame:
    """G1: each call with ``repeat`` (redundant) and ``retry``, from windows alone.

    calls: case, idx, tool, sig and execution (the place of its execution, or null); executions: case, idx, step, tool, ok.
    ``sensitive`` and ``mutates`` are conditions on the tool. What came before a call is the last call of its signature (an
    island of equal signatures), the last failed call of the case, and how many changes had succeeded up to an execution.
    """
    changed = F.sum((mutates & F.col("ok")).cast("bigint")).over(by_case(case).rowsBetween(Window.unboundedPreceding, 0))
    ran = executions.select(F.col(case).alias("_case"), F.col("idx").alias("_idx"), "step", F.coalesce("ok", F.lit(False)).alias("ok"), changed.alias("changes"), (mutates & F.col("ok")).cast("bigint").alias("own"))
    both = calls.select(case, "idx", "tool", "sig", "execution").join(ran, (F.col(case) == F.col("_case")) & (F.col("execution") == F.col("_idx")), "left").drop("_case", "_idx")
    own, before = Window.partitionBy(case, "sig").orderBy("idx"), so_far(case)
    seen = both.withColumns({
        "count": F.row_number().over(own) - 1, "last": F.lag(F.struct("idx", "step", "ok", "changes", "execution")).over(own),
        "failed": F.last(F.when(~F.col("ok"), F.struct("idx", "step")), ignorenulls=True).over(before),
    })
    after_failed = F.coalesce(~F.col("last.ok"), F.lit(False))
    later = F.coalesce(F.col("step") > F.col("last.step"), F.lit(False))
    in_new_state = sensitive & F.coalesce(F.col("changes") - F.col("own") > F.col("last.changes"), F.lit(False))
    behind_failure = F.coalesce((F.col("failed.idx") > F.col("last.idx")) & (F.col("step") > F.col("failed.step")), F.lit(False))
    again = F.col("count") > 0
    retry = again & after_failed & later
    repeat = again & F.when(after_failed, ~later | (F.col("count") > 1)).otherwise(~in_new_state & ~behind_failure)
    return seen.withColumns({"retry": retry, "repeat": repeat}).drop("count", "last", "failed", "changes", "own")


def repeat_metrics(classes: DataFrame, case: str = "case_id") -> DataFrame:
    """G1: repeats and retries of each case, and their shares of its calls."""
    n = F.count(F.lit(1))
    return classes.groupBy(case).agg(*(x for name, c in (("repeated_tool_call", "repeat"), ("retry_call", "retry")) for x in (F.count_if(c).alias(f"{name}s"), (F.count_if(c) / n).alias(f"{name}_rate"))))


def multiset_scores(required: DataFrame, predicted: DataFrame, optional: DataFrame | None = None, case: str = "case_id") -> DataFrame:
    """true and false positives and misses of two multisets (columns case, name, n); optional entries excuse extras."""
    both = required.select(case, "name", F.col("n").alias("r")).join(predicted.select(case, "name", F.col("n").alias("p")), [case, "name"], "full_outer")
    if optional is not None:
        both = both.join(optional.select(case, "name", F.col("n").alias("o")), [case, "name"], "left")
    r, p, o = (F.coalesce(F.col(c), F.lit(0)) if c in both.columns else F.lit(0) for c in ("r", "p", "o"))
    one = both.groupBy(case).agg(*(F.sum(x).cast("bigint").alias(n) for n, x in (("tp", F.least(r, p)), ("fp", F.greatest(p - r - o, F.lit(0))), ("fn", F.greatest(r - p, F.lit(0))))))
    precision, recall = (F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col(c), F.lit(0)), F.lit(1.0)) for c in ("fp", "fn"))
    scored = one.withColumns({"precision": precision, "recall": recall})
    return scored.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
