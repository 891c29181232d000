"""Aggregations (F1-F6, F13-F17, F20, F25): null-aware means with their own denominators, three groupings in one pass, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the metrics of a summary
MACRO = ("tool_precision", "tool_recall", "tool_f1", "argument_accuracy", "valid_call_rate", "execution_success_rate", "adjusted_execution_success_rate", "unknown_tool_rate", "repeated_tool_call_rate", "retry_call_rate", "invalid_transition_rate", "tool_order_score", "required_tool_results_accuracy")
RATES = ("task_success", "recovery_success", "ordered_subsequence_match", "ordered_tool_match", "tool_set_match")
AVERAGES = {"num_steps": "num_steps", "tool_attempts": "tool_attempt_count", "tool_calls": "tool_call_count", "invalid_tool_calls": "invalid_tool_calls", "malformed_tool_call_markers": "malformed_tool_call_markers", "failed_tool_calls": "failed_tool_calls", "expected_failed_calls": "expected_failed_calls", "unexpected_failed_calls": "unexpected_failed_calls", "unknown_tool_calls": "unknown_tool_calls", "repeated_tool_calls": "repeated_tool_calls", "retry_calls": "retry_calls", "invalid_transitions": "invalid_transition_count"}


def number(c: Column | str) -> Column:
    """Booleans as 1.0 and 0.0."""
    return F.expr(f"cast({c} as double)") if isinstance(c, str) else c.cast("double")


def mean_with_base(columns: dict[str, str]) -> list[Column]:
    """each mean over its own non-null values, and how many those are."""
    out = []
    for name, column in columns.items():
        out += [F.avg(number(column)).alias(name), F.count(column).alias(f"{name}_evaluated_cases")]
    return out


def totals(columns: dict[str, str]) -> list[Column]:
    """sums, 0 over nothing."""
    return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in columns.items()]


def group_key(c: str) -> Column:
    """null and empty keys as 'unknown'."""
    text = F.col(c).cast("string")
    return F.when(text.isNull() | (text == ""), "unknown").otherwise(text)


def grouped(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """overall and by each key, as grouping sets: columns scope, key and the aggregates."""
    keyed = df.withColumns({f"_{k}": group_key(k) for k in keys})
    columns = [F.col(f"_{k}") for k in keys]
    sets = [[]] + [[c] for c in columns]
    out = keyed.groupingSets(sets, *columns).agg(F.grouping_id().alias("_id"), *aggregates)
    scope = F.lit("overall")
    for i, k in enumerate(keys):  # a set bit means that the key is not in the set
        mask = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i))
        scope = F.when(F.col("_id") == mask, k).otherwise(scope)
    names = [a for a in out.columns if a not in {f"_{k}" for k in keys} | {"_id"}]
    return out.select(scope.alias("scope"), F.coalesce(*columns, F.lit("")).alias("key"), *names)


def summary(metrics: DataFrame, keys: tuple[str, ...] = ("category", "difficulty", "scenario_family")) -> DataFrame:
    """the summary of metrics rows (columns named as the metrics), overall and by each key."""
    long = (F.col("category") == "long_horizon") | F.coalesce(F.array_contains("tags", "long_horizon"), F.lit(False))
    aggregates = [
        F.count(F.lit(1)).alias("num_cases"), *mean_with_base({m: m for m in MACRO}), *mean_with_base({f"{m}_rate": m for m in RATES}),
        *(F.avg(number(c)).alias(f"average_{n}") for n, c in AVERAGES.items()), *totals({f"total_{n}": c for n, c in AVERAGES.items() if n != "num_steps"}),
        F.avg(F.when(long, number("task_success"))).alias("long_horizon_success_rate"), F.count(F.when(long, F.col("task_success"))).alias("long_horizon_success_evaluated_cases"),
    ]
    return grouped(metrics, list(keys), aggregates)


def macro_of_groups(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """the mean of the groups' means; a group without values does not count."""
    per = df.groupBy(group_key(key).alias("key")).agg(*(F.avg(number(c)).alias(n) for n, c in columns.items()))
    return per.agg(F.count(F.lit(1)).alias("num_groups"), *(x for n in columns for x in (F.avg(n).alias(n), F.count(n).alias(f"{n}_evaluated_groups"))))


def task_bounds(success: str, verdict: str | None = None) -> list[Column]:
    """F5 for a tri-state column: counts, the rate only if nothing is pending, and logical bounds."""
    n, passed, pending = F.count(F.lit(1)), F.count_if(F.col(success)), F.count_if(F.col(success).isNull())
    out = [
        n.alias("num_cases"), passed.alias("task_pass_count"), (n - passed - pending).alias("task_fail_count"), pending.alias("task_unresolved_count"),
        F.when(pending == 0, passed / F.nullif(n, F.lit(0))).alias("task_success_rate"),
        (passed / F.nullif(n, F.lit(0))).alias("task_success_lower_bound"), ((passed + pending) / F.nullif(n, F.lit(0))).alias("task_success_upper_bound"),
    ]
    return out if verdict is None else [*out, F.count_if(F.col(verdict) == "uncertain").alias("answer_uncertain_count")]


def reviewed_summary(metrics: DataFrame, keys: tuple[str, ...] = ("category", "difficulty", "scenario_family")) -> DataFrame:
    """tri-state summary, overall and by key, with long-horizon and recovery rates (null while any is pending)."""
    def rate(where: Column) -> Column:
        pending = F.count_if(where & F.col("task_success").isNull())
        return F.when(pending == 0, F.count_if(where & F.col("task_success")) / F.nullif(F.count_if(where), F.lit(0)))

    long, recovery = F.coalesce(F.col("category") == "long_horizon", F.lit(False)), F.coalesce(F.col("requires_recovery"), F.lit(False))
    more = [
        (F.count_if(F.col("execution_success")) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("task_execution_success_rate"),
        F.avg("structured_argument_accuracy").alias("structured_argument_accuracy"), rate(long).alias("long_horizon_success_rate"), rate(recovery).alias("recovery_success_rate"),
    ]
    return grouped(metrics, list(keys), [*task_bounds("task_success", "answer_review"), *more])


def reviewed_category_macro(metrics: DataFrame) -> DataFrame:
    """the mean of the categories' rates, only if no case is pending; long-horizon and recovery are never averaged."""
    per = metrics.groupBy(group_key("category").alias("key")).agg(F.count_if(F.col("task_success").isNull()).alias("pending"), F.avg(number("task_success")).alias("rate"))
    none = F.lit(None).cast("double")
    return per.agg(F.when(F.sum("pending") == 0, F.avg("rate")).alias("task_success_rate"), none.alias("long_horizon_success_rate"), none.alias("recovery_success_rate"))


def histogram(df: DataFrame, keys: list[str], value: Column, name: str = "value") -> DataFrame:
    """How often each value occurs per key; an array counts by its items."""
    kind = df.select(value.alias("v")).schema["v"].dataType.typeName()
    return df.select(*keys, (F.explode(value) if kind == "array" else value).alias(name)).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))


def coverage(selected: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Completed of selected; what is missing or extra; 1.0 if nothing was selected."""
    both = selected.select(key).distinct().withColumn("s", F.lit(1)).join(completed.select(key).distinct().withColumn("c", F.lit(1)), key, "full_outer")
    n, done = F.count("s"), F.count_if(F.col("s").isNotNull() & F.col("c").isNotNull())
    return both.agg(n.alias("selected"), done.alias("completed"), (n - done).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"), F.coalesce(done / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("coverage"))


def mean_and_deviation(c: str) -> list[Column]:
    """count, mean and population deviation; null over nothing."""
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation")]
