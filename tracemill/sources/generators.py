"""Generated sources (A13, E21, I6, K5): cartesian products with derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def product(spark: SparkSession, dimensions: dict[str, list]) -> DataFrame:
    """Every combination of a few small dimensions, from one range by division (no join)."""
    total = 1
    for values in dimensions.values():
        total *= len(values)
    out, rest = spark.range(total), F.col("id")
    for name, values in reversed(dimensions.items()):
        out = out.withColumn(name, F.element_at(F.array(*map(F.lit, values)), (rest % len(values)).cast("int") + 1))
        rest = F.floor(rest / len(values))
    return out.drop("id").select(*dimensions)


def transaction_outcome(concurrent: Column, transient: Column, timeout: Column, delay: Column, passes: Column, *, writable: Column | None = None, revoked: Column | None = None, revision: Column | int = 1) -> dict[str, Column]:
    """K5: what the transaction teacher does and reports, in closed form."""
    start = F.lit(revision) if isinstance(revision, int) else revision
    writable, revoked = writable if writable is not None else F.lit(True), revoked if revoked is not None else F.lit(False)
    blocked = ~writable | revoked
    by = lambda no, lost, full: F.when(~writable, no).when(revoked, lost).otherwise(full)
    return {
        "calls": by(2, 5, 4 * (concurrent + transient) + timeout + delay + (1 - passes) + 7).cast("bigint"),
        "tool_errors": by(0, 1, concurrent + transient + timeout).cast("bigint"),
        "check_failures": F.when(blocked, 0).otherwise(1 - passes).cast("bigint"),
        "outcome": F.when(blocked, "blocked").when(passes == 1, "applied").otherwise("rolled_back"),
        "revision": F.when(blocked, start).otherwise(start + concurrent + 1 + (1 - passes)).cast("bigint"),
    }


def transaction_grid(spark: SparkSession) -> DataFrame:
    flags = [0, 1]
    grid = product(spark, {"concurrent": flags, "transient": [0, 1, 2, 3], "timeout": flags, "delay": [0, 1, 2], "passes": flags})
    return grid.withColumns(transaction_outcome(*(F.col(c) for c in ("concurrent", "transient", "timeout", "delay", "passes"))))


def variants(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Each row once per variant."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


# fixed values: the seed and the splits of the transaction study, and configurations in its order
SEED = 20260917
CONFIGS = [f'{{"cache_enabled":{c},"quality":"{q}"}}' for q in ("low", "standard", "high") for c in ("false", "true")]


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def transaction_profiles(spark: SparkSession) -> DataFrame:
    """The fault profiles, each a group, split by hash rank; timeout with a concurrent change is out of distribution."""
    flags = ["false", "true"]
    grid = product(spark, {"transient": [0, 1, 2], "timeout": flags, "concurrent": flags, "passes": flags, "delay": [0, 1, 2, 3]})
    text = F.format_string('{"check_delay":%d,"check_passes":%s,"concurrent":%s,"timeout_after_commit":%s,"transient_commits":%d}', "delay", "passes", "concurrent", "timeout", "transient")
    grid = grid.withColumn("group_id", F.substring(_sha(text), 1, 16)).withColumn("ood", (F.col("timeout") == "true") & (F.col("concurrent") == "true"))
    place = F.row_number().over(Window.partitionBy("ood", "passes").orderBy(_sha(F.concat(F.lit(f'[{SEED},"'), F.col("group_id"), F.lit('"]')))))
    split = F.when(F.col("ood"), "confirmation_ood").when(place <= 24, "train").when(place <= 32, "dev").otherwise("confirmation_id")
    usual = grid.withColumn("split", split).withColumn("permission", F.lit(None).cast("string")).drop("ood")
    kinds = spark.createDataFrame([("initial_readonly", "train"), ("revoke_before_commit", "confirmation_ood")], "permission string, split string")
    special = kinds.withColumns({"transient": F.lit(0), "timeout": F.lit("false"), "concurrent": F.lit("false"), "passes": F.lit("true"), "delay": F.lit(1), "group_id": F.substring(_sha(F.concat(F.lit('"'), "permission", F.lit('"'))), 1, 16)})
    return usual.unionByName(special.select(usual.columns))


def transaction_cases(spark: SparkSession) -> DataFrame:
    """The study's cases: of each profile the first 42 (train) or 16 variants of start, goal and revision by hash."""
    pairs = product(spark, {"initial": CONFIGS, "desired": CONFIGS, "revision": [7, 19]}).filter("initial <> desired")
    # a small literal table against a small literal table: 98 profiles by 60 variants
    both = transaction_profiles(spark).crossJoin(F.broadcast(pairs))
    key = F.format_string('[%d,"%s",[%s,%s,%d]]', F.lit(SEED), "group_id", "initial", "desired", "revision")
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("group_id").orderBy(_sha(key))) - 1).filter("n < CASE WHEN split = 'train' THEN 42 ELSE 16 END")
    other = F.element_at(F.filter(F.array(*map(F.lit, CONFIGS)), lambda c: (c != F.col("initial")) & (c != F.col("desired"))), 1)
    scenario = F.format_string('{"initial_config":%s,"revision":%d%s}', "initial", "revision", F.when(F.col("permission") == "initial_readonly", ',"writable":false').when(F.col("permission").isNotNull(), ',"revoke_before_commit":true').otherwise(
        F.concat(F.format_string(',"transient_commits":%d,"timeout_after_commit":%s,"check_passes":%s,"check_delay":%d', "transient", "timeout", "passes", "delay"), F.when(F.col("concurrent") == "true", F.concat(F.lit(',"concurrent_config":'), other)).otherwise(""))))
    category = F.when(F.col("permission").isNotNull(), "permission").when(F.col("passes") == "true", "apply").otherwise("rollback")
    return ranked.withColumns({"case_id": F.format_string("txn1_%s_%02d", "group_id", "n"), "scenario": scenario, "category": category})
