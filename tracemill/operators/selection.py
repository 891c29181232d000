"""Selection and splits (E1, E4, E6-E8, E15-E17, F11, F12, F18, F19, G7-G10, G14, G15, H2-H5, I1-I6, N-group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """sha256 of the parts' texts, joined by a bar."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary"), 256)


def ranked(df: DataFrame, strata: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Place within the stratum, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*strata).orderBy(*order)))


def hash_ranked(df: DataFrame, strata: list[str], key: Column, name: str = "rank", size: str | None = None) -> DataFrame:
    """Place within the stratum by hash of the key, from 1 (and the stratum's size, if it gets a name).

    The first two hex digits of the hash cut each stratum into 256 ordered parts of about equal size. A task numbers one
    part; counts per part, which are summed up before anything is shuffled, give what stands before it.
    """
    rows = df.withColumn("_digest", digest(key)).withColumn("_part", F.substring("_digest", 1, 2))
    counts = rows.groupBy(*strata, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in strata), F.col("_part").alias("_own"), before.alias("_before"), F.sum("_rows").over(whole).alias("_size"))
    same = F.col("_part") == F.col("_own")
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy(*strata, "_part").orderBy("_digest", key.asc()))
    out = rows.withColumn("_place", place).join(counts, same).withColumn(name, (F.col("_before") + F.col("_place")).cast("int"))
    kept = [*df.columns, name] + ([size] if size else [])
    return (out.withColumnRenamed("_size", size) if size else out).select(*kept)


def hash_split(df: DataFrame, strata: list[str], key: Column, shares: list[tuple[str, float]]) -> DataFrame:
    """Rows of each stratum by hash rank, cut at cumulative shares; the last split takes the rest."""
    with_rank = hash_ranked(df, strata, key, size="_n")
    split, upto = F.lit(shares[-1][0]), 0.0
    cuts = []
    for name, share in shares[:-1]:
        upto += share
        cuts.append((name, F.floor(F.col("_n") * upto + 1e-9)))
    for name, cut in reversed(cuts):
        split = F.when(F.col("rank") <= cut, name).otherwise(split)
    return with_rank.withColumn("split", split).drop("_n")


def first_n(df: DataFrame, strata: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n of each stratum."""
    return ranked(df, strata, order).filter(F.col("rank") <= n)


def quota(df: DataFrame, category: str, group: str, key: Column, groups: int) -> DataFrame:
    """One row per group (least hash), then the first groups of each category, even places before odd ones."""
    best = first_n(df, [category, group], [digest(key), key.asc()], 1).drop("rank")
    picked = first_n(best, [category], [digest(F.col(group)), F.col(group).asc()], groups)
    place = F.row_number().over(Window.partitionBy(category).orderBy(F.col("rank") % 2 == 1, "rank"))
    return picked.withColumn("place", place)


def in_several(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that more than one split has."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).filter("splits > 1")


def repeated(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def seen_before(df: DataFrame, old: DataFrame, key: Column, old_key: Column) -> DataFrame:
    """Rows whose key the old corpus has too, by digest."""
    keys = old.select(digest(old_key).alias("_k")).distinct()
    return df.withColumn("_k", digest(key)).join(keys, "_k", "left_semi").drop("_k")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only (with multiplicity); none if both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def transitions(pairs: DataFrame, base: str, treatment: str) -> DataFrame:
    """counts of '0->1' and the like."""
    flag = lambda c: F.col(c).cast("int").cast("string")
    return pairs.groupBy(F.concat(flag(base), F.lit("->"), flag(treatment)).alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def paired_outcomes(base: str, treatment: str) -> list[Column]:
    """improved, regressed, both pass, both fail."""
    b, t = F.col(base), F.col(treatment)
    return [F.count_if(c).alias(n) for n, c in (("improved", ~b & t), ("regressed", b & ~t), ("both_pass", b & t), ("both_fail", ~b & ~t))]


def arm_pairs(df: DataFrame, context: str, arm: str, value: Column, arms: tuple[str, str]) -> DataFrame:
    """Contexts that have both arms, with the value of each."""
    one, two = (F.sum(F.when(F.col(arm) == a, value)) for a in arms)
    return df.groupBy(context).agg(one.alias("first_arm"), two.alias("second_arm")).filter("first_arm is not null and second_arm is not null")


def in_group_preferences(df: DataFrame, group: str, idx: str, success: Column) -> DataFrame:
    """The first success over the first failure of each group; groups without both abstain."""
    pairs = df.groupBy(group).agg(F.min(F.when(success, F.col(idx))).alias("chosen"), F.min(F.when(~success, F.col(idx))).alias("rejected"))
    return pairs.filter("chosen is not null and rejected is not null")


def cross_preferences(df: DataFrame, base: Column, candidate: Column) -> DataFrame:
    """Which of two policies wins; equal outcomes abstain."""
    return df.filter(base != candidate).withColumn("chosen", F.when(base, "base").otherwise("candidate")).withColumn("rejected", F.when(base, "candidate").otherwise("base"))


def advantages(df: DataFrame, group: str, reward: str) -> DataFrame:
    """(r - mean) / (population deviation + 1e-8) within the group; 0 if all are equal or the group has one row."""
    w = Window.partitionBy(group)
    mean, deviation = F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    return df.withColumns({"mean": mean, "deviation": deviation, "advantage": F.when(deviation == 0, 0.0).otherwise((F.col(reward) - mean) / (deviation + 1e-8))})


def rollout_groups(df: DataFrame, group: str, reward: str) -> DataFrame:
    """groups with mixed rewards and groups without variance."""
    per = df.groupBy(group).agg(F.stddev_pop(reward).alias("d"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("d") > 0).alias("mixed_groups"), F.count_if(F.col("d") == 0).alias("zero_variance_groups"), F.sum("n").alias("rollouts"))


def layout(rank: Column, n: int) -> Column:
    """Layouts in turn by rank."""
    return (rank - 1) % n


def wrong_order(df: DataFrame, ordinal: str, value: str, cycle: list[str]) -> DataFrame:
    """Rows whose value is not the one that the cycle has at their place."""
    return df.filter(F.col(value) != F.element_at(F.array(*map(F.lit, cycle)), (F.col(ordinal) % len(cycle)).cast("int") + 1))


def stale(reviews: DataFrame, records: DataFrame, key: str, digest_col: str) -> DataFrame:
    """Reviews whose record is unknown or has another digest."""
    known = records.select(key, F.col(digest_col).alias("_now"))
    return reviews.join(known, key, "left").withColumn("reason", F.when(F.col("_now").isNull(), "unknown").when(F.col("_now") != F.col(digest_col), "stale")).filter("reason is not null").drop("_now")
